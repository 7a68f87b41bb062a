"""Detection replay: every pass over the history in one job.

samples -> increase -> rules (D1..D6) -> union -> suppression -> sessions ->
incidents. Exchanges sit at (series), (namespace, service, pass),
(namespace, pass, hash), (namespace, pass) and (fingerprint).
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.config import Params, replay_params
from vigil.operators import detect as D
from vigil.operators import incidents as I
from vigil.operators import logs as L
from vigil.operators import metrics as M
from vigil.operators.windows import epoch_seconds
from vigil.sources import testdata as T

SERIES = ["namespace", "service", "status_class"]

log = logging.getLogger(__name__)

def flagship_params() -> Params:
    day = 86400
    return replay_params(window_seconds=7 * day, slide_seconds=day, recovery_seconds=7 * day, cooldown_seconds=8 * day,
                       max_range_minutes=7 * 24 * 60)


def build_snapshot(spark: SparkSession, sf: str, params: Params, services: int = T.DEFAULT_SERVICES) -> D.Snapshot:
    """Inputs from the driver's tables, all of which are there: one that fails is an error."""
    return snapshot_from(test_data_telemetry(spark, sf, services), params, whole=True)


@dataclass
class Telemetry:
    """Input tables of a replay; any may be None when the source is absent.

    counters   namespace, service, status_class, ts, value [, event_id]
    requests   namespace, service, ts, duration_s
    dep_calls  namespace, service, dependency, kind, outcome, ts, duration_s
    latency_buckets   namespace, service, le, ts, value, event_id: cumulative
               bucket counters; taken instead of ``requests`` where given
    failure_counters  namespace, service, dependency, kind, ts, value,
               event_id: taken instead of ``dep_calls`` where given
    pods       snapshot_ts, namespace, pod, workload, restart_count, ready,
               waiting_reason, last_termination_reason
    logs       ts, namespace, container, level, pod, line
    """

    counters: DataFrame | None = None
    requests: DataFrame | None = None
    dep_calls: DataFrame | None = None
    pods: DataFrame | None = None
    logs: DataFrame | None = None
    latency_buckets: DataFrame | None = None
    failure_counters: DataFrame | None = None


def snapshot_from(t: Telemetry, params: Params, whole: bool = False) -> D.Snapshot:
    """Per-pass rule inputs for every pass at once (lazy, but for the counts of signatures). Lines that cannot be read
    leave the signatures out, with ``whole`` they are an error."""
    either = {"requests": t.latency_buckets, "dep_calls": t.failure_counters}
    missing = tuple(n for n in ("counters", "requests", "dep_calls", "pods", "logs") if getattr(t, n) is None and either.get(n) is None)
    p95 = fails = None
    if t.latency_buckets is not None:
        p95 = M.latency_p95_from_buckets(t.latency_buckets, params)
    elif t.requests is not None:
        p95 = M.latency_p95(t.requests, params)
    if t.failure_counters is not None:
        fails = M.dependency_failures_from_counters(t.failure_counters, params)
    elif t.dep_calls is not None:
        fails = M.dependency_failures(t.dep_calls, params)
    er = None
    if t.counters is not None:
        tiebreak = "event_id" if "event_id" in t.counters.columns else None
        er = M.http_error_rate(M.increase(t.counters, SERIES, params, tiebreak=tiebreak))
    signatures = None
    if t.logs is not None:
        try:
            signatures = L.error_signatures(t.logs, params)  # counts them now, so the lines may turn out to be unreadable
        except Exception as error:  # noqa: BLE001 - a failing source must not cost the others
            if whole:
                raise
            log.warning("loki was unavailable: %s", error)
            missing += ("loki",)
    return D.Snapshot(
        error_rate=er,
        latency_p95=p95,
        dependency_failures=fails,
        pods=D.restart_delta(t.pods) if t.pods is not None else None,
        signatures=signatures,
        unavailable_sources=missing,
    )


def replay(t: Telemetry, params: Params, replay_end_ts=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every detection pass over the given history: (candidates, suppressed
    candidates in queue order, incidents). A rule that fails to plan is left
    out and logged; the others run. ``replay_end_ts`` is the last pass instant
    (default: the last pass whose window holds the newest row of any source)."""
    cands, failed = D.detect_all(snapshot_from(t, params), params)
    if failed:
        log.warning("rules left out of the replay: %s", ", ".join(failed))
    if cands is None:
        raise ValueError("no rule has its input tables")
    sup = D.suppress(cands)
    if replay_end_ts is None:
        end = newest_pass(t, params)
    else:
        end = sup.sparkSession.createDataFrame([(replay_end_ts,)], "replay_end timestamp")
    return cands, sup, I.incidents(I.with_replay_end(sup, end), params)


def newest_pass(t: Telemetry, params: Params) -> DataFrame:
    """One row: the last pass instant whose window still holds a row of any source."""
    parts = [x.agg(F.max(F.col("ts").cast("timestamp")).alias("ts")) for x in (
        t.counters, t.requests, t.dep_calls, t.logs, t.latency_buckets, t.failure_counters) if x is not None]
    if t.pods is not None:
        parts.append(t.pods.agg(F.max(F.col("snapshot_ts").cast("timestamp")).alias("ts")))
    newest = parts[0]
    for p in parts[1:]:
        newest = newest.union(p)
    last = F.floor(epoch_seconds(F.max("ts")) / params.slide_seconds) * params.slide_seconds + params.window_seconds
    return newest.agg(F.timestamp_seconds(last).alias("replay_end"))


def test_data_telemetry(spark: SparkSession, sf: str, services: int = T.DEFAULT_SERVICES) -> Telemetry:
    return Telemetry(counters=T.counter_samples(spark, sf, services), requests=T.requests(spark, sf, services),
                     dep_calls=T.dep_calls(spark, sf, services), pods=T.pod_snapshots(spark, sf, services),
                     logs=T.logs(spark, sf, services))


def replay_end(spark: SparkSession, sf: str, params: Params) -> DataFrame:
    """One row: the last pass instant whose window still holds data."""
    e = T.read(spark, sf, "events")
    last = F.floor(epoch_seconds(F.max("ts")) / params.slide_seconds) * params.slide_seconds + params.window_seconds
    return e.agg(F.timestamp_seconds(last).alias("replay_end"))


def candidates(spark, sf, params: Params, services: int = T.DEFAULT_SERVICES) -> DataFrame:
    """Candidates of every rule; one that fails to plan is an error, as the result could not name it."""
    cands, failed = D.detect_all(build_snapshot(spark, sf, params, services), params)
    if failed:
        raise RuntimeError(f"rules that failed to plan: {', '.join(failed)}")
    return cands


def suppressed(spark, sf, params: Params, services: int = T.DEFAULT_SERVICES) -> DataFrame:
    return D.suppress(candidates(spark, sf, params, services))


def incidents(spark, sf, params: Params, services: int = T.DEFAULT_SERVICES) -> DataFrame:
    return I.incidents(I.with_replay_end(suppressed(spark, sf, params, services), replay_end(spark, sf, params)), params)


def pass_summary(spark, sf, params: Params, services: int = T.DEFAULT_SERVICES) -> DataFrame:
    """Per (namespace, pass): candidates before/after suppression, incidents
    created (first detection) and de-duplicated (joined an existing one)."""
    raw = candidates(spark, sf, params, services)
    before = raw.groupBy("namespace", "pass_ts").agg(F.count(F.lit(1)).alias("candidates"))
    sup = D.suppress(raw)
    ses = I.sessions(sup, params)
    from pyspark.sql import Window

    w = Window.partitionBy("fingerprint", "session_no").orderBy("detected_at", "queue_rank")
    ses = ses.withColumn("__first", F.row_number().over(w) == 1)
    after = ses.groupBy("namespace", "pass_ts").agg(
        F.count(F.lit(1)).alias("kept"),
        F.sum(F.col("__first").cast("int")).alias("created"),
        F.sum((~F.col("__first")).cast("int")).alias("deduplicated"),
    )
    return before.join(after, ["namespace", "pass_ts"], "left").select(
        "namespace", "pass_ts", "candidates",
        F.coalesce("kept", F.lit(0)).alias("kept"),
        (F.col("candidates") - F.coalesce("kept", F.lit(0))).alias("suppressed"),
        F.coalesce("created", F.lit(0)).cast("bigint").alias("created"),
        F.coalesce("deduplicated", F.lit(0)).cast("bigint").alias("deduplicated"),
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Replay on a small table: 7-day windows every day over 4 services."""
    return incidents(spark, sf, flagship_params(), services=4)
