"""Streaming queries. Each runs its stream to completion
(``availableNow``) into the shared checkpoint folder and returns the batch
view of the result, so the oracle compares it with the batch semantics."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import functions as F

from vigil.config import Thresholds, replay_params
from vigil.operators.detect import rule_http_error_rate
from vigil.operators.windows import epoch_seconds, sql_passes, sql_window_join
from vigil.plans.q_detect import SQL_SESSIONS_OPEN, live_and_closed
from vigil.plans.registry import register
from vigil.session import ensure_checkpoint_dir, stored
from vigil.sources import testdata as T
from vigil.streaming import detection as S
from vigil.streaming import incidents as SI

P = replay_params()
R6 = 6


def _name(base: str, sf: str, run: str) -> str:
    """One folder per run: these queries run their stream to completion now,
    so a fresh checkpoint is the right semantics (long-running jobs keep a
    stable name and resume from it)."""
    return f"{base}-{hashlib.sha1(os.path.abspath(sf).encode()).hexdigest()[:10]}-{run}"


def _run() -> str:
    return uuid.uuid4().hex[:12]


# The 30 days arrive in three parts; the rows of one half (odd ids) of days 10 and 20 come a part later.
PARTS = 3


def _part(ts, half) -> F.Column:
    """Number of the part in which a row arrives."""
    return F.floor((2 * (F.dayofmonth(ts) - 1) + F.when(half, 1).otherwise(0) + 1) / 20).cast("int")


SQL_PART = "CAST(floor((2 * (day({ts}) - 1) + CASE WHEN {half} THEN 1 ELSE 0 END + 1) / 20) AS INTEGER)"


FILES = 8  # of a part


def _arrivals(df, part, base: str, parts: int = PARTS + 1):
    """Write ``df`` to a folder part by part, in several files each, and give the folder as a stream after each part.

    A query run on each of them with one checkpoint resumes where it stopped and takes the new part as a micro-batch.
    """
    tagged = stored(df.withColumn("__part", part), "arrivals")
    for k in range(parts):
        tagged.filter(F.col("__part") == k).drop("__part").repartition(FILES).write.parquet(os.path.join(base, f"part{k}"))
        yield df.sparkSession.readStream.schema(df.schema).parquet(os.path.join(base, "part*"))


def _folder(spark, base: str, sf: str, run: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", _name(base, sf, run))


def _requests(spark, sf, services: int = T.DEFAULT_SERVICES):
    r = T.requests(spark, sf, services).select("event_id", "ts", "namespace", "service", "status_class")
    return r.withColumn("ts", F.col("ts").cast("timestamp"))


def _request_arrivals(spark, sf, run):
    return _arrivals(_requests(spark, sf), _part(F.col("ts"), F.col("event_id") % 2 == 1), _folder(spark, "requests", sf, run))


def stream_rates(spark, sf):
    """All parts through the bucket stream, whose table is updated part by part; the passes from that table."""
    run = _run()
    name = _name("error-rate", sf, run)
    for src in _request_arrivals(spark, sf, run):
        S.run_table(S.error_buckets(src, P, watermark="2 days"), name, ["namespace", "service", "bucket"], at="bucket")
    return S.error_rates(S.read_table(spark, name), P)


SQL_RATE = T.sql_requests() + f""",
rw AS (SELECT namespace, service, status_class, {sql_passes('ts', P)} FROM requests, {sql_window_join(P)}),
rates AS (SELECT namespace, service, window_start, pass_ts, CAST(count(*) AS DOUBLE) AS total,
  CAST(count(*) FILTER (WHERE status_class = '5xx') AS DOUBLE) AS errors FROM rw GROUP BY ALL)"""


@register(
    "stream_sliding_detection",
    sql="WITH " + SQL_RATE + f"\nSELECT namespace, service, window_start, pass_ts, total, errors, round(errors / total, {R6}) AS ratio FROM rates",
)
def q_stream_sliding_detection(spark, sf):
    r = stream_rates(spark, sf)
    return r.select("namespace", "service", "window_start", "pass_ts", "total", "errors", F.round("ratio", R6).alias("ratio"))


@register(
    "stream_incident_state",
    sql="WITH " + SQL_RATE + f""",
c AS (SELECT namespace, pass_ts, left(sha256('http_error_rate|' || namespace || '|' || service), 20) AS fingerprint,
  CASE WHEN errors / total >= 0.5 THEN 3 WHEN errors / total >= 0.25 THEN 2 ELSE 1 END AS severity_rank
  FROM rates WHERE total >= {P.thresholds.min_request_sample} AND errors / total >= {P.thresholds.http_error_rate}),
g AS (SELECT *, epoch(pass_ts) - epoch(lag(pass_ts) OVER (PARTITION BY fingerprint ORDER BY pass_ts)) AS gap FROM c),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {P.cooldown_seconds} THEN 1 ELSE 0 END)
  OVER (PARTITION BY fingerprint ORDER BY pass_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sn FROM g)
SELECT fingerprint, count(*) AS detection_count, min(pass_ts) AS first_detected_at, max(pass_ts) AS last_detected_at,
  max(severity_rank) AS severity_rank FROM s GROUP BY fingerprint, sn""",
)
def q_stream_incident_state(spark, sf):
    """Requests make final passes (one stream), passes make events, events change the state of incidents (another stream)."""
    run = _run()
    rates, name = _name("final-rates", sf, run), _name("incidents", sf, run)
    r = _requests(spark, sf)
    # a detector that finds nothing goes on, so the last passes become final too
    end = r.agg(F.timestamp_seconds(epoch_seconds(F.max("ts")) + 2 * 86400 + P.window_seconds + 2 * P.slide_seconds).alias("ts"))
    r = r.unionByName(end, allowMissingColumns=True)
    part = F.when(F.col("service").isNull(), PARTS + 1).otherwise(_part(F.col("ts"), F.col("event_id") % 2 == 1))
    for src in _arrivals(r, part, _folder(spark, "requests", sf, run), PARTS + 2):
        path = S.run_rates(src, rates, P, watermark="2 days")
        SI.run_incidents(S.rate_events(spark, path, P), name, P)
    return SI.incident_table(spark, name).drop("closed_at")


@register("stream_incident_open", sql=SQL_SESSIONS_OPEN)
def q_stream_incident_open(spark, sf):
    """The state log closes incidents, and passes stop for longer than the cooldown: as the batch replay of the same candidates."""
    run = _run()
    name = _name("incidents-open", sf, run)
    live, closed = live_and_closed(spark, sf)
    events = live.select("fingerprint", F.col("detected_at").cast("timestamp").alias("at"), "severity_rank", F.lit(False).alias("closes")).unionByName(
        closed.select("fingerprint", F.col("closed_at").cast("timestamp").alias("at"), F.lit(None).cast("int").alias("severity_rank"),
                      F.lit(True).alias("closes")))
    part = F.least(F.lit(PARTS - 1), F.floor((F.dayofyear("at") - 1) / 11).cast("int"))
    for src in _arrivals(events, part, _folder(spark, "incident-events", sf, run), PARTS):
        SI.run_incidents(src, name, P, by_log=True)
    return SI.incident_table(spark, name).drop("closed_at")


LATE = "ts < TIMESTAMP '2024-01-15 00:00:00' AND event_id % 50 = 0"  # these rows come with the last part
DELAY = 2 * 86400


@register(
    "stream_late_rows",
    sql="WITH " + T.sql_requests() + f""",
fed AS (SELECT event_id, ts, CASE WHEN {LATE} THEN {PARTS} ELSE {SQL_PART.format(ts='ts', half='event_id % 2 = 1')} END AS part FROM requests),
mx AS (SELECT part, max(ts) AS newest FROM fed GROUP BY part),
wm AS (SELECT part, max(newest) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM mx)
SELECT event_id, ts FROM fed JOIN wm USING (part)
WHERE floor(epoch(ts) / {P.slide_seconds}) * {P.slide_seconds} + {P.slide_seconds} <= floor(epoch(before)) - {DELAY}""",
)
def q_stream_late_rows(spark, sf):
    """Rows that came behind the watermark, as a table."""
    run = _run()
    name = _name("raw", sf, run)
    for src in _late_arrivals(spark, sf, run):
        S.run_upserts(src, name, mode="append")
    return S.late_rows(S.read_step(spark, name), P, DELAY).select("event_id", "ts")


def _late_arrivals(spark, sf, run):
    part = F.when(F.expr(LATE), PARTS).otherwise(_part(F.col("ts"), F.col("event_id") % 2 == 1))
    return _arrivals(_requests(spark, sf), part, _folder(spark, "late", sf, run))


@register(
    "stream_late_correction",
    sql="WITH " + SQL_RATE + f""",
fed AS (SELECT namespace, ts, CASE WHEN {LATE} THEN {PARTS} ELSE {SQL_PART.format(ts='ts', half='event_id % 2 = 1')} END AS part FROM requests),
mx AS (SELECT part, max(ts) AS newest FROM fed GROUP BY part),
wm AS (SELECT part, max(newest) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM mx),
lt AS (SELECT namespace, ts FROM fed JOIN wm USING (part)
  WHERE floor(epoch(ts) / {P.slide_seconds}) * {P.slide_seconds} + {P.slide_seconds} <= floor(epoch(before)) - {DELAY}),
tp AS (SELECT DISTINCT namespace, pass_ts FROM (SELECT namespace, {sql_passes('ts', P)} FROM lt, {sql_window_join(P)}))
SELECT namespace, service, window_start, pass_ts, total, errors, round(errors / total, {R6}) AS ratio,
  (namespace, pass_ts) IN (SELECT (namespace, pass_ts) FROM tp) AS corrected FROM rates""",
)
def q_stream_late_correction(spark, sf):
    """The stream drops rows behind its watermark; the passes they touch are replayed, and all passes are as if no row had been late."""
    run = _run()
    buckets, raw = _name("late-buckets", sf, run), _name("late-raw", sf, run)
    for src in _late_arrivals(spark, sf, run):
        S.run_table(S.error_buckets(src, P, watermark=f"{DELAY} seconds"), buckets, ["namespace", "service", "bucket"], at="bucket")
        S.run_upserts(src, raw, mode="append")
    rows = S.read_step(spark, raw)
    late = S.late_rows(rows, P, DELAY)
    fixed = S.corrected_rates(S.error_rates(S.read_table(spark, buckets), P), rows, late, P)
    return fixed.withColumn("ratio", F.round("ratio", R6))


@register(
    "stream_restart_state",
    sql="WITH " + T.sql_pod_snapshots() + """,
pp AS (SELECT DISTINCT namespace, snapshot_ts AS pass_ts FROM pods),
ps AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY pass_ts) AS pass_seq FROM pp),
pj AS (SELECT p.*, ps.pass_ts, ps.pass_seq FROM pods p JOIN ps ON p.namespace = ps.namespace AND p.snapshot_ts = ps.pass_ts),
pdl AS (SELECT *, CASE WHEN lag(pass_seq) OVER w = pass_seq - 1 THEN lag(restart_count) OVER w ELSE restart_count END AS prev_rc
  FROM pj WINDOW w AS (PARTITION BY namespace, pod ORDER BY pass_seq))
SELECT namespace, pod, pass_ts, restart_count, prev_rc AS previous_restart_count, greatest(0, restart_count - prev_rc) AS restart_increase FROM pdl""",
)
def q_stream_restart_state(spark, sf):
    """Pod snapshots in parts that split two passes, with per-pod state."""
    run = _run()
    pods = T.pod_snapshots(spark, sf).select("snapshot_ts", "namespace", "pod", "restart_count")
    odd = F.substring("pod", -1, 1).isin("1", "3", "5", "7", "9")
    name = _name("restart-state", sf, run)
    for src in _arrivals(pods.withColumn("snapshot_ts", F.col("snapshot_ts").cast("timestamp")),
                         _part(F.col("snapshot_ts") - F.expr("INTERVAL 1 DAY"), odd), _folder(spark, "pod-snapshots", sf, run)):
        S.run_upserts(S.restart_state(src), name, mode="append")
    return S.restart_increase(S.read_step(spark, name))


@register(
    "stream_evidence_dedup",
    sql="SELECT DISTINCT 'ev-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || strftime(l_shipdate, '%Y%m%d') AS evidence_id FROM lineitem",
)
def q_stream_evidence_dedup(spark, sf):
    """Evidence in four parts by time; each part also brings the last 30 days
    of the part before again. The watermark (60 days) bounds what is remembered."""
    li = T.read(spark, sf, "lineitem")
    ev = li.select(
        F.concat(F.lit("ev-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"),
                 F.lit("-"), F.date_format("l_shipdate", "yyyyMMdd")).alias("evidence_id"),
        F.col("l_shipdate").cast("timestamp").alias("observed_at"),
    )
    cuts = ["1994-01-01", "1996-01-01", "1998-01-01"]
    part = sum((F.col("observed_at") >= F.lit(c).cast("timestamp")).cast("int") for c in cuts)
    first = ev.withColumn("__k", part)
    again = first.filter(sum(((F.col("observed_at") < F.lit(c).cast("timestamp")) & (F.col("observed_at") >= F.lit(c).cast("timestamp") - F.expr("INTERVAL 30 DAYS"))).cast("int")
                             for c in cuts) > 0).withColumn("__k", F.col("__k") + 1)
    run = _run()
    name = _name("evidence-dedup", sf, run)
    for src in _arrivals(first.unionByName(again), F.col("__k"), _folder(spark, "evidence", sf, run), len(cuts) + 1):
        S.run_upserts(S.dedup_evidence_stream(src, watermark="60 days"), name, mode="append")
    return S.read_step(spark, name).select("evidence_id")


# Recovery needs gaps between detections: this query alerts at the High level.
P_HIGH = replay_params(thresholds=Thresholds(http_error_rate=0.25))


@register(
    "stream_recovery_timer",
    sql="WITH " + SQL_RATE + f""",
c AS (SELECT pass_ts, left(sha256('http_error_rate|' || namespace || '|' || service), 20) AS fingerprint FROM rates
  WHERE total >= {P_HIGH.thresholds.min_request_sample} AND errors / total >= {P_HIGH.thresholds.http_error_rate}),
wm AS (SELECT max(pass_ts) AS wm FROM c),
g AS (SELECT *, epoch(pass_ts) - epoch(lag(pass_ts) OVER (PARTITION BY fingerprint ORDER BY pass_ts)) AS gap FROM c),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {P.cooldown_seconds} THEN 1 ELSE 0 END)
  OVER (PARTITION BY fingerprint ORDER BY pass_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sn FROM g),
r AS (SELECT *, lead(pass_ts) OVER (PARTITION BY fingerprint, sn ORDER BY pass_ts) AS nxt,
  make_timestamp(((CAST(floor((epoch(pass_ts) + {P.recovery_seconds}) / {P.slide_seconds}) AS BIGINT) + 1) * {P.slide_seconds}) * 1000000) AS rp FROM s),
x AS (SELECT fingerprint, sn, min(pass_ts) AS first_detected_at,
  min(rp) FILTER (WHERE (nxt IS NOT NULL AND rp < nxt) OR (nxt IS NULL AND rp < (SELECT wm FROM wm))) AS recovered_at,
  count(*) FILTER (WHERE pass_ts <= coalesce((SELECT min(r2.rp) FROM r r2 WHERE r2.fingerprint = r.fingerprint AND r2.sn = r.sn
    AND ((r2.nxt IS NOT NULL AND r2.rp < r2.nxt) OR (r2.nxt IS NULL AND r2.rp < (SELECT wm FROM wm)))), pass_ts)) AS detection_count
  FROM r GROUP BY fingerprint, sn)
SELECT fingerprint, first_detected_at, recovered_at, detection_count FROM x WHERE recovered_at IS NOT NULL""",
)
def q_stream_recovery_timer(spark, sf):
    """T1 alerts written as a table, then a stateful stream with event-time
    timers emits each incident's recovery once."""
    run = _run()
    cands = rule_http_error_rate(S.error_rate_windows(_requests(spark, sf), P_HIGH), P_HIGH).select("fingerprint", "pass_ts")
    base = _folder(spark, "recovery-candidates", sf, run)
    cands.write.mode("overwrite").parquet(base)
    src = spark.readStream.schema("fingerprint string, pass_ts timestamp").parquet(base)
    name = _name("recovery-timer", sf, run)
    S.run_upserts(S.recovery_timers(src, P_HIGH), name, mode="append")
    return S.read_step(spark, name).select("fingerprint", "first_detected_at", "recovered_at", "detection_count")
