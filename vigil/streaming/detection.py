"""Continuous detection with Structured Streaming.

T1 error-rate passes: the stream keeps slide-sized buckets (one state row per
   bucket, not one per window it falls in); passes are sums of buckets,
T2 restart counts per pod (``applyInPandasWithState`` keyed by namespace and
   pod, so a namespace is no hot key and a pass may arrive in parts),
T3 incidents: one state row per fingerprint (``vigil.streaming.incidents``),
T4 recovery by event-time timers,
T5 idempotent evidence (``dropDuplicatesWithinWatermark``),
T6 late rows as an output, and as a correction of the passes they touch,
T7 offsets and state: the checkpoint under ``spark.checkpoint.dir``,
T8 order in a pass: detections are recorded, then recoveries confirmed.

Sinks write under the shared checkpoint folder: every micro-batch in a
directory of its own (batch id as a column), or into a stored table of which
only the dates concerned are rewritten (``run_table``). Nothing passes through the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil.config import Params
from vigil.functions import ids
from vigil.operators.detect import HTTP_ERROR_RATE, rule_http_error_rate
from vigil.operators.windows import epoch_seconds, expand_to_passes, slide_bucket
from vigil.session import ensure_checkpoint_dir
from vigil.sources import store


def stream_table(spark: SparkSession, path: str, schema, ts: str = "ts", max_files: int | None = None) -> DataFrame:
    """Parquet folder as a stream; event time cast to TIMESTAMP (watermarks
    reject TIMESTAMP_NTZ)."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def error_buckets(requests: DataFrame, params: Params, watermark: str = "10 minutes") -> DataFrame:
    """Per (namespace, service, slide bucket): requests and 5xx. Stream or batch."""
    w = F.window("ts", f"{params.slide_seconds} seconds")
    src = requests.withWatermark("ts", watermark) if requests.isStreaming else requests
    agg = src.groupBy(w.alias("w"), "namespace", "service").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("status_class") == "5xx", 1).otherwise(0)).alias("errors"),
    )
    return agg.select("namespace", "service", F.col("w.start").alias("bucket"), "total", "errors")


def error_rates(buckets: DataFrame, params: Params) -> DataFrame:
    """Per (namespace, service, pass): requests and 5xx in the window, ratio; only windows with traffic exist."""
    agg = expand_to_passes(buckets.select("namespace", "service", "bucket", "total", "errors"), "bucket", params).groupBy(
        "namespace", "service", "window_start", "pass_ts").agg(
        F.sum("total").cast("double").alias("total"), F.sum("errors").cast("double").alias("errors"))
    return agg.withColumn("ratio", F.col("errors") / F.col("total"))


def error_rate_windows(requests: DataFrame, params: Params) -> DataFrame:
    """The passes of a batch of requests."""
    return error_rates(error_buckets(requests, params), params)


def final_rates(requests: DataFrame, params: Params, watermark: str = "10 minutes") -> DataFrame:
    """The passes of a stream, each once: when the watermark has passed its end, so no row of it can come any more.

    Rows go into slide buckets first, and only final buckets into the windows that hold them.
    """
    src = requests.withWatermark("ts", watermark)
    buckets = src.groupBy(F.window("ts", f"{params.slide_seconds} seconds").alias("b"), "namespace", "service").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("status_class") == "5xx", 1).otherwise(0)).alias("errors"))
    pass_window = F.window(F.window_time("b"), f"{params.window_seconds} seconds", f"{params.slide_seconds} seconds")
    passes = buckets.groupBy(pass_window.alias("w"), "namespace", "service").agg(
        F.sum("total").cast("double").alias("total"), F.sum("errors").cast("double").alias("errors"))
    # a row without a service only moves the watermark on; the filter names the window, so that it is not applied before that
    return passes.filter(F.when(F.col("w.end").isNotNull(), F.col("service").isNotNull())).select(
        "namespace", "service", F.col("w.start").alias("window_start"), F.col("w.end").alias("pass_ts"), "total", "errors",
        (F.col("errors") / F.col("total")).alias("ratio"))


RATES = "namespace string, service string, window_start timestamp, pass_ts timestamp, total double, errors double, ratio double"


def run_rates(requests: DataFrame, name: str, params: Params, watermark: str = "10 minutes") -> str:
    """Write the final passes of a stream to its output folder (exactly once), which is returned for others to stream from."""
    base = _out_dir(requests.sparkSession, name)
    w = final_rates(requests, params, watermark).writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", os.path.join(base, "checkpoint"))
    w.trigger(availableNow=True).start(os.path.join(base, "rates")).awaitTermination()
    return os.path.join(base, "rates")


def rate_events(spark: SparkSession, rates_path: str, params: Params) -> DataFrame:
    """Rule D1 over a stream of final passes as events for ``incidents.run_incidents``; passes that do not alert are there too."""
    rates = spark.readStream.schema(RATES).parquet(rates_path)
    alerts = rule_http_error_rate(rates, params).select("fingerprint", F.col("pass_ts").alias("at"), "severity_rank", F.lit(False).alias("closes"))
    fp = ids.fingerprint(F.lit(HTTP_ERROR_RATE), F.col("namespace"), F.array("service"))
    return alerts.unionByName(rates.select(fp.alias("fingerprint"), F.col("pass_ts").alias("at"), F.lit(None).cast("int").alias("severity_rank"),
                                           F.lit(False).alias("closes")))


# --- T2: restart state ------------------------------------------------------------------

RESTART_OUT = "namespace string, pod string, pass_ts timestamp, restart_count int, last_ts timestamp, last_count int"
RESTART_STATE = "last_ms long, last_count int"


def _restart_state_fn(keep_ms: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the pod is long gone
            state.remove()
            return
        frames = [p for p in pdfs]
        rows = pd.concat(frames, ignore_index=True).sort_values("snapshot_ts")
        last = state.get if state.exists else None
        out = []
        for ts, n in zip(rows["snapshot_ts"], rows["restart_count"].astype(int)):
            known = last is not None and last[0] < int(pd.Timestamp(ts).value // 1_000_000)
            out.append((*key, ts, n, pd.Timestamp(last[0], unit="ms") if known else None, last[1] if known else None))
            if last is None or known:
                last = (int(pd.Timestamp(ts).value // 1_000_000), n)
        state.update(last)
        state.setTimeoutTimestamp(max(last[0], state.getCurrentWatermarkMs()) + keep_ms)
        frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in RESTART_OUT.split(", ")])
        frame["last_count"] = frame["last_count"].astype("Int32")
        yield frame

    return fn


def restart_state(pods: DataFrame, watermark: str = "1 day", keep_days: int = 7) -> DataFrame:
    """T2 on a stream of pod snapshots: each with the pod's snapshot before it.

    State is one row per (namespace, pod), dropped after ``keep_days`` without
    a snapshot. What the increase is also depends on the namespace's passes:
    see ``restart_increase``.
    """
    return pods.withWatermark("snapshot_ts", watermark).groupBy("namespace", "pod").applyInPandasWithState(
        _restart_state_fn(keep_days * 86_400_000), RESTART_OUT, RESTART_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def restart_increase(states: DataFrame) -> DataFrame:
    """The increase since the namespace's previous non-empty pass; a pod that was not in it counts from here."""
    w = Window.partitionBy("namespace").orderBy("pass_ts")
    passes = states.select("namespace", "pass_ts").distinct().withColumn("before", F.lag("pass_ts").over(w))
    j = states.join(passes, ["namespace", "pass_ts"])
    previous = F.when(F.col("last_ts") == F.col("before"), F.col("last_count")).otherwise(F.col("restart_count"))
    return j.withColumn("previous_restart_count", previous).select(
        "namespace", "pod", "pass_ts", "restart_count", "previous_restart_count",
        F.greatest(F.lit(0), F.col("restart_count") - F.col("previous_restart_count")).alias("restart_increase"))


# --- sinks -----------------------------------------------------------------------------------

def _out_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def run_upserts(df: DataFrame, name: str, mode: str = "update", trigger_available_now: bool = True,
                interval: str = "60 seconds", steps: list | None = None):
    """Run a streaming query. Every micro-batch goes through the ``steps`` (T8),
    pairs of a name and a function of (batch, batch id); each result is written
    to ``<checkpoint dir>/streams/<name>/<step>/batch_id=<n>`` before the next
    step starts. Offsets and state live in ``.../checkpoint`` (T7). A retried
    batch overwrites what it wrote, so it never duplicates output."""
    spark = df.sparkSession
    base = _out_dir(spark, name)
    steps = steps or [("data", lambda batch, _: batch)]

    def sink(batch: DataFrame, batch_id: int) -> None:
        for step, fn in steps:
            fn(batch, batch_id).write.mode("overwrite").parquet(os.path.join(base, step, f"batch_id={batch_id}"))

    w = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", os.path.join(base, "checkpoint"))
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime=interval)
    q = w.start()
    if trigger_available_now:
        q.awaitTermination()
    return q


def read_step(spark: SparkSession, name: str, step: str = "data") -> DataFrame:
    """Everything a step of a query has written, with its ``batch_id``."""
    return spark.read.parquet(os.path.join(_out_dir(spark, name), step))


def latest_view(spark: SparkSession, name: str, key: list[str], step: str = "data") -> DataFrame:
    """Newest version of every key written by a step."""
    d = read_step(spark, name, step)
    cols = [c for c in d.columns if c not in key + ["batch_id"]]
    agg = d.groupBy(*key).agg(F.max_by(F.struct(*cols), "batch_id").alias("__v"))
    return agg.select(*key, "__v.*")


def run_table(df: DataFrame, name: str, key: list[str], at: str):
    """Keep a table with the newest row of each key up to date with a stream in update mode; a micro-batch rewrites the
    dates (of ``at``, a part of the key) that its rows fall on."""
    spark = df.sparkSession
    path = os.path.join(_out_dir(spark, name), "table")

    def merge(rows: DataFrame) -> DataFrame:
        return store.newest(rows, key, ["batch_id"]).select(rows.columns)

    def sink(batch: DataFrame, batch_id: int) -> None:
        store.upsert(path, batch.withColumn("batch_id", F.lit(batch_id).cast("long")), store.date_bucket(at), merge, name=f"batch-{batch_id}")

    q = df.writeStream.outputMode("update").foreachBatch(sink).option(
        "checkpointLocation", os.path.join(_out_dir(spark, name), "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(_out_dir(spark, name), "table")).drop("batch_id", store.BUCKET)


def dedup_evidence_stream(evidence: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """T5: an evidence id is emitted once (within the watermark)."""
    return evidence.withWatermark("observed_at", watermark).dropDuplicatesWithinWatermark(["evidence_id"])


# --- T3 + T4: incident state with a recovery timer --------------------------------------

RECOVERY_OUT = "fingerprint string, first_detected_at timestamp, recovered_at timestamp, detection_count long"
RECOVERY_STATE = "first_ms long, last_ms long, n long, recovered_ms long"


def _recovery_fn(params: Params):
    cooldown = params.cooldown_seconds * 1000
    recovery = params.recovery_seconds * 1000
    slide = params.slide_seconds * 1000

    def rp(last_ms: int) -> int:
        # first pass instant strictly after last + recovery
        return ((last_ms + recovery) // slide + 1) * slide

    def emit(out, fp, st):
        first, last, n, rec = st
        out.append((fp, pd.Timestamp(first, unit="ms"), pd.Timestamp(rec, unit="ms"), n))

    def settle(fp, st, state: GroupState, out) -> None:
        """Apply whatever the watermark already passed, then arm the next timer."""
        wm = state.getCurrentWatermarkMs()
        if st[3] < 0 and rp(st[1]) < wm:
            st[3] = rp(st[1])
            emit(out, fp, st)
        if st[3] >= 0 and st[1] + cooldown < wm:
            state.remove()
            return
        state.update(tuple(st))
        state.setTimeoutTimestamp(max(wm, rp(st[1]) if st[3] < 0 else st[1] + cooldown))

    def fn(key, pdfs, state: GroupState):
        (fp,) = key
        out = []
        st = list(state.get) if state.exists else None
        if not state.hasTimedOut:
            rows = pd.concat(list(pdfs), ignore_index=True)
            times = sorted(int(pd.Timestamp(t).value // 1_000_000) for t in rows["pass_ts"])
            for t in times:
                if st is not None:
                    if st[3] < 0 and rp(st[1]) < t:
                        st[3] = rp(st[1])
                        emit(out, fp, st)
                    st = [st[0], t, st[2] + 1, st[3]] if t - st[1] <= cooldown else None
                if st is None:
                    st = [t, t, 1, -1]
        settle(fp, st, state, out)
        if out:
            yield pd.DataFrame(out, columns=["fingerprint", "first_detected_at", "recovered_at", "detection_count"])

    return fn


def recovery_timers(candidates: DataFrame, params: Params, watermark: str = "0 seconds") -> DataFrame:
    """T3/T4 on a candidate stream: sessions by cooldown per fingerprint and a
    recovery emitted by an event-time timer at the first pass instant after
    ``last + recovery`` (or when the next detection shows it already passed).
    A recovered incident still absorbs detections within the cooldown."""
    src = candidates.withWatermark("pass_ts", watermark)
    return src.groupBy("fingerprint").applyInPandasWithState(
        _recovery_fn(params), RECOVERY_OUT, RECOVERY_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def late_rows(raw: DataFrame, params: Params, delay_seconds: int, ts: str = "ts") -> DataFrame:
    """The rows that came too late for the buckets of ``error_buckets``.

    ``raw``: the stream's rows with the ``batch_id`` they came in (a query of
    its own, or ``run_upserts`` of the source). The watermark of a batch is the
    newest row of all earlier batches less the delay; a row is late if its
    slide bucket ends at or before it.
    """
    per = raw.groupBy("batch_id").agg(F.max(ts).alias("newest"))  # one row per batch
    w = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    marks = per.select("batch_id", (epoch_seconds(F.max("newest").over(w)) - delay_seconds).alias("watermark"))
    end = epoch_seconds(slide_bucket(ts, params.slide_seconds)) + params.slide_seconds
    return raw.join(marks, "batch_id").filter(end <= F.col("watermark")).withColumn(
        "watermark", F.timestamp_seconds("watermark"))


def corrected_rates(streamed: DataFrame, raw: DataFrame, late: DataFrame, params: Params, read: Observation | None = None,
                    ts: str = "ts") -> DataFrame:
    """The passes of a stream after its late rows (``corrected``: the pass was replayed).

    Late rows touch the (namespace, pass) whose windows hold them. These are evaluated anew from ``raw``, of which only
    the slide buckets of touched passes are taken (``read`` counts those ``rows``); all others stay as streamed.
    """
    bucket = slide_bucket(ts, params.slide_seconds)
    touched = expand_to_passes(late.select("namespace", bucket.alias("bucket")).distinct(), "bucket", params).select("namespace", "pass_ts").distinct()
    back = F.explode(F.sequence(F.lit(1), F.lit(params.slides_per_window)))
    needed = touched.select("namespace", "pass_ts", back.alias("k")).select(
        "namespace", F.timestamp_seconds(epoch_seconds("pass_ts") - F.col("k") * params.slide_seconds).alias("bucket")).distinct()
    rows = raw.withColumn("bucket", bucket).join(needed, ["namespace", "bucket"], "left_semi").drop("bucket")
    if read is not None:
        rows = rows.observe(read, F.count(F.lit(1)).alias("rows"))
    anew = error_rate_windows(rows, params).join(touched, ["namespace", "pass_ts"], "left_semi")
    kept = streamed.join(touched, ["namespace", "pass_ts"], "left_anti")
    both = kept.withColumn("corrected", F.lit(False)).unionByName(anew.withColumn("corrected", F.lit(True)))
    return both.select(*streamed.columns, "corrected")
