"""Incidents as arbitrary state: one state row per fingerprint, timers in event time.

A micro-batch brings detections (and, where a state log closes incidents, its
closing moves). For each fingerprint it reads that one row, applies the events in
their order and emits the incidents they changed; nothing of the history is
read again, however long it is. The rules are those of ``operators.incidents.sessions``:

* gap mode: passes run every ``slide``, so an incident recovers at the first
  pass after ``recovery`` without a detection: by the next detection, or by a
  timer when the watermark has passed that instant;
* log mode: only the log closes incidents (fingerprint, closed_at), so one that
  no pass could close stays open however long the gap. A move counts for the
  incident open before its instant and for one that begins at it.

In a pass detections are recorded before recoveries are confirmed: a timer is
set 1 ms behind its instant, after all detections of that pass. A closed incident's state
lives for the cooldown, in which it still takes detections, and a timer then
drops it (the state store's own TTL follows the machine's clock, not the data's,
and does not go with event-time timers). An open one lives until it is closed.

State is in RocksDB, offsets and state under the query's checkpoint, so a
restart goes on where it stopped.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigil.config import Params
from vigil.session import ensure_checkpoint_dir
from vigil.sources import store

EVENTS = "fingerprint string, at timestamp, severity_rank int, closes boolean"
OUT = "fingerprint string, first_ms long, last_ms long, detection_count long, severity_rank int, closed_ms long"
STATE = "first_ms long, last_ms long, n long, severity int, closed_ms long"  # closed_ms: -1 while open
TABLE = ("fingerprint string, first_detected_at timestamp, last_detected_at timestamp, detection_count long, severity_rank int, "
         "closed_at timestamp")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Incidents(StatefulProcessor):
    def __init__(self, params: Params, by_log: bool):
        self.cooldown, self.recovery = params.cooldown_seconds * 1000, params.recovery_seconds * 1000
        self.slide, self.by_log = params.slide_seconds * 1000, by_log

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.incident = handle.getValueState("incident", STATE)

    def close(self) -> None:
        pass

    def recovers(self, last: int) -> int:
        """First pass more than ``recovery`` after a detection."""
        return ((last + self.recovery) // self.slide + 1) * self.slide

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.incident.get()
        held = list(known) if known is not None else None
        changed: dict[int, tuple] = {}
        events = [(int(pd.Timestamp(at).value // 1_000_000), not closes, rank)  # a closing move comes before detections of its instant
                  for part in rows for at, closes, rank in zip(part["at"], part["closes"], part["severity_rank"])]
        closings = {at for at, detects, _ in events if not detects}
        for at, detects, rank in sorted(events, key=lambda e: e[:2]):
            if not detects:
                if held is not None and held[4] < 0:
                    held[4] = at
                    changed[held[0]] = tuple(held)
                continue
            if held is not None and not self.by_log and held[4] < 0 and self.recovers(held[1]) < at:
                held[4] = self.recovers(held[1])
                changed[held[0]] = tuple(held)
            if held is not None and (held[4] < 0 or at - held[1] <= self.cooldown):
                held[1:4] = [max(at, held[1]), held[2] + 1, max(held[3], int(rank))]
            else:
                held = [at, at, 1, int(rank), at if at in closings else -1]
            changed[held[0]] = tuple(held)
        if held is not None:
            self.incident.update(tuple(held))
            self._set_timer(held)
        yield from self._emit(key, changed.values())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.incident.get()
        if known is None:
            return
        held = list(known)
        if held[4] < 0:
            held[4] = self.recovers(held[1])
            self.incident.update(tuple(held))
            self._set_timer(held)
            yield from self._emit(key, [tuple(held)])
        else:
            self.incident.clear()

    def _set_timer(self, held: list) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if held[4] >= 0:
            self.handle.registerTimer(held[1] + self.cooldown + 1)
        elif not self.by_log:
            self.handle.registerTimer(self.recovers(held[1]) + 1)

    def _emit(self, key, incidents) -> Iterator[pd.DataFrame]:
        rows = [(key[0], first, last, n, severity, closed if closed >= 0 else None) for first, last, n, severity, closed in incidents]
        if rows:
            frame = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in OUT.split(", ")])
            yield frame.astype({"severity_rank": "int32", "closed_ms": "Int64"})


def incident_stream(events: DataFrame, params: Params, by_log: bool = False, watermark: str = "0 seconds") -> DataFrame:
    """Changes of incidents, in the columns of ``TABLE``, from a stream of ``EVENTS``.

    Rows without a severity that close nothing are passes that found nothing: they move the watermark on.
    """
    src = events.withWatermark("at", watermark)
    # names the event time, so that Spark does not filter these rows out before they have moved the watermark
    src = src.filter(F.when(F.col("at").isNotNull(), F.col("closes") | F.col("severity_rank").isNotNull()))
    changes = src.groupBy("fingerprint").transformWithStateInPandas(
        statefulProcessor=Incidents(params, by_log), outputStructType=OUT, outputMode="append", timeMode="EventTime")
    return changes.select("fingerprint", F.timestamp_millis("first_ms").alias("first_detected_at"),
                          F.timestamp_millis("last_ms").alias("last_detected_at"), "detection_count", "severity_rank",
                          F.timestamp_millis("closed_ms").alias("closed_at"))


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which this kind of state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _merge(rows: DataFrame) -> DataFrame:
    """The newest version of each incident: detections are only added, and a closed one stays closed."""
    return store.newest(rows, ["fingerprint", "first_detected_at"], ["detection_count", "closed_at"]).select(rows.columns)


def incident_table(spark: SparkSession, name: str) -> DataFrame:
    """The incidents that the query ``name`` keeps."""
    return store.read(spark, _path(spark, name), spark.createDataFrame([], TABLE).schema).drop(store.BUCKET)


def _path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/streams/{name}/incidents"


def run_incidents(events: DataFrame, name: str, params: Params, by_log: bool = False, watermark: str = "0 seconds", available_now: bool = True,
                  interval: str = "60 seconds"):
    """Keep the table of incidents up to date with a stream of events; each micro-batch rewrites the dates on which the
    incidents it concerns began."""
    spark = events.sparkSession
    path = _path(spark, name)

    def sink(batch: DataFrame, batch_id: int) -> None:
        store.upsert(path, batch, store.date_bucket("first_detected_at"), _merge, name=f"batch-{batch_id}")

    with rocksdb(spark):
        w = incident_stream(events, params, by_log, watermark).writeStream.foreachBatch(sink).outputMode("append").option(
            "checkpointLocation", f"{ensure_checkpoint_dir(spark)}/streams/{name}/checkpoint")
        q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()
        if available_now:
            q.awaitTermination()
    return q
