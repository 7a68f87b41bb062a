"""Incident state per fingerprint against the batch operators, over micro-batches and restarts; the bucketed store."""

import os
import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigil.config import Params
from vigil.operators import incidents as I
from vigil.session import ensure_checkpoint_dir
from vigil.sources import store
from vigil.streaming import incidents as SI

T0 = datetime(2024, 1, 1)
P = Params(window_seconds=300, slide_seconds=60, cooldown_seconds=900, recovery_seconds=600)


def events(seed, n=12, minutes=240):
    """Detections with gaps around recovery and cooldown, and closing moves."""
    rng = random.Random(seed)
    detections, closings = [], []
    for f in range(n):
        at = rng.randint(0, 20)
        while at < minutes:
            detections.append((f"f{f}", T0 + timedelta(minutes=at), rng.randint(1, 3)))
            if rng.random() < 0.3:
                closings.append((f"f{f}", T0 + timedelta(minutes=at + rng.choice([0, 3, 12]))))
            at += rng.choice([1, 1, 2, 9, 10, 11, 14, 15, 16, 17, 40])
    return detections, closings


def frames(spark, detections, closings):
    d = spark.createDataFrame([(f, t, r, False) for f, t, r in detections] or [], SI.EVENTS)
    c = spark.createDataFrame([(f, t, None, True) for f, t in closings] or [], SI.EVENTS)
    return d.unionByName(c)


def run_parts(spark, rows, name, cuts, by_log):
    """Each part is a run of its own from the checkpoint; the last brings only a pass that found nothing."""
    base = os.path.join(ensure_checkpoint_dir(spark), "tests", name)
    bounds = [T0 - timedelta(days=1), *cuts, T0 + timedelta(days=9)]
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        rows.filter((F.col("at") >= low) & (F.col("at") < high)).repartition(3).write.parquet(f"{base}/part{k}")
        src = spark.readStream.schema(SI.EVENTS).parquet(f"{base}/part*")
        q = SI.run_incidents(src, name, P, by_log)
    tick = spark.createDataFrame([("none", T0 + timedelta(days=10), None, False)], SI.EVENTS)
    tick.write.parquet(f"{base}/part9")
    return SI.run_incidents(spark.readStream.schema(SI.EVENTS).parquet(f"{base}/part*"), name, P, by_log) or q


def batch(spark, detections, closings, by_log):
    d = spark.createDataFrame(detections, "fingerprint string, detected_at timestamp, severity_rank int").withColumn("queue_rank", F.lit(0))
    closed = spark.createDataFrame(closings, "fingerprint string, closed_at timestamp") if by_log else None
    s = I.sessions(d, P, closed)
    return {(r.fingerprint, r.first, r.last, r.n, r.rank) for r in s.groupBy("fingerprint", "session_no").agg(
        F.min("detected_at").alias("first"), F.max("detected_at").alias("last"), F.count("*").alias("n"),
        F.max("severity_rank").alias("rank")).collect()}


def brute_recoveries(detections):
    """closed_at of every incident in gap mode by the plain loop over passes."""
    out = {}
    for f in {d[0] for d in detections}:
        times = sorted(d[1] for d in detections if d[0] == f)
        held = None
        for t in [*times, None]:
            if held is not None and held[2] is None:
                at = held[1] + timedelta(minutes=11)  # first pass strictly after ten minutes
                if t is None or at < t:
                    held[2] = at
            if held is not None:
                out[(f, held[0])] = held[2]
            if t is None:
                break
            if held is not None and (held[2] is None or t - held[1] <= timedelta(minutes=15)):
                held[1] = t
            else:
                held = [t, t, None]
    return out


@pytest.mark.parametrize("by_log", [False, True])
def test_equals_the_batch_operators_over_restarts(spark, by_log):
    detections, closings = events(5)
    name = f"incidents-{uuid.uuid4().hex[:8]}"
    cuts = [T0 + timedelta(minutes=m) for m in (40, 41, 130)]
    run_parts(spark, frames(spark, detections, closings if by_log else []), name, cuts, by_log)
    got = SI.incident_table(spark, name).collect()
    assert {(r.fingerprint, r.first_detected_at, r.last_detected_at, r.detection_count, r.severity_rank) for r in got} == batch(
        spark, detections, closings, by_log)
    assert len(got) == len({(r.fingerprint, r.first_detected_at) for r in got})
    if not by_log:
        assert {(r.fingerprint, r.first_detected_at): r.closed_at for r in got} == brute_recoveries(detections)


def test_a_batch_reads_only_what_is_new(spark):
    """Rows in of each micro-batch are that part's; state rows are one per live fingerprint."""
    name = f"incidents-{uuid.uuid4().hex[:8]}"
    base = os.path.join(ensure_checkpoint_dir(spark), "tests", name)
    for k in range(4):
        rows = [(f"f{i}", T0 + timedelta(hours=2 * k, minutes=i % 3), 1, False) for i in range(20)]
        spark.createDataFrame(rows, SI.EVENTS).write.parquet(f"{base}/part{k}")
        q = SI.run_incidents(spark.readStream.schema(SI.EVENTS).parquet(f"{base}/part*"), name, P)
        assert sum(p.numInputRows for p in q.recentProgress) == 20
        assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= 120  # incident and timers, not the history
    assert SI.incident_table(spark, name).count() == 80


def test_store_rewrites_only_touched_buckets(spark):
    path = os.path.join(ensure_checkpoint_dir(spark), "tests", uuid.uuid4().hex)
    schema = "k long, v string, version int"
    merge = lambda rows: store.newest(rows, ["k"], ["version"]).select(rows.columns)

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) if "_staged" not in d for f in fs
                if f.endswith(".parquet")}

    assert store.upsert(path, spark.createDataFrame([(i, "a", 1) for i in range(100)], schema), store.hash_bucket(["k"], 8), merge) == 8
    before = files()
    assert store.upsert(path, spark.createDataFrame([], schema), store.hash_bucket(["k"], 8), merge) == 0 and files() == before
    assert store.upsert(path, spark.createDataFrame([(7, "b", 2), (7, "old", 0)], schema), store.hash_bucket(["k"], 8), merge, name="w1") == 1
    after = files()
    assert len(set(before) & set(after)) == len(before) - 1
    rows = {r.k: r.v for r in store.read(spark, path, spark.createDataFrame([], schema).schema).collect()}
    assert rows == {**{i: "a" for i in range(100)}, 7: "b"}
    # a bucket lost half way through a write comes back when the write is repeated
    lost, = set(after) - set(before)
    os.remove(lost)
    store.upsert(path, spark.createDataFrame([(7, "b", 2), (7, "old", 0)], schema), store.hash_bucket(["k"], 8), merge, name="w1")
    assert {r.k: r.v for r in store.read(spark, path, spark.createDataFrame([], schema).schema).collect()} == rows


def test_store_reads_only_touched_buckets(spark):
    path = os.path.join(ensure_checkpoint_dir(spark), "tests", uuid.uuid4().hex)
    df = spark.createDataFrame([(i, 1) for i in range(50)], "k long, v int")
    store.upsert(path, df, store.hash_bucket(["k"], 8), lambda r: r)
    plan = store.read(spark, path, df.schema).filter(F.col(store.BUCKET).isin(1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"{store.BUCKET}" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_correction_replays_only_touched_passes(spark):
    from pyspark.sql import Observation

    from vigil.streaming import detection as S

    rng = random.Random(2)
    rows = [(i, T0 + timedelta(minutes=rng.randint(0, 600)), rng.choice("ab"), rng.choice(["x", "y"]), rng.choice(["2xx", "5xx"])) for i in range(3000)]
    raw = spark.createDataFrame(rows, "event_id int, ts timestamp, namespace string, service string, status_class string")
    late = raw.filter("event_id % 500 = 3 AND namespace = 'a'")
    streamed = S.error_rate_windows(raw.join(late, "event_id", "left_anti"), P)
    seen = Observation("read")
    got = S.corrected_rates(streamed, raw, late, P, seen).collect()
    assert {tuple(r)[:-1] for r in got} == {tuple(r) for r in S.error_rate_windows(raw, P).collect()}
    assert {r.namespace for r in got if r.corrected} == {"a"}
    assert 0 < seen.get["rows"] < 300  # of 3000: nine slide buckets around each late row, in its namespace
    again = S.corrected_rates(streamed, raw, late.limit(0), P).collect()
    assert {tuple(r)[:-1] for r in again} == {tuple(r) for r in streamed.collect()} and not any(r.corrected for r in again)
