"""Cut-offs as partition filters, expiry by whole partitions; open incidents by a sweep; late fetch of samples."""

import os
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigil.config import Params
from vigil.operators import incidents as I
from vigil.operators import logs as L
from vigil.session import ensure_checkpoint_dir
from vigil.sources import retention as RT

T0 = datetime(2024, 1, 1)
P = Params(window_seconds=300, slide_seconds=60, cooldown_seconds=900, recovery_seconds=600)


def new_path(spark):
    return os.path.join(ensure_checkpoint_dir(spark), "tests", uuid.uuid4().hex)


def table(spark, path, rule, step, n):
    rows = [(i, T0 + i * step) for i in range(n)]
    RT.write_partitioned(spark.createDataFrame(rows, "i int, ts timestamp"), path, rule)
    return rows


def test_rows_beyond_the_age_are_not_read(spark):
    for rule, step, n in ((RT.LOGS, timedelta(hours=5), 100), (RT.METRICS, timedelta(minutes=7), 200)):
        path = new_path(spark)
        rows = table(spark, path, rule, step, n)
        cut = rows[-1][1] - timedelta(hours=rule.hours)
        kept = RT.retained(spark.read.parquet(path), rule)
        assert {r.i for r in kept.collect()} == {i for i, t in rows if t >= cut}
        plan = kept._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
        assert rule.column in filters and "ubquery" in filters, filters


def test_expiry_removes_whole_partitions(spark):
    for rule, step, n in ((RT.LOGS, timedelta(hours=5), 100), (RT.METRICS, timedelta(minutes=7), 200)):
        path = new_path(spark)
        rows = table(spark, path, rule, step, n)
        before = {r.i for r in RT.retained(spark.read.parquet(path), rule).collect()}
        folders = {d for d in os.listdir(path) if d.startswith(rule.column)}
        gone = RT.expire(spark, path, rule)
        left = {d for d in os.listdir(path) if d.startswith(rule.column)}
        assert gone and set(gone) == folders - left and max(gone) < min(left)
        assert {r.i for r in RT.retained(spark.read.parquet(path), rule).collect()} == before
        cut = rows[-1][1] - timedelta(hours=rule.hours)
        start = cut.replace(hour=0 if rule.unit == "day" else cut.hour, minute=0)
        assert {r.i for r in spark.read.parquet(path).collect()} == {i for i, t in rows if t >= start}
        assert RT.expire(spark, path, rule) == []


def test_open_incidents_at_moments(spark):
    m = lambda k: T0 + timedelta(minutes=k)
    inc = [("a", m(0), m(90)), ("a", m(30), None), ("a", m(30), m(30)), ("b", m(200), m(400)), ("a", m(3000), None)]
    moments = [("a", m(k), k) for k in (-5, 0, 29, 30, 89, 90, 91, 3000, 9000)] + [("b", m(300), 1), ("b", m(300), 2), ("c", m(0), 3)]
    got = I.open_at(spark.createDataFrame(inc, "namespace string, first_detected_at timestamp, recovered_at timestamp"),
                    spark.createDataFrame(moments, "namespace string, moment_ts timestamp, k int"))
    want = {(ns, k): sum(n == ns and f <= t and (r is None or r > t) for n, f, r in inc) for ns, t, k in moments}
    assert {(r.namespace, r.k): r.open_incidents for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "first_detected_at" in plan and "<=" not in plan  # no range join


def test_signature_samples_are_fetched_late(spark):
    rows = [(T0 + timedelta(seconds=s), "ns", w, lv, pod, msg) for s, w, lv, pod, msg in [
        (0, "api", "error", "p1", "boom 1"), (10, "api", "error", "p2", "boom 2"), (10, "web", "warn", "p3", "boom 3"), (10, "web", "warn", None, "boom 9"),
        (20, "api", "info", "p9", "boom 4"), (30, None, None, "p1", "boom 5"), (40, "api", "error", "p1", "other")]]
    df = spark.createDataFrame(rows, "ts timestamp, namespace string, container string, level string, pod string, line string")
    sig = L.error_signatures(df, P)
    got = {(r.pass_ts, r.normalised): r for r in sig.collect()}
    r = got[(T0 + timedelta(minutes=1), "boom <n>")]
    assert (r.occurrences, r.distinct_pods, r.workload, r.level, r.last_seen) == (4, 4, "web", "warn", T0 + timedelta(seconds=10))
    assert got[(T0 + timedelta(minutes=1), "other")].occurrences == 1
    only = L.error_signatures(df, P, top=1, by_workload=True, passes=spark.createDataFrame(
        [("ns", "api", T0 + timedelta(minutes=2))], "namespace string, container string, pass_ts timestamp")).collect()
    assert [(r.workload, r.normalised, r.occurrences) for r in only] == [("api", "boom <n>", 2)]
    plan = L.error_signatures(df, P)._jdf.queryExecution().executedPlan().toString()
    # what is sorted are texts of lines that meet a newest instant, after the semi join
    assert plan.count("SortAggregate") == 0 or "LeftSemi" in plan.split("SortAggregate")[-1]
