"""Counter increase and histogram quantile rules (FIXTURES F9)."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigil import session
from vigil.config import Params
from vigil.operators import metrics as M
from vigil.sources import testdata as T

T0 = datetime(2024, 1, 1, 0, 0)
P = Params(window_seconds=300, slide_seconds=60, cooldown_seconds=900, recovery_seconds=600)


def samples(spark, rows):
    return spark.createDataFrame(
        [("default", "svc", "2xx", T0 + timedelta(seconds=s), i, float(v)) for i, (s, v) in enumerate(rows)],
        "namespace string, service string, status_class string, ts timestamp, event_id long, value double",
    )


def inc_at(spark, rows, pass_ts):
    inc = M.increase(samples(spark, rows), ["namespace", "service", "status_class"], P)
    got = inc.filter(F.col("pass_ts") == pass_ts).collect()
    return got[0].increase if got else None


def test_reset_counts_new_value(spark):
    # 10, 15, (reset) 3, 7 in one window: deltas 0,5,3,4 minus the first -> 12
    rows = [(0, 10), (30, 15), (60, 3), (90, 7)]
    assert inc_at(spark, rows, T0 + timedelta(minutes=5)) == 12.0


def test_single_sample_window_is_zero(spark):
    assert inc_at(spark, [(0, 10)], T0 + timedelta(minutes=5)) == 0.0


def test_left_edge_delta_excluded(spark):
    # second window [1min, 6min) starts at the sample at 60s; its delta (from 30s) crossed the edge
    rows = [(0, 1), (30, 2), (60, 5), (200, 9)]
    assert inc_at(spark, rows, T0 + timedelta(minutes=6)) == 4.0


def _q(spark, buckets):
    df = spark.createDataFrame([(buckets,)], "b array<struct<le:double,count:double>>")
    return df.select(M.quantile_from_buckets(0.95, F.col("b")).alias("q")).collect()[0].q


def test_quantile_rules(spark):
    import math

    inf = float("inf")
    assert math.isnan(_q(spark, [(1.0, 0.0), (inf, 0.0)]))             # total 0
    assert math.isnan(_q(spark, [(1.0, 5.0), (2.0, 5.0)]))             # no +Inf bucket
    assert _q(spark, [(1.0, 0.0), (2.0, 0.0), (inf, 10.0)]) == 2.0      # all mass in +Inf
    assert abs(_q(spark, [(1.0, 50.0), (2.0, 100.0), (inf, 100.0)]) - 1.9) < 1e-9
    assert abs(_q(spark, [(inf, 100.0), (1.0, 100.0)]) - 0.95) < 1e-9   # unsorted input, first bucket from 0


def test_error_rate_drops_zero_total(spark):
    df = spark.createDataFrame(
        [("d", "a", "5xx", T0, T0, 3.0), ("d", "a", "2xx", T0, T0, 7.0), ("d", "b", "2xx", T0, T0, 0.0)],
        "namespace string, service string, status_class string, window_start timestamp, pass_ts timestamp, increase double",
    )
    r = {x.service: x.ratio for x in M.http_error_rate(df).collect()}
    assert r == {"a": 0.3}


def extrapolated(spark, rows):
    inc = M.increase(samples(spark, rows), ["namespace", "service", "status_class"], P, extrapolate=True)
    got = inc.filter(F.col("pass_ts") == T0 + timedelta(minutes=5)).collect()
    return got[0].increase if got else None


def test_extrapolation_to_the_edges(spark):
    # samples every 60 s from 30 s to 270 s: 30 s before and after are nearer than 1.1 gaps, so 240 s become 300 s
    assert abs(extrapolated(spark, [(30 + 60 * i, 100 + 12 * i) for i in range(5)]) - 48 * 300 / 240) < 1e-9
    # samples end at 150 s: 150 s to the edge are beyond 1.1 gaps of 60 s, so half a gap
    assert abs(extrapolated(spark, [(30, 100), (90, 112), (150, 124)]) - 24 * (120 + 30 + 30) / 120) < 1e-9
    # the counter would have been 0 at 25 s (5 s before the first sample, at 1 a second)
    assert abs(extrapolated(spark, [(30 + 60 * i, 5 + 60 * i) for i in range(5)]) - 240 * (240 + 5 + 30) / 240) < 1e-9
    # a reset counts its new value; the clamp uses the first sample of the window
    assert abs(extrapolated(spark, [(30, 100), (90, 110), (150, 4), (210, 10), (270, 20)]) - 30 * 300 / 240) < 1e-9
    assert extrapolated(spark, [(30, 100)]) is None
    assert extrapolated(spark, [(30, 100), (30, 107)]) == 7.0
    assert extrapolated(spark, [(30, 7), (90, 7)]) == 0.0


def _buckets(spark, n=240):
    """Running bucket counts of two services with resets, three buckets each."""
    rows = [("default", f"svc-{i % 2}", le, T0 + timedelta(seconds=37 * i), i, float((i * (k + 1)) % 90))
            for i in range(n) for k, le in enumerate((0.5, 1.0, float("inf")))]
    return spark.createDataFrame(rows, "namespace string, service string, le double, ts timestamp, event_id long, value double")


def test_increase_sorts_in_as_many_tasks_as_its_rows_ask_for(spark, monkeypatch):
    """Before, a fixed number of tasks sorted whatever there was."""
    series = ["namespace", "service", "le"]
    samples = _buckets(spark).localCheckpoint()
    few = M.increase(samples, series, P)
    expected = sorted(few.collect())
    monkeypatch.setattr(session, "ROWS_PER_TASK", 20)
    many = M.increase(samples, series, P)
    plan = many._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window ["):]
    # 720 rows; one exchange serves the window, also with a fraction as a key
    assert below.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in below and ", 36)" in below
    assert sorted(many.collect()) == expected and expected


def test_bucket_counters_sort_one_row_per_request(spark, tmp_path, monkeypatch):
    values = [0.5, 1.0, 2.5, 3.0, 40.0, 100.0, 999.0, 5000.0, None, float("nan")]
    rows = [(i, T0 + timedelta(minutes=13 * i) if i % 17 else None, i % 3, ("error", "view")[i % 2], values[i % 10], '{"k": 1}') for i in range(300)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        f"{tmp_path}/events.parquet")
    expected = []
    for le in [*M.BUCKET_BOUNDS, float("inf")]:
        seen = {}
        for r in sorted(T.requests(spark, tmp_path).collect(), key=lambda r: (r.ts is not None, r.ts or T0, r.event_id)):
            key = r.namespace, r.service, r.ts and r.ts.date()
            seen[key] = seen.get(key, 0.0) + float(r.duration_s is not None and r.duration_s <= le)
            expected.append((r.namespace, r.service, le, r.ts, r.event_id, seen[key]))
    for limit in (session.ROWS_PER_TASK, 40):
        monkeypatch.setattr(session, "ROWS_PER_TASK", limit)
        found = T.bucket_counters(spark, tmp_path)
        assert found.columns == ["namespace", "service", "le", "ts", "event_id", "value"]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Window")  # the buckets unfold above the sort
