"""Tool entry points and batch/stream parity."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF0001
from vigil.config import replay_params
from vigil.operators import logs as L
from vigil.plans.tools import Sources, Tools, clamp_minutes
from vigil.sources import k8sdata as KD
from vigil.sources import testdata as T


def test_clamp_minutes():
    assert [clamp_minutes(x, 15) for x in (None, 0, 30, 500)] == [15, 1, 30, 60]


def test_tools_run(spark):
    p = replay_params(embedding_dim=64)
    src = Sources(logs=T.logs(spark, SF0001), pods=KD.pods(spark, SF0001), k8s_events=KD.events(spark, SF0001),
                  deployments=KD.deployments(spark, SF0001), counters=T.counter_samples(spark, SF0001),
                  requests=T.requests(spark, SF0001), dep_calls=T.dep_calls(spark, SF0001), memory=T.memory(spark, SF0001))
    t = Tools(src, p, "prod", datetime(2024, 1, 20))
    lines = Tools(src, p, "prod", datetime(2024, 1, 20, 12)).search_logs("svc-0", minutes=60).collect()
    assert 0 < len(lines) <= 40 and not any("hunter" in r.message for r in lines)
    assert t.pod_status("svc-0").count() > 0
    assert {r.involved[:5] for r in t.kubernetes_events("svc-0", minutes=60).collect()} <= {"svc-0"}
    assert {r.kind for r in t.service_metrics("svc-0", minutes=60).collect()} <= {"Metric"}
    assert t.similar_incidents([0.1] * 64, "svc-1").count() <= 5
    with pytest.raises(L.QueryRejected):
        t.search_logs("../etc")


def test_stream_matches_batch(spark):
    import __spark_entry__ as entry

    q = entry.queries()
    streamed = q["stream_sliding_detection"](spark, SF0001)
    from vigil.streaming.detection import error_rate_windows

    batch = error_rate_windows(T.requests(spark, SF0001), replay_params()).select(
        "namespace", "service", "window_start", "pass_ts", "total", "errors", F.round("ratio", 6).alias("ratio"))
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_recovery_timers(spark):
    import os
    import uuid
    from datetime import datetime, timedelta

    from vigil.config import Params
    from vigil.session import ensure_checkpoint_dir
    from vigil.streaming import detection as S

    p = Params(window_seconds=300, slide_seconds=60, cooldown_seconds=900, recovery_seconds=600)
    t0 = datetime(2024, 1, 1, 12, 0)
    mins = {"a": [0, 1, 2, 14, 30], "b": [0, 5], "c": [0, 40]}
    rows = [(fp, t0 + timedelta(minutes=m)) for fp, ms in mins.items() for m in ms] + [("z", t0 + timedelta(minutes=60))]
    base = os.path.join(ensure_checkpoint_dir(spark), "tests", uuid.uuid4().hex)
    spark.createDataFrame(rows, "fingerprint string, pass_ts timestamp").write.parquet(base + "/in")
    src = spark.readStream.schema("fingerprint string, pass_ts timestamp").parquet(base + "/in")
    name = "recovery-test-" + uuid.uuid4().hex[:8]
    S.run_upserts(S.recovery_timers(src, p), name, mode="append")
    got = spark.read.parquet(os.path.join(ensure_checkpoint_dir(spark), "streams", name, "data")).collect()
    rec = {(r.fingerprint, r.first_detected_at): r.recovered_at for r in got}
    # a: 2 -> 14 is within cooldown but past recovery (12:13 < 12:14): recovered at 12:13, then 14 joins;
    #    30 is > 15 min after 14: new session, recovered when the watermark (13:00) passes 12:41
    assert rec[("a", t0)] == t0 + timedelta(minutes=13)
    assert rec[("a", t0 + timedelta(minutes=30))] == t0 + timedelta(minutes=41)
    assert rec[("b", t0)] == t0 + timedelta(minutes=16)
    assert rec[("c", t0)] == t0 + timedelta(minutes=11)
    assert rec[("c", t0 + timedelta(minutes=40))] == t0 + timedelta(minutes=51)
    assert ("z", t0 + timedelta(minutes=60)) not in rec


def test_sql_tools(spark):
    from vigil.plans.sql_tools import register_sql_tools

    p = replay_params(embedding_dim=64)
    src = Sources(logs=T.logs(spark, SF0001), pods=KD.pods(spark, SF0001), k8s_events=KD.events(spark, SF0001),
                  deployments=KD.deployments(spark, SF0001), counters=T.counter_samples(spark, SF0001),
                  requests=T.requests(spark, SF0001), dep_calls=T.dep_calls(spark, SF0001), memory=T.memory(spark, SF0001))
    names = register_sql_tools(spark, src, p)
    assert len(names) == 9
    at = "TIMESTAMP '2024-01-20 12:00:00'"
    logs = spark.sql(f"SELECT * FROM search_logs('prod', 'svc-0', NULL, NULL, 600, {at})").collect()
    direct = L.search(src.logs, p, "prod", datetime(2024, 1, 20, 11, 0), datetime(2024, 1, 20, 12, 0), container="svc-0", limit=40)
    assert logs and [r.message for r in logs] == [r.message for r in direct.collect()]
    assert spark.sql("SELECT * FROM pod_status('prod', 'svc-0')").count() > 0
    assert spark.sql(f"SELECT * FROM kubernetes_events('prod', 'svc-0', 60, {at})").count() > 0
    assert len({r.observed_at for r in spark.sql(f"SELECT * FROM service_metrics('prod', 'svc-0', {at})").collect()}) == 1
    q = ", ".join(["0.1"] * 64)
    assert spark.sql(f"SELECT * FROM runbooks(array({q}), 'no such category', 2.0)").count() == 5  # relaxed
    q = ", ".join(["0.1"] * 64)
    assert spark.sql(f"SELECT * FROM runbooks(array({q}), NULL, 2.0)").count() == 5
    assert spark.sql(f"SELECT * FROM search_logs('prod', '../etc', NULL, NULL, 15, {at})").count() == 0


def test_sql_tools_reject_bad_level(spark):
    from vigil.plans.sql_tools import register_sql_tools

    register_sql_tools(spark, Sources(logs=T.logs(spark, SF0001)), replay_params())
    q = "SELECT * FROM search_logs('prod', 'svc-0', {lvl}, NULL, 60, TIMESTAMP '2024-01-20 12:00:00')"
    assert spark.sql(q.format(lvl="'loud'")).count() == 0
    assert spark.sql(q.format(lvl="NULL")).count() > 0


def test_tools_without_sources(spark):
    """An absent source gives an empty result, from Python and from SQL; the sources that are there still answer."""
    from vigil.plans.sql_tools import register_sql_tools

    p = replay_params(embedding_dim=64)
    none = Tools(Sources(), p, "prod", datetime(2024, 1, 20))
    at, q = "TIMESTAMP '2024-01-20 00:00:00'", ", ".join(["0.1"] * 64)
    calls = [none.search_logs("svc-0"), none.search_logs_around(datetime(2024, 1, 20), "svc-0"), none.pod_status("svc-0"), none.restart_history(),
             none.kubernetes_events("svc-0"), none.deployment_status("svc-0"), none.service_metrics("svc-0"),
             none.similar_incidents([0.1] * 64, None), none.runbooks([0.1] * 64, None)]
    assert [c.count() for c in calls] == [0] * 9
    with pytest.raises(L.QueryRejected):
        none.search_logs("../etc")
    register_sql_tools(spark, Sources(), p)
    for call in (f"search_logs('prod', 'svc-0', NULL, NULL, 15, {at})", f"search_logs_around('prod', 'svc-0', {at}, 60, 60)", "pod_status('prod', NULL)",
                 "restart_history('prod')", f"kubernetes_events('prod', 'svc-0', 30, {at})", "deployment_status('prod', 'svc-0')",
                 f"service_metrics('prod', 'svc-0', {at})", f"similar_incidents(array({q}), NULL, NULL, 2.0)", f"runbooks(array({q}), NULL, 2.0)"):
        assert spark.sql(f"SELECT * FROM {call}").count() == 0, call
    src = Sources(counters=T.counter_samples(spark, SF0001), requests=T.requests(spark, SF0001))  # no dependency calls
    rows = Tools(src, p, "prod", datetime(2024, 1, 20)).service_metrics("svc-0", minutes=60).collect()
    assert {r.kind for r in rows} <= {"Metric"}
    register_sql_tools(spark, src, p)
    assert spark.sql(f"SELECT * FROM service_metrics('prod', 'svc-0', {at})").count() > 0
