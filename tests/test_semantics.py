"""Ledger cases: enrichment (L6), unknown categories (D11), stream/batch
parity of the restart state (T2), late rows (T6)."""

import json
import os
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigil.operators import detect as D
from vigil.operators import logs as L
from vigil.session import ensure_checkpoint_dir
from vigil.streaming import detection as S


def test_enrich(spark):
    rows = [
        (1, json.dumps({"msg": "boom", "level": "error", "service": "api", "pod": "p1", "operation": "pay",
                        "dependency": "db", "correlationId": "c1", "errorMessage": "timeout"}), {}),
        (2, json.dumps({"msg": 5, "service": "api"}), {}),                      # non-string msg is ignored
        (3, json.dumps([1, 2]), {"level": "warn"}),                             # not an object: raw line
        (4, "plain text", {"container": "web", "level": "info"}),
        (5, json.dumps({"msg": "x", "level": "debug", "service": "api"}), {"level": "error", "container": "gw"}),
    ]
    df = spark.createDataFrame(rows, "id int, line string, labels map<string,string>")
    got = {r.id: r for r in L.enrich(df).collect()}
    assert got[1].message == "boom (operation=pay, dependency=db, correlationId=c1, error=timeout)"
    assert (got[1].level_resolved, got[1].workload, got[1].pod_resolved) == ("error", "api", "p1")
    assert got[2].message == json.dumps({"msg": 5, "service": "api"})
    assert got[3].message == "[1, 2]" and got[3].level_resolved == "warn"
    assert got[4].message == "plain text" and got[4].workload == "web"
    assert (got[5].level_resolved, got[5].workload) == ("error", "gw")   # stream labels win


def test_unknown_category_sorts_first(spark):
    t = datetime(2024, 1, 1)
    rows = [("d", t, "f1", "http_error_rate", "High", 2, "t", "r", t, ["a"], {}, None),
            ("d", t, "f2", "something_new", "High", 2, "t", "r", t, ["b"], {}, None)]
    df = spark.createDataFrame(rows, "namespace string, pass_ts timestamp, fingerprint string, category string, severity string, "
                                     "severity_rank int, title string, detection_rule string, detected_at timestamp, "
                                     "affected_workloads array<string>, signals map<string,string>, occurrences int")
    out = [r.category for r in D.suppress(df).orderBy("queue_rank").collect()]
    assert out == ["something_new", "http_error_rate"]


POD_SCHEMA = ("snapshot_ts timestamp, namespace string, pod string, workload string, restart_count int, "
              "ready boolean, waiting_reason string, last_termination_reason string")


def test_restart_state_stream_matches_batch(spark):
    """Also when a pass arrives in two micro-batches."""
    t = datetime(2024, 1, 1)
    m = lambda k: t + timedelta(minutes=k)
    rows = [
        (t, "a", "p1", "w", 1, True, None, None), (t, "a", "p2", "w", 5, True, None, None),
        (m(1), "a", "p1", "w", 4, True, None, None),        # +3
        (m(1), "a", "p3", "w", 9, True, None, None),        # new pod: 0
        (m(3), "a", "p2", "w", 7, True, None, None),        # p2 absent last pass: 0
        (t, "b", "q1", "v", 2, True, None, None), (m(5), "b", "q1", "v", 6, True, None, None),
        (m(3), "a", "p1", "w", 9, True, None, None),        # in the second batch: +5
    ]
    df = spark.createDataFrame(rows, POD_SCHEMA)
    batch = {(r.namespace, r.pod, r.pass_ts): r.restart_increase for r in D.restart_delta(df).collect()}
    base = os.path.join(ensure_checkpoint_dir(spark), "tests", uuid.uuid4().hex)
    for k, part in enumerate((rows[:-1], rows[-1:])):
        spark.createDataFrame(part, POD_SCHEMA).coalesce(1).write.parquet(f"{base}/{k}")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(base + "/*")
    name = "restart-parity-" + uuid.uuid4().hex[:8]
    S.run_upserts(S.restart_state(src), name, mode="append")
    stream = {(r.namespace, r.pod, r.pass_ts): r.restart_increase for r in S.restart_increase(S.read_step(spark, name)).collect()}
    assert stream == batch
    assert batch[("a", "p1", m(1))] == 3 and batch[("a", "p2", m(3))] == 0 and batch[("a", "p1", m(3))] == 5
    assert batch[("b", "q1", m(5))] == 4


def test_late_rows_are_an_output_and_a_restart_resumes(spark):
    t = datetime(2024, 1, 1)
    base = os.path.join(ensure_checkpoint_dir(spark), "tests", uuid.uuid4().hex)
    schema = "ts timestamp, namespace string, service string, status_class string"
    from vigil.config import Params

    p = Params(window_seconds=300, slide_seconds=60, cooldown_seconds=900, recovery_seconds=600)
    name, raw = ("late-" + uuid.uuid4().hex[:8] for _ in range(2))

    def run():
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base + "/*")
        S.run_upserts(S.error_buckets(src, p, watermark="1 minute"), name, mode="update")
        S.run_upserts(src, raw, mode="append")

    spark.createDataFrame([(t + timedelta(hours=2), "n", "s", "2xx")], schema).coalesce(1).write.parquet(base + "/1")
    run()
    # two hours late, and one row that is not
    late = [(t, "n", "s", "5xx"), (t + timedelta(hours=2), "n", "s", "5xx")]
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(base + "/2")
    run()  # the same names: offsets and state go on
    assert [r.ts for r in S.late_rows(S.read_step(spark, raw), p, 60).collect()] == [t]
    buckets = S.latest_view(spark, name, ["namespace", "service", "bucket"]).collect()
    assert [(r.bucket, r.total, r.errors) for r in buckets] == [(t + timedelta(hours=2), 2, 1)]


LOG_SCHEMA = "ts timestamp, namespace string, container string, level string, pod string, line string"


def test_one_log_path_hides_secrets_and_joins_correlated_errors(spark):
    from vigil.config import Params

    t = datetime(2024, 1, 1)
    p = Params(window_seconds=300, slide_seconds=60, cooldown_seconds=900, recovery_seconds=600)
    line = lambda i: json.dumps({"msg": "login failed password=hunter2secret", "level": "error", "service": "api", "correlationId": f"c-{i}"})
    logs = spark.createDataFrame([(t + timedelta(seconds=i), "default", "api", "error", "p", line(i)) for i in range(12)], LOG_SCHEMA)
    hit = D.rule_repeated_signature(L.error_signatures(logs, p), p).collect()
    assert hit and {r.occurrences for r in hit} == {12} and len({r.fingerprint for r in hit}) == 1
    texts = [r.signals["sample"] for r in hit]
    found = L.search(logs, p, "default", t, t + timedelta(minutes=1)).collect()
    moment = spark.createDataFrame([("m", "default", None, t)], "moment_id string, namespace string, workload string, moment_ts timestamp")
    near = L.around(moment, logs, 60, 60, 5).collect()
    assert len(found) == 12 and len(near) == 5 and "line" not in found[0].asDict()
    texts += [r.message for r in found] + [r.message for r in near]
    texts += [r.summary for r in L.to_sample_evidence(L.find(logs, p, "default", t, t + timedelta(minutes=1)), workload="container").collect()]
    assert texts and not any("hunter2" in x for x in texts)
    assert texts[0].startswith("12x [error] login failed")


def test_rules_see_more_signatures_than_are_listed(spark):
    from vigil.config import Params

    t = datetime(2024, 1, 1)
    p = Params(window_seconds=300, slide_seconds=300, cooldown_seconds=900, recovery_seconds=600)
    names = ["".join(chr(97 + (k // 26 ** j) % 26) for j in range(3)) for k in range(40)]
    logs = spark.createDataFrame([(t, "default", f"svc{n}", "error", "p", f"failure of part {n}") for n in names for _ in range(10)], LOG_SCHEMA)
    assert D.rule_repeated_signature(L.error_signatures(logs, p), p).count() == 40
    assert L.error_signatures(logs, p, top=p.max_signatures).count() == 25


def test_replay_takes_any_sources_and_survives_a_broken_rule(spark, monkeypatch):
    from vigil.config import Params
    from vigil.plans.replay import Telemetry, newest_pass, replay

    t = datetime(2024, 1, 1, 12, 0)
    p = Params(window_seconds=300, slide_seconds=60, cooldown_seconds=900, recovery_seconds=600)
    pods = spark.createDataFrame([(t, "default", "p", "w", 1, False, "CrashLoopBackOff", None)], POD_SCHEMA)
    logs = spark.createDataFrame([(t + timedelta(hours=3), "default", "api", "error", "p", "x")], LOG_SCHEMA)
    assert replay(Telemetry(pods=pods), p)[2].count() == 1
    assert newest_pass(Telemetry(pods=pods, logs=logs), p).first().replay_end == t + timedelta(hours=3, minutes=5)

    def broken(*_):
        raise RuntimeError("no")

    monkeypatch.setitem(D.RULES, "repeated-error-signature", broken)
    assert replay(Telemetry(pods=pods, logs=logs), p)[2].count() == 1


def test_open_incidents_outlive_the_cooldown(spark):
    from vigil.config import Params
    from vigil.operators import incidents as I

    t = datetime(2024, 1, 1)
    p = Params(window_seconds=300, slide_seconds=60, cooldown_seconds=300, recovery_seconds=600)  # cooldown below recovery is valid
    m = lambda k: t + timedelta(minutes=k)
    c = spark.createDataFrame([("f", m(k), 1) for k in (0, 7, 40, 41, 90)], "fingerprint string, detected_at timestamp, queue_rank int")

    def numbers(closed):
        return [r.session_no for r in I.sessions(c, p, closed).orderBy("detected_at").collect()]

    assert numbers(None) == [1, 1, 2, 2, 3]     # 7 minutes: past the cooldown, but not recovered yet
    log = lambda *ks: spark.createDataFrame([("f", m(k)) for k in ks], "fingerprint string, closed_at timestamp")
    assert numbers(log(60)) == [1, 1, 1, 1, 2]  # nothing closed it before
    assert numbers(log(3, 20)) == [1, 2, 3, 3, 3]
    assert numbers(spark.createDataFrame([], "fingerprint string, closed_at timestamp")) == [1, 1, 1, 1, 1]


def test_cluster_status_counts_open_incidents_and_the_queue(spark):
    from vigil.operators import incidents as I

    inc = spark.createDataFrame([("Candidate",), ("Candidate",), ("Failed",), ("Recovered",), ("Reported",)], "state string")
    queue = spark.createDataFrame([("Pending", 4)], "state string, n long")
    (r,) = I.cluster_status(inc, queue).collect()
    assert (r.open_incidents, r.incidents_by_state, r.work_queue) == (3, "Candidate=2;Failed=1", "Pending=4")


def test_cluster_reports_keep_citations_of_any_incident(spark):
    from vigil.operators import grounding as V

    reports = spark.createDataFrame([("r", None, ["e1", "e2", "zz"])], "report_id string, incident_id string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("i1", "e1"), ("i2", "e2")], "incident_id string, evidence_id string")
    (r,) = V.ground_report(reports, evidence, cluster=True).collect()
    assert r.real_ids == ["e1", "e2"] and r.invented_ids == ["zz"] and len(r.problems) == 1


def test_a_source_without_rows_is_available(spark):
    from vigil.operators import evidence as E

    ev = spark.createDataFrame([("i1", "KubernetesState"), ("i1", "Metric"), ("i2", "Metric")], "incident_id string, kind string")
    inc = spark.createDataFrame([("i1",), ("i2",), ("i3",)], "incident_id string")
    failed = spark.createDataFrame([("i3", "log signatures (TimeoutException)")], "incident_id string, source string")
    got = {r.incident_id: r for r in E.completeness(ev, inc, failed).collect()}
    assert (got["i1"].is_complete, got["i1"].api_check) == (True, True)
    assert (got["i2"].is_complete, got["i2"].api_check) == (True, False)
    assert got["i3"].unavailable_sources == ["log signatures (TimeoutException)"] and not got["i3"].is_complete


def test_bundles_hold_six_families(spark):
    from tests.conftest import SF0001
    from vigil.operators import evidence as E
    from vigil.plans import q_bundle as B
    from vigil.sources import testdata as T

    moments = T.pod_snapshots(spark, SF0001).groupBy("namespace", "workload").agg(F.max("snapshot_ts").alias("moment_ts")).withColumn(
        "incident_id", F.concat("namespace", "workload"))
    got, failed = E.bundle(moments, B.sources(spark, SF0001), B.P)
    assert failed.count() == 0
    rows = got.select("kind", "summary").collect()
    assert {r.kind for r in rows} == {"KubernetesState", "KubernetesEvent", "Metric", "LogSignature", "LogSample"}
    assert any(r.summary.startswith("deployment ") for r in rows) and any(r.summary.startswith("pod ") for r in rows)
    assert not any("hunter" in r.summary for r in rows)


def test_metrics_from_cumulative_series(spark):
    from vigil.config import Params
    from vigil.operators import metrics as M

    t = datetime(2024, 1, 1)
    p = Params(window_seconds=300, slide_seconds=300, cooldown_seconds=900, recovery_seconds=600)
    # two pods; the second restarts (its counters fall to what came after)
    rows = [(t + timedelta(seconds=k), "n", "s", pod, le, float(v)) for pod, series in
            (("a", [(0.5, (0, 8)), (1.0, (0, 10)), (float("inf"), (0, 10))]), ("b", [(0.5, (50, 1)), (1.0, (70, 9)), (float("inf"), (90, 10))]))
            for le, (x, y) in series for k, v in ((1, x), (2, y))]
    df = spark.createDataFrame(rows, "ts timestamp, namespace string, service string, pod string, le double, value double")
    inc = M.p95_from_buckets(df, ["namespace", "service"], ["namespace", "service", "pod"], p, tiebreak=None).collect()
    # counts: 0.5 -> 9, 1.0 -> 19, all -> 20; rank 19 lies in (0.5, 1.0]
    assert [round(r.p95, 9) for r in inc] == [1.0]
    f = spark.createDataFrame([(t + timedelta(seconds=k), "n", None, "db", None, float(v)) for k, v in ((1, 4), (2, 6), (3, 1))],
                              "ts timestamp, namespace string, service string, dependency string, kind string, value double")
    (r,) = M.dependency_failures_from_counters(f, p, tiebreak=None).collect()
    assert (r.service, r.kind, r.failures) == ("unknown", "unknown", 3.0)


def test_service_metrics_of_a_window_that_ends_now(spark):
    from vigil.config import replay_params
    from vigil.plans.tools import Sources, Tools

    t = datetime(2024, 1, 1, 12, 17)
    req = spark.createDataFrame([(t - timedelta(seconds=30 * k + 1), "prod", "api", 0.2) for k in range(28)],
                                "ts timestamp, namespace string, service string, duration_s double")
    cnt = spark.createDataFrame([(t - timedelta(seconds=30 * k + 1), "prod", "api", "2xx", float(28 - k)) for k in range(28)],
                                "ts timestamp, namespace string, service string, status_class string, value double")
    dep = spark.createDataFrame([], "ts timestamp, namespace string, service string, dependency string, kind string, outcome string, duration_s double")
    rows = Tools(Sources(counters=cnt, requests=req, dep_calls=dep), replay_params(), "prod", t).service_metrics("api", 15).collect()
    assert len(rows) == 2 and {r.observed_at for r in rows} == {t}
    assert any("(27 requests)" in r.summary for r in rows)


def test_source_that_fails_while_running_costs_only_itself(spark):
    from dataclasses import replace

    from pyspark.sql import Observation

    from tests.conftest import SF0001
    from vigil.config import replay_params
    from vigil.operators import evidence as E
    from vigil.plans import q_bundle as QB
    from vigil.plans import replay as R

    p = replay_params()
    t = R.test_data_telemetry(spark, SF0001)
    t.logs = t.logs.withColumn("pod", F.when(F.length("line") > 0, F.raise_error(F.lit("down")).cast("string")).otherwise(F.col("pod")))
    snap = D.gathered(R.snapshot_from(t, p))
    assert snap.unavailable_sources == ("loki",) and snap.signatures is None and snap.error_rate is not None
    rules = {r.detection_rule for r in D.detect_all(snap, p)[0].select("detection_rule").distinct().collect()}
    assert "pod-restarts" in rules and "repeated-error-signature" not in rules
    seen = Observation("sources")
    passes = snap.error_rate.select("namespace", "pass_ts").distinct()
    rows = D.unavailable_by_pass(snap, passes, seen).collect()
    assert all("loki" in r.unavailable_sources and "prometheus" not in r.unavailable_sources for r in rows)
    assert seen.get["passes"] == len(rows) == seen.get["loki"] and seen.get["prometheus"] == 0 < seen.get["kubernetes"] < len(rows)
    whole = D.gathered(R.build_snapshot(spark, SF0001, p))
    assert whole.unavailable_sources == ()

    src = QB.sources(spark, SF0001)
    broken = replace(src, logs=t.logs)
    moments = spark.createDataFrame([("i1", "prod", "svc-0", datetime(2024, 1, 20))], "incident_id string, namespace string, workload string, moment_ts timestamp")
    got, failed = E.bundle(moments, broken, p)
    assert {r.source.split(" (")[0] for r in failed.collect()} == {"log signatures", "error log samples"}
    assert "LogSample" not in {r.kind for r in got.collect()}


@pytest.mark.parametrize("query", ["cluster_health_facts", "evidence_bundle", "incident_prompt"])
def test_a_failed_source_is_no_result(spark, monkeypatch, query):
    """These results cannot say that a family of evidence is missing, so it is an error."""
    from dataclasses import replace

    from tests.conftest import SF0001
    from vigil.plans import q_bundle as QB

    src = QB.sources(spark, SF0001)
    down = F.when(F.col("observed_at").isNotNull(), F.raise_error(F.lit("connection reset")).cast("timestamp")).otherwise(F.col("observed_at"))
    monkeypatch.setattr(QB, "sources", lambda *a: replace(src, pods=src.pods.withColumn("observed_at", down)))
    with pytest.raises(RuntimeError, match="would lack kubernetes pod state"):
        getattr(QB, f"q_{query}")(spark, SF0001)


def test_a_failed_rule_or_log_store_is_no_replay(spark, monkeypatch):
    from tests.conftest import SF0001
    from vigil.config import replay_params
    from vigil.plans import replay as R

    def broken(snap, params):
        raise ValueError("no such column")

    with monkeypatch.context() as m:
        m.setitem(D.RULES, "dependency-failure", broken)
        with pytest.raises(RuntimeError, match="dependency-failure"):
            R.incidents(spark, SF0001, replay_params())
    t = R.test_data_telemetry(spark, SF0001)
    t.logs = t.logs.withColumn("pod", F.when(F.length("line") > 0, F.raise_error(F.lit("down")).cast("string")).otherwise(F.col("pod")))
    monkeypatch.setattr(R, "test_data_telemetry", lambda *a: t)
    with pytest.raises(Exception, match="down"):
        R.build_snapshot(spark, SF0001, replay_params())
