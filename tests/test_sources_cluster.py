"""JSON / CRI readers (S1, S2, S6), relabel (S11), pod state (K1, K4),
evaluation helpers (X3, X4)."""

import json
import os
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from vigil.operators import cluster as K
from vigil.operators import evaluate as X
from vigil.operators import relabel as RL
from vigil.session import ensure_checkpoint_dir
from vigil.sources import json_api as J


def test_parse_vector(spark):
    doc = json.dumps({"status": "success", "data": {"resultType": "vector", "result": [
        {"metric": {"service": "a"}, "value": [1, "1.5"]},
        {"metric": {"service": "b"}, "value": [1, "NaN"]},
        {"metric": {"service": "c"}, "value": [1, "+Inf"]},
        {"metric": {"service": "d"}, "value": [1, "oops"]},
        {"metric": {"service": "e"}, "value": [1]},
    ]}})
    df = spark.createDataFrame([(doc,), ("{}",)], "d string").select(F.inline(J.parse_vector(F.col("d"))))
    got = {r.labels["service"]: r.value for r in df.collect()}
    assert got["a"] == 1.5 and got["c"] == float("inf") and got["b"] != got["b"]
    assert set(got) == {"a", "b", "c"}


def test_parse_streams(spark):
    doc = json.dumps({"data": {"result": [{"stream": {"container": "x"},
                                            "values": [["1704067200123456789", "hello"], ["1"], ["1704067201000000000", "bye"]]}]}})
    rows = spark.createDataFrame([(doc,)], "d string").select(F.inline(J.parse_streams(F.col("d")))).collect()
    assert [(r.line, r.ts) for r in rows] == [("hello", datetime(2024, 1, 1, 0, 0, 0, 123000)), ("bye", datetime(2024, 1, 1, 0, 0, 1))]


def test_cri_partial_lines(spark):
    base = os.path.join(ensure_checkpoint_dir(spark), "tests", uuid.uuid4().hex)
    os.makedirs(base)
    with open(os.path.join(base, "app.log"), "w") as f:
        f.write("2024-01-01T00:00:00.000001Z stdout P part one \n")
        f.write("2024-01-01T00:00:00.000002Z stdout P part two \n")
        f.write("2024-01-01T00:00:00.000003Z stdout F end\n")
        f.write("2024-01-01T00:00:01.000000Z stderr F whole line\n")
    with open(os.path.join(base, "collector.log"), "w") as f:
        f.write("2024-01-01T00:00:00.000001Z stdout F own\n")
    rows = J.read_cri(spark, base, exclude_prefix="collector").orderBy("ts").collect()
    assert [r.log for r in rows] == ["part one part two end", "whole line"]


def test_cri_keeps_file_order_and_counts_rejects(spark):
    base = os.path.join(ensure_checkpoint_dir(spark), "tests", uuid.uuid4().hex)
    os.makedirs(base)
    with open(os.path.join(base, "app.log"), "w") as f:
        f.write("2024-01-01T00:00:00.000000002Z stdout P zz\n")   # equal to the microsecond: file order decides
        f.write("2024-01-01T00:00:00.000000001Z stdout F aa\n")
        f.write("yesterday stdout F bad stamp\n")
        f.write("no cri line\n\n")
    rows = J.read_cri(spark, base).orderBy("line_no").collect()
    assert [(r.log, r.stamp) for r in rows] == [("zzaa", "2024-01-01T00:00:00.000000002Z"), ("bad stamp", "yesterday")]
    assert rows[0].ts is not None and rows[1].ts is None
    assert [r.rejected for r in J.cri_rejects(spark, base).collect()] == [1]


def test_bad_application_stamp_gives_null(spark):
    df = spark.createDataFrame([('{"ts":"yesterday","msg":"a"}',), ('{"ts":"2024-01-01T00:00:00"}',)], "log string")
    assert [r.app_ts is None for r in J.parse_app_json(df).collect()] == [True, False]


def test_label_audit_names_what_is_missing(spark):
    df = spark.createDataFrame([({"namespace": "n", "container": "api", "Pod": "p"},)], "labels map<string,string>")
    got = {r.label: r for r in RL.cardinality_audit(df, ["namespace", "container", "level"], ["pod"],
                                                  expected={"container": ["api", "worker"]}).collect()}
    assert (got["level"].verdict, got["level"].distinct_values) == ("missing", 0)
    assert got["Pod"].verdict == "forbidden" and got["namespace"].verdict == "ok"
    assert (got["container"].verdict, got["container"].missing_values) == ("incomplete", "worker")


def test_workload_names_come_from_deployments(spark):
    rows = [({"name": n, "namespace": "n"}, {"replicas": 1}, None) for n in ("web", "api", "api")]
    got = K.workload_names(spark.createDataFrame(rows, J.DEPLOYMENT)).collect()
    assert [r.workload for r in got] == ["api", "web"]


def test_events_meet_every_workload_that_begins_their_name(spark):
    names = spark.createDataFrame([("n", "api-gateway-7f"), ("n", "api"), ("m", "api-1"), ("n", "")], "namespace string, involved string")
    wl = spark.createDataFrame([("n", "api"), ("n", "api-gateway"), ("n", "gateway"), ("m", "x")], "namespace string, workload string")
    got = sorted((r.involved, r.workload) for r in K.prefix_workloads(names, wl).collect())
    assert got == [("api", "api"), ("api-gateway-7f", "api"), ("api-gateway-7f", "api-gateway")]


def test_pod_unknown_to_the_baseline_counts_from_zero(spark):
    t = datetime(2024, 1, 1)
    pods = spark.createDataFrame([(t, "n", "new", 3, True, None, "Error"), (t, "n", "old", 3, True, None, "Error"), (t, "n", "idle", 0, False, None, "Old")],
                                 "snapshot_ts timestamp, namespace string, pod string, restart_count int, ready boolean, waiting_reason string, last_termination_reason string")
    base = spark.createDataFrame([("n", "old", 3), ("n", "idle", 0)], "namespace string, pod string, restart_count int")
    got = {r.pod: r.reasons for r in X.pod_reasons(pods, base).collect()}
    assert got == {"new": ["Restarted", "Error"], "old": [], "idle": ["NotReady"]}
    assert {r.pod: r.reasons for r in X.pod_reasons(pods, None).collect()}["idle"] == ["NotReady", "Old"]


def test_not_ready_is_no_disruption_and_case_does_not_matter(spark):
    sc = spark.createDataFrame([("a", ["x"], ["Timed OUT"], False), ("b", ["x"], [], False)],
                               "scenario string, expected_conditions array<string>, expected_log_substrings array<string>, expect_disruption boolean")
    seen = spark.createDataFrame([("a", "NotReady"), ("a", "x"), ("b", "NotReady")], "scenario string, condition string")
    lines = spark.createDataFrame([("a", "call TIMED out")], "scenario string, line string")
    got = {r.scenario: r for r in X.scenario_signal(seen, sc, lines, ["Timed Out"]).collect()}
    assert got["a"].log_substrings_seen and got["b"].no_unexpected_disruption and not got["a"].no_unexpected_disruption


def test_relabel(spark):
    df = spark.createDataFrame([({"job": "api", "__meta_pod": "p1", "__meta_ns": "n"},), ({"job": "db", "__meta_pod": "p2"},)],
                               "labels map<string,string>")
    rules = [RL.Rule("keep", source=["job"], regex="api|web"), RL.Rule("labelmap", regex="__meta_(.*)", replacement="$1"),
             RL.Rule("replace", source=["job", "pod"], regex="(.*);(.*)", target="instance", replacement="$1/$2")]
    (r,) = RL.apply(df, "labels", rules).collect()
    assert r.labels == {"job": "api", "pod": "p1", "ns": "n", "instance": "api/p1", "__meta_pod": "p1", "__meta_ns": "n"}


def test_labelmap_collisions_take_the_last_label(spark):
    df = spark.createDataFrame([({"a_x": "1", "b_x": "2", "x": "old"},)], "labels map<string,string>")
    (r,) = RL.apply(df, "labels", [RL.Rule("labelmap", regex="[ab]_(.*)", replacement="$1")]).collect()
    assert r.labels == {"a_x": "1", "b_x": "2", "x": "2"}


def test_pod_status_edge_cases(spark):
    from vigil.sources.k8sdata import POD_ROW as SCHEMA

    docs = [
        {"metadata": {"name": "empty", "namespace": "d", "labels": {}}, "status": {"phase": "Pending", "containerStatuses": []},
         "observed_at": "2024-01-01T01:00:00Z"},
        {"metadata": {"name": "crash", "namespace": "d", "labels": {"app.kubernetes.io/name": "w"}},
         "spec": {"containers": [{"name": "a", "resources": {"limits": {"memory": "1Gi"}}}]},
         "status": {"phase": "Running", "containerStatuses": [
             {"name": "a", "ready": False, "restartCount": 3, "state": {"waiting": {"reason": ""}},
              "lastState": {"terminated": {"reason": "OOMKilled", "exitCode": 137, "finishedAt": "2024-01-01T00:50:00Z"}}},
             {"name": "b", "ready": True, "restartCount": 2, "state": {"waiting": {"reason": "CrashLoopBackOff"}}}]},
         "observed_at": "2024-01-01T01:00:00Z"},
    ]
    base = os.path.join(ensure_checkpoint_dir(spark), "tests", uuid.uuid4().hex)
    spark.createDataFrame([(json.dumps(d),) for d in docs], "value string").write.text(base)
    p = {r.pod: r for r in K.pod_status(J.read_objects(spark, base, SCHEMA)).collect()}
    assert p["empty"].ready is False and p["empty"].restarts == 0 and p["empty"].minutes_since_last_restart is None
    c = p["crash"]
    assert (c.restarts, c.ready, c.waiting_reason, c.last_termination_reason, c.last_exit_code) == (5, False, "CrashLoopBackOff", "OOMKilled", "137")
    assert c.minutes_since_last_restart == "10" and c.restart_is_recent == "true" and c.memory_limit == "1Gi" and c.workload == "w"
    assert c.summary.endswith("last restart 10m ago (RECENT)")


def test_deployment_status(spark):
    rows = [({"name": "d1", "namespace": "n"}, {"replicas": 3}, {"readyReplicas": None, "availableReplicas": 1, "updatedReplicas": 3,
             "conditions": [{"type": "Available", "status": "False", "reason": "MinimumReplicasUnavailable", "message": "down"}]})]
    df = spark.createDataFrame(rows, J.DEPLOYMENT)
    (r,) = K.deployment_status(df).collect()
    assert (r.desired, r.ready, r.available) == (3, 0, 1)
    assert r.summary == "deployment d1: desired=3 ready=0 available=1 updated=3 - MinimumReplicasUnavailable: down"


def test_category_and_victims(spark):
    df = spark.createDataFrame([("Dependency-Latency", "dependency_latency", "caused by svc-2 today", ["svc-2"]),
                                ("memory of the pod", "out_of_memory", "root cause is the svc-9", ["svc-1"]),
                                ("the_a", "of_the", "nothing", ["x"])],
                               "r string, e string, t string, v array<string>")
    out = df.select(X.category_overlap("r", "e").alias("c"), X.blames_victim("t", "v").alias("b")).collect()
    assert [(o.c, o.b) for o in out] == [(True, True), (False, False), (False, False)]
