"""Suppression (FIXTURES F1), pod rules (F10), state machine (F3), sessions."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigil.config import Params, replay_params
from vigil.operators import detect as D
from vigil.operators import incidents as I

T0 = datetime(2024, 1, 1, 12, 0)
SCHEMA = ("namespace string, pass_ts timestamp, fingerprint string, category string, severity string, "
          "severity_rank int, title string, detection_rule string, detected_at timestamp, "
          "affected_workloads array<string>, signals map<string,string>, occurrences int")
RANK = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}


def cands(spark, rows, ts=T0):
    data = []
    for i, (cat, sev, wl, occ) in enumerate(rows):
        data.append(("default", ts, f"fp{i}", cat, sev, RANK[sev], f"t{i}", "r", ts, wl, {}, occ))
    return spark.createDataFrame(data, SCHEMA)


def run(spark, rows):
    out = D.suppress(cands(spark, rows)).orderBy("queue_rank").collect()
    return [(r.category, r.severity, r.occurrences) for r in out]


def test_explained_signatures_dropped(spark):
    out = run(spark, [("dependency_unavailable", "High", ["order-api", "notification-worker"], None),
                      ("repeated_error_signature", "High", ["order-api"], 21),
                      ("repeated_error_signature", "Medium", ["notification-worker"], 11)])
    assert [o[0] for o in out] == ["dependency_unavailable"]


def test_unexplained_signature_survives(spark):
    out = run(spark, [("http_error_rate", "High", ["gateway"], None),
                      ("repeated_error_signature", "Medium", ["payment-simulator"], 40)])
    assert len(out) == 2


def test_collapse_keeps_most_frequent(spark):
    out = run(spark, [("repeated_error_signature", "Medium", ["gateway"], 10),
                      ("repeated_error_signature", "High", ["gateway"], 27),
                      ("repeated_error_signature", "High", ["gateway"], 21)])
    assert out == [("repeated_error_signature", "High", 27)]


def test_distinct_categories_kept_and_order(spark):
    out = run(spark, [("out_of_memory", "High", ["a"], None), ("readiness_failure", "High", ["b"], None),
                      ("dependency_latency", "High", ["c"], None)])
    assert len(out) == 3
    out = run(spark, [("http_error_rate", "High", ["a"], None), ("dependency_unavailable", "High", ["b"], None)])
    assert out[0][0] == "dependency_unavailable"
    out = run(spark, [("dependency_latency", "Medium", ["a"], None), ("http_error_rate", "Critical", ["b"], None)])
    assert out[0][1] == "Critical"


def test_lone_candidate_unchanged(spark):
    assert run(spark, [("repeated_error_signature", "Medium", ["gateway"], 12)]) == [("repeated_error_signature", "Medium", 12)]


def test_suppression_idempotent(spark):
    rows = [("dependency_unavailable", "High", ["a"], None), ("repeated_error_signature", "High", ["a"], 21),
            ("repeated_error_signature", "Medium", ["b"], 11), ("repeated_error_signature", "High", ["b"], 30)]
    once = D.suppress(cands(spark, rows))
    twice = D.suppress(once.drop("queue_rank"))
    assert sorted(once.select("fingerprint").collect()) == sorted(twice.select("fingerprint").collect())


POD_SCHEMA = ("snapshot_ts timestamp, namespace string, pod string, workload string, restart_count int, "
              "ready boolean, waiting_reason string, last_termination_reason string")


def pods(spark, rows):
    return spark.createDataFrame(rows, POD_SCHEMA)


def test_restart_delta_rules(spark):
    t1, t2, t3 = T0, T0 + timedelta(minutes=1), T0 + timedelta(minutes=2)
    p = pods(spark, [
        (t1, "default", "a-1", "a", 5, True, None, None),
        (t2, "default", "a-1", "a", 8, True, None, None),      # +3
        (t2, "default", "a-2", "a", 9, True, None, None),      # new pod: 0
        (t3, "default", "b-1", "b", 0, False, None, None),     # unready, all replicas
        (t3, "default", "c-1", "c", 1, False, "CrashLoopBackOff", "OOMKilled"),
    ])
    d = D.restart_delta(p)
    inc = {(r.pod, r.pass_ts): r.restart_increase for r in d.collect()}
    assert inc[("a-1", t2)] == 3 and inc[("a-2", t2)] == 0 and inc[("a-1", t1)] == 0
    params = replay_params()
    restarts = {(r.affected_workloads[0], r.pass_ts): r for r in D.rule_pod_restart(d, params).collect()}
    assert restarts[("a", t2)].category == "pod_restart_loop" and restarts[("a", t2)].severity == "Medium"
    assert restarts[("c", t3)].category == "out_of_memory" and restarts[("c", t3)].severity == "High"
    ready = {r.affected_workloads[0]: r for r in D.rule_readiness(d, params).collect()}
    assert ready["b"].severity == "High" and "c" not in ready


def test_empty_pass_keeps_state(spark):
    # pass 2 has no pods in the namespace at all: pass 3 compares with pass 1
    t1, t3 = T0, T0 + timedelta(minutes=2)
    p = pods(spark, [(t1, "default", "a-1", "a", 1, True, None, None), (t3, "default", "a-1", "a", 4, True, None, None)])
    r = D.restart_delta(p).filter(F.col("pass_ts") == t3).collect()[0]
    assert r.restart_increase == 3


def test_transition_audit(spark):
    allowed = [("Candidate", "Triaging"), ("Triaging", "Investigating"), ("Triaging", "Ignored"),
               ("Investigating", "Reported"), ("Investigating", "Inconclusive"), ("Failed", "Investigating"),
               ("Reported", "Recovered")]
    refused = [("Candidate", "Reported"), ("Reported", "Investigating"), ("Ignored", "Investigating"),
               ("Inconclusive", "Reported"), ("Recovered", "Triaging"), ("Recovered", "Candidate")]
    rows = [("i", T0, a, b) for a, b in allowed + refused + [("Reported", "Reported")]]
    df = spark.createDataFrame(rows, "incident_id string, ts timestamp, from_state string, to_state string")
    v = {(r.from_state, r.to_state): r.verdict for r in I.transition_audit(df).collect()}
    assert all(v[x] == "allowed" for x in allowed)
    assert all(v[x] == "refused" for x in refused)
    assert v[("Reported", "Reported")] == "noop"


def test_sessions_partition_candidates(spark):
    p = Params(cooldown_seconds=900, recovery_seconds=600, window_seconds=300, slide_seconds=60)
    times = [T0 + timedelta(minutes=m) for m in (0, 1, 2, 20, 21, 50)]
    df = None
    for t in times:
        c = cands(spark, [("http_error_rate", "High", ["a"], None)], ts=t).withColumn("queue_rank", F.lit(1))
        df = c if df is None else df.unionByName(c)
    df = df.withColumn("fingerprint", F.lit("fp")).withColumn("replay_end", F.lit(T0 + timedelta(minutes=80)))
    inc = I.incidents(df, p).orderBy("first_detected_at").collect()
    assert [r.detection_count for r in inc] == [3, 2, 1]
    assert sum(r.detection_count for r in inc) == len(times)
    # 2 -> 20 is an 18 minute gap (> cooldown): new incident; recovery at 2+10 -> first pass after 12:12
    assert inc[0].recovered_at == T0 + timedelta(minutes=13)
    assert all(r.state == "Recovered" for r in inc)


def test_replay_api_on_own_tables(spark):
    """The public replay entry point on plain DataFrames (no test adapters)."""
    from vigil.plans.replay import Telemetry, replay

    p = Params(window_seconds=300, slide_seconds=60, cooldown_seconds=900, recovery_seconds=600)
    t0 = datetime(2024, 1, 1, 12, 0)
    reqs = [("default", "api", t0 + timedelta(seconds=5 * i), 0.05) for i in range(60)]
    cnt = []
    for i in range(60):
        cnt.append(("default", "api", "2xx", t0 + timedelta(seconds=5 * i), float(i)))
        cnt.append(("default", "api", "5xx", t0 + timedelta(seconds=5 * i), float(i // 2)))
    tel = Telemetry(
        counters=spark.createDataFrame(cnt, "namespace string, service string, status_class string, ts timestamp, value double"),
        requests=spark.createDataFrame(reqs, "namespace string, service string, ts timestamp, duration_s double"),
    )
    cands, sup, inc = replay(tel, p)
    cats = {r.category for r in cands.collect()}
    assert cats == {"http_error_rate"}
    got = inc.collect()
    assert len(got) == 1 and got[0].severity in ("High", "Critical") and got[0].detection_count >= 1
