"""Stored reports and investigations, incident memories, memory against limits."""

from datetime import datetime, timedelta

from tests.conftest import SF0001
from vigil.config import Params
from vigil.operators import memory as SM
from vigil.operators import metrics as M
from vigil.operators import reports as RP

T0 = datetime(2024, 1, 1)


def test_report_takes_severity_and_workloads_from_triage(spark):
    reports = spark.createDataFrame([
        ("r1", "incident", "i1", "v1", None, None), ("r2", "incident", "i2", "v2", None, None), ("r3", "incident", "i3", "v3", None, None),
        ("r4", "cluster", "i1", "v1", "Degraded", ["a", "b"])],
        "report_id string, kind string, incident_id string, investigation_id string, overall_status string, workloads_reviewed array<string>")
    shape = "incident_id string, severity string, affected_workloads array<string>"
    incidents = spark.createDataFrame([("i1", "Low", ["x"]), ("i2", "High", ["y"]), ("i3", "High", ["z"])], shape)
    triage = spark.createDataFrame([("i1", "Critical", ["x2"]), ("i3", None, ["z2"])], shape)
    got = {r.report_id: r for r in RP.report_rows(reports, incidents, triage).collect()}
    assert {k: (r.severity, r.affected_workloads) for k, r in got.items()} == {
        "r1": ("Critical", ["x2"]), "r2": ("High", ["y"]), "r3": ("High", ["z2"]), "r4": ("Degraded", ["a", "b"])}
    assert (got["r4"].incident_id, got["r4"].investigation_id) == (None, None) and got["r1"].investigation_id == "v1"


def test_investigation_record(spark):
    inv = spark.createDataFrame([("v1", "i1", "Failed", "no result"), ("v2", "i2", "Reported", "kept to itself"), ("v3", "i3", "Inconclusive", None)],
                                "investigation_id string, incident_id string, final_state string, terminal_outcome string")
    m = lambda k: T0 + timedelta(seconds=k)
    runs = spark.createDataFrame([("v1", "triage", m(5), m(7), ["a", "a"], True), ("v1", "report", m(1), m(2), [], False)],
                                 "investigation_id string, agent string, started_at timestamp, finished_at timestamp, tools array<string>, succeeded boolean")
    lacking = spark.createDataFrame([("i1", "loki"), ("i1", "kubernetes"), ("i1", "loki")], "incident_id string, source string")
    got = {r.investigation_id: r for r in RP.investigation_rows(inv, runs, lacking).collect()}
    v = got["v1"]
    assert (v.state, v.duration_ms, v.failure_reason, v.evidence_complete, v.unavailable_sources) == ("Failed", 6000, "no result", False, ["kubernetes", "loki"])
    assert [(e.agent, e.duration_ms, e.tool_calls, e.succeeded) for e in v.executions] == [("report", 1000, 0, False), ("triage", 2000, 2, True)]
    assert (got["v2"].failure_reason, got["v2"].evidence_complete, got["v2"].executions, got["v2"].duration_ms) == (None, True, [], 0)


def test_incident_memory(spark):
    inc = spark.createDataFrame([("i1", "seen", "oom", ["a", "b"], "High", T0), ("i2", "never reported", "oom", [], "Low", T0)],
                                "incident_id string, title string, category string, affected_workloads array<string>, severity string, first_detected_at timestamp")
    rep = spark.createDataFrame([("i1", "found", "sum", "leak", "a leak", None, ["do", "that"])],
                                "incident_id string, title string, summary string, root_cause_category string, likely_root_cause string, impact string, "
                                "recommended_actions array<string>")
    r, = SM.incident_memories(inc, rep).collect()
    assert r.content == ("Incident: found\nCategory: oom\nAffected workloads: a, b\nSeverity: High\n\nSymptoms: seen\nsum\n\nRoot cause (leak): a leak\n\n"
                         "Impact: \n\nResolution guidance: do that")
    assert (r.kind, r.source_ref, r.title, r.workload, r.root_cause_category, r.occurred_at) == ("incident", "i1", "found", "a", "leak", T0)


def test_memory_against_the_last_limit(spark):
    p = Params(window_seconds=300, slide_seconds=60, cooldown_seconds=900, recovery_seconds=600)
    shape = "namespace string, pod string, container string, ts timestamp, value double"
    at = lambda s: T0 + timedelta(seconds=s)
    used = spark.createDataFrame([("n", "p", c, at(s), 50.0) for c, s in (("app", 10), ("app", 299), ("app", 301), ("app", 650), ("proxy", 20), ("app", 0))], shape)
    limits = spark.createDataFrame([("n", "p", "app", at(10), 100.0), ("n", "p", "app", at(300), 200.0), ("n", "p", "app", at(299), 0.0),
                                    ("n", "p", "proxy", at(30), 10.0)], shape)
    got = {(r.container, int((r.ts - T0).total_seconds())): (r.limit_bytes, r.ratio) for r in M.memory_vs_limit(used, limits, p).collect()}
    assert got == {("app", 10): (100.0, 0.5), ("app", 299): (100.0, 0.5), ("app", 301): (200.0, 0.25)}


def test_signatures_are_counted_once_and_only_where_used(spark, monkeypatch):
    """Both inputs of the open sessions come from one replay; metrics of a bundle read no lines."""
    from vigil.operators import logs
    from vigil.plans import q_bundle, q_detect

    counted, real = [], logs.stored
    monkeypatch.setattr(logs, "stored", lambda df, name: counted.append(name) or real(df, name))
    q_detect.live_and_closed(spark, SF0001)
    assert counted == ["signature-counts"]
    counted.clear()
    q_bundle.metric_evidence(spark, SF0001)
    assert counted == []


def test_texts_of_events_are_made_after_the_limits(spark):
    """Redaction stands above the ranks of the events, not below them."""
    from vigil.operators import cluster
    from vigil.sources import k8sdata

    events = k8sdata.events(spark, SF0001)
    names = events.selectExpr("metadata.namespace AS namespace", "substring_index(involvedObject.name, '-', 2) AS workload").distinct()
    plan = cluster.k8s_events(events, names, "2024-01-01 00:00:00", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "REDACTED" in plan and plan.rindex("REDACTED") < plan.index("Window [")
