"""Grounding (FIXTURES F13), work queue (F8), query arguments."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigil.config import replay_params
from vigil.operators import grounding as V
from vigil.operators import logs as L
from vigil.operators import reports as RP

H_SCHEMA = ("hypothesis_id string, investigation_id string, incident_id string, position int, statement string, "
            "confidence double, evidence_ids array<string>")


def test_citations(spark):
    ev = spark.createDataFrame([("i", "e1"), ("i", "e2")], "incident_id string, evidence_id string")
    h = spark.createDataFrame([
        ("h1", "inv", "i", 1, "all invented", 0.5, ["x", "y"]),
        ("h2", "inv", "i", 2, "some invented", 1.7, ["e2", "x", "e1", "e2", "x"]),
        ("h3", "inv", "i", 3, "fine", -0.3, ["e1"]),
    ], H_SCHEMA)
    g = {r.hypothesis_id: r for r in V.ground_hypotheses(h, ev).collect()}
    assert g["h1"].rejected and g["h1"].invented_ids == ["x", "y"]
    assert g["h2"].real_ids == ["e2", "e1", "e2"] and g["h2"].invented_ids == ["x"]
    assert len(g["h1"].problems) == 2 and len(g["h2"].problems) == 1 and g["h3"].problems == []
    ranked = V.rank_accepted(V.ground_hypotheses(h, ev)).orderBy("rank").collect()
    assert [(r.hypothesis_id, r.confidence) for r in ranked] == [("h2", 1.0), ("h3", 0.0)]
    res = spark.createDataFrame([("inv", True), ("none", True)], "investigation_id string, conclusive boolean")
    c = {r.investigation_id: r.conclusive for r in V.conclusive(V.ground_hypotheses(h, ev), res).collect()}
    assert c == {"inv": True, "none": False}


def test_triage_floor(spark):
    df = spark.createDataFrame([("Low", "High"), ("bogus", "High"), ("CRITICAL", "Medium")], "p string, d string")
    eff, prob = V.triage_floor("p", "d")
    out = [(r.e, r.pr is not None) for r in df.select(eff.alias("e"), prob.alias("pr")).collect()]
    assert out == [("High", True), ("High", True), ("Critical", False)]


WI = ("id string, kind string, dedup_key string, state string, attempt int, max_attempts int, "
      "available_at timestamp, leased_until timestamp, leased_by string")
NOW = datetime(2024, 1, 1, 12, 0)


def test_queue(spark):
    items = spark.createDataFrame([
        ("a", "inv", "k1", "Pending", 1, 3, NOW - timedelta(minutes=5), None, None),
        ("b", "inv", "k2", "Claimed", 1, 3, NOW - timedelta(hours=1), NOW - timedelta(minutes=1), "w1"),
        ("c", "inv", "k3", "Claimed", 3, 3, NOW - timedelta(hours=1), NOW + timedelta(minutes=5), "w2"),
        ("d", "inv", "k4", "Completed", 1, 3, NOW - timedelta(hours=2), None, None),
    ], WI)
    assert [r.id for r in RP.claimable(items, NOW, 10).collect()] == ["b", "a"]
    assert [r.id for r in RP.claimable(items, NOW, 1).collect()] == ["b"]
    req = spark.createDataFrame([("inv", "k1", 1), ("inv", "k4", 2), ("inv", "k4", 3)], "kind string, dedup_key string, n int")
    assert [(r.dedup_key, r.n) for r in RP.enqueue_dedup(items, req, "n").collect()] == [("k4", 2)]
    sched = {r.id: (r.next_state, r.delay_seconds) for r in RP.retry_schedule(items).collect()}
    assert sched["a"] == ("Pending", 30.0) and sched["c"] == ("Failed", 0.0)
    inc = spark.createDataFrame([("k1", "Triaging"), ("k9", "Investigating"), ("k8", "Reported")], "incident_id string, state string")
    assert [r.incident_id for r in RP.stranded(inc, items).collect()] == ["k9"]


def test_query_arguments():
    p = replay_params()
    for bad in ['order-api"} |= "password', 'order-api", container="gateway', "../../etc/passwd", "Order-API", "", None]:
        with pytest.raises(L.QueryRejected):
            L.require_workload(bad)
    with pytest.raises(L.QueryRejected):
        L.require_namespace("kube-system", p)
    assert L.require_namespace(None, p) == p.default_namespace
    end = datetime(2024, 1, 1, 12, 0)
    p30 = replay_params(max_range_minutes=30 * 24 * 60)
    s, e = L.clamp_window(end - timedelta(days=60), end, p30)
    assert e == end and s == end - timedelta(days=30)
    with pytest.raises(L.QueryRejected):
        L.clamp_window(end, end - timedelta(minutes=1), p)
    assert [L.clamp_limit(x, 500) for x in (10000, 0, -5, 50)] == [500, 500, 500, 50]
