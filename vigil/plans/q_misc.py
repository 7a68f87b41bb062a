"""Remaining operator rows of SURVEY §2: transition audit (I4), incident with
evidence (I7), report / investigation rows (R8, R9), memory as evidence and
incident memory text (SM6, SM10), memory vs limit (M13), partial snapshots
(D8), stored restart state (S14), Kubernetes bundle (E10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.config import replay_params
from vigil.operators import cluster as K
from vigil.operators import detect as D
from vigil.operators import grounding as V
from vigil.operators import incidents as I
from vigil.operators import memory as SM
from vigil.operators import metrics as M
from vigil.operators import reports as RP
from vigil.plans import replay as R
from vigil.plans.q_detect import CAND_SQL_OUT, cand_view, sql_pipeline
from vigil.plans.q_reports import SQL_CHECK
from vigil.plans.registry import register
from vigil.session import ensure_checkpoint_dir
from vigil.sources import k8sdata as KD
from vigil.sources import orderdata as O
from vigil.sources import state as ST
from vigil.sources import testdata as T

P = replay_params()


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_ALLOWED_SQL = ", ".join(f"('{a}', '{b}')" for a, b in I.ALLOWED_TRANSITIONS)


@register(
    "transition_audit",
    sql=f"""WITH st AS (SELECT 'inc-' || CAST(l_orderkey AS VARCHAR) AS incident_id, l_linenumber, l_partkey, l_suppkey,
  {_sql_list(I.STATES)}[l_partkey % 8 + 1] AS to_state FROM lineitem),
lg AS (SELECT incident_id, l_linenumber, l_partkey, l_suppkey, lag(to_state) OVER (PARTITION BY incident_id ORDER BY l_linenumber, l_partkey, l_suppkey)
  AS from_state, to_state FROM st),
al AS (SELECT * FROM (VALUES {_ALLOWED_SQL}) t(a, b))
SELECT incident_id, l_linenumber AS step, l_partkey, from_state, to_state,
  CASE WHEN from_state = to_state THEN 'noop' WHEN EXISTS (SELECT 1 FROM al WHERE al.a = from_state AND al.b = to_state) THEN 'allowed'
  ELSE 'refused' END AS verdict FROM lg WHERE from_state IS NOT NULL""",
)
def q_transition_audit(spark, sf):
    """State moves logged per incident (one per lineitem, in line order)."""
    li = T.read(spark, sf, "lineitem")
    states = F.array(*[F.lit(s) for s in I.STATES])
    st = li.select(F.concat(F.lit("inc-"), F.col("l_orderkey").cast("string")).alias("incident_id"), "l_linenumber", "l_partkey",
                   "l_suppkey", F.element_at(states, (F.col("l_partkey") % 8 + 1).cast("int")).alias("to_state"))
    w = Window.partitionBy("incident_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lg = st.withColumn("from_state", F.lag("to_state").over(w)).filter(F.col("from_state").isNotNull())
    return I.transition_audit(lg).select("incident_id", F.col("l_linenumber").alias("step"), "l_partkey", "from_state", "to_state", "verdict")


@register(
    "incident_get",
    sql="WITH " + O.SQL_EVIDENCE + """
SELECT 'inc-' || CAST(o_orderkey AS VARCHAR) AS incident_id, o_orderstatus AS state, count(e.evidence_id) AS evidence_count,
  coalesce(array_to_string(list(e.evidence_id ORDER BY e.observed_at, e.evidence_id) FILTER (WHERE e.evidence_id IS NOT NULL), ','), '') AS evidence
FROM orders LEFT JOIN evidence e ON e.incident_id = 'inc-' || CAST(o_orderkey AS VARCHAR) GROUP BY ALL""",
)
def q_incident_get(spark, sf):
    """Every incident with its evidence ordered by time (the by-id API view,
    for all ids at once: one partitioned join + grouping)."""
    o = T.read(spark, sf, "orders")
    inc = o.select(F.concat(F.lit("inc-"), F.col("o_orderkey").cast("string")).alias("incident_id"), F.col("o_orderstatus").alias("state"))
    ev = O.evidence(spark, sf)
    j = inc.join(ev, "incident_id", "left")
    return j.groupBy("incident_id", "state").agg(
        F.count("evidence_id").alias("evidence_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("evidence_id").isNotNull(), F.struct("observed_at", "evidence_id")))),
                                 lambda x: x["evidence_id"]), ",").alias("evidence"),
    )


_PROPOSED = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'Medium' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'low' END"
_DETECTED = "CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Medium' ELSE 'Low' END"


_RANKS = "['Low', 'Medium', 'High', 'Critical']"


@register(
    "report_rows",
    sql="WITH " + O.SQL_REPORTS + f""",
t AS (SELECT o_orderkey, {_PROPOSED} AS proposed, {_DETECTED} AS detected, 'svc-' || CAST(o_custkey % 8 AS VARCHAR) AS triage_wl,
  'svc-' || CAST(o_orderkey % 8 AS VARCHAR) AS incident_wl, o_totalprice > 150000 AS bad FROM orders),
r AS (SELECT *, CASE WHEN regexp_full_match(lower(trim(coalesce(proposed, ''))), '[0-3]') THEN CAST(lower(trim(proposed)) AS INTEGER)
  ELSE coalesce(list_position(['low', 'medium', 'high', 'critical'], lower(trim(coalesce(proposed, '')))), 0) - 1 END AS p_rank,
  list_position({_RANKS}, detected) - 1 AS d_rank FROM t)
SELECT reports.report_id, reports.kind, reports.incident_id, reports.investigation_id,
  CASE WHEN reports.kind = 'cluster' THEN CASE WHEN bad THEN 'Degraded' ELSE 'Healthy' END
    WHEN proposed IS NULL THEN detected ELSE {_RANKS}[(CASE WHEN p_rank >= 0 THEN greatest(p_rank, d_rank) ELSE d_rank END) + 1] END AS severity,
  CASE WHEN reports.kind = 'cluster' THEN incident_wl || ',' || triage_wl WHEN proposed IS NULL THEN incident_wl ELSE triage_wl END AS workloads
FROM reports JOIN r ON reports.report_id = 'rep-' || CAST(r.o_orderkey AS VARCHAR)""",
)
def q_report_rows(spark, sf):
    """Every order's report; an order of priority '4-NOT SPECIFIED' had no triage, one of status P is a cluster report."""
    o = T.read(spark, sf, "orders")
    own, seen = (F.concat(F.lit("svc-"), (F.col(c) % 8).cast("string")) for c in ("o_orderkey", "o_custkey"))
    flat = o.select(F.concat(F.lit("inc-"), F.col("o_orderkey").cast("string")).alias("incident_id"), F.expr(_PROPOSED).alias("proposed"),
                    F.expr(_DETECTED).alias("detected"), own.alias("own"), seen.alias("seen"))
    incidents = flat.select("incident_id", F.col("detected").alias("severity"), F.array("own").alias("affected_workloads"))
    floor, _ = V.triage_floor("proposed", "detected")
    triage = flat.filter(F.col("proposed").isNotNull()).select("incident_id", floor.alias("severity"), F.array("seen").alias("affected_workloads"))
    status = o.select(F.concat(F.lit("rep-"), F.col("o_orderkey").cast("string")).alias("report_id"),
                      F.when(F.col("o_totalprice") > 150000, "Degraded").otherwise("Healthy").alias("overall_status"),
                      F.array(own, seen).alias("workloads_reviewed"))
    reports = O.reports(spark, sf).select("report_id", "kind", "incident_id", "investigation_id").join(status, "report_id")
    r = RP.report_rows(reports, incidents, triage)
    return r.select("report_id", "kind", "incident_id", "investigation_id", "severity", F.array_join("affected_workloads", ",").alias("workloads"))


_FLAGS = """o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AS recovered, o_orderkey % 11 <> 0 AS triage_ok,
  o_orderpriority <> '4-NOT SPECIFIED' AS actionable, o_orderkey % 13 <> 0 AS investigation_ok, o_orderkey % 17 <> 0 AS report_ok"""


@register(
    "investigation_rows",
    sql="WITH " + SQL_CHECK + f""",
fl AS (SELECT o_orderkey, o_totalprice > 150000 AS conclusive0, {_FLAGS} FROM orders),
acc AS (SELECT position AS o_orderkey, len(real_ids) AS n FROM gh),
ex AS (SELECT l_orderkey AS o_orderkey, min(l_shipdate) AS started_at, max(l_shipdate + to_microseconds(CAST(l_quantity * 1000000 AS BIGINT))) AS finished_at
  FROM lineitem GROUP BY ALL),
st AS (SELECT fl.o_orderkey, CASE WHEN recovered THEN 'Recovered' WHEN NOT triage_ok THEN 'Failed' WHEN NOT actionable THEN 'Ignored'
  WHEN NOT investigation_ok THEN 'Failed' WHEN NOT (conclusive0 AND coalesce(acc.n, 0) > 0) THEN 'Inconclusive' WHEN NOT report_ok THEN 'Failed'
  ELSE 'Reported' END AS final_state, coalesce(acc.n, 0) AS accepted FROM fl LEFT JOIN acc USING (o_orderkey))
SELECT 'inv-' || CAST(st.o_orderkey AS VARCHAR) AS investigation_id, final_state,
  CASE WHEN final_state IN ('Failed', 'Inconclusive') THEN 1 ELSE 0 END AS has_failure_reason,
  coalesce(epoch_ms(finished_at) - epoch_ms(started_at), 0) AS duration_ms,
  st.o_orderkey % 5 <> 0 AND st.o_orderkey % 7 <> 0 AS evidence_complete,
  concat_ws(',', CASE WHEN st.o_orderkey % 7 = 0 THEN 'kubernetes' END, CASE WHEN st.o_orderkey % 5 = 0 THEN 'loki' END) AS unavailable_sources,
  coalesce(xs.executions, '') AS executions
FROM st LEFT JOIN ex USING (o_orderkey) LEFT JOIN xs USING (o_orderkey)""".replace("st AS (SELECT fl.o_orderkey", """xs AS (SELECT l_orderkey AS o_orderkey,
  string_agg(ag || ':' || CAST(ms AS VARCHAR) || ':' || CAST(calls AS VARCHAR), ',' ORDER BY l_shipdate, ag, ms, calls) AS executions
  FROM (SELECT *, ['triage', 'investigation', 'report'][l_linenumber % 3 + 1] AS ag, CAST(l_quantity * 1000 AS BIGINT) AS ms,
    CAST(l_quantity AS INTEGER) % 4 AS calls FROM lineitem) GROUP BY l_orderkey),
st AS (SELECT fl.o_orderkey"""),
)
def q_investigation_rows(spark, sf):
    """One record per investigation (here: per order), with what the evidence lacked and the agents' executions."""
    o = T.read(spark, sf, "orders")
    h = V.ground_hypotheses(O.hypotheses(spark, sf), O.evidence(spark, sf))
    acc = h.select(F.col("position").alias("o_orderkey"), F.size("real_ids").alias("accepted"))
    flags = o.select("o_orderkey", *[F.expr(x.strip()) for x in _FLAGS.split(",")],
                     (F.col("o_totalprice") > 150000).alias("conclusive0"))
    j = flags.join(acc, "o_orderkey", "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    key = F.col("o_orderkey").cast("string")
    named = V.final_state(j.withColumn("conclusive", F.col("conclusive0") & (F.col("accepted") > 0))).withColumn(
        "investigation_id", F.concat(F.lit("inv-"), key)).withColumn("incident_id", F.concat(F.lit("inc-"), key))
    lacking = F.array_compact(F.array(*(F.when(F.col("o_orderkey") % n == 0, F.lit(s)) for s, n in (("loki", 5), ("kubernetes", 7)))))
    unavailable = o.select(F.concat(F.lit("inc-"), key).alias("incident_id"), F.explode(lacking).alias("source"))
    r = RP.investigation_rows(named, O.executions(spark, sf), unavailable)
    one = F.transform("executions", lambda x: F.concat(x["agent"], F.lit(":"), x["duration_ms"].cast("string"), F.lit(":"), x["tool_calls"].cast("string")))
    return r.select("investigation_id", F.col("state").alias("final_state"), F.col("failure_reason").isNotNull().cast("int").alias("has_failure_reason"),
                    "duration_ms", "evidence_complete", F.array_join("unavailable_sources", ",").alias("unavailable_sources"),
                    F.array_join(one, ",").alias("executions"))


def _sql_memory_to_evidence() -> str:
    from vigil.plans.q_memory import _search_sql

    conf = "round_even(least(greatest(1 - distance, 0.0), 1.0), 3)"
    label = ("CAST(CAST(floor(distance * 1000 + 0.5) AS BIGINT) // 1000 AS VARCHAR) || '.' "
             "|| lpad(CAST(CAST(floor(distance * 1000 + 0.5) AS BIGINT) % 1000 AS VARCHAR), 3, '0')")
    sel = f"""SELECT query_id, 'hist_' || left(sha256('HistoricalIncident|memory|' || source_ref), 12) AS evidence_id,
  'HistoricalIncident' AS kind, 'memory' AS source, CAST(NULL AS TIMESTAMP) AS observed_at, source_ref, {conf} AS retrieval_confidence,
  array_to_string(list_filter(['historicalIncidentId=' || incident_id,
    'retrievalConfidence=' || printf('%.3f', {conf}), 'retrievalDistance=' || {label}, 'rootCauseCategory=' || category,
    'sourceRef=' || source_ref, 'workload=' || workload], lambda x: x IS NOT NULL), chr(10)) AS attributes,
  CAST(CAST(floor(distance * 1000 + 0.5) AS BIGINT) // 1000 AS VARCHAR) || '.'
    || lpad(CAST(CAST(floor(distance * 1000 + 0.5) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS distance_label,
  'PAST INCIDENT (not evidence about the current one, retrieval confidence '
    || CAST(CAST(floor({conf} * 100 + 0.5) AS BIGINT) AS VARCHAR) || ' %): ' || source_ref || chr(10) AS summary FROM res"""
    return _search_sql(T.SQL_INCIDENT_QUERIES, True, sel)


@register("memory_to_evidence", sql=_sql_memory_to_evidence())
def q_memory_to_evidence(spark, sf):
    """SM6 over the similar-incident search."""
    r = SM.search(T.memory(spark, sf), T.incident_queries(spark, sf), replay_params(embedding_dim=64), relaxed=True)
    e = SM.to_evidence(r, "HistoricalIncident")
    return e.withColumn("attributes", D.signals_text("attributes"))


@register(
    "incident_memory_text",
    sql="WITH " + O.SQL_REPORTS + """
SELECT r.incident_id, concat('Incident: ', r.title, chr(10), 'Category: ', ['http_error_rate', 'out_of_memory', 'dependency_latency'][o_custkey % 3 + 1],
  chr(10), 'Affected workloads: svc-', o_custkey % 8, ', svc-', o_custkey % 5, chr(10), 'Severity: ', CASE o_orderstatus WHEN 'F' THEN 'High' ELSE 'Medium' END,
  chr(10), chr(10), 'Symptoms: order ', o_orderkey, ' of customer ', o_custkey, chr(10), len(r.evidence_ids), ' item(s)', chr(10), chr(10),
  'Root cause (', o_orderstatus, '): ', o_orderpriority, chr(10), chr(10), 'Impact: ', chr(10), chr(10),
  'Resolution guidance: check ', r.evidence_ids[1], ' then close') AS content, 'svc-' || CAST(o_custkey % 8 AS VARCHAR) AS workload
FROM reports r JOIN orders ON r.incident_id = 'inc-' || CAST(o_orderkey AS VARCHAR) WHERE len(r.evidence_ids) > 0""",
)
def q_incident_memory_text(spark, sf):
    """SM10 from the incidents (orders) and their reports; cluster reports and incidents without evidence leave no memory."""
    o = T.read(spark, sf, "orders")
    service = [F.concat(F.lit("svc-"), (F.col("o_custkey") % n).cast("string")) for n in (8, 5)]
    incidents = o.select(
        F.concat(F.lit("inc-"), F.col("o_orderkey").cast("string")).alias("incident_id"),
        F.format_string("order %d of customer %d", "o_orderkey", "o_custkey").alias("title"),
        F.get(F.array(*map(F.lit, ("http_error_rate", "out_of_memory", "dependency_latency"))), F.col("o_custkey") % 3).alias("category"),
        F.array(*service).alias("affected_workloads"), F.when(F.col("o_orderstatus") == "F", "High").otherwise("Medium").alias("severity"),
        F.col("o_orderdate").alias("first_detected_at"))
    detail = o.select(F.concat(F.lit("rep-"), F.col("o_orderkey").cast("string")).alias("report_id"), F.col("o_orderstatus").alias("root_cause_category"),
                      F.col("o_orderpriority").alias("likely_root_cause"), F.lit(None).cast("string").alias("impact"))
    reports = O.reports(spark, sf).filter(F.col("incident_id").isNotNull() & (F.size("evidence_ids") > 0)).join(detail, "report_id")
    reports = reports.withColumn("summary", F.format_string("%d item(s)", F.size("evidence_ids"))).withColumn(
        "recommended_actions", F.array(F.concat(F.lit("check "), F.get("evidence_ids", 0)), F.lit("then close")))
    return SM.incident_memories(incidents, reports).select("incident_id", "content", "workload")


@register(
    "memory_vs_limit",
    sql="WITH " + T.sql_events() + f""",
used AS (SELECT namespace, 'pod-' || CAST(user_id AS VARCHAR) AS pod, CASE WHEN event_id % 2 = 0 THEN 'app' ELSE 'proxy' END AS container, ts,
  value * 1048576.0 AS value FROM ev),
lim AS (SELECT namespace, 'pod-' || CAST(user_id AS VARCHAR) AS pod, CASE WHEN event_id % 3 = 0 THEN 'app' ELSE 'proxy' END AS container, ts,
  CAST((event_id % 4) * 134217728 AS DOUBLE) AS value FROM ev WHERE event_id % 6 IN (0, 1)),
one AS (SELECT namespace, pod, container, ts, max(value) AS value FROM lim GROUP BY ALL),
j AS (SELECT u.*, l.ts AS limit_ts, l.value AS limit_bytes FROM used u ASOF JOIN (SELECT * FROM one WHERE value > 0) l
  ON u.namespace = l.namespace AND u.pod = l.pod AND u.container = l.container AND u.ts >= l.ts)
SELECT namespace, pod, container, ts, value AS working_set_bytes, limit_bytes, round(value / limit_bytes, 12) AS ratio FROM j
WHERE epoch(ts) - epoch(limit_ts) <= {P.window_seconds}""",
)
def q_memory_vs_limit(spark, sf):
    """Working sets (from events, MiB) against the limit metric of the same container, as last reported within a window."""
    e = T._events(spark, sf, T.DEFAULT_SERVICES).withColumn("pod", F.concat(F.lit("pod-"), F.col("user_id").cast("string")))

    def by(n: int):
        return F.when(F.col("event_id") % n == 0, "app").otherwise("proxy").alias("container")

    used = e.select("namespace", "pod", by(2), "ts", (F.col("value") * 1048576.0).alias("value"))
    limits = e.filter((F.col("event_id") % 6).isin(0, 1)).select(
        "namespace", "pod", by(3), "ts", ((F.col("event_id") % 4) * 134217728).cast("double").alias("value"))
    limits = limits.groupBy("namespace", "pod", "container", "ts").agg(F.max("value").alias("value"))
    return M.memory_vs_limit(used, limits, P).withColumn("ratio", F.round("ratio", 12))


_SQL_UNAVAILABLE = """,
fam AS (SELECT 'prometheus' AS source, namespace, pass_ts FROM er UNION SELECT 'prometheus', namespace, pass_ts FROM p95
  UNION SELECT 'prometheus', namespace, pass_ts FROM dfail UNION SELECT 'loki', namespace, pass_ts FROM sg),
un AS (SELECT namespace, pass_ts, array_to_string(list_filter(['prometheus', 'kubernetes', 'loki'],
  lambda s: s = 'kubernetes' OR NOT list_contains(list(source), s)), ',') AS unavailable_sources FROM fam GROUP BY namespace, pass_ts)"""


def _without_pods(spark, sf):
    """The inputs of every pass where reading the pods breaks off with an error in a task."""
    t = R.test_data_telemetry(spark, sf)
    broken = F.when(F.col("pod").isNotNull(), F.raise_error(F.lit("connection reset")).cast("int")).otherwise(F.col("restart_count"))
    t.pods = t.pods.withColumn("restart_count", broken)
    return D.gathered(R.snapshot_from(t, P))


@register(
    "detect_partial",
    sql="WITH " + sql_pipeline(P) + _SQL_UNAVAILABLE + f"""
SELECT {CAND_SQL_OUT}, unavailable_sources FROM cand JOIN un USING (namespace, pass_ts)
WHERE detection_rule NOT IN ('pod-restarts', 'readiness-failure')""",
)
def q_detect_partial(spark, sf):
    """The pod source fails while it is read: its two rules do not fire, the others do, and each pass says what it lacked."""
    snap = _without_pods(spark, sf)
    cands, failed = D.detect_all(snap, P)
    assert not failed and snap.unavailable_sources == ("kubernetes",)
    lacking = D.unavailable_by_pass(snap, cands.select("namespace", "pass_ts").distinct())
    view = cand_view(cands, title=False).join(lacking, ["namespace", "pass_ts"])
    return view.withColumn("unavailable_sources", F.array_join("unavailable_sources", ","))


@register(
    "pass_sources",
    sql="WITH " + sql_pipeline(P) + _SQL_UNAVAILABLE.replace("s = 'kubernetes' OR ", "").replace("UNION SELECT 'loki'", """UNION SELECT 'kubernetes', namespace, pass_ts FROM pp
  UNION SELECT 'loki'""") + "\nSELECT namespace, pass_ts, unavailable_sources FROM un",
)
def q_pass_sources(spark, sf):
    """What each pass lacked: a pod list comes once a day only, and at the edges of the history a window may hold no log."""
    snap = R.build_snapshot(spark, sf, P)
    every = [getattr(snap, n).select("namespace", "pass_ts") for inputs in D.SOURCE_INPUTS.values() for n in inputs]
    passes = every[0]
    for more in every[1:]:
        passes = passes.unionByName(more)
    return D.unavailable_by_pass(snap, passes.distinct()).withColumn("unavailable_sources", F.array_join("unavailable_sources", ","))


UNREACHABLE = "namespace = 'staging' AND snapshot_ts >= TIMESTAMP '2024-01-21 00:00:00'"


@register(
    "state_upsert",
    sql="WITH " + T.sql_pod_snapshots() + f""",
seen AS (SELECT * FROM pods WHERE NOT ({UNREACHABLE}))
SELECT namespace, pod, restart_count, snapshot_ts AS pass_ts FROM seen
WHERE (namespace, snapshot_ts) IN (SELECT namespace, max(snapshot_ts) FROM seen GROUP BY namespace)""",
)
def q_state_upsert(spark, sf):
    """The stored restart counts after three runs of passes and one that saw no pod at all; one namespace is not seen in
    the last run, so its counts stay those of the run before."""
    p = T.pod_snapshots(spark, sf).filter(~F.expr(UNREACHABLE)).select(
        "namespace", "pod", "restart_count", F.col("snapshot_ts").cast("timestamp").alias("pass_ts"))
    path = f"{ensure_checkpoint_dir(spark)}/vigil/restart-counts-{uuid.uuid4().hex}"
    run = F.floor((F.dayofmonth("pass_ts") - 1) / 10)
    for k in range(3):
        ST.save_restart_counts(path, p.filter(run == k if k < 2 else run >= k))
    ST.save_restart_counts(path, p.filter("false"))
    return ST.restart_counts(spark, path)


def _sql_k8s_bundle() -> str:
    from vigil.functions.ids import sql_evidence_id
    from vigil.plans.q_cluster import SQL_EVENTS, SQL_POD_FACTS, _SUMMARY

    dep_id = sql_evidence_id("KubernetesState", "kubernetes", "namespace", "deployment", "'deployment'",
                             "CAST(desired AS VARCHAR) || '/' || CAST(ready AS VARCHAR) || '/' || CAST(available AS VARCHAR)")
    pod_id = sql_evidence_id("KubernetesState", "kubernetes", "namespace", "pod", "phase", "CAST(restarts AS VARCHAR)",
                             "waiting_reason", "last_termination_reason")
    return SQL_EVENTS + ",\npf AS" + SQL_POD_FACTS.split("pf AS", 1)[1] + f""",
dg AS (SELECT namespace, workload || '@' || strftime(snapshot_ts, '%Y%m%d') AS deployment, CAST(count(*) AS INTEGER) AS desired,
  CAST(sum(CAST(ready AS INTEGER)) AS INTEGER) AS ready, CAST(sum(CAST(ready AS INTEGER)) AS INTEGER) AS available,
  CAST(sum(CAST(restart_count = 0 AS INTEGER)) AS INTEGER) AS updated FROM pods GROUP BY namespace, workload, snapshot_ts)
SELECT 'pods' AS section, namespace, workload, {pod_id} AS evidence_id, {_SUMMARY} AS summary FROM pf
UNION ALL
SELECT 'deployments', namespace, deployment, {dep_id}, 'deployment ' || deployment || ': desired=' || CAST(desired AS VARCHAR) || ' ready='
  || CAST(ready AS VARCHAR) || ' available=' || CAST(available AS VARCHAR) || ' updated=' || CAST(updated AS VARCHAR)
  || CASE WHEN ready <> desired THEN ' - MinimumReplicasUnavailable: Deployment does not have minimum availability.' ELSE '' END FROM dg
UNION ALL
SELECT 'events', namespace, workload, evidence_id, summary FROM (SELECT *, row_number() OVER (PARTITION BY namespace, workload
  ORDER BY occurred_at DESC, evidence_id) AS r FROM kx) WHERE r <= 200"""


@register("k8s_bundle", sql=_sql_k8s_bundle())
def q_k8s_bundle(spark, sf):
    """E10 for every workload at once."""
    from vigil.plans.q_cluster import SINCE

    pods = KD.pods(spark, sf)
    wl = K.restart_counts(pods).select("namespace", "workload")
    return K.k8s_bundle(pods, KD.deployments(spark, sf), KD.events(spark, sf), wl, SINCE)


@register(
    "evidence_id",
    sql="""SELECT l_orderkey, l_linenumber, l_partkey,
  ['log', 'sig', 'met', 'k8s', 'evt', 'hist', 'book'][l_partkey % 7 + 1] || '_' || left(sha256(concat_ws('|',
    ['LogSample', 'LogSignature', 'Metric', 'KubernetesState', 'KubernetesEvent', 'HistoricalIncident', 'Runbook'][l_partkey % 7 + 1],
    'lineitem', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), '')), 12) AS evidence_id FROM lineitem""",
)
def q_evidence_id(spark, sf):
    """E1 for every lineitem as an item of each kind: prefix by kind + 12 hex
    over ``Kind|source|parts`` with a NULL part kept as an empty field."""
    from vigil.functions.ids import EVIDENCE_PREFIX

    li = T.read(spark, sf, "lineitem")
    kinds = list(EVIDENCE_PREFIX)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("l_partkey") % 7 + 1).cast("int"))
    prefix = F.element_at(F.array(*[F.lit(EVIDENCE_PREFIX[k]) for k in kinds]), (F.col("l_partkey") % 7 + 1).cast("int"))
    digest = F.substring(F.sha2(F.concat_ws("|", kind, F.lit("lineitem"), F.col("l_orderkey").cast("string"),
                                            F.col("l_linenumber").cast("string"), F.coalesce(F.lit(None).cast("string"), F.lit(""))), 256), 1, 12)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.concat(prefix, F.lit("_"), digest).alias("evidence_id"))
