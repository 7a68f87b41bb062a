"""Grounding, evidence, report and queue queries over orders / lineitem /
customer (SURVEY §2.7, §2.8, §2.10)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vigil.functions.ids import KIND_PRIORITY
from vigil.operators import evidence as E
from vigil.operators import grounding as V
from vigil.operators import reports as RP
from vigil.plans.registry import register
from vigil.sources import orderdata as O
from vigil.sources.testdata import read

R6 = 6
NOW = datetime(1996, 6, 1)


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


SQL_CHECK = O.SQL_EVIDENCE + ",\n" + O.SQL_HYPOTHESES + """,
hx AS (SELECT hypothesis_id, incident_id, UNNEST(evidence_ids) AS cited, UNNEST(range(len(evidence_ids))) AS pos FROM hyps),
hj AS (SELECT hx.*, e.evidence_id IS NOT NULL AS ok FROM hx LEFT JOIN (SELECT DISTINCT incident_id, evidence_id FROM evidence) e
  ON e.incident_id = hx.incident_id AND e.evidence_id = hx.cited),
inv1 AS (SELECT hypothesis_id, cited, min(pos) AS p FROM hj WHERE NOT ok GROUP BY ALL),
inv AS (SELECT hypothesis_id, list(cited ORDER BY p) AS invented_ids FROM inv1 GROUP BY ALL),
rl AS (SELECT hypothesis_id, list(cited ORDER BY pos) FILTER (WHERE ok) AS real_ids, count(*) AS cited_count FROM hj GROUP BY ALL),
gh AS (SELECT h.*, coalesce(rl.real_ids, []) AS real_ids, coalesce(inv.invented_ids, []) AS invented_ids,
  len(coalesce(rl.real_ids, [])) = 0 AS rejected FROM hyps h LEFT JOIN rl USING (hypothesis_id) LEFT JOIN inv USING (hypothesis_id))"""


def grounded(spark, sf):
    return V.ground_hypotheses(O.hypotheses(spark, sf), O.evidence(spark, sf))


@register(
    "ground_hypotheses",
    sql="WITH " + SQL_CHECK + """
SELECT hypothesis_id, array_to_string(real_ids, ',') AS real_ids, array_to_string(invented_ids, ',') AS invented_ids, rejected FROM gh""",
)
def q_ground_hypotheses(spark, sf):
    g = grounded(spark, sf)
    return g.select("hypothesis_id", F.array_join("real_ids", ",").alias("real_ids"),
                    F.array_join("invented_ids", ",").alias("invented_ids"), "rejected")


SQL_SHORT = "CASE WHEN length(statement) <= 60 THEN statement ELSE substr(statement, 1, 60) || '...' END"


@register(
    "ground_problems",
    sql="WITH " + SQL_CHECK + f"""
SELECT hypothesis_id, array_to_string(list_filter([
  CASE WHEN len(invented_ids) > 0 THEN 'hypothesis ''' || {SQL_SHORT} || ''' cited ' || CAST(len(invented_ids) AS VARCHAR)
    || ' evidence id(s) that do not exist: ' || array_to_string(invented_ids[1:3], ', ') END,
  CASE WHEN rejected THEN 'hypothesis ''' || {SQL_SHORT} || ''' was rejected because no cited evidence exists' END],
  lambda x: x IS NOT NULL), ' | ') AS problems FROM gh""",
)
def q_ground_problems(spark, sf):
    return grounded(spark, sf).select("hypothesis_id", F.array_join("problems", " | ").alias("problems"))


@register(
    "ground_rank",
    sql="WITH " + SQL_CHECK + f"""
SELECT investigation_id, hypothesis_id, round(least(greatest(confidence, 0.0), 1.0), 9) AS confidence,
  row_number() OVER (PARTITION BY investigation_id ORDER BY least(greatest(confidence, 0.0), 1.0) DESC, position) AS rank
FROM gh WHERE NOT rejected""",
)
def q_ground_rank(spark, sf):
    r = V.rank_accepted(grounded(spark, sf))
    # prices carry 2 decimals, so confidence has at most 7: round at 9 to avoid ties
    return r.select("investigation_id", "hypothesis_id", F.round("confidence", 9).alias("confidence"), "rank")


@register(
    "ground_conclusive",
    sql="WITH " + SQL_CHECK + """,
res AS (SELECT 'inv-' || CAST(c_custkey AS VARCHAR) AS investigation_id, c_acctbal > 0 AS conclusive FROM customer),
acc AS (SELECT investigation_id, sum(CASE WHEN NOT rejected THEN 1 ELSE 0 END) AS accepted FROM gh GROUP BY ALL)
SELECT investigation_id, conclusive AND coalesce(accepted, 0) > 0 AS conclusive, CAST(coalesce(accepted, 0) AS BIGINT) AS accepted
FROM res LEFT JOIN acc USING (investigation_id)""",
)
def q_ground_conclusive(spark, sf):
    return V.conclusive(grounded(spark, sf), O.investigation_results(spark, sf))


SQL_REPORT_CHECK = O.SQL_EVIDENCE + ",\n" + O.SQL_REPORTS + """,
rx AS (SELECT report_id, incident_id, UNNEST(evidence_ids) AS cited, UNNEST(range(len(evidence_ids))) AS pos FROM reports),
rj AS (SELECT rx.*, CASE WHEN rx.incident_id IS NULL THEN EXISTS (SELECT 1 FROM evidence e WHERE e.evidence_id = rx.cited)
  ELSE EXISTS (SELECT 1 FROM evidence e WHERE e.evidence_id = rx.cited AND e.incident_id = rx.incident_id) END AS ok FROM rx),
rr AS (SELECT report_id, coalesce(list(cited ORDER BY pos) FILTER (WHERE ok), []) AS real_ids, count(*) AS cited_count,
  count(DISTINCT cited) FILTER (WHERE NOT ok) AS n_invented FROM rj GROUP BY ALL),
gr AS (SELECT r.report_id, r.kind, coalesce(rr.real_ids, []) AS real_ids, coalesce(rr.cited_count, 0) AS cited_count,
  coalesce(rr.n_invented, 0) AS n_invented FROM reports r LEFT JOIN rr USING (report_id))"""


@register(
    "ground_report",
    sql="WITH " + SQL_REPORT_CHECK + """
SELECT report_id, array_to_string(real_ids, ',') AS real_ids, array_to_string(list_filter([
  CASE WHEN n_invented > 0 THEN 'report cited ' || CAST(n_invented AS VARCHAR) || ' evidence id(s) that do not exist' END,
  CASE WHEN len(real_ids) = 0 THEN 'report cites no real evidence' END], lambda x: x IS NOT NULL), ' | ') AS problems
FROM gr WHERE kind = 'incident'""",
)
def q_ground_report(spark, sf):
    r = V.ground_report(O.reports(spark, sf).filter(F.col("kind") == "incident"), O.evidence(spark, sf))
    return r.select("report_id", F.array_join("real_ids", ",").alias("real_ids"), F.array_join("problems", " | ").alias("problems"))


@register(
    "ground_cluster_report",
    sql="WITH " + SQL_REPORT_CHECK + """
SELECT report_id, array_to_string(real_ids, ',') AS real_ids, array_to_string(list_filter([
  CASE WHEN cited_count - len(real_ids) > 0 THEN 'cluster report cited ' || CAST(cited_count - len(real_ids) AS VARCHAR)
    || ' evidence id(s) that do not exist' END], lambda x: x IS NOT NULL), ' | ') AS problems
FROM gr WHERE kind = 'cluster'""",
)
def q_ground_cluster_report(spark, sf):
    r = V.ground_report(O.reports(spark, sf).filter(F.col("kind") == "cluster"), O.evidence(spark, sf), cluster=True)
    return r.select("report_id", F.array_join("real_ids", ",").alias("real_ids"), F.array_join("problems", " | ").alias("problems"))


_PROPOSED = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN ' HIGH' WHEN '3-MEDIUM' THEN '1' WHEN '4-NOT SPECIFIED' THEN 'bogus' ELSE 'low' END"
_DETECTED = "CASE o_orderstatus WHEN 'F' THEN 'High' WHEN 'O' THEN 'Medium' ELSE 'Low' END"


@register(
    "triage_floor",
    sql=f"""WITH t AS (SELECT o_orderkey, {_PROPOSED} AS proposed, {_DETECTED} AS detected FROM orders),
r AS (SELECT *, CASE WHEN regexp_full_match(lower(trim(coalesce(proposed, ''))), '[0-3]') THEN CAST(lower(trim(proposed)) AS INTEGER)
  ELSE coalesce(list_position(['low', 'medium', 'high', 'critical'], lower(trim(coalesce(proposed, '')))), 0) - 1 END AS p_rank,
  list_position(['Low', 'Medium', 'High', 'Critical'], detected) - 1 AS d_rank FROM t)
SELECT o_orderkey, ['Low', 'Medium', 'High', 'Critical'][(CASE WHEN p_rank >= 0 THEN greatest(p_rank, d_rank) ELSE d_rank END) + 1] AS effective,
  CASE WHEN p_rank < 0 THEN 'triage returned an unknown severity ''' || proposed || '''; the detected severity is kept'
       WHEN p_rank < d_rank THEN 'triage proposed ' || ['Low', 'Medium', 'High', 'Critical'][p_rank + 1] || ' but detection measured '
         || detected || '; the higher severity is kept' END AS problem FROM r""",
)
def q_triage_floor(spark, sf):
    o = read(spark, sf, "orders")
    prop = F.expr(_PROPOSED)
    det = F.expr(_DETECTED)
    t = o.select("o_orderkey", prop.alias("proposed"), det.alias("detected"))
    eff, prob = V.triage_floor("proposed", "detected")
    return t.select("o_orderkey", eff.alias("effective"), prob.alias("problem"))


_FLAGS = """o_orderstatus = 'F' AND o_orderpriority = '5-LOW' AS recovered, o_orderkey % 11 <> 0 AS triage_ok,
  o_orderpriority <> '4-NOT SPECIFIED' AS actionable, o_orderkey % 13 <> 0 AS investigation_ok, o_orderkey % 17 <> 0 AS report_ok"""


@register(
    "final_state",
    sql="WITH " + SQL_CHECK + f""",
res AS (SELECT 'inv-' || CAST(c_custkey AS VARCHAR) AS investigation_id, c_acctbal > 0 AS conclusive FROM customer),
acc AS (SELECT investigation_id, sum(CASE WHEN NOT rejected THEN 1 ELSE 0 END) AS accepted FROM gh GROUP BY ALL),
cc AS (SELECT investigation_id, conclusive AND coalesce(accepted, 0) > 0 AS conclusive, coalesce(accepted, 0) AS accepted
  FROM res LEFT JOIN acc USING (investigation_id)),
fl AS (SELECT o_orderkey, 'inv-' || CAST(o_custkey AS VARCHAR) AS investigation_id, {_FLAGS} FROM orders)
SELECT o_orderkey, CASE WHEN recovered THEN 'Recovered' WHEN NOT triage_ok THEN 'Failed' WHEN NOT actionable THEN 'Ignored'
  WHEN NOT investigation_ok THEN 'Failed' WHEN NOT conclusive THEN 'Inconclusive' WHEN NOT report_ok THEN 'Failed' ELSE 'Reported' END AS final_state
FROM fl JOIN cc USING (investigation_id)""",
)
def q_final_state(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("inv-"), F.col("o_custkey").cast("string")).alias("investigation_id"),
                                         *[F.expr(x.strip()) for x in _FLAGS.split(",")])
    cc = V.conclusive(grounded(spark, sf), O.investigation_results(spark, sf))
    return V.final_state(o.join(cc, "investigation_id")).select("o_orderkey", "final_state")


@register(
    "findings_text",
    sql="WITH " + SQL_CHECK + """,
acc AS (SELECT *, least(greatest(confidence, 0.0), 1.0) AS conf,
  row_number() OVER (PARTITION BY investigation_id ORDER BY least(greatest(confidence, 0.0), 1.0) DESC, position) AS rank
  FROM gh WHERE NOT rejected)
SELECT investigation_id, string_agg(CAST(rank AS VARCHAR) || '. [' || CAST(CAST(floor(conf * 100 + 0.5) AS BIGINT) AS VARCHAR) || ' %] '
  || statement || ' (category: ' || coalesce(root_cause_category, '') || ', suspected workload: ' || coalesce(suspected_workload, '')
  || ', evidence: ' || array_to_string(real_ids, ', ') || ')', chr(10) ORDER BY rank) AS findings
FROM acc GROUP BY investigation_id""",
)
def q_findings_text(spark, sf):
    return V.findings_text(V.rank_accepted(grounded(spark, sf)))


# --- evidence ------------------------------------------------------------------------


@register(
    "evidence_select",
    sql="WITH " + O.SQL_EVIDENCE + f""",
ep AS (SELECT *, coalesce(list_position({_sql_list(KIND_PRIORITY)}, kind), {len(KIND_PRIORITY) + 1}) - 1 AS kp,
  count(*) OVER (PARTITION BY incident_id) AS n FROM evidence)
SELECT incident_id, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY kp, observed_at DESC, evidence_id) AS r FROM ep)
WHERE n <= 3 OR r <= 3""",
)
def q_evidence_select(spark, sf):
    return E.select(O.evidence(spark, sf), 3).select("incident_id", "evidence_id")


@register(
    "evidence_triage",
    sql="WITH " + O.SQL_EVIDENCE + f""",
ep AS (SELECT *, coalesce(list_position({_sql_list(KIND_PRIORITY)}, kind), {len(KIND_PRIORITY) + 1}) - 1 AS kp,
  count(*) OVER (PARTITION BY incident_id) AS n FROM evidence WHERE kind <> 'Runbook')
SELECT incident_id, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY kp, observed_at DESC, evidence_id) AS r FROM ep)
WHERE n <= 2 OR r <= 2""",
)
def q_evidence_triage(spark, sf):
    return E.triage_select(O.evidence(spark, sf), 2).select("incident_id", "evidence_id")


@register(
    "evidence_dedup",
    sql="""SELECT evidence_id, l_linenumber AS first_line FROM (SELECT 'ev-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber % 3 AS VARCHAR) AS evidence_id,
  l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber) AS r FROM lineitem) WHERE r = 1""",
)
def q_evidence_dedup(spark, sf):
    li = read(spark, sf, "lineitem").select(
        F.concat(F.lit("ev-"), F.col("l_orderkey").cast("string"), F.lit("-"), (F.col("l_linenumber") % 3).cast("string")).alias("evidence_id"),
        F.col("l_linenumber").alias("first_line"),
    )
    return E.dedup(li, ["first_line"])


@register(
    "sink_insert_ignore",
    sql="WITH " + O.SQL_EVIDENCE + """,
inc AS (SELECT evidence_id, l_linenumber AS line FROM (SELECT 'ev-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber % 7 AS VARCHAR) AS evidence_id,
  l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 7 ORDER BY l_linenumber) AS r FROM lineitem) WHERE r = 1)
SELECT evidence_id, line FROM inc WHERE evidence_id NOT IN (SELECT evidence_id FROM evidence)""",
)
def q_sink_insert_ignore(spark, sf):
    incoming = read(spark, sf, "lineitem").select(
        F.concat(F.lit("ev-"), F.col("l_orderkey").cast("string"), F.lit("-"), (F.col("l_linenumber") % 7).cast("string")).alias("evidence_id"),
        F.col("l_linenumber").alias("line"),
    )
    return E.insert_ignore(O.evidence(spark, sf), incoming, ["line"])


@register(
    "evidence_by_kind",
    sql="WITH " + O.SQL_EVIDENCE + """
SELECT incident_id, kind, count(*) AS n, array_to_string(list(evidence_id ORDER BY observed_at DESC, evidence_id DESC), ',') AS ids
FROM evidence GROUP BY ALL""",
)
def q_evidence_by_kind(spark, sf):
    b = E.by_kind(O.evidence(spark, sf))
    return b.select("incident_id", "kind", "n", F.array_join("ids", ",").alias("ids"))


@register(
    "evidence_of_kind",
    sql="WITH " + O.SQL_EVIDENCE + "\nSELECT incident_id, evidence_id FROM evidence WHERE kind = 'Metric'",
)
def q_evidence_of_kind(spark, sf):
    return O.evidence(spark, sf).filter(F.col("kind") == "Metric").select("incident_id", "evidence_id")


@register(
    "evidence_by_id",
    sql="WITH " + O.SQL_EVIDENCE + ",\n" + O.SQL_REPORTS + """
SELECT incident_id, evidence_id, kind FROM evidence
WHERE evidence_id IN (SELECT UNNEST(evidence_ids) FROM reports WHERE kind = 'cluster')""",
)
def q_evidence_by_id(spark, sf):
    """Lookup by id, for every id a cluster report cites at once (left-semi join)."""
    ids = O.reports(spark, sf).filter(F.col("kind") == "cluster").select(F.explode("evidence_ids").alias("evidence_id"))
    return O.evidence(spark, sf).join(ids, "evidence_id", "left_semi").select("incident_id", "evidence_id", "kind")


SQL_COMPLETE = "WITH " + O.SQL_EVIDENCE + """,
inc AS (SELECT 'inc-' || CAST(o_orderkey AS VARCHAR) AS incident_id FROM orders),
ks AS (SELECT incident_id, list(DISTINCT kind) AS kinds FROM evidence GROUP BY ALL),
fl AS (SELECT 'inc-' || CAST(o_orderkey AS VARCHAR) AS incident_id, list_filter([
  CASE WHEN o_orderkey % 5 = 0 THEN 'log signatures (TimeoutException)' END,
  CASE WHEN o_orderkey % 3 = 0 THEN 'service metrics (HttpRequestException)' END], lambda x: x IS NOT NULL) AS missing FROM orders),
cm AS (SELECT incident_id, missing, coalesce(kinds, []) AS kinds FROM inc LEFT JOIN ks USING (incident_id) JOIN fl USING (incident_id))"""


def _source_failures(o):
    """(incident_id, source): the telemetry calls that failed while an incident's bundle was collected."""
    failed = F.array_compact(F.array(F.when(F.col("o_orderkey") % 5 == 0, "log signatures (TimeoutException)"),
                                     F.when(F.col("o_orderkey") % 3 == 0, "service metrics (HttpRequestException)")))
    return o.select(F.concat(F.lit("inc-"), F.col("o_orderkey").cast("string")).alias("incident_id"), F.explode(failed).alias("source"))


@register(
    "evidence_completeness",
    sql=SQL_COMPLETE + "\nSELECT incident_id, array_to_string(missing, ',') AS unavailable_sources, len(missing) = 0 AS is_complete FROM cm",
)
def q_evidence_completeness(spark, sf):
    o = read(spark, sf, "orders")
    inc = o.select(F.concat(F.lit("inc-"), F.col("o_orderkey").cast("string")).alias("incident_id"))
    c = E.completeness(O.evidence(spark, sf), inc, _source_failures(o))
    return c.select("incident_id", F.array_join("unavailable_sources", ",").alias("unavailable_sources"), "is_complete")


@register(
    "evidence_api_check",
    sql=SQL_COMPLETE + "\nSELECT incident_id, len(missing) = 0 AND list_contains(kinds, 'KubernetesState') AND list_contains(kinds, 'Metric') AS api_check FROM cm",
)
def q_evidence_api_check(spark, sf):
    o = read(spark, sf, "orders")
    inc = o.select(F.concat(F.lit("inc-"), F.col("o_orderkey").cast("string")).alias("incident_id"))
    return E.completeness(O.evidence(spark, sf), inc, _source_failures(o)).select("incident_id", "api_check")


_KINDS = _sql_list(KIND_PRIORITY)
_SECTIONS = ", ".join(f"('{k}', {i + 1}, '{h}')" for i, (k, h) in enumerate(E.DIGEST_SECTIONS))


@register(
    "evidence_digest",
    sql="WITH " + O.SQL_EVIDENCE + f""",
sec AS (SELECT * FROM (VALUES {_SECTIONS}) t(kind, r, heading)),
tr AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY list_position({_KINDS}, kind) - 1, observed_at DESC, evidence_id) AS rn FROM evidence),
blk AS (SELECT e.incident_id, sec.r, sec.heading, e.observed_at, e.evidence_id,
  '<evidence id="' || e.evidence_id || '" source="' || e.source || '" at="' || strftime(e.observed_at, '%Y-%m-%d %H:%M:%SZ') || '">' || chr(10)
  || e.summary || chr(10) || '</evidence>' || chr(10) AS b FROM tr e JOIN sec USING (kind) WHERE rn <= 60),
ks AS (SELECT incident_id, r, count(*) AS n, '### ' || any_value(heading) || chr(10) || string_agg(b, '' ORDER BY observed_at DESC, evidence_id) AS s
  FROM blk GROUP BY incident_id, r)
SELECT incident_id, string_agg(s, chr(10) ORDER BY r) || chr(10) AS digest, CAST(sum(n) AS BIGINT) AS items FROM ks GROUP BY incident_id""",
)
def q_evidence_digest(spark, sf):
    return E.digest(O.evidence(spark, sf), 60)


# --- reports -----------------------------------------------------------------------------


@register("report_latest", sql="WITH " + O.SQL_REPORTS + "\nSELECT report_id, created_at FROM reports ORDER BY created_at DESC, report_id DESC LIMIT 1")
def q_report_latest(spark, sf):
    return RP.latest(O.reports(spark, sf)).select("report_id", "created_at")


@register("report_list", sql="WITH " + O.SQL_REPORTS + "\nSELECT report_id, created_at FROM reports ORDER BY created_at DESC, report_id DESC LIMIT 20")
def q_report_list(spark, sf):
    return RP.newest(O.reports(spark, sf), 20).select("report_id", "created_at")


@register(
    "report_for_incident",
    sql="WITH " + O.SQL_REPORTS + "\nSELECT incident_id, arg_max(report_id, (created_at, report_id)) AS report_id FROM reports WHERE incident_id IS NOT NULL GROUP BY ALL",
)
def q_report_for_incident(spark, sf):
    return RP.for_incident(O.reports(spark, sf)).select("incident_id", "report_id")


@register(
    "report_evidence",
    sql="WITH " + O.SQL_EVIDENCE + ",\n" + O.SQL_REPORTS + """
SELECT DISTINCT r.report_id, e.evidence_id, e.kind FROM (SELECT report_id, incident_id, UNNEST(evidence_ids) AS evidence_id FROM reports WHERE kind = 'incident') r
JOIN evidence e ON e.incident_id = r.incident_id AND e.evidence_id = r.evidence_id""",
)
def q_report_evidence(spark, sf):
    return RP.cited_evidence(O.reports(spark, sf), O.evidence(spark, sf)).select("report_id", "evidence_id", "kind")


@register(
    "report_link_check",
    sql="WITH " + O.SQL_REPORTS + "\nSELECT report_id FROM reports WHERE kind = 'incident' AND (incident_id IS NULL OR investigation_id IS NULL)",
)
def q_report_link_check(spark, sf):
    return RP.link_violations(O.reports(spark, sf)).select("report_id")


@register(
    "agent_stats",
    sql=f"""WITH ex AS (SELECT {_sql_list(O.AGENTS)}[l_linenumber % 3 + 1] AS agent, l_shipdate AS started_at,
  l_shipdate + to_microseconds(CAST(l_quantity * 1000000 AS BIGINT)) AS finished_at,
  CASE WHEN CAST(l_quantity AS INTEGER) % 4 > 0 THEN list_transform(range(CAST(l_quantity AS INTEGER) % 4),
    lambda i: {_sql_list(O.TOOLS)}[(l_partkey + i) % 5 + 1]) ELSE [] END AS tools, l_discount < 0.05 AS succeeded FROM lineitem)
SELECT agent, count(*) AS executions, CAST(sum(epoch_ms(finished_at) - epoch_ms(started_at)) AS BIGINT) AS total_ms,
  max(epoch_ms(finished_at) - epoch_ms(started_at)) AS max_ms, CAST(sum(len(tools)) AS BIGINT) AS tool_calls,
  CAST(sum(len(list_distinct(tools))) AS BIGINT) AS distinct_tool_calls, CAST(sum(CAST(succeeded AS INTEGER)) AS BIGINT) AS succeeded FROM ex GROUP BY agent""",
)
def q_agent_stats(spark, sf):
    return RP.agent_stats(O.executions(spark, sf))


# --- queue ---------------------------------------------------------------------------------


@register("queue_depth", sql="WITH " + O.SQL_WORK_ITEMS + "\nSELECT state, count(*) AS n FROM wi GROUP BY state")
def q_queue_depth(spark, sf):
    return RP.queue_depth(O.work_items(spark, sf))


@register(
    "enqueue_dedup",
    sql="WITH " + O.SQL_WORK_ITEMS + """,
rq AS (SELECT o_orderpriority AS kind, CAST(o_custkey AS VARCHAR) AS dedup_key, min(o_orderkey) AS o_orderkey FROM orders
  WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT kind, dedup_key, o_orderkey FROM rq WHERE NOT EXISTS (SELECT 1 FROM wi WHERE wi.state IN ('Pending', 'Claimed')
  AND wi.kind = rq.kind AND wi.dedup_key = rq.dedup_key)""",
)
def q_enqueue_dedup(spark, sf):
    o = read(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    req = o.select(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").cast("string").alias("dedup_key"), "o_orderkey")
    return RP.enqueue_dedup(O.work_items(spark, sf), req, "o_orderkey")


@register(
    "claimable",
    sql="WITH " + O.SQL_WORK_ITEMS + f"""
SELECT id, state, available_at FROM wi WHERE (state = 'Pending' AND available_at <= TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}')
  OR (state = 'Claimed' AND leased_until < TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}') ORDER BY available_at, id LIMIT 20""",
)
def q_claimable(spark, sf):
    return RP.claimable(O.work_items(spark, sf), NOW, 20).select("id", "state", "available_at")


@register(
    "retry_schedule",
    sql="WITH " + O.SQL_WORK_ITEMS + """
SELECT id, attempt, CASE WHEN attempt >= max_attempts THEN 'Failed' ELSE 'Pending' END AS next_state,
  CASE WHEN attempt >= max_attempts THEN 0.0 ELSE least(30.0 * pow(2.0, greatest(0, attempt - 1)), 900.0) END AS delay_seconds FROM wi""",
)
def q_retry_schedule(spark, sf):
    return RP.retry_schedule(O.work_items(spark, sf))


_CUST_STATE = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Candidate' WHEN 'AUTOMOBILE' THEN 'Investigating' WHEN 'MACHINERY' THEN 'Reported' WHEN 'HOUSEHOLD' THEN 'Failed' ELSE 'Triaging' END"


@register(
    "stranded_incidents",
    sql="WITH " + O.SQL_WORK_ITEMS + f""",
inc AS (SELECT CAST(c_custkey AS VARCHAR) AS incident_id, {_CUST_STATE} AS state FROM customer)
SELECT incident_id, state FROM inc WHERE state IN ('Candidate', 'Triaging', 'Investigating', 'Failed')
  AND incident_id NOT IN (SELECT dedup_key FROM wi WHERE state IN ('Pending', 'Claimed') AND kind = '1-URGENT')""",
)
def q_stranded_incidents(spark, sf):
    """Investigation work items are the '1-URGENT' kind; an in-flight
    incident (customer) with no active one of those is stranded."""
    inc = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("incident_id"), F.expr(_CUST_STATE).alias("state"))
    return RP.stranded(inc, O.work_items(spark, sf).filter(F.col("kind") == "1-URGENT"))


@register("stale_leases", sql="WITH " + O.SQL_WORK_ITEMS + "\nSELECT id, leased_until FROM wi WHERE state = 'Claimed' AND leased_by = 'worker-1'")
def q_stale_leases(spark, sf):
    return RP.stale_leases(O.work_items(spark, sf), "worker-1").select("id", "leased_until")


@register(
    "pending_batch",
    sql="WITH " + O.SQL_WORK_ITEMS + "\nSELECT id, available_at FROM wi WHERE state = 'Pending' ORDER BY available_at, id LIMIT 20",
)
def q_pending_batch(spark, sf):
    return O.work_items(spark, sf).filter(F.col("state") == "Pending").orderBy("available_at", "id").limit(20).select("id", "available_at")


@register("pending_depth", sql="WITH " + O.SQL_WORK_ITEMS + "\nSELECT count(*) AS pending FROM wi WHERE state = 'Pending'")
def q_pending_depth(spark, sf):
    return O.work_items(spark, sf).filter(F.col("state") == "Pending").agg(F.count(F.lit(1)).alias("pending"))


@register("order_lookup", sql="SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey = 4242")
def q_order_lookup(spark, sf):
    return read(spark, sf, "orders").filter(F.col("o_orderkey") == 4242).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@register("recent_orders", sql="SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def q_recent_orders(spark, sf):
    return read(spark, sf, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(10).select("o_orderkey", "o_orderdate")
