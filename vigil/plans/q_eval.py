"""Evaluation queries: retrieval gold cases, report scoring,
scenario checks, startup report check."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.config import replay_params
from vigil.operators import evaluate as X
from vigil.operators import memory as SM
from vigil.operators import reports as RP
from vigil.plans.registry import register
from vigil.sources import orderdata as O
from vigil.sources import testdata as T

P = replay_params(embedding_dim=64, max_distance=2.0)


def _gold_queries(spark, sf):
    q = T.memory_queries(spark, sf)
    return q.select("query_id", "embedding", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("workload"),
                    F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("exclude_incident_id"))


def _gold(spark, sf):
    e = T.read(spark, sf, "embeddings").select("label").distinct()
    rb = F.col("label") >= 5
    return e.select(F.concat(F.lit("q-c"), F.col("label").cast("string")).alias("query_id"),
                    F.when(rb, "runbook/").otherwise("incident/").alias("expected_source_prefix"),
                    F.when(rb, "incident/").otherwise("runbook/").alias("must_not_rank_first"))


@register(
    "retrieval_eval",
    sql=f"""WITH {T.SQL_MEMORY}, {T.sql_memory_queries()},
pr AS (SELECT q.query_id, m.id, m.source_ref, 1 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[]))
  / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
     * sqrt(list_dot_product(CAST(m.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])))) AS distance FROM queries q, mem m),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pr) WHERE rank <= 5),
gold AS (SELECT DISTINCT 'q-c' || CAST(label AS VARCHAR) AS query_id, CASE WHEN label >= 5 THEN 'runbook/' ELSE 'incident/' END AS expected_source_prefix,
  CASE WHEN label >= 5 THEN 'incident/' ELSE 'runbook/' END AS must_not_rank_first FROM embeddings),
g AS (SELECT gold.query_id, min(CASE WHEN starts_with(source_ref, expected_source_prefix) THEN rank END) AS hit_rank,
  max(CASE WHEN rank = 1 AND starts_with(source_ref, must_not_rank_first) THEN 1 ELSE 0 END) = 1 AS wrong_first, count(rank) AS n
  FROM gold LEFT JOIN rk USING (query_id) GROUP BY ALL)
SELECT query_id, hit_rank, wrong_first, n > 0 AND hit_rank IS NOT NULL AND NOT wrong_first AS passed FROM g""",
)
def q_retrieval_eval(spark, sf):
    res = SM.search(T.memory(spark, sf), _gold_queries(spark, sf), P)
    return X.retrieval_eval(res, _gold(spark, sf))


def _eval_reports(spark, sf):
    o = T.read(spark, sf, "orders").filter(F.col("o_orderstatus") != "P")
    k = F.col("o_orderkey")
    return o.join(O.citations(spark, sf), k == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("rep-"), k.cast("string")).alias("report_id"),
        F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("scenario"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("svc-"), (k % 8).cast("string"), F.lit(" is failing")).alias("summary"),
        F.when(k % 3 == 0, F.lit("Pod crash observed")).otherwise(F.lit("latency up")).alias("impact"),
        F.when(k % 4 == 0, F.concat(F.lit("Root cause is svc-"), ((k + 1) % 8).cast("string")))
        .otherwise(F.concat(F.lit("caused by svc-"), (k % 8).cast("string"))).alias("likely_root_cause"),
        F.when(k % 2 == 0, F.lit("dependency-latency")).otherwise(F.lit("memory_limit")).alias("root_cause_category"),
        F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))).alias("cited"),
    )


def _expected(spark, sf):
    r = T.read(spark, sf, "region")
    k = F.col("r_regionkey")
    return r.select(
        F.concat(F.lit("s"), k.cast("string")).alias("scenario"),
        F.concat(F.lit("svc-"), k.cast("string")).alias("root_cause_workload"),
        F.when(k % 2 == 0, F.lit("dependency_latency")).otherwise(F.lit("out_of_memory")).alias("root_cause_category"),
        F.array(F.concat(F.lit("svc-"), (k + 1).cast("string"))).alias("victims"),
        (k % 2 == 1).alias("expect_disruption"),
    )


SQL_EVAL = "WITH " + O.SQL_EVIDENCE + ",\n" + O.SQL_REPORTS + """,
rep AS (SELECT 'rep-' || CAST(o_orderkey AS VARCHAR) AS report_id, 's' || CAST(o_custkey % 5 AS VARCHAR) AS scenario,
  lower(concat_ws(' ', o_orderpriority, 'svc-' || CAST(o_orderkey % 8 AS VARCHAR) || ' is failing',
    CASE WHEN o_orderkey % 3 = 0 THEN 'Pod crash observed' ELSE 'latency up' END,
    CASE WHEN o_orderkey % 4 = 0 THEN 'Root cause is svc-' || CAST((o_orderkey + 1) % 8 AS VARCHAR)
         ELSE 'caused by svc-' || CAST(o_orderkey % 8 AS VARCHAR) END)) AS txt,
  CASE WHEN o_orderkey % 2 = 0 THEN 'dependency-latency' ELSE 'memory_limit' END AS rc
  FROM orders WHERE o_orderstatus <> 'P'),
cited AS (SELECT report_id, len(evidence_ids) AS cited FROM reports),
res AS (SELECT report_id, count(*) AS resolved FROM (SELECT r.report_id, e.evidence_id FROM
  (SELECT report_id, incident_id, UNNEST(evidence_ids) AS evidence_id FROM reports WHERE kind = 'incident') r
  JOIN evidence e ON e.incident_id = r.incident_id AND e.evidence_id = r.evidence_id GROUP BY ALL) GROUP BY report_id),
ex AS (SELECT 's' || CAST(r_regionkey AS VARCHAR) AS scenario, 'svc-' || CAST(r_regionkey AS VARCHAR) AS culprit,
  CASE WHEN r_regionkey % 2 = 0 THEN 'dependency_latency' ELSE 'out_of_memory' END AS ec,
  ['svc-' || CAST(r_regionkey + 1 AS VARCHAR)] AS victims, r_regionkey % 2 = 1 AS expect_disruption FROM region),
sc AS (SELECT rep.report_id, rep.scenario, contains(txt, lower(culprit)) AS names_culprit,
  len(list_filter(list_intersect(list_distinct(string_split(replace(lower(rc), '-', '_'), '_')), list_distinct(string_split(replace(lower(ec), '-', '_'), '_'))),
    lambda w: NOT list_contains(['the', 'a', 'of', 'and', 'is', 'was'], w))) > 0 AS category_matches,
  NOT len(list_filter(victims, lambda v: contains(txt, 'root cause is ' || v) OR contains(txt, 'root cause is the ' || v)
    OR contains(txt, 'caused by ' || v) OR contains(txt, v || ' is the root cause'))) > 0 AS no_victim_blamed,
  coalesce(cited, 0) > 0 AND coalesce(cited, 0) = coalesce(resolved, 0) AS citations_resolve,
  CASE WHEN expect_disruption THEN NULL ELSE NOT (contains(txt, 'crashloop') OR contains(txt, 'oomkill') OR contains(txt, 'pod crash')
    OR contains(txt, 'restarted repeatedly')) END AS no_invented_pod_failure
  FROM rep JOIN ex USING (scenario) LEFT JOIN cited USING (report_id) LEFT JOIN res USING (report_id))"""


def _scored(spark, sf):
    resolved = RP.cited_evidence(O.reports(spark, sf), O.evidence(spark, sf)).groupBy("report_id").agg(
        F.count_distinct("evidence_id").alias("resolved"))
    return X.report_score(_eval_reports(spark, sf), _expected(spark, sf), resolved)


@register(
    "report_score",
    sql=SQL_EVAL + """
SELECT report_id, scenario, names_culprit, category_matches, no_victim_blamed, citations_resolve, no_invented_pod_failure,
  names_culprit AND category_matches AND no_victim_blamed AND citations_resolve AND coalesce(no_invented_pod_failure, true) AS passed FROM sc""",
)
def q_report_score(spark, sf):
    return _scored(spark, sf)


@register("category_overlap", sql=SQL_EVAL + "\nSELECT report_id, category_matches FROM sc")
def q_category_overlap(spark, sf):
    return _scored(spark, sf).select("report_id", "category_matches")


@register("victim_phrases", sql=SQL_EVAL + "\nSELECT report_id, NOT no_victim_blamed AS blames_victim FROM sc")
def q_victim_phrases(spark, sf):
    return _scored(spark, sf).select("report_id", (~F.col("no_victim_blamed")).alias("blames_victim"))


SUBSTRINGS = ["Timed Out", "retrying"]


@register(
    "scenario_signal",
    sql="WITH " + T.sql_pod_snapshots() + ",\n" + T.SQL_LOGS_ONLY + """,
sc AS (SELECT DISTINCT namespace || '@' || strftime(snapshot_ts - INTERVAL 1 DAY, '%Y-%m-%d') AS scenario,
  CASE WHEN day(snapshot_ts) % 2 = 0 THEN ['CrashLoopBackOff'] ELSE ['OOMKilled'] END AS expected_conditions,
  ['Timed Out', 'retrying'] AS expected_log_substrings, dayofweek(snapshot_ts) <> 0 AS expect_disruption FROM pods),
obs AS (SELECT DISTINCT scenario, c FROM (SELECT namespace || '@' || strftime(snapshot_ts - INTERVAL 1 DAY, '%Y-%m-%d') AS scenario,
  UNNEST([waiting_reason, last_termination_reason, CASE WHEN NOT ready THEN 'NotReady' END]) AS c FROM pods) WHERE c IS NOT NULL),
oc AS (SELECT scenario, list(c) AS conds FROM obs GROUP BY ALL),
hits AS (SELECT DISTINCT namespace || '@' || strftime(ts, '%Y-%m-%d') AS scenario, h FROM logs,
  (SELECT UNNEST(['timed out', 'retrying']) AS h) t WHERE contains(lower(line), h)),
hf AS (SELECT scenario, list(h) AS found FROM hits GROUP BY ALL),
j AS (SELECT sc.*, coalesce(conds, []) AS conds, coalesce(found, []) AS found FROM sc LEFT JOIN oc USING (scenario) LEFT JOIN hf USING (scenario))
SELECT scenario, len(list_intersect(expected_conditions, conds)) > 0 AS condition_seen,
  len(list_filter(expected_log_substrings, lambda s: NOT list_contains(found, lower(s)))) = 0 AS log_substrings_seen,
  expect_disruption OR len(list_filter(conds, lambda c: c <> 'NotReady')) = 0 AS no_unexpected_disruption,
  len(list_intersect(expected_conditions, conds)) > 0 AND len(list_filter(expected_log_substrings, lambda s: NOT list_contains(found, lower(s)))) = 0
  AND (expect_disruption OR len(list_filter(conds, lambda c: c <> 'NotReady')) = 0) AS passed FROM j""",
)
def q_scenario_signal(spark, sf):
    pods = T.pod_snapshots(spark, sf)
    scen = F.concat(F.col("namespace"), F.lit("@"), F.date_format(F.col("snapshot_ts") - F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd"))
    scenarios = pods.select(
        scen.alias("scenario"),
        F.when(F.dayofmonth("snapshot_ts") % 2 == 0, F.array(F.lit("CrashLoopBackOff"))).otherwise(F.array(F.lit("OOMKilled"))).alias("expected_conditions"),
        F.array(*[F.lit(s) for s in SUBSTRINGS]).alias("expected_log_substrings"),
        (F.dayofweek("snapshot_ts") != 1).alias("expect_disruption"),  # Spark: Sunday = 1
    ).distinct()
    observed = pods.select(scen.alias("scenario"), F.explode(F.array_compact(F.array(
        "waiting_reason", "last_termination_reason", F.when(~F.col("ready"), F.lit("NotReady"))))).alias("condition"))
    lines = T.logs(spark, sf).select(F.concat(F.col("namespace"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd")).alias("scenario"), "line")
    return X.scenario_signal(observed, scenarios, lines, SUBSTRINGS)


@register(
    "pod_reasons_vs_baseline",
    sql="WITH " + T.sql_pod_snapshots() + """,
base AS (SELECT namespace, pod, arg_min(restart_count, snapshot_ts) AS base_restarts FROM pods WHERE pod NOT LIKE '%3' GROUP BY ALL),
pr AS (SELECT pods.*, coalesce(base_restarts, 0) AS base_restarts FROM pods LEFT JOIN base USING (namespace, pod))
SELECT namespace, pod, snapshot_ts, array_to_string(list_filter([CASE WHEN NOT ready THEN 'NotReady' END,
  CASE WHEN restart_count > base_restarts THEN 'Restarted' END, waiting_reason,
  CASE WHEN restart_count > base_restarts THEN last_termination_reason END], lambda x: x IS NOT NULL), ',') AS reasons
FROM pr""",
)
def q_pod_reasons_vs_baseline(spark, sf):
    pods = T.pod_snapshots(spark, sf)
    # pods whose name ends in 3 came after the baseline was taken
    base = pods.filter(~F.col("pod").endswith("3")).groupBy("namespace", "pod").agg(F.min_by("restart_count", "snapshot_ts").alias("restart_count"))
    r = X.pod_reasons(pods, base)
    return r.select("namespace", "pod", "snapshot_ts", F.array_join("reasons", ",").alias("reasons"))


@register(
    "startup_report_check",
    sql="WITH " + O.SQL_REPORTS + """
SELECT report_id, (CASE title WHEN '1-URGENT' THEN 'Degraded' WHEN '5-LOW' THEN 'Healthy' ELSE 'Unknown' END) IN ('Healthy', 'Degraded')
  AND len(evidence_ids) >= 1 AND incident_id IS NULL AS passed FROM reports WHERE kind = 'cluster'""",
)
def q_startup_report_check(spark, sf):
    r = O.reports(spark, sf).filter(F.col("kind") == "cluster")
    status = F.when(F.col("title") == "1-URGENT", "Degraded").when(F.col("title") == "5-LOW", "Healthy").otherwise("Unknown")
    return r.select("report_id", (status.isin("Healthy", "Degraded") & (F.size("evidence_ids") >= 1) & F.col("incident_id").isNull()).alias("passed"))
