"""Adapters over orders / lineitem / customer: evidence items, agent
hypotheses and reports that cite them, investigations, work items and agent
executions. Each is a projection or grouping of the given tables (SQL twins
below for the oracle).

  evidence      one item per lineitem that exists as evidence: line number
                at most 5 and return flag not 'R' (other cited ids are
                "invented"); kind by part key; incident 'inc-' || order key
  hypotheses    one per order: cites all of its lineitem ids in line order;
                investigation = customer; confidence from the total price
  reports       one per order, kind 'cluster' for status P else 'incident'
  work_items    one per order (state from status: O Pending, P Claimed, F Completed)
  executions    one per lineitem: agent by line number, duration from quantity
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.functions.ids import KIND_PRIORITY
from vigil.sources.testdata import read

AGENTS = ["triage", "investigation", "report"]
TOOLS = ["search_logs", "pod_status", "service_metrics", "kubernetes_events", "runbooks"]
NOW = "1996-06-01 00:00:00"


def _lid(o="l_orderkey", n="l_linenumber"):
    return F.concat(F.lit("ev-"), F.col(o).cast("string"), F.lit("-"), F.col(n).cast("string"))


def evidence(spark, sf) -> DataFrame:
    li = read(spark, sf, "lineitem")
    kinds = F.array(*[F.lit(k) for k in KIND_PRIORITY])
    li = li.filter((F.col("l_linenumber") <= 5) & (F.col("l_returnflag") != "R"))
    # Ids repeat in lineitem; evidence is insert-or-ignore, so the first write wins.
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    li = li.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1)
    return li.select(
        F.concat(F.lit("inc-"), F.col("l_orderkey").cast("string")).alias("incident_id"),
        _lid().alias("evidence_id"),
        F.element_at(kinds, (F.col("l_partkey") % 7 + 1).cast("int")).alias("kind"),
        F.lit("lineitem").alias("source"),
        F.col("l_shipdate").alias("observed_at"),
        F.concat(F.lit("svc-"), (F.col("l_suppkey") % 8).cast("string")).alias("workload"),
        F.concat(F.lit("qty "), F.col("l_quantity").cast("bigint").cast("string"), F.lit(" flag "), F.col("l_returnflag")).alias("summary"),
    )


def citations(spark, sf) -> DataFrame:
    """(l_orderkey, evidence_ids in line order) - one grouped row per order."""
    li = read(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", _lid().alias("id")))), lambda x: x["id"]).alias("evidence_ids")
    )


def hypotheses(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    c = citations(spark, sf)
    return o.join(c, o["o_orderkey"] == c["l_orderkey"], "left").select(
        F.concat(F.lit("hyp-"), F.col("o_orderkey").cast("string")).alias("hypothesis_id"),
        F.concat(F.lit("inv-"), F.col("o_custkey").cast("string")).alias("investigation_id"),
        F.concat(F.lit("inc-"), F.col("o_orderkey").cast("string")).alias("incident_id"),
        F.col("o_orderkey").alias("position"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" placed with priority "), F.col("o_orderpriority"),
                 F.lit(" is in state "), F.col("o_orderstatus")).alias("statement"),
        F.col("o_orderstatus").alias("root_cause_category"),
        F.concat(F.lit("svc-"), (F.col("o_custkey") % 8).cast("string")).alias("suspected_workload"),
        (F.col("o_totalprice") / 200000 - 0.1).alias("confidence"),
        F.coalesce(F.col("evidence_ids"), F.array().cast("array<string>")).alias("evidence_ids"),
    )


def investigation_results(spark, sf) -> DataFrame:
    cu = read(spark, sf, "customer")
    return cu.select(F.concat(F.lit("inv-"), F.col("c_custkey").cast("string")).alias("investigation_id"),
                     (F.col("c_acctbal") > 0).alias("conclusive"))


def reports(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    c = citations(spark, sf)
    kind = F.when(F.col("o_orderstatus") == "P", "cluster").otherwise("incident")
    inc = F.when(kind == "incident", F.concat(F.lit("inc-"), F.col("o_orderkey").cast("string")))
    inv = F.when((kind == "incident") & (F.col("o_orderkey") % 10 != 0), F.concat(F.lit("inv-"), F.col("o_custkey").cast("string")))
    return o.join(c, o["o_orderkey"] == c["l_orderkey"], "left").select(
        F.concat(F.lit("rep-"), F.col("o_orderkey").cast("string")).alias("report_id"),
        kind.alias("kind"),
        inc.alias("incident_id"),
        inv.alias("investigation_id"),
        (F.col("o_orderdate") + F.make_interval(secs=F.col("o_orderkey") % 86400)).alias("created_at"),
        F.coalesce(F.col("evidence_ids"), F.array().cast("array<string>")).alias("evidence_ids"),
        F.col("o_orderpriority").alias("title"),
    )


def work_items(spark, sf) -> DataFrame:
    o = read(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "Pending").when(F.col("o_orderstatus") == "P", "Claimed").otherwise("Completed")
    return o.select(
        F.concat(F.lit("wi-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderpriority").alias("kind"),
        F.col("o_custkey").cast("string").alias("dedup_key"),
        state.alias("state"),
        (F.col("o_orderkey") % 5).cast("int").alias("attempt"),
        F.lit(3).alias("max_attempts"),
        F.col("o_orderdate").alias("available_at"),
        F.when(state == "Claimed", F.col("o_orderdate") + F.expr("INTERVAL 40 MINUTES")).alias("leased_until"),
        F.when(state == "Claimed", F.concat(F.lit("worker-"), (F.col("o_orderkey") % 4).cast("string"))).alias("leased_by"),
    )


def executions(spark, sf) -> DataFrame:
    li = read(spark, sf, "lineitem")
    agents = F.array(*[F.lit(a) for a in AGENTS])
    tools = F.array(*[F.lit(t) for t in TOOLS])
    n_tools = (F.col("l_quantity").cast("int") % 4).cast("int")
    picked = F.transform(F.sequence(F.lit(0), F.greatest(n_tools - 1, F.lit(0))), lambda i: F.element_at(tools, ((F.col("l_partkey") + i) % 5 + 1).cast("int")))
    return li.select(
        F.concat(F.lit("inv-"), F.col("l_orderkey").cast("string")).alias("investigation_id"),
        F.element_at(agents, (F.col("l_linenumber") % 3 + 1).cast("int")).alias("agent"),
        F.col("l_shipdate").alias("started_at"),
        (F.col("l_shipdate") + F.make_interval(secs=F.col("l_quantity"))).alias("finished_at"),
        F.when(n_tools > 0, picked).otherwise(F.array().cast("array<string>")).alias("tools"),
        (F.col("l_discount") < 0.05).alias("succeeded"),
    )


# --- SQL twins -----------------------------------------------------------------

def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


SQL_EVIDENCE = f"""evidence AS (SELECT 'inc-' || CAST(l_orderkey AS VARCHAR) AS incident_id,
  'ev-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS evidence_id,
  {_sql_list(KIND_PRIORITY)}[l_partkey % 7 + 1] AS kind, 'lineitem' AS source, l_shipdate AS observed_at,
  'svc-' || CAST(l_suppkey % 8 AS VARCHAR) AS workload,
  'qty ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' flag ' || l_returnflag AS summary
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS r
        FROM lineitem WHERE l_linenumber <= 5 AND l_returnflag <> 'R') WHERE r = 1)"""

SQL_CITATIONS = """cit AS (SELECT l_orderkey, list('ev-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)
  ORDER BY l_linenumber) AS evidence_ids FROM lineitem GROUP BY l_orderkey)"""

SQL_HYPOTHESES = SQL_CITATIONS + """,
hyps AS (SELECT 'hyp-' || CAST(o_orderkey AS VARCHAR) AS hypothesis_id, 'inv-' || CAST(o_custkey AS VARCHAR) AS investigation_id,
  'inc-' || CAST(o_orderkey AS VARCHAR) AS incident_id, o_orderkey AS position,
  'Order ' || CAST(o_orderkey AS VARCHAR) || ' placed with priority ' || o_orderpriority || ' is in state ' || o_orderstatus AS statement,
  o_orderstatus AS root_cause_category, 'svc-' || CAST(o_custkey % 8 AS VARCHAR) AS suspected_workload,
  o_totalprice / 200000 - 0.1 AS confidence, coalesce(evidence_ids, []) AS evidence_ids
  FROM orders LEFT JOIN cit ON o_orderkey = l_orderkey)"""

SQL_REPORTS = SQL_CITATIONS + """,
reports AS (SELECT 'rep-' || CAST(o_orderkey AS VARCHAR) AS report_id,
  CASE WHEN o_orderstatus = 'P' THEN 'cluster' ELSE 'incident' END AS kind,
  CASE WHEN o_orderstatus <> 'P' THEN 'inc-' || CAST(o_orderkey AS VARCHAR) END AS incident_id,
  CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 10 <> 0 THEN 'inv-' || CAST(o_custkey AS VARCHAR) END AS investigation_id,
  o_orderdate + to_seconds(o_orderkey % 86400) AS created_at, coalesce(evidence_ids, []) AS evidence_ids, o_orderpriority AS title
  FROM orders LEFT JOIN cit ON o_orderkey = l_orderkey)"""

SQL_WORK_ITEMS = """wi AS (SELECT 'wi-' || CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS kind, CAST(o_custkey AS VARCHAR) AS dedup_key,
  CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Claimed' ELSE 'Completed' END AS state,
  CAST(o_orderkey % 5 AS INTEGER) AS attempt, 3 AS max_attempts, o_orderdate AS available_at,
  CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 40 MINUTE END AS leased_until,
  CASE WHEN o_orderstatus = 'P' THEN 'worker-' || CAST(o_orderkey % 4 AS VARCHAR) END AS leased_by FROM orders)"""
