"""The investigation tools as SQL table functions.

``register_sql_tools`` publishes the tool sources as temporary views (built by
the DataFrame operators, so the SQL only filters and orders) and defines one
temporary SQL table function per tool::

    SELECT * FROM search_logs('prod', 'svc-1', 'error', 'timed out', 15, TIMESTAMP '2024-01-20 00:00:00')

Arguments follow the tool defaults and clamps (minutes 1-60, 40 log lines,
200 events, top 5 memories); a workload that is not a lower-case Kubernetes
name or log level matches nothing. The memory tools take the query as a
vector (embedding text is outside the engine).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vigil.config import Params
from vigil.operators import cluster as K
from vigil.operators import evidence as E
from vigil.operators import logs as L
from vigil.operators import metrics as M
from vigil.plans.tools import Sources

# Argument checks as predicates: an invalid workload name or log level matches
# nothing (the Python entry points in tools.py raise instead; a SQL filter
# cannot raise reliably because the optimizer may skip it on empty inputs).
NAME_CHECK = f"coalesce(p_workload RLIKE '{K.NAME_RE}', false)"

LEVEL_CHECK = "(p_level IS NULL OR p_level IN (" + ", ".join(f"'{x}'" for x in L.LEVELS) + "))"

COSINE = ("1 - aggregate(zip_with(embedding, p_query, (a, b) -> a * b), 0D, (s, v) -> s + v)"
          " / (sqrt(aggregate(embedding, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(p_query, 0D, (s, v) -> s + v * v)))")


def _minutes(arg: str, default: int) -> str:
    return f"least(greatest(coalesce({arg}, {default}), 1), 60)"


# Parameters carry a p_ prefix: a column of the same name would shadow them.
FUNCTIONS = {
    "search_logs": f"""(p_ns STRING, p_workload STRING, p_level STRING, p_needle STRING, p_minutes INT, p_at TIMESTAMP)
RETURNS TABLE (ts TIMESTAMP, container STRING, pod STRING, level STRING, message STRING)
RETURN SELECT ts, container, pod, level, message FROM vigil_logs
WHERE {NAME_CHECK} AND {LEVEL_CHECK} AND namespace = p_ns AND container = p_workload AND (p_level IS NULL OR level = p_level)
  AND (p_needle IS NULL OR contains(line, p_needle))
  AND ts >= p_at - make_dt_interval(0, 0, {_minutes('p_minutes', 15)}, 0) AND ts <= p_at
ORDER BY ts DESC, event_id DESC LIMIT 40""",
    "search_logs_around": f"""(p_ns STRING, p_workload STRING, p_at TIMESTAMP, p_before INT, p_after INT)
RETURNS TABLE (ts TIMESTAMP, container STRING, pod STRING, level STRING, message STRING)
RETURN SELECT ts, container, pod, level, message FROM vigil_logs
WHERE {NAME_CHECK} AND namespace = p_ns AND container = p_workload
  AND ts >= p_at - make_dt_interval(0, 0, 0, least(greatest(coalesce(p_before, 120), 10), 900))
  AND ts <= p_at + make_dt_interval(0, 0, 0, least(greatest(coalesce(p_after, 60), 10), 900))
ORDER BY ts DESC, event_id DESC LIMIT 40""",
    "pod_status": f"""(p_ns STRING, p_workload STRING)
RETURNS TABLE (pod STRING, phase STRING, ready BOOLEAN, restarts INT, waiting_reason STRING,
               last_termination_reason STRING, summary STRING, evidence_id STRING)
RETURN SELECT pod, phase, ready, restarts, waiting_reason, last_termination_reason, summary, evidence_id
FROM vigil_pod_status WHERE namespace = p_ns AND (p_workload IS NULL OR ({NAME_CHECK} AND workload = p_workload))""",
    "restart_history": """(p_ns STRING)
RETURNS TABLE (pod STRING, restarts INT, last_termination_reason STRING, last_terminated_at TIMESTAMP)
RETURN SELECT pod, restarts, last_termination_reason, last_terminated_at FROM vigil_pod_status WHERE namespace = p_ns""",
    "kubernetes_events": f"""(p_ns STRING, p_workload STRING, p_minutes INT, p_at TIMESTAMP)
RETURNS TABLE (occurred_at TIMESTAMP, involved STRING, summary STRING, evidence_id STRING)
RETURN SELECT occurred_at, involved, summary, evidence_id FROM vigil_k8s_events
WHERE {NAME_CHECK} AND namespace = p_ns AND startswith(involved, p_workload)
  AND occurred_at >= p_at - make_dt_interval(0, 0, {_minutes('p_minutes', 30)}, 0) AND occurred_at <= p_at
ORDER BY occurred_at DESC, evidence_id LIMIT 200""",
    "deployment_status": f"""(p_ns STRING, p_workload STRING)
RETURNS TABLE (deployment STRING, desired INT, ready INT, available INT, updated INT, summary STRING)
RETURN SELECT deployment, desired, ready, available, updated, summary FROM vigil_deployments
WHERE {NAME_CHECK} AND namespace = p_ns AND deployment = p_workload""",
    "service_metrics": f"""(p_ns STRING, p_workload STRING, p_at TIMESTAMP)
RETURNS TABLE (observed_at TIMESTAMP, evidence_id STRING, summary STRING)
RETURN SELECT observed_at, evidence_id, summary FROM (
  SELECT *, rank() OVER (PARTITION BY namespace, workload ORDER BY observed_at DESC) AS age FROM vigil_metric_evidence
  WHERE {NAME_CHECK} AND namespace = p_ns AND workload = p_workload AND observed_at <= p_at)
WHERE age = 1""",
    "similar_incidents": f"""(p_query ARRAY<DOUBLE>, p_workload STRING, p_exclude STRING, p_max_distance DOUBLE)
RETURNS TABLE (source_ref STRING, distance DOUBLE)
RETURN SELECT source_ref, distance FROM (
  SELECT *, max(facet) OVER (PARTITION BY kind) AS strict FROM (
    SELECT source_ref, id, kind, {COSINE} AS distance, p_workload IS NULL OR workload IS NULL OR workload = p_workload AS facet FROM vigil_memory
    WHERE kind = 'incident' AND (p_exclude IS NULL OR incident_id IS NULL OR incident_id <> p_exclude))
  WHERE distance <= coalesce(p_max_distance, 0.65))
WHERE facet OR NOT strict ORDER BY distance, id LIMIT 5""",
    "runbooks": f"""(p_query ARRAY<DOUBLE>, p_category STRING, p_max_distance DOUBLE)
RETURNS TABLE (source_ref STRING, distance DOUBLE)
RETURN SELECT source_ref, distance FROM (
  SELECT *, max(facet) OVER (PARTITION BY kind) AS strict FROM (
    SELECT source_ref, id, kind, {COSINE} AS distance, p_category IS NULL OR category IS NULL OR category = p_category AS facet FROM vigil_memory
    WHERE kind = 'runbook')
  WHERE distance <= coalesce(p_max_distance, 0.65))
WHERE facet OR NOT strict ORDER BY distance, id LIMIT 5""",
}


# The columns of each view that the functions use; an absent source is an empty view.
VIEWS = {
    "vigil_logs": "ts timestamp, namespace string, container string, pod string, level string, line string, message string, event_id long",
    "vigil_pod_status": "namespace string, workload string, pod string, phase string, ready boolean, restarts int, waiting_reason string, "
                        "last_termination_reason string, last_terminated_at timestamp, summary string, evidence_id string",
    "vigil_k8s_events": "namespace string, involved string, occurred_at timestamp, summary string, evidence_id string",
    "vigil_deployments": "namespace string, deployment string, desired int, ready int, available int, updated int, summary string",
    "vigil_metric_evidence": "namespace string, workload string, observed_at timestamp, evidence_id string, summary string",
    "vigil_memory": "id string, kind string, incident_id string, source_ref string, workload string, category string, embedding array<double>",
}


def register_sql_tools(spark: SparkSession, src: Sources, params: Params, since: datetime | None = None) -> list[str]:
    """Create the views and the table functions; returns the function names."""
    for name, schema in VIEWS.items():
        spark.createDataFrame([], schema).createOrReplaceTempView(name)
    if src.logs is not None:
        lines = L.redacted(L.messages(src.logs))
        if "event_id" not in lines.columns:
            lines = lines.withColumn("event_id", F.xxhash64("pod", "line"))
        lines.createOrReplaceTempView("vigil_logs")
    if src.pods is not None:
        K.pod_status(src.pods).createOrReplaceTempView("vigil_pod_status")
    if src.k8s_events is not None:
        ev = K.k8s_events(src.k8s_events, None, since or datetime(1970, 1, 1), limit=None)
        ev.createOrReplaceTempView("vigil_k8s_events")
    if src.deployments is not None:
        K.deployment_status(src.deployments).createOrReplaceTempView("vigil_deployments")
    if src.counters is not None or src.requests is not None or src.dep_calls is not None:
        calls, requests = src.dep_calls, src.requests
        errors = None if src.counters is None else M.http_error_rate(M.increase(src.counters, ["namespace", "service", "status_class"], params))
        me = E.service_metric_evidence(errors, None if requests is None else M.latency_p95(requests, params),
                                       None if calls is None else M.dependency_failures(calls, params),
                                       None if calls is None else M.dependency_latency_p95(calls, params), params.window_minutes)
        me.createOrReplaceTempView("vigil_metric_evidence")
    if src.memory is not None:
        src.memory.withColumn("embedding", F.col("embedding").cast("array<double>")).createOrReplaceTempView("vigil_memory")
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)
