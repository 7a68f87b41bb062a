"""Adapters: the driver's synthetic tables -> the engine's telemetry tables.

Every adapter is a pure projection / aggregation of a given table, so its work
grows with the table and DuckDB can repeat it (``SQL`` below holds the same
definitions as CTE text for the oracle queries).

Mapping (events -> telemetry):
  requests     service = 'svc-' || user_id % M, namespace by user parity,
               status 503 for 'error', 404 for 'signup', else 200,
               duration_s = value / 100
  dep_calls    dependency by event_id % 4, failure kind by event_id % 3
  counters     per (namespace, service, status_class) request count so far
               that day, modulo 40 (resets at midnight and every 40)
  logs         one line per event: structured JSON for errors (some with a
               planted password) and warnings, plain text otherwise
  pod_snapshots one snapshot per (user, day): cumulative 'error' count as
               restarts, readiness and reasons from the day's last event
  memory       embeddings as semantic memory (kind/category/workload by label
               and id); queries are per-category centroids
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.session import keyed

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed adapter values.
DEPENDENCIES = ["inventory", "payments", "postgres", "redis"]
FAILURE_KINDS = ["timeout", "connection", "http_error"]
COUNTER_MODULUS = 40
DEFAULT_SERVICES = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir, services: int) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.concat(F.lit("svc-"), (F.col("user_id") % services).cast("string")).alias("service"),
        F.when(F.col("user_id") % 2 == 0, F.lit("prod")).otherwise(F.lit("staging")).alias("namespace"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def status_class(status) -> F.Column:
    s = F.col(status) if isinstance(status, str) else status
    return (
        F.when(s >= 500, "5xx").when(s >= 400, "4xx").when(s >= 300, "3xx").when(s >= 200, "2xx").otherwise("other")
    )


def requests(spark, sf_dir, services: int = DEFAULT_SERVICES) -> DataFrame:
    e = _events(spark, sf_dir, services)
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 404).otherwise(200)
    return e.select(
        "event_id", "ts", "namespace", "service",
        F.col("event_type").alias("operation"),
        status.alias("status"),
        status_class(status).alias("status_class"),
        (F.col("value") / 100).alias("duration_s"),
    )


def dep_calls(spark, sf_dir, services: int = DEFAULT_SERVICES) -> DataFrame:
    e = _events(spark, sf_dir, services)
    failed = F.col("event_type") == "error"
    dep = F.element_at(F.array(*[F.lit(d) for d in DEPENDENCIES]), (F.col("event_id") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(k) for k in FAILURE_KINDS]), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(
        "event_id", "ts", "namespace", "service",
        dep.alias("dependency"),
        F.when(failed, kind).alias("kind"),
        F.when(failed, "failure").otherwise("success").alias("outcome"),
        (F.col("value") / 100).alias("duration_s"),
    )


def counter_samples(spark, sf_dir, services: int = DEFAULT_SERVICES) -> DataFrame:
    """``http_requests_total``-style counter samples with planted resets: the
    request count of the series so far that day, modulo 40 (so the counter
    resets at midnight and every 40 requests, like a restarted process)."""
    r = requests(spark, sf_dir, services).select("event_id", "ts", "namespace", "service", "status_class")
    keys = ["namespace", "service", "status_class"]
    w = Window.partitionBy(*keys, F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    return r.select(
        F.lit("http_requests_total").alias("metric"),
        *keys, "ts", "event_id",
        (F.row_number().over(w) % COUNTER_MODULUS).cast("double").alias("value"),
    )


def bucket_counters(spark, sf_dir, services: int = DEFAULT_SERVICES) -> DataFrame:
    """Cumulative latency bucket counters: per (service, le) the requests of
    the day so far that took at most ``le`` (so they reset at midnight)."""
    from vigil.operators.metrics import BUCKET_BOUNDS

    r = requests(spark, sf_dir, services).select("event_id", "ts", "namespace", "service", "duration_s", F.date_trunc("day", "ts").alias("day"))
    r = keyed(r, r.count(), "namespace", "service", "day")
    bounds = [F.lit(float(b)) for b in [*BUCKET_BOUNDS, float("inf")]]
    w = Window.partitionBy("namespace", "service", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counts = F.array(*[F.sum(F.when(F.col("duration_s") <= b, 1.0).otherwise(0.0)).over(w) for b in bounds])
    # one sorted row per request; the buckets unfold after the sort
    x = r.withColumn("counts", counts).select("*", F.posexplode(F.array(*bounds)).alias("at", "le"))
    return x.select("namespace", "service", "le", "ts", "event_id", F.get("counts", "at").alias("value"))


def failure_counters(spark, sf_dir, services: int = DEFAULT_SERVICES) -> DataFrame:
    """Failure counters per (service, dependency, kind), sampled at each
    failure; they reset
    every 5 failures, and some kinds are missing."""
    c = dep_calls(spark, sf_dir, services).filter(F.col("outcome") == "failure")
    kind = F.when(F.col("event_id") % 9 != 0, F.col("kind"))
    keys = ["namespace", "service", "dependency", "kind"]
    w = Window.partitionBy(*keys).orderBy("ts", "event_id")
    d = c.withColumn("kind", kind)
    return d.select(*keys, "ts", "event_id", (F.row_number().over(w) % 5).cast("double").alias("value"))


def _ms(col="value") -> F.Column:
    return F.round(F.col(col) * 100).cast("bigint").cast("string")


def logs(spark, sf_dir, services: int = DEFAULT_SERVICES) -> DataFrame:
    e = _events(spark, sf_dir, services)
    dep = F.element_at(F.array(*[F.lit(d) for d in DEPENDENCIES]), (F.col("event_id") % 4 + 1).cast("int"))
    order_ref = F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 12)
    et = F.col("event_type")
    level = F.when(et == "error", "error").when(et == "signup", "warn").when(et == "view", "debug").otherwise("info")
    event = F.col("event_id").cast("string")
    secret = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit(" password=hunter"), event)).otherwise(F.lit(""))
    line = (
        F.when(et == "error", F.concat(
            F.lit('{"level":"error","msg":"Dependency '), dep, F.lit(" timed out after "), _ms(), F.lit("ms while processing ord_"), order_ref, secret,
            F.lit('","operation":"checkout","dependency":"'), dep, F.lit('","correlationId":"c-'), event, F.lit('"}')))
        .when(et == "signup", F.concat(
            F.lit('{"level":"warn","msg":"Retrying call to '), dep, F.lit(" for user "), F.col("user_id").cast("string"), F.lit(" after "), _ms(),
            F.lit('ms","correlationId":"c-'), event, F.lit('"}')))
        .otherwise(F.concat(F.lit("Handled "), et, F.lit(" for user "), F.col("user_id").cast("string"), F.lit(" in "), _ms(), F.lit("ms")))
    )
    return e.select(
        "event_id", "ts", "namespace",
        F.col("service").alias("container"),
        level.alias("level"),
        F.concat(F.col("service"), F.lit("-"), (F.col("user_id") % 3).cast("string")).alias("pod"),
        line.alias("line"),
    )


def pod_snapshots(spark, sf_dir, services: int = DEFAULT_SERVICES) -> DataFrame:
    e = _events(spark, sf_dir, services)
    day = F.date_trunc("day", F.col("ts"))
    per_day = e.groupBy("namespace", "user_id", "service", day.alias("day")).agg(
        F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"),
        F.max_by(F.struct("event_type", "k"), F.struct("ts", "event_id")).alias("last"),
    )
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select(
        (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("snapshot_ts"),
        "namespace",
        F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("pod"),
        F.col("service").alias("workload"),
        F.sum("errors").over(w).cast("int").alias("restart_count"),
        (F.col("last.event_type") != "error").alias("ready"),
        F.when(F.col("last.k") < 5, "CrashLoopBackOff").alias("waiting_reason"),
        F.when(F.col("last.k") > 95, "OOMKilled").alias("last_termination_reason"),
        F.col("last.k").alias("last_k"),
    )


def memory(spark, sf_dir) -> DataFrame:
    m = read(spark, sf_dir, "embeddings")
    kind = F.when(F.col("label") < 5, "incident").otherwise("runbook")
    return m.select(
        F.concat(F.lit("mem-"), F.col("vec_id").cast("string")).alias("id"),
        kind.alias("kind"),
        F.when(F.col("label") < 5, F.concat(F.lit("inc-"), F.col("vec_id").cast("string"))).alias("incident_id"),
        F.concat(kind, F.lit("/"), F.col("vec_id").cast("string")).alias("source_ref"),
        F.when(F.col("vec_id") % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("svc-"), (F.col("vec_id") % 8).cast("string"))).alias("workload"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"),
        "embedding",
    )


def memory_queries(spark, sf_dir, kind: str = "runbook") -> DataFrame:
    """One query per category: the mean vector of that category's memories.

    Derived from the whole table by a grouped aggregation (per-dimension mean,
    re-assembled in dimension order), so the query batch is bounded by the
    number of categories while the corpus scan grows with the table.
    """
    m = read(spark, sf_dir, "embeddings")
    per_dim = m.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(
        F.avg("x").alias("x")
    )
    vec = per_dim.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("pairs"))
    return vec.select(
        F.concat(F.lit("q-c"), F.col("label").cast("string")).alias("query_id"),
        F.transform("pairs", lambda p: p["x"]).alias("embedding"),
        F.lit(kind).alias("kind"),
        F.lit(None).cast("string").alias("workload"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"),
        F.lit(None).cast("string").alias("exclude_incident_id"),
    )


def incident_queries(spark, sf_dir) -> DataFrame:
    """Per-category centroids searching past incidents: workload facet by
    label, and the category's first incident excluded as "self"."""
    q = memory_queries(spark, sf_dir, kind="incident")
    m = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("first_id"))
    m = m.select(
        F.concat(F.lit("q-c"), F.col("label").cast("string")).alias("query_id"),
        F.concat(F.lit("svc-"), (F.col("label") % 8).cast("string")).alias("q_workload"),
        F.concat(F.lit("inc-"), F.col("first_id").cast("string")).alias("q_exclude"),
    )
    return q.join(m, "query_id").select(
        "query_id", "embedding", "kind", F.col("q_workload").alias("workload"),
        F.lit(None).cast("string").alias("category"), F.col("q_exclude").alias("exclude_incident_id"),
    )


def runbook_markdown(spark, sf_dir) -> DataFrame:
    """Each document as a runbook: title line, a preamble, then three sections
    (Symptoms = the whole text, Causes = the language, an empty Actions)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang")
    md = F.concat(
        F.lit("# "), F.col("source"), F.lit(" runbook "), F.col("doc_id").cast("string"), F.lit("\nOverview.\n## Symptoms\n"),
        F.col("text"), F.lit("\n## Causes\n"), F.col("lang"), F.lit("\n## Actions\n\n"),
    )
    return d.select(F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string")).alias("file_name"), "doc_id",
                    md.alias("markdown"))


# --- the same adapters as DuckDB CTE text (oracle side) ---------------------

def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_events(services: int = DEFAULT_SERVICES) -> str:
    return f"""ev AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value,
  'svc-' || CAST(user_id % {services} AS VARCHAR) AS service,
  CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'staging' END AS namespace,
  TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


SQL_STATUS_CLASS = """CASE WHEN {s} >= 500 THEN '5xx' WHEN {s} >= 400 THEN '4xx' WHEN {s} >= 300 THEN '3xx'
  WHEN {s} >= 200 THEN '2xx' ELSE 'other' END"""


def sql_requests(services: int = DEFAULT_SERVICES) -> str:
    return sql_events(services) + ",\n" + SQL_REQUESTS_ONLY


_STATUS = "(CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 ELSE 200 END)"
SQL_REQUESTS_ONLY = f"""requests AS (SELECT event_id, ts, namespace, service, event_type AS operation, {_STATUS} AS status,
  {SQL_STATUS_CLASS.format(s=_STATUS)} AS status_class, value / 100 AS duration_s FROM ev)"""


def sql_dep_calls(services: int = DEFAULT_SERVICES) -> str:
    return sql_events(services) + ",\n" + SQL_DEP_CALLS_ONLY


SQL_DEP_CALLS_ONLY = f"""dep_calls AS (SELECT event_id, ts, namespace, service,
  {_sql_list(DEPENDENCIES)}[event_id % 4 + 1] AS dependency,
  CASE WHEN event_type = 'error' THEN {_sql_list(FAILURE_KINDS)}[event_id % 3 + 1] END AS kind,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
  value / 100 AS duration_s FROM ev)"""


def sql_counter_samples(services: int = DEFAULT_SERVICES) -> str:
    return sql_requests(services) + ",\n" + SQL_COUNTERS_ONLY


SQL_COUNTERS_ONLY = f"""counters AS (SELECT 'http_requests_total' AS metric, namespace, service, status_class, ts, event_id,
  CAST(row_number() OVER (PARTITION BY namespace, service, status_class, date_trunc('day', ts) ORDER BY ts, event_id) % {COUNTER_MODULUS} AS DOUBLE) AS value
  FROM requests)"""


SQL_BUCKETS_ONLY = """bks AS (SELECT namespace, service, le, ts, event_id, sum(CASE WHEN duration_s <= le THEN 1.0::DOUBLE ELSE 0.0 END) OVER (
    PARTITION BY namespace, service, le, date_trunc('day', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
  FROM requests, (SELECT unnest({bounds}) AS le))"""
SQL_FAILURE_COUNTERS_ONLY = """fcs AS (SELECT namespace, service, dependency, kind, ts, event_id,
  CAST(row_number() OVER (PARTITION BY namespace, service, dependency, kind ORDER BY ts, event_id) % 5 AS DOUBLE) AS value
  FROM (SELECT * REPLACE (CASE WHEN event_id % 9 <> 0 THEN kind END AS kind) FROM dep_calls WHERE outcome = 'failure'))"""


def sql_logs(services: int = DEFAULT_SERVICES) -> str:
    return sql_events(services) + ",\n" + SQL_LOGS_ONLY


_MS = "CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)"
_DEP = f"{_sql_list(DEPENDENCIES)}[event_id % 4 + 1]"
_ERROR_MSG = (f"'Dependency ' || {_DEP} || ' timed out after ' || {_MS} || 'ms while processing ord_' || left(sha256(CAST(event_id AS VARCHAR)), 12)"
              " || CASE WHEN event_id % 10 = 0 THEN ' password=hunter' || CAST(event_id AS VARCHAR) ELSE '' END")
_WARN_MSG = f"'Retrying call to ' || {_DEP} || ' for user ' || CAST(user_id AS VARCHAR) || ' after ' || {_MS} || 'ms'"
_PLAIN_MSG = f"'Handled ' || event_type || ' for user ' || CAST(user_id AS VARCHAR) || ' in ' || {_MS} || 'ms'"
# line: as stored; message: what reading the structured line must give
SQL_LOGS_ONLY = f"""logs AS (SELECT event_id, ts, namespace, service AS container,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
  service || '-' || CAST(user_id % 3 AS VARCHAR) AS pod,
  CASE WHEN event_type = 'error' THEN '{{"level":"error","msg":"' || {_ERROR_MSG} || '","operation":"checkout","dependency":"' || {_DEP}
         || '","correlationId":"c-' || CAST(event_id AS VARCHAR) || '"}}'
       WHEN event_type = 'signup' THEN '{{"level":"warn","msg":"' || {_WARN_MSG} || '","correlationId":"c-' || CAST(event_id AS VARCHAR) || '"}}'
       ELSE {_PLAIN_MSG} END AS line,
  CASE WHEN event_type = 'error' THEN {_ERROR_MSG} || ' (operation=checkout, dependency=' || {_DEP} || ', correlationId=c-' || CAST(event_id AS VARCHAR) || ')'
       WHEN event_type = 'signup' THEN {_WARN_MSG} || ' (correlationId=c-' || CAST(event_id AS VARCHAR) || ')'
       ELSE {_PLAIN_MSG} END AS message
  FROM ev)"""


def sql_pod_snapshots(services: int = DEFAULT_SERVICES) -> str:
    return sql_events(services) + ",\n" + SQL_PODS_ONLY


SQL_PODS_ONLY = """pd AS (SELECT namespace, user_id, service, date_trunc('day', ts) AS day,
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors,
  arg_max(event_type, (ts, event_id)) AS last_type, arg_max(k, (ts, event_id)) AS last_k
  FROM ev GROUP BY ALL),
pods AS (SELECT day + INTERVAL 1 DAY AS snapshot_ts, namespace, 'pod-' || CAST(user_id AS VARCHAR) AS pod,
  service AS workload,
  CAST(sum(errors) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS restart_count,
  last_type <> 'error' AS ready,
  CASE WHEN last_k < 5 THEN 'CrashLoopBackOff' END AS waiting_reason,
  CASE WHEN last_k > 95 THEN 'OOMKilled' END AS last_termination_reason, last_k FROM pd)"""


SQL_MEMORY = """mem AS (SELECT 'mem-' || CAST(vec_id AS VARCHAR) AS id,
  CASE WHEN label < 5 THEN 'incident' ELSE 'runbook' END AS kind,
  CASE WHEN label < 5 THEN 'inc-' || CAST(vec_id AS VARCHAR) END AS incident_id,
  CASE WHEN label < 5 THEN 'incident' ELSE 'runbook' END || '/' || CAST(vec_id AS VARCHAR) AS source_ref,
  CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 'svc-' || CAST(vec_id % 8 AS VARCHAR) END AS workload,
  'c' || CAST(label AS VARCHAR) AS category, embedding FROM embeddings)"""


def sql_memory_queries(kind: str = "runbook") -> str:
    return f"""qd AS (SELECT label, i AS pos, avg(embedding[i]) AS x
  FROM embeddings, range(1, len(embedding) + 1) t(i) GROUP BY label, i),
queries AS (SELECT 'q-c' || CAST(label AS VARCHAR) AS query_id, list(x ORDER BY pos) AS embedding,
  '{kind}' AS kind, CAST(NULL AS VARCHAR) AS workload, 'c' || CAST(label AS VARCHAR) AS category,
  CAST(NULL AS VARCHAR) AS exclude_incident_id FROM qd GROUP BY label)"""


SQL_INCIDENT_QUERIES = sql_memory_queries("incident").replace("queries AS", "queries0 AS") + """,
queries AS (SELECT q.query_id, q.embedding, q.kind, 'svc-' || CAST(f.label % 8 AS VARCHAR) AS workload,
  CAST(NULL AS VARCHAR) AS category, 'inc-' || CAST(f.first_id AS VARCHAR) AS exclude_incident_id
  FROM queries0 q JOIN (SELECT label, min(vec_id) AS first_id FROM embeddings GROUP BY label) f
  ON q.query_id = 'q-c' || CAST(f.label AS VARCHAR))"""

SQL_MARKDOWN = """md AS (SELECT source || '-' || CAST(doc_id AS VARCHAR) AS file_name, doc_id,
  '# ' || source || ' runbook ' || CAST(doc_id AS VARCHAR) || chr(10) || 'Overview.' || chr(10) || '## Symptoms' || chr(10)
  || text || chr(10) || '## Causes' || chr(10) || lang || chr(10) || '## Actions' || chr(10) || chr(10) AS markdown FROM documents)"""
