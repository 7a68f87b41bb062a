"""Log queries over the logs adapter and the documents table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vigil.config import replay_params
from vigil.functions import text as X
from vigil.operators import logs as L
from vigil.operators.detect import signals_text
from vigil.operators.windows import sql_passes, sql_window_join
from vigil.plans.registry import register
from vigil.sources import testdata as T

P = replay_params()


def _docs(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", "text")


def sql_redacted(table: str, cols: str, text: str, out: str, prefix: str) -> str:
    """CTEs ending in ``out``: the columns, the redacted text as ``message`` and ``redacted_value_count``."""
    return f"""{X.sql_redaction_ctes(table, cols, text, prefix=prefix)},
{out} AS (SELECT {cols}, {X.sql_strip_control('w')} AS message, CAST(n AS INTEGER) AS redacted_value_count FROM {prefix}{len(X.REDACT_RULES)})"""


@register(
    "log_normalise",
    sql=f"SELECT doc_id, {X.sql_normalise('text')} AS normalised FROM documents",
)
def q_log_normalise(spark, sf):
    return _docs(spark, sf).select("doc_id", X.normalise("text").alias("normalised"))


@register(
    "log_signature_hash",
    sql="WITH " + T.sql_logs() + f"\nSELECT event_id, {X.sql_signature_hash(X.sql_normalise('message'))} AS signature_hash FROM logs",
)
def q_log_signature_hash(spark, sf):
    return L.messages(T.logs(spark, sf)).select("event_id", X.log_signature("message").alias("signature_hash"))


@register(
    "redact",
    sql="WITH " + X.sql_redaction_ctes("documents", "doc_id", "text")
    + f"\nSELECT doc_id, {X.sql_strip_control('w')} AS redacted_text, CAST(n AS INTEGER) AS redaction_count FROM r{len(X.REDACT_RULES)}",
)
def q_redact(spark, sf):
    return X.with_redaction(_docs(spark, sf), "text").select("doc_id", "redacted_text", "redaction_count")


@register("strip_control", sql=f"SELECT doc_id, {X.sql_strip_control('text')} AS clean_text FROM documents")
def q_strip_control(spark, sf):
    return _docs(spark, sf).select("doc_id", X.strip_control("text").alias("clean_text"))


@register(
    "truncate",
    sql="SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS summary,"
    " CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) ELSE text END AS payload FROM documents",
)
def q_truncate(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", X.truncate("text", 500).alias("summary"), X.truncate("text", 2000, "").alias("payload"))


@register(
    "correlation_sanitise",
    sql="SELECT event_id, CASE WHEN substr(regexp_replace(coalesce(props, ''), '[^A-Za-z0-9_-]', '', 'g'), 1, 64) = ''"
    " THEN left(sha256(CAST(event_id AS VARCHAR)), 16)"
    " ELSE substr(regexp_replace(coalesce(props, ''), '[^A-Za-z0-9_-]', '', 'g'), 1, 64) END AS correlation_id FROM events",
)
def q_correlation_sanitise(spark, sf):
    e = T.read(spark, sf, "events")
    return e.select("event_id", X.correlation_sanitise("props", "event_id").alias("correlation_id"))


@register(
    "level_filter",
    sql="WITH " + T.sql_logs() + "\nSELECT event_id, ts, container, level FROM logs WHERE level = 'warn'",
)
def q_level_filter(spark, sf):
    lv = L.validate_level("warn")
    return T.logs(spark, sf).filter(F.col("level") == lv).select("event_id", "ts", "container", "level")


_LINE = "event_id, ts, container, pod, level"


@register(
    "errors_panel",
    sql="WITH " + T.sql_logs() + f""",
hits AS (SELECT * FROM logs WHERE regexp_full_match(level, 'error|warn') ORDER BY ts DESC, event_id DESC LIMIT 100),
{sql_redacted('hits', _LINE, 'message', 'red', 'q')}
SELECT event_id, ts, container, level, message, redacted_value_count FROM red""",
)
def q_errors_panel(spark, sf):
    return L.errors_panel(T.logs(spark, sf)).select("event_id", "ts", "container", "level", "message", "redacted_value_count")


SEARCH = dict(namespace="prod", start=datetime(2024, 1, 10), end=datetime(2024, 1, 12), container="svc-0",
              contains="timed out", limit=40)
SQL_SEARCH = """SELECT * FROM logs WHERE namespace = 'prod' AND container = 'svc-0' AND contains(line, 'timed out')
  AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 40"""


@register(
    "log_search",
    sql="WITH " + T.sql_logs() + f""",
hits AS ({SQL_SEARCH}),
{sql_redacted('hits', _LINE, 'message', 'red', 'q')}
SELECT {_LINE}, message, redacted_value_count FROM red""",
)
def q_log_search(spark, sf):
    r = L.search(T.logs(spark, sf), P, **SEARCH)
    return r.select("event_id", "ts", "container", "pod", "level", "message", "redacted_value_count")


def sql_sample_id(ts: str, container: str, pod: str, message: str) -> str:
    return (f"'log_' || left(sha256(concat_ws('|', 'LogSample', 'loki', strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00', "
            f"{container}, {pod}, left(sha256({X.sql_normalise(message)}), 16))), 12)")


@register(
    "log_sample_evidence",
    sql="WITH " + T.sql_logs() + f""",
hits AS (SELECT *, {sql_sample_id('ts', 'container', 'pod', 'message')} AS evidence_id FROM ({SQL_SEARCH})),
{sql_redacted('hits', _LINE + ', evidence_id', 'message', 'red', 'q')}
SELECT evidence_id, 'LogSample' AS kind, ts AS observed_at, container AS workload,
  '[' || coalesce(level, 'info') || '] ' || CASE WHEN length(message) > 500 THEN substr(message, 1, 500) || '...' ELSE message END AS summary,
  'level=' || level || chr(10) || 'pod=' || pod || chr(10) || 'timestampUtc=' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00' AS attributes,
  redacted_value_count FROM red""",
)
def q_log_sample_evidence(spark, sf):
    ev = L.to_sample_evidence(L.find(T.logs(spark, sf), P, **SEARCH).withColumnRenamed("container", "workload"))
    return ev.select("evidence_id", "kind", "observed_at", "workload", "summary", signals_text("attributes").alias("attributes"),
                     "redacted_value_count")


SQL_SIGNATURES_CTE = (
    T.sql_logs()
    + f""",
lh AS (SELECT *, {X.sql_normalise('message')} AS norm FROM logs WHERE level IN ('error', 'warn')),
lw AS (SELECT namespace, left(sha256(norm), 16) AS signature_hash, pod, ts, message, level, container, norm,
  {sql_passes('ts', P)} FROM lh, {sql_window_join(P)}),
sg AS (SELECT namespace, window_start, pass_ts, signature_hash, count(*) AS occurrences, min(ts) AS first_seen,
  max(ts) AS last_seen, count(DISTINCT pod) + max(CASE WHEN pod IS NULL THEN 1 ELSE 0 END) AS distinct_pods,
  arg_max(level, (ts, pod, message)) AS level, arg_max(container, (ts, pod, message)) AS workload,
  arg_max(norm, (ts, pod, message)) AS normalised FROM lw GROUP BY ALL),
sigs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY namespace, pass_ts
  ORDER BY occurrences DESC, signature_hash) AS rn FROM sg) WHERE rn <= {P.max_signatures})"""
)


def signatures(spark, sf):
    return L.error_signatures(T.logs(spark, sf), P, top=P.max_signatures)


_SIG = ("namespace, window_start, pass_ts, signature_hash, occurrences, first_seen, last_seen, distinct_pods, level, workload")


def sql_signature_evidence(table: str, out: str, prefix: str) -> str:
    return sql_redacted(table, _SIG, "normalised", out + "_red", prefix) + f""",
{out} AS (SELECT * EXCLUDE (message), 'sig_' || left(sha256(concat_ws('|', 'LogSignature', 'loki', signature_hash, coalesce(workload, ''))), 12) AS evidence_id,
  CAST(occurrences AS VARCHAR) || 'x [' || coalesce(level, '') || '] ' || message AS summary FROM {out}_red)"""


@register("error_signatures", sql="WITH " + SQL_SIGNATURES_CTE + ",\n" + sql_signature_evidence("sigs", "sev", "q") + "\nSELECT * FROM sev")
def q_error_signatures(spark, sf):
    return L.signature_evidence(signatures(spark, sf)).select(*_SIG.split(", "), "evidence_id", "summary", "redacted_value_count")


@register(
    "log_around",
    sql="WITH " + SQL_SIGNATURES_CTE
    + """,
mo AS (SELECT namespace, CASE WHEN occurrences % 5 > 0 THEN workload END AS workload, last_seen AS moment_ts,
  namespace || '/' || CAST(pass_ts AS VARCHAR) || '/' || signature_hash AS moment_id FROM sigs),
ar AS (SELECT * FROM (SELECT mo.moment_id, mo.moment_ts, l.event_id, l.ts, l.level, l.pod, l.message,
    row_number() OVER (PARTITION BY mo.moment_id ORDER BY l.ts DESC, l.event_id DESC) AS rank
  FROM mo JOIN logs l ON l.namespace = mo.namespace AND (mo.workload IS NULL OR l.container = mo.workload)
   AND l.ts BETWEEN mo.moment_ts - INTERVAL 900 SECOND AND mo.moment_ts + INTERVAL 900 SECOND) WHERE rank <= 40),
""" + sql_redacted("ar", "moment_id, moment_ts, event_id, ts, level, pod, rank", "message", "red", "z") + """
SELECT moment_id, moment_ts, event_id, ts, level, pod, message, redacted_value_count, rank FROM red""",
)
def q_log_around(spark, sf):
    sigs = signatures(spark, sf)
    moments = sigs.select(
        "namespace", F.when(F.col("occurrences") % 5 > 0, F.col("workload")).alias("workload"), F.col("last_seen").alias("moment_ts"),
        F.concat_ws("/", "namespace", F.date_format("pass_ts", "yyyy-MM-dd HH:mm:ss"), "signature_hash").alias("moment_id"),
    )
    return L.around(moments, T.logs(spark, sf), 900, 900, 40).select(
        "moment_id", "moment_ts", "event_id", "ts", "level", "pod", "message", "redacted_value_count", "rank")


@register(
    "log_enrich",
    sql="WITH " + T.sql_logs() + """
SELECT event_id,
  CASE WHEN level <> 'debug' THEN level END AS level_resolved,
  CASE WHEN level <> 'debug' THEN container END AS workload,
  CASE WHEN level <> 'debug' THEN pod END AS pod_resolved,
  CASE WHEN level = 'debug' THEN message
       ELSE message || ' (' || CASE WHEN level = 'error' THEN 'operation=checkout, ' ELSE '' END
            || 'correlationId=c-' || CAST(event_id AS VARCHAR) || ')' END AS message
FROM logs""",
)
def q_log_enrich(spark, sf):
    """Structured JSON lines (built from events) through enrichment."""
    e = L.messages(T.logs(spark, sf)).drop("line").withColumnRenamed("message", "line")
    as_json = F.when(
        F.col("level") != "debug",
        F.to_json(F.struct(
            F.col("level"), F.col("line").alias("msg"), F.col("container").alias("service"), F.col("pod"),
            F.when(F.col("level") == "error", F.lit("checkout")).alias("operation"),
            F.concat(F.lit("c-"), F.col("event_id").cast("string")).alias("correlationId"),
            (F.col("event_id") % 7).alias("durationMs"),
        )),
    ).otherwise(F.col("line"))
    raw = e.select("event_id", "ts", "namespace", as_json.alias("line"),
                   F.create_map(F.lit("namespace"), F.col("namespace")).alias("labels"))
    return L.enrich(raw).select("event_id", "level_resolved", "workload", "pod_resolved", "message")


@register(
    "camel_keys",
    sql="""SELECT event_id, array_to_string(list_sort(list_filter([
  'eventType=' || event_type, 'userId=' || CAST(user_id AS VARCHAR),
  CASE WHEN event_type <> 'view' THEN 'props=' || props END], lambda x: x IS NOT NULL)), ',') AS fields FROM events""",
)
def q_camel_keys(spark, sf):
    e = T.read(spark, sf, "events")
    m = F.create_map(
        F.lit("EventType"), F.col("event_type"),
        F.lit("UserId"), F.col("user_id").cast("string"),
        F.lit("Props"), F.when(F.col("event_type") != "view", F.col("props")),
    )
    kv = F.transform(F.map_entries(L.camel_keys(m)), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return e.select("event_id", F.array_join(F.array_sort(kv), ",").alias("fields"))
