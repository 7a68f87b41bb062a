"""Evidence bundles for all detected incidents at once (SURVEY §2.7 E2/E8,
§2.2 M10, §2.10 R7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.config import replay_params
from vigil.functions import text as X
from vigil.functions.ids import KIND_PRIORITY, sql_evidence_id
from vigil.operators import detect as D
from vigil.operators import evidence as E
from vigil.operators import incidents as I
from vigil.operators import metrics as M
from vigil.plans import q_cluster as QC
from vigil.plans import replay as R
from vigil.plans.q_detect import _sql_fixed as _fixed
from vigil.plans.q_detect import _sql_fixed_double as _fixed_d
from vigil.plans.q_detect import sql_incidents, sql_pipeline
from vigil.plans.q_logs import sql_redacted, sql_sample_id
from vigil.plans.q_metrics import sql_histogram, sql_quantile
from vigil.plans.registry import register
from vigil.session import stored
from vigil.sources import k8sdata as KD
from vigil.sources import testdata as T

P = replay_params()
WINDOW_MIN = P.window_minutes


def metric_evidence(spark, sf, params=P):
    tel = R.test_data_telemetry(spark, sf)
    tel.pods = tel.logs = None  # metrics need neither
    snap = R.snapshot_from(tel, params)
    dep = M.dependency_latency_p95(T.dep_calls(spark, sf), params)
    return E.service_metric_evidence(snap.error_rate, snap.latency_p95, snap.dependency_failures, dep, params.window_minutes)


def sources(spark, sf, params=P) -> E.BundleSources:
    return E.BundleSources(pods=KD.pods(spark, sf), deployments=KD.deployment_snapshots(spark, sf), events=KD.events(spark, sf),
                           metrics=metric_evidence(spark, sf, params), logs=T.logs(spark, sf))


def _text(**kv):
    """Attributes as ``key=value`` lines in key order, without NULLs."""
    return "array_to_string(list_filter([" + ", ".join(f"'{k}=' || {kv[k]}" for k in sorted(kv)) + "], lambda x: x IS NOT NULL), chr(10))"


def _whole(x):
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"


def _iso(x):
    return f"(strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00')"


def _mid(*parts):
    return "'met_' || left(sha256(concat_ws('|', 'Metric', 'prometheus', " + ", ".join(parts) + ")), 12)"


_MIN = "strftime(pass_ts, '%Y%m%d%H%M')"
SQL_METRIC_EV = f""",
{sql_histogram('dep_calls', 'namespace, service, dependency', 'dhist')},
dp95 AS (SELECT namespace, service, dependency, pass_ts, p95 FROM ({sql_quantile('dhist', 'namespace, service, dependency', 0.95, 'p95')}) WHERE NOT isnan(p95)),
mev AS (SELECT namespace, service AS workload, pass_ts AS observed_at, {_mid('service', "'http_error_rate'", _MIN)} AS evidence_id,
    service || ': ' || {_fixed('errors * 100', 'total', 1)} || ' % of requests returned 5xx over the last {WINDOW_MIN} minutes ('
      || {_whole('total')} || ' requests)' AS summary,
    {_text(errorRatio=_fixed('errors', 'total', 4), totalRequests=_whole('total'), windowMinutes=f"'{WINDOW_MIN}'")} AS attributes FROM er
  UNION ALL SELECT namespace, service, pass_ts, {_mid('service', "'latency_p95'", _MIN)},
    service || ': 95th percentile request duration ' || {_fixed_d('p95', 3)} || 's', {_text(p95Seconds=_fixed_d('p95', 4))} FROM p95
  UNION ALL SELECT namespace, service, pass_ts, {_mid('service', 'dependency', 'kind', _MIN)},
    service || ': ' || {_whole('failures')} || ' ''' || kind || ''' failures calling ' || dependency,
    {_text(dependency='dependency', failureKind='kind', count=_whole('failures'))} FROM dfail
  UNION ALL SELECT namespace, service, pass_ts, {_mid('service', 'dependency', "'latency'", _MIN)},
    service || ': calls to ' || dependency || ' take ' || {_fixed_d('p95', 3)} || 's at the 95th percentile',
    {_text(dependency='dependency', p95Seconds=_fixed_d('p95', 4))} FROM dp95)"""


@register("service_metric_evidence", sql="WITH " + sql_pipeline(P) + SQL_METRIC_EV + "\nSELECT *, 'Metric' AS kind FROM mev")
def q_service_metric_evidence(spark, sf):
    return metric_evidence(spark, sf).select("namespace", "workload", "observed_at", "evidence_id", "summary",
                                             D.signals_text("attributes").alias("attributes"), "kind")


_SIG_COLS = "namespace, workload, pass_ts, signature_hash, occurrences, first_seen, last_seen, distinct_pods, level"
_POD_ID = sql_evidence_id("KubernetesState", "kubernetes", "namespace", "pod", "phase", "CAST(restarts AS VARCHAR)", "waiting_reason", "last_termination_reason")
_DEP_ID = sql_evidence_id("KubernetesState", "kubernetes", "namespace", "workload", "'deployment'",
                          "CAST(desired AS VARCHAR) || '/' || CAST(ready AS VARCHAR) || '/' || CAST(ready AS VARCHAR)")


def sql_bundle(samples: int) -> str:
    """CTEs from moments ``mo`` (incident_id, namespace, workload, moment_ts) to ``bun``."""
    ev = QC.SQL_EVENTS.split(",\nko AS", 1)[1].replace(T.SQL_PODS_ONLY + ",", "").replace("TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '1970-01-01'")
    ev = ev[:ev.index("kx AS")].rstrip().rstrip(",")
    w = P.window_seconds
    within = f"BETWEEN mo.moment_ts - INTERVAL {w} SECOND AND mo.moment_ts - INTERVAL 1 MICROSECOND"
    pod_attrs = _text(
        phase="phase", ready="CASE WHEN ready THEN 'true' ELSE 'false' END", restarts="CAST(restarts AS VARCHAR)", node="node", waitingReason="waiting_reason",
        lastTerminationReason="last_termination_reason", lastExitCode="CAST(last_exit_code AS VARCHAR)",
        minutesSinceLastRestart="CAST(minutes_since_last_restart AS VARCHAR)",
        restartIsRecent="CASE WHEN restart_is_recent THEN 'true' WHEN NOT restart_is_recent THEN 'false' END", memoryLimit="memory_limit")
    return f""",
ko AS{ev},
pf AS{QC.SQL_POD_FACTS.split("pf AS", 1)[1]},
snp AS (SELECT mo.incident_id, max(s.snapshot_ts) AS snap FROM mo JOIN (SELECT DISTINCT namespace, snapshot_ts FROM pods) s
  ON s.namespace = mo.namespace AND s.snapshot_ts <= mo.moment_ts GROUP BY ALL),
b1 AS (SELECT mo.incident_id, {_POD_ID.replace('namespace', 'pf.namespace')} AS evidence_id, 'KubernetesState' AS kind, pf.observed_at, pf.workload,
  {QC._SUMMARY} AS summary, {pod_attrs} AS attributes
  FROM mo JOIN snp USING (incident_id) JOIN pf ON pf.namespace = mo.namespace AND pf.workload = mo.workload AND pf.observed_at = snp.snap),
dsn AS (SELECT namespace, workload, snapshot_ts, count(*) AS desired, sum(CAST(ready AS INTEGER)) AS ready,
  sum(CAST(restart_count = 0 AS INTEGER)) AS updated FROM pods GROUP BY ALL),
b2 AS (SELECT mo.incident_id, {_DEP_ID.replace('namespace', 'dsn.namespace').replace('workload', 'dsn.workload')} AS evidence_id, 'KubernetesState' AS kind,
  dsn.snapshot_ts AS observed_at, dsn.workload,
  'deployment ' || dsn.workload || ': desired=' || {_whole('desired')} || ' ready=' || {_whole('ready')} || ' available=' || {_whole('ready')}
    || ' updated=' || {_whole('updated')}
    || CASE WHEN ready <> desired THEN ' - MinimumReplicasUnavailable: Deployment does not have minimum availability.' ELSE '' END AS summary,
  {_text(desiredReplicas=_whole('desired'), readyReplicas=_whole('ready'), availableReplicas=_whole('ready'), updatedReplicas=_whole('updated'))} AS attributes
  FROM mo JOIN snp USING (incident_id) JOIN dsn ON dsn.namespace = mo.namespace AND dsn.workload = mo.workload AND dsn.snapshot_ts = snp.snap),
ev3 AS (SELECT DISTINCT r7.*, coalesce(lastTimestamp, eventTime, firstTimestamp) AS occurred_at FROM r7),
ev4 AS (SELECT mo.incident_id, mo.workload, e.*, 'evt_' || left(sha256(concat_ws('|', 'KubernetesEvent', 'kubernetes', e.namespace, involved, reason,
    {_iso('occurred_at')})), 12) AS evidence_id FROM mo JOIN ev3 e ON e.namespace = mo.namespace AND starts_with(e.involved, mo.workload)
  AND e.occurred_at {within}),
b3 AS (SELECT incident_id, evidence_id, 'KubernetesEvent' AS kind, occurred_at AS observed_at, workload,
  '[' || type || '] ' || reason || ' on Pod ' || involved || ': ' || {X.sql_strip_control('w')} AS summary,
  {_text(type='type', reason='reason', object="'Pod/' || involved", count='CAST(coalesce(count, 1) AS VARCHAR)', occurredAtUtc=_iso('occurred_at'))} AS attributes
  FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY occurred_at DESC, evidence_id) AS rn FROM ev4) WHERE rn <= {P.max_items}),
b4 AS (SELECT mo.incident_id, evidence_id, 'Metric' AS kind, mev.observed_at, mev.workload, summary, attributes
  FROM mo JOIN mev ON mev.namespace = mo.namespace AND mev.workload = mo.workload AND mev.observed_at = mo.moment_ts),
s7 AS (SELECT namespace, container AS workload, pass_ts, signature_hash, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen,
  count(DISTINCT pod) + max(CASE WHEN pod IS NULL THEN 1 ELSE 0 END) AS distinct_pods, arg_max(level, (ts, pod, message)) AS level,
  arg_max(norm, (ts, pod, message)) AS normalised FROM lw GROUP BY ALL),
s8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace, workload, pass_ts ORDER BY occurrences DESC, signature_hash) AS rn FROM s7)
  WHERE rn <= {P.max_signatures}),
{sql_redacted('s8', _SIG_COLS, 'normalised', 's9', 'sx')},
b5 AS (SELECT mo.incident_id, 'sig_' || left(sha256(concat_ws('|', 'LogSignature', 'loki', signature_hash, s9.workload)), 12) AS evidence_id,
  'LogSignature' AS kind, last_seen AS observed_at, s9.workload, CAST(occurrences AS VARCHAR) || 'x [' || level || '] ' || message AS summary,
  {_text(occurrences='CAST(occurrences AS VARCHAR)', signatureHash='signature_hash', level='level', firstSeenUtc=_iso('first_seen'),
         lastSeenUtc=_iso('last_seen'), distinctPods='CAST(distinct_pods AS VARCHAR)')} AS attributes
  FROM mo JOIN s9 ON s9.namespace = mo.namespace AND s9.workload = mo.workload AND s9.pass_ts = mo.moment_ts),
l6 AS (SELECT * FROM (SELECT mo.incident_id, l.*, row_number() OVER (PARTITION BY mo.incident_id ORDER BY l.ts DESC, l.event_id DESC) AS rn
  FROM mo JOIN logs l ON l.namespace = mo.namespace AND l.container = mo.workload AND l.level = 'error' AND l.ts {within}) WHERE rn <= {samples}),
l7 AS (SELECT *, {sql_sample_id('ts', 'container', 'pod', 'message')} AS evidence_id FROM l6),
{sql_redacted('l7', 'incident_id, evidence_id, ts, container, pod, level', 'message', 'l8', 'ly')},
b6 AS (SELECT incident_id, evidence_id, 'LogSample' AS kind, ts AS observed_at, container AS workload,
  '[' || level || '] ' || CASE WHEN length(message) > 500 THEN substr(message, 1, 500) || '...' ELSE message END AS summary,
  {_text(level='level', pod='pod', timestampUtc=_iso('ts'))} AS attributes FROM l8),
bun AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3 UNION ALL SELECT * FROM b4 UNION ALL SELECT * FROM b5 UNION ALL SELECT * FROM b6)"""


SQL_INCIDENT_MOMENTS = """,
mo AS (SELECT incident_id, namespace, split_part(workloads, ',', 1) AS workload, first_detected_at AS moment_ts FROM incidents)"""
SQL_INCIDENT_BUNDLE = "WITH " + sql_pipeline(P) + sql_incidents(P) + SQL_METRIC_EV + SQL_INCIDENT_MOMENTS + sql_bundle(P.max_log_samples)


def incident_moments(spark, sf):
    """Every incident at the pass that first detected it, replayed once for all families."""
    return stored(R.incidents(spark, sf, P), "incidents").select("incident_id", "namespace", F.get("affected_workloads", 0).alias("workload"),
                                            F.col("first_detected_at").alias("moment_ts"))


@register(
    "evidence_bundle",
    sql=SQL_INCIDENT_BUNDLE + "\nSELECT incident_id, evidence_id, kind, observed_at, workload, summary, attributes FROM bun",
)
def q_evidence_bundle(spark, sf):
    """All six families for every incident of the replay."""
    got, _ = E.bundle(incident_moments(spark, sf), sources(spark, sf), P, whole=True)
    return got.select("incident_id", "evidence_id", "kind", "observed_at", "workload", "summary", D.signals_text("attributes").alias("attributes"))


@register(
    "evidence_bundle_partial",
    sql=SQL_INCIDENT_BUNDLE + """,
un AS (SELECT ['error log samples (ValueError)', 'log signatures (ValueError)'] AS missing)
SELECT mo.incident_id, array_to_string(missing, ',') AS unavailable_sources, false AS is_complete, false AS api_check,
  (SELECT count(*) FROM bun WHERE bun.incident_id = mo.incident_id AND kind NOT IN ('LogSignature', 'LogSample')) AS items FROM mo, un""",
)
def q_evidence_bundle_partial(spark, sf):
    """The log store is down: the other families are collected, and the bundle says what it lacks."""
    src = sources(spark, sf)
    src.logs = None
    m = incident_moments(spark, sf)
    got, failed = E.bundle(m, src, P)
    items = got.groupBy("incident_id").agg(F.count(F.lit(1)).alias("items"))
    c = E.completeness(got, m, failed).join(items, "incident_id", "left")
    return c.select("incident_id", F.array_join("unavailable_sources", ",").alias("unavailable_sources"), "is_complete", "api_check",
                    F.coalesce("items", F.lit(0)).alias("items"))


_KINDS = "[" + ", ".join(f"'{k}'" for k in KIND_PRIORITY) + "]"
HEALTH_LINES = 10  # log lines per Deployment in a cluster report


@register(
    "cluster_health_facts",
    sql="WITH " + sql_pipeline(P) + sql_incidents(P) + SQL_METRIC_EV + """,
mo AS (SELECT namespace || '@' || strftime(snapshot_ts, '%Y-%m-%d') || '/' || workload AS incident_id, namespace, workload, snapshot_ts AS moment_ts
  FROM (SELECT DISTINCT namespace, workload, snapshot_ts FROM pods))""" + sql_bundle(HEALTH_LINES) + f""",
rk AS (SELECT split_part(incident_id, '/', 1) AS scope, row_number() OVER (PARTITION BY split_part(incident_id, '/', 1)
  ORDER BY list_position({_KINDS}, kind) - 1, observed_at DESC, evidence_id) AS r FROM bun),
fc AS (SELECT scope, count(*) AS facts FROM rk WHERE r <= {P.max_evidence_items} GROUP BY scope),
sc AS (SELECT DISTINCT namespace, moment_ts, namespace || '@' || strftime(moment_ts, '%Y-%m-%d') AS scope FROM mo),
op AS (SELECT scope, count(*) AS n FROM sc JOIN incidents i ON i.namespace = sc.namespace AND i.first_detected_at <= sc.moment_ts
  AND (i.recovered_at IS NULL OR i.recovered_at > sc.moment_ts) GROUP BY scope)
SELECT fc.scope AS incident_id, facts, CAST(coalesce(n, 0) AS VARCHAR) || ' open incident(s), ' || CAST(facts AS VARCHAR)
  || ' evidence item(s) examined' AS impact FROM fc LEFT JOIN op USING (scope)""",
)
def q_cluster_health_facts(spark, sf):
    """A report per namespace and snapshot: a bundle per Deployment with ten
    log lines each, trimmed together, and the incidents open at that time."""
    d = stored(KD.deployment_snapshots(spark, sf).select(
        F.col("metadata.namespace").alias("namespace"), F.col("metadata.name").alias("workload"), F.col("observed_at").alias("moment_ts")), "moments")
    scope = F.concat(F.col("namespace"), F.lit("@"), F.date_format("moment_ts", "yyyy-MM-dd"))
    got, _ = E.bundle(d.withColumn("incident_id", F.concat(scope, F.lit("/"), F.col("workload"))), sources(spark, sf), P, HEALTH_LINES, whole=True)
    got = got.withColumn("incident_id", F.substring_index("incident_id", "/", 1))
    scopes = d.select("namespace", "moment_ts", scope.alias("incident_id")).distinct()
    live = I.open_at(R.incidents(spark, sf, P), scopes)
    return E.cluster_health(got, live.select("incident_id", F.col("open_incidents").alias("n")), P.max_evidence_items)


_SEC = ", ".join(f"('{k}', {i + 1}, '{h}')" for i, (k, h) in enumerate(E.DIGEST_SECTIONS))


@register(
    "incident_prompt",
    sql=SQL_INCIDENT_BUNDLE + f""",
src AS (SELECT * FROM (VALUES ('KubernetesState', 'kubernetes'), ('KubernetesEvent', 'kubernetes'), ('Metric', 'prometheus'),
  ('LogSignature', 'loki'), ('LogSample', 'loki')) t(kind, source)),
sec AS (SELECT * FROM (VALUES {_SEC}) t(kind, r, heading)),
tr AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY list_position({_KINDS}, kind) - 1, observed_at DESC, evidence_id) AS rn FROM bun),
blk AS (SELECT e.incident_id, sec.r, sec.heading, e.observed_at, e.evidence_id,
  '<evidence id="' || e.evidence_id || '" source="' || src.source || '" at="' || strftime(e.observed_at, '%Y-%m-%d %H:%M:%SZ') || '">' || chr(10)
  || e.summary || chr(10) || '</evidence>' || chr(10) AS b FROM tr e JOIN sec USING (kind) JOIN src USING (kind) WHERE rn <= {P.max_evidence_items}),
ks AS (SELECT incident_id, r, '### ' || any_value(heading) || chr(10) || string_agg(b, '' ORDER BY observed_at DESC, evidence_id) AS s FROM blk GROUP BY incident_id, r),
dg AS (SELECT incident_id, string_agg(s, chr(10) ORDER BY r) || chr(10) AS digest FROM ks GROUP BY incident_id),
fst AS (SELECT fingerprint, session_no, arg_min(signals, (pass_ts, queue_rank)) AS signals, arg_min(detection_rule, (pass_ts, queue_rank)) AS detection_rule,
  min(pass_ts) AS first_detected_at FROM ses2 GROUP BY ALL)
SELECT i.incident_id, '## Incident' || chr(10) || '- category: ' || category || chr(10) || '- detected severity: ' || severity || chr(10) || '- title: ' || title
  || chr(10) || '- namespace: ' || namespace || chr(10) || '- workloads showing symptoms: ' || replace(workloads, ',', ', ')
  || chr(10) || '- first detected: ' || strftime(i.first_detected_at, '%Y-%m-%d %H:%M:%SZ') || chr(10) || '- most recently observed: '
  || strftime(last_detected_at, '%Y-%m-%d %H:%M:%SZ') || chr(10) || '- observed ' || CAST(detection_count AS VARCHAR) || ' time(s)'
  || chr(10) || '- raised by rule: ' || fst.detection_rule || chr(10) || chr(10) || '### Measured values that triggered the rule' || chr(10)
  || array_to_string(list_transform(string_split(signals, chr(10)), lambda x: '- ' || regexp_replace(x, '=', ': ')), chr(10))
  || chr(10) || chr(10) || '## Evidence' || chr(10) || chr(10) || coalesce(digest, '') AS prompt
FROM incidents i JOIN fst ON fst.fingerprint = i.fingerprint AND fst.first_detected_at = i.first_detected_at LEFT JOIN dg USING (incident_id)""",
)
def q_incident_prompt(spark, sf):
    """Header, signals and trimmed evidence of every incident."""
    inc = stored(R.incidents(spark, sf, P), "incidents")
    moments = inc.select("incident_id", "namespace", F.get("affected_workloads", 0).alias("workload"), F.col("first_detected_at").alias("moment_ts"))
    got, _ = E.bundle(moments, sources(spark, sf), P, whole=True)
    return E.prompt(inc, E.digest(got, P.max_evidence_items))
