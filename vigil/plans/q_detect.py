"""Detection, suppression and incident queries with the
whole pipeline repeated in DuckDB SQL as the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.config import Params, replay_params
from vigil.functions import text as X
from vigil.operators import detect as D
from vigil.operators import incidents as I
from vigil.operators import reports as RP
from vigil.operators.metrics import BUCKET_BOUNDS
from vigil.operators.windows import sql_passes, sql_window_join
from vigil.plans import replay as R
from vigil.plans.registry import register
from vigil.session import stored
from vigil.sources import orderdata as O
from vigil.sources import testdata as T

P = replay_params()
R6 = 6


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _sql_fixed(num: str, den: str, dec: int) -> str:
    scale = 10**dec
    scaled = f"CAST(floor(({2 * scale} * ({num}) + ({den})) / (2 * ({den}))) AS BIGINT)"
    return f"(CAST({scaled} // {scale} AS VARCHAR) || '.' || lpad(CAST({scaled} % {scale} AS VARCHAR), {dec}, '0'))"


def _sql_fixed_double(x: str, dec: int) -> str:
    scale = 10**dec
    scaled = f"CAST(floor(({x}) * {scale} + 0.5) AS BIGINT)"
    return f"(CAST({scaled} // {scale} AS VARCHAR) || '.' || lpad(CAST({scaled} % {scale} AS VARCHAR), {dec}, '0'))"


def sql_pipeline(p: Params, services: int = T.DEFAULT_SERVICES) -> str:
    """CTE text from raw tables to suppressed candidates (``sup``)."""
    t = p.thresholds
    bounds = "[" + ", ".join(repr(b) for b in BUCKET_BOUNDS) + ", 'inf'::DOUBLE]"
    sev_rank = "(CASE severity WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 WHEN 'Critical' THEN 3 END)"
    cols = "namespace, pass_ts, category, severity, detection_rule, wl_list, sig, occurrences, signals"

    def signals(**kv):  # in key order, as text lines
        return " || chr(10) || ".join(f"'{k}=' || {kv[k]}" for k in sorted(kv))

    def whole(x):
        return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"

    def flag(x):
        return f"CASE WHEN {x} THEN 'true' ELSE 'false' END"

    minutes = f"'{p.window_minutes}'"
    sig1 = signals(errorRatio=_sql_fixed("errors", "total", 4), threshold=f"'{t.http_error_rate:.4f}'", totalRequests=whole("total"), windowMinutes=minutes)
    sig2 = signals(p95Seconds=_sql_fixed_double("p95", 3), thresholdSeconds=f"'{t.latency_p95_seconds:.3f}'", windowMinutes=minutes)
    sig3 = signals(dependency="dependency", failureKind="kind", failureCount=whole("total"), threshold=f"'{t.dependency_failure_count}'",
                   callerCount="CAST(len(callers) AS VARCHAR)")
    sig4 = (f"'crashLoopBackOff=' || {flag('crash')} || chr(10) || 'oomKilled=' || {flag('oom')} || chr(10) || 'podCount=' || {whole('pod_count')}"
            f" || CASE WHEN reason IS NOT NULL THEN chr(10) || 'reason=' || reason ELSE '' END || chr(10) || 'restartIncrease=' || {whole('increase')}"
            f" || chr(10) || 'threshold={t.pod_restart_increase}'")
    sig5 = signals(unreadyPods=whole("unready"), totalPods=whole("total"), allReplicasUnready=flag("unready = total"), restartsObserved=whole("restarts"))
    sig6 = signals(occurrences=whole("occurrences"), threshold=f"'{t.repeated_signature_count}'", signatureHash="signature_hash",
                   sample=f"{whole('occurrences')} || 'x [' || coalesce(level, '') || '] ' || {X.sql_strip_control('w')}")
    red6 = X.sql_redaction_ctes("s6", "namespace, pass_ts, signature_hash, occurrences, level, workload", "normalised", prefix="dz")
    return f"""{T.sql_events(services)},
{T.SQL_REQUESTS_ONLY},
{T.SQL_COUNTERS_ONLY},
{T.SQL_DEP_CALLS_ONLY},
{T.SQL_LOGS_ONLY},
{T.SQL_PODS_ONLY},
cd AS (SELECT *, lag(value) OVER (PARTITION BY namespace, service, status_class ORDER BY ts, event_id) AS prev FROM counters),
cdd AS (SELECT *, CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END AS delta FROM cd),
cw AS (SELECT namespace, service, status_class, ts, event_id, delta, {sql_passes('ts', p)} FROM cdd, {sql_window_join(p)}),
inc AS (SELECT namespace, service, status_class, window_start, pass_ts,
  sum(delta) - arg_min(delta, (ts, event_id)) AS increase FROM cw GROUP BY ALL),
er AS (SELECT namespace, service, window_start, pass_ts,
  coalesce(sum(CASE WHEN status_class = '5xx' THEN increase END), 0.0) AS errors, sum(increase) AS total
  FROM inc GROUP BY ALL HAVING sum(increase) IS NOT NULL AND sum(increase) <> 0),
hw AS (SELECT namespace, service, duration_s, {sql_passes('ts', p)} FROM requests, {sql_window_join(p)}),
hist AS (SELECT namespace, service, window_start, pass_ts, b.le AS le,
  CAST(count(*) FILTER (WHERE duration_s <= b.le) AS DOUBLE) AS count
  FROM hw, (SELECT unnest({bounds}) AS le) b GROUP BY ALL),
hq AS (SELECT *, lag(le) OVER g AS prev_le, lag(count) OVER g AS prev_count, max(count) OVER g2 AS total FROM hist
  WINDOW g AS (PARTITION BY namespace, service, window_start, pass_ts ORDER BY le),
         g2 AS (PARTITION BY namespace, service, window_start, pass_ts)),
p95 AS (SELECT * FROM (SELECT namespace, service, pass_ts,
  CASE WHEN max(total) IS NULL OR max(total) <= 0 THEN 'nan'::DOUBLE
       WHEN min(le) FILTER (WHERE le <> 'inf'::DOUBLE AND count >= 0.95 * total) IS NULL THEN max(le) FILTER (WHERE le <> 'inf'::DOUBLE)
       ELSE arg_min(CASE WHEN prev_le IS NULL THEN 0.0 + le * ((0.95 * total - 0.0) / (count - 0.0))
                         ELSE prev_le + (le - prev_le) * ((0.95 * total - prev_count) / (count - prev_count)) END, le)
            FILTER (WHERE le <> 'inf'::DOUBLE AND count >= 0.95 * total) END AS p95
  FROM hq GROUP BY ALL) WHERE NOT isnan(p95)),
dfw AS (SELECT namespace, service, dependency, coalesce(kind, 'unknown') AS kind, {sql_passes('ts', p)}
  FROM dep_calls, {sql_window_join(p)} WHERE outcome = 'failure'),
dfail AS (SELECT namespace, service, dependency, kind, pass_ts, CAST(count(*) AS DOUBLE) AS failures FROM dfw GROUP BY ALL),
lh AS (SELECT *, {X.sql_normalise('message')} AS norm FROM logs WHERE level IN ('error', 'warn')),
lw AS (SELECT namespace, left(sha256(norm), 16) AS signature_hash, pod, ts, message, level, container, norm,
  {sql_passes('ts', p)} FROM lh, {sql_window_join(p)}),
sg AS (SELECT namespace, pass_ts, signature_hash, count(*) AS occurrences,
  arg_max(level, (ts, pod, message)) AS level, arg_max(container, (ts, pod, message)) AS workload,
  arg_max(norm, (ts, pod, message)) AS normalised FROM lw GROUP BY ALL),
s6 AS (SELECT * FROM sg WHERE occurrences >= {t.repeated_signature_count} AND level = 'error'),
{red6},
pp AS (SELECT DISTINCT namespace, snapshot_ts AS pass_ts FROM pods),
ps AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY pass_ts) AS pass_seq FROM pp),
pj AS (SELECT p.*, ps.pass_ts, ps.pass_seq FROM pods p JOIN ps ON p.namespace = ps.namespace AND p.snapshot_ts = ps.pass_ts),
pdl AS (SELECT *, CASE WHEN lag(pass_seq) OVER w = pass_seq - 1 THEN lag(restart_count) OVER w ELSE restart_count END AS prev_rc
  FROM pj WINDOW w AS (PARTITION BY namespace, pod ORDER BY pass_seq)),
pdelta AS (SELECT *, greatest(0, restart_count - prev_rc) AS restart_increase FROM pdl),
d1 AS (SELECT namespace, pass_ts, 'http_error_rate' AS category,
  CASE WHEN errors / total >= 0.5 THEN 'Critical' WHEN errors / total >= 0.25 THEN 'High' ELSE 'Medium' END AS severity,
  'http-error-rate' AS detection_rule, [service] AS wl_list, CAST(NULL AS VARCHAR) AS sig, CAST(NULL AS INTEGER) AS occurrences, {sig1} AS signals,
  service || ' is returning ' || {_sql_fixed('errors * 100', 'total', 1)} || ' % server errors' AS title
  FROM er WHERE total >= {t.min_request_sample} AND errors / total >= {t.http_error_rate}),
d2 AS (SELECT p95.namespace, p95.pass_ts, 'dependency_latency' AS category,
  CASE WHEN p95 >= {t.latency_p95_seconds * 3} THEN 'High' ELSE 'Medium' END AS severity,
  'request-latency' AS detection_rule, [p95.service] AS wl_list, CAST(NULL AS VARCHAR) AS sig, CAST(NULL AS INTEGER) AS occurrences, {sig2} AS signals,
  p95.service || ' 95th percentile latency is ' || {_sql_fixed_double('p95', 2)} || 's' AS title
  FROM p95 JOIN er ON p95.namespace = er.namespace AND p95.service = er.service AND p95.pass_ts = er.pass_ts
  WHERE p95 >= {t.latency_p95_seconds} AND er.total >= {t.min_request_sample}),
d3g AS (SELECT namespace, pass_ts, dependency, kind, sum(failures) AS total, list_sort(list_distinct(list(service))) AS callers
  FROM dfail GROUP BY ALL HAVING sum(failures) >= {t.dependency_failure_count}),
d3 AS (SELECT namespace, pass_ts, CASE WHEN kind = 'timeout' THEN 'dependency_latency' ELSE 'dependency_unavailable' END AS category,
  CASE WHEN len(callers) > 1 THEN 'High' ELSE 'Medium' END AS severity, 'dependency-failure' AS detection_rule,
  callers AS wl_list, dependency || ':' || kind AS sig, CAST(NULL AS INTEGER) AS occurrences, {sig3} AS signals,
  CAST(CAST(total AS BIGINT) AS VARCHAR) || ' ''' || kind || ''' failures calling ' || dependency || ' from ' || array_to_string(callers, ', ') AS title
  FROM d3g),
d4g AS (SELECT namespace, pass_ts, workload, sum(restart_increase) AS increase, count(*) AS pod_count,
  bool_or(coalesce(waiting_reason = 'CrashLoopBackOff', false)) AS crash,
  bool_or(coalesce(last_termination_reason = 'OOMKilled', false)) AS oom,
  arg_min(coalesce(last_termination_reason, waiting_reason), pod)
    FILTER (WHERE coalesce(last_termination_reason, waiting_reason) IS NOT NULL AND coalesce(last_termination_reason, waiting_reason) <> '') AS reason
  FROM pdelta GROUP BY ALL),
d4 AS (SELECT namespace, pass_ts, CASE WHEN oom THEN 'out_of_memory' ELSE 'pod_restart_loop' END AS category,
  CASE WHEN oom OR crash THEN 'High' ELSE 'Medium' END AS severity, 'pod-restarts' AS detection_rule,
  [workload] AS wl_list, reason AS sig, CAST(NULL AS INTEGER) AS occurrences, {sig4} AS signals,
  CASE WHEN oom THEN workload || ' was terminated for exceeding its memory limit'
       ELSE workload || ' restarted ' || CAST(increase AS VARCHAR) || ' time(s)' || CASE WHEN crash THEN ' and is in CrashLoopBackOff' ELSE '' END END AS title
  FROM d4g WHERE increase >= {t.pod_restart_increase} OR crash OR oom),
d5g AS (SELECT namespace, pass_ts, workload,
  sum(CASE WHEN NOT ready AND NOT coalesce(waiting_reason = 'CrashLoopBackOff', false)
            AND NOT coalesce(last_termination_reason = 'OOMKilled', false) THEN 1 ELSE 0 END) AS unready, count(*) AS total, sum(restart_count) AS restarts
  FROM pdelta GROUP BY ALL),
d5 AS (SELECT namespace, pass_ts, 'readiness_failure' AS category, CASE WHEN unready = total THEN 'High' ELSE 'Medium' END AS severity,
  'readiness-failure' AS detection_rule, [workload] AS wl_list, CAST(NULL AS VARCHAR) AS sig, CAST(NULL AS INTEGER) AS occurrences, {sig5} AS signals,
  CASE WHEN unready = total THEN 'every ' || workload || ' pod is failing its readiness probe'
       ELSE CAST(unready AS VARCHAR) || ' of ' || CAST(total AS VARCHAR) || ' ' || workload || ' pods are not ready' END AS title
  FROM d5g WHERE unready >= {t.unready_pod_count}),
d6 AS (SELECT namespace, pass_ts, 'repeated_error_signature' AS category,
  CASE WHEN occurrences >= {t.repeated_signature_count * 5} THEN 'High' ELSE 'Medium' END AS severity,
  'repeated-error-signature' AS detection_rule, [coalesce(workload, 'unknown')] AS wl_list, signature_hash AS sig,
  CAST(occurrences AS INTEGER) AS occurrences, {sig6} AS signals,
  coalesce(workload, 'unknown') || ' logged the same error ' || CAST(occurrences AS VARCHAR) || ' times' AS title
  FROM dz{len(X.REDACT_RULES)}),
cand0 AS (SELECT {cols}, title FROM d1 UNION ALL SELECT {cols}, title FROM d2 UNION ALL SELECT {cols}, title FROM d3
  UNION ALL SELECT {cols}, title FROM d4 UNION ALL SELECT {cols}, title FROM d5 UNION ALL SELECT {cols}, title FROM d6),
cand AS (SELECT *, array_to_string(wl_list, ',') AS workloads, {sev_rank} AS severity_rank,
  left(sha256(category || '|' || namespace || '|' || array_to_string(wl_list, ',')
    || CASE WHEN sig IS NOT NULL AND trim(sig) <> '' THEN '|' || sig ELSE '' END), 20) AS fingerprint FROM cand0),
ex AS (SELECT namespace, pass_ts, list_distinct(flatten(list(wl_list))) AS explained FROM cand
  WHERE category IN {tuple(D.EXPLANATORY)} GROUP BY ALL),
cnt AS (SELECT namespace, pass_ts, count(*) AS n FROM cand GROUP BY ALL),
c1 AS (SELECT c.*, cnt.n, coalesce(ex.explained, []) AS explained FROM cand c JOIN cnt USING (namespace, pass_ts)
  LEFT JOIN ex USING (namespace, pass_ts)),
c2 AS (SELECT * FROM c1 WHERE n <= 1 OR category <> 'repeated_error_signature' OR NOT list_has_all(explained, wl_list)),
c3 AS (SELECT *, row_number() OVER (PARTITION BY namespace, pass_ts,
  CASE WHEN category = 'repeated_error_signature' THEN workloads ELSE fingerprint END
  ORDER BY coalesce(occurrences, 0) DESC, fingerprint) AS top FROM c2),
sup AS (SELECT *, row_number() OVER (PARTITION BY namespace, pass_ts ORDER BY severity_rank DESC,
  coalesce(list_position({_sql_list(D.PRECEDENCE)}, category), 0) - 1, fingerprint) AS queue_rank
  FROM c3 WHERE n <= 1 OR category <> 'repeated_error_signature' OR top = 1)"""


def sql_incidents(p: Params) -> str:
    s, w = p.slide_seconds, p.window_seconds
    return f""",
rend AS (SELECT make_timestamp((CAST(floor(epoch(max(ts)) / {s}) AS BIGINT) * {s} + {w}) * 1000000) AS replay_end FROM events),
sg1 AS (SELECT *, epoch(pass_ts) - epoch(lag(pass_ts) OVER (PARTITION BY fingerprint ORDER BY pass_ts, queue_rank)) AS gap FROM sup),
ses AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {p.cooldown_seconds} THEN 1 ELSE 0 END)
  OVER (PARTITION BY fingerprint ORDER BY pass_ts, queue_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no FROM sg1),
ses2 AS (SELECT *, lead(pass_ts) OVER (PARTITION BY fingerprint, session_no ORDER BY pass_ts, queue_rank) AS nxt,
  make_timestamp(((CAST(floor((epoch(pass_ts) + {p.recovery_seconds}) / {s}) AS BIGINT) + 1) * {s}) * 1000000) AS rp FROM ses),
incs AS (SELECT fingerprint, session_no, arg_min(namespace, (pass_ts, queue_rank)) AS namespace,
  arg_min(category, (pass_ts, queue_rank)) AS category, arg_min(workloads, (pass_ts, queue_rank)) AS workloads,
  arg_min(title, (pass_ts, queue_rank)) AS title,
  max(severity_rank) AS severity_rank, min(pass_ts) AS first_detected_at, max(pass_ts) AS last_detected_at,
  count(*) AS detection_count,
  min(rp) FILTER (WHERE (nxt IS NOT NULL AND rp < nxt) OR (nxt IS NULL AND rp <= (SELECT replay_end FROM rend))) AS recovered_at
  FROM ses2 GROUP BY ALL),
incidents AS (SELECT left(sha256(fingerprint || '|' || CAST(CAST(epoch(first_detected_at) AS BIGINT) AS VARCHAR)), 32) AS incident_id,
  fingerprint, namespace, category, {_sql_list(D.SEVERITIES)}[severity_rank + 1] AS severity, severity_rank, title, workloads,
  first_detected_at, last_detected_at, detection_count,
  CAST(epoch(last_detected_at) - epoch(first_detected_at) AS BIGINT) AS duration_seconds,
  CASE WHEN recovered_at IS NOT NULL THEN 'Recovered' ELSE 'Candidate' END AS state, recovered_at FROM incs)"""


CAND_OUT = ["namespace", "pass_ts", "fingerprint", "category", "severity", "detection_rule"]
CAND_SQL_OUT = ", ".join(CAND_OUT) + ", workloads"


def cand_view(df, title: bool = True):
    cols = [*CAND_OUT, F.array_join("affected_workloads", ",").alias("workloads")]
    if title:
        cols += ["title", D.signals_text().alias("signals")]
    return df.select(*cols)


def _snap(spark, sf):
    return R.build_snapshot(spark, sf, P)


def _rule_query(key: str, cte: str, rule_fn, title: bool = True):
    sql = "WITH " + sql_pipeline(P) + f"\nSELECT {CAND_SQL_OUT}{', title, signals' if title else ''} FROM cand WHERE detection_rule = '{cte}'"

    @register(key, sql=sql)
    def q(spark, sf):
        return cand_view(rule_fn(_snap(spark, sf)), title)

    return q


_rule_query("rule_http_error_rate", "http-error-rate", lambda s: D.rule_http_error_rate(s.error_rate, P))
_rule_query("rule_latency", "request-latency", lambda s: D.rule_latency(s.latency_p95, s.error_rate, P))
_rule_query("rule_dependency_failure", "dependency-failure", lambda s: D.rule_dependency_failure(s.dependency_failures, P))
_rule_query("rule_pod_restart", "pod-restarts", lambda s: D.rule_pod_restart(s.pods, P))
_rule_query("rule_readiness", "readiness-failure", lambda s: D.rule_readiness(s.pods, P))
_rule_query("rule_repeated_signature", "repeated-error-signature", lambda s: D.rule_repeated_signature(s.signatures, P))


@register(
    "restart_delta",
    sql="WITH " + sql_pipeline(P) + "\nSELECT namespace, pod, pass_ts, restart_count, prev_rc AS previous_restart_count, restart_increase FROM pdelta",
)
def q_restart_delta(spark, sf):
    d = D.restart_delta(T.pod_snapshots(spark, sf))
    return d.select("namespace", "pod", "pass_ts", "restart_count", "previous_restart_count", "restart_increase")


@register("detect_all", sql="WITH " + sql_pipeline(P) + f"\nSELECT {CAND_SQL_OUT} FROM cand")
def q_detect_all(spark, sf):
    return cand_view(R.candidates(spark, sf, P), title=False)


@register("suppress_explained", sql="WITH " + sql_pipeline(P) + f"\nSELECT {CAND_SQL_OUT} FROM c2")
def q_suppress_explained(spark, sf):
    return cand_view(D.suppress_explained(R.candidates(spark, sf, P)), title=False)


@register(
    "suppress_collapse",
    sql="WITH " + sql_pipeline(P) + f"\nSELECT {CAND_SQL_OUT} FROM c3 WHERE n <= 1 OR category <> 'repeated_error_signature' OR top = 1",
)
def q_suppress_collapse(spark, sf):
    return cand_view(D.suppress_collapse(D.suppress_explained(R.candidates(spark, sf, P))), title=False)


@register("suppress_order", sql="WITH " + sql_pipeline(P) + f"\nSELECT {CAND_SQL_OUT}, queue_rank FROM sup")
def q_suppress_order(spark, sf):
    s = R.suppressed(spark, sf, P)
    return s.select(*CAND_OUT, F.array_join("affected_workloads", ",").alias("workloads"), "queue_rank")


@register(
    "fingerprint",
    sql="WITH " + sql_pipeline(P) + "\nSELECT DISTINCT category, namespace, workloads, sig AS signature, fingerprint FROM cand",
)
def q_fingerprint(spark, sf):
    c = R.candidates(spark, sf, P)
    sig = F.when(F.col("category") == D.REPEATED_ERROR_SIGNATURE, F.col("signals")["signatureHash"]).when(
        F.col("detection_rule") == "dependency-failure",
        F.concat(F.col("signals")["dependency"], F.lit(":"), F.col("signals")["failureKind"]),
    ).when(F.col("detection_rule") == "pod-restarts", F.col("signals")["reason"])
    return c.select(
        "category", "namespace", F.array_join("affected_workloads", ",").alias("workloads"), sig.alias("signature"), "fingerprint"
    ).distinct()


INC_OUT = ("incident_id, fingerprint, namespace, category, severity, workloads, first_detected_at, last_detected_at, "
           "detection_count, duration_seconds, state, recovered_at")


def inc_view(df):
    return df.select(
        "incident_id", "fingerprint", "namespace", "category", "severity",
        F.array_join("affected_workloads", ",").alias("workloads"), "first_detected_at", "last_detected_at",
        "detection_count", "duration_seconds", "state", "recovered_at",
    )


SQL_INCIDENTS = "WITH " + sql_pipeline(P) + sql_incidents(P)


@register("incident_sessions", sql=SQL_INCIDENTS + f"\nSELECT {INC_OUT} FROM incidents", headline=True)
def q_incident_sessions(spark, sf):
    return inc_view(R.incidents(spark, sf, P))


# A detector outage: no pass ran in these days, so nothing recovered in them either.
OUTAGE = ("2024-01-08 00:00:00", "2024-01-13 00:00:00")
SQL_OUTAGE = f"""pass_ts >= TIMESTAMP '{OUTAGE[0]}' AND pass_ts < TIMESTAMP '{OUTAGE[1]}'"""


SQL_SESSIONS_OPEN = SQL_INCIDENTS + f""",
live AS (SELECT * FROM sup WHERE NOT ({SQL_OUTAGE})),
cl AS (SELECT fingerprint, recovered_at AS closed_at FROM incidents WHERE recovered_at IS NOT NULL AND NOT ({SQL_OUTAGE.replace('pass_ts', 'recovered_at')})),
og AS (SELECT *, lag(pass_ts) OVER (PARTITION BY fingerprint ORDER BY pass_ts, queue_rank) AS prev FROM live),
ol AS (SELECT *, prev IS NULL OR epoch(pass_ts) - epoch(prev) > {P.cooldown_seconds} AS late FROM og),
orun AS (SELECT *, max(CASE WHEN late THEN pass_ts END) OVER (PARTITION BY fingerprint ORDER BY pass_ts, queue_rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM ol),
onew AS (SELECT *, late AND (run IS NULL OR EXISTS (SELECT 1 FROM cl WHERE cl.fingerprint = orun.fingerprint
  AND cl.closed_at >= orun.run AND cl.closed_at <= orun.pass_ts)) AS is_new FROM orun),
oses AS (SELECT *, sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY pass_ts, queue_rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no FROM onew)
SELECT fingerprint, min(pass_ts) AS first_detected_at, max(pass_ts) AS last_detected_at, count(*) AS detection_count,
  max(severity_rank) AS severity_rank FROM oses GROUP BY fingerprint, session_no"""


def live_and_closed(spark, sf):
    """Candidates of the passes that ran, and the log of the recoveries they confirmed."""
    def out_of_outage(col):
        return ~((F.col(col) >= F.lit(OUTAGE[0]).cast("timestamp")) & (F.col(col) < F.lit(OUTAGE[1]).cast("timestamp")))

    found = stored(R.suppressed(spark, sf, P), "suppressed")  # both come from one replay
    inc = I.incidents(I.with_replay_end(found, R.replay_end(spark, sf, P)), P)
    closed = inc.filter(F.col("recovered_at").isNotNull() & out_of_outage("recovered_at")).select(
        "fingerprint", F.col("recovered_at").alias("closed_at"))
    return found.filter(out_of_outage("pass_ts")).select("fingerprint", "detected_at", "queue_rank", "severity_rank"), closed


@register("incident_sessions_open", sql=SQL_SESSIONS_OPEN)
def q_incident_sessions_open(spark, sf):
    """Passes stop for longer than the cooldown; incidents that nothing closed go on after it."""
    live, closed = live_and_closed(spark, sf)
    return I.sessions(live, P, closed).groupBy("fingerprint", "session_no").agg(
        F.min("detected_at").alias("first_detected_at"), F.max("detected_at").alias("last_detected_at"),
        F.count(F.lit(1)).alias("detection_count"), F.max("severity_rank").alias("severity_rank")).drop("session_no")


@register(
    "recovered",
    sql=SQL_INCIDENTS + "\nSELECT incident_id, recovered_at FROM incidents WHERE state = 'Recovered'",
)
def q_recovered(spark, sf):
    return R.incidents(spark, sf, P).filter(F.col("state") == "Recovered").select("incident_id", "recovered_at")


@register(
    "severity_floor",
    sql=SQL_INCIDENTS + "\nSELECT incident_id, severity FROM incidents",
)
def q_severity_floor(spark, sf):
    return R.incidents(spark, sf, P).select("incident_id", "severity")


@register(
    "pass_summary",
    sql="WITH " + sql_pipeline(P) + f""",
fs AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, session_no ORDER BY pass_ts, queue_rank) = 1 AS first_in
  FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {P.cooldown_seconds} THEN 1 ELSE 0 END)
  OVER (PARTITION BY fingerprint ORDER BY pass_ts, queue_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no
  FROM (SELECT *, epoch(pass_ts) - epoch(lag(pass_ts) OVER (PARTITION BY fingerprint ORDER BY pass_ts, queue_rank)) AS gap FROM sup))),
bef AS (SELECT namespace, pass_ts, count(*) AS candidates FROM cand GROUP BY ALL),
aft AS (SELECT namespace, pass_ts, count(*) AS kept, sum(CAST(first_in AS INTEGER)) AS created,
  sum(CAST(NOT first_in AS INTEGER)) AS deduplicated FROM fs GROUP BY ALL)
SELECT namespace, pass_ts, candidates, coalesce(kept, 0) AS kept, candidates - coalesce(kept, 0) AS suppressed,
  CAST(coalesce(created, 0) AS BIGINT) AS created, CAST(coalesce(deduplicated, 0) AS BIGINT) AS deduplicated
FROM bef LEFT JOIN aft USING (namespace, pass_ts)""",
)
def q_pass_summary(spark, sf):
    return R.pass_summary(spark, sf, P)


@register(
    "replay",
    sql="WITH " + sql_pipeline(P) + sql_incidents(P)
    + "\nSELECT state, category, severity, count(*) AS incidents, CAST(sum(detection_count) AS BIGINT) AS detections FROM incidents GROUP BY ALL",
    headline=True,
)
def q_replay(spark, sf):
    inc = R.incidents(spark, sf, P)
    return inc.groupBy("state", "category", "severity").agg(
        F.count(F.lit(1)).alias("incidents"), F.sum("detection_count").alias("detections")
    )


# The service's own defaults: five-minute windows every 60 seconds.
P_DEFAULT = replay_params(window_seconds=300, slide_seconds=60, cooldown_seconds=900, recovery_seconds=600, max_range_minutes=120)


@register(
    "replay_defaults",
    sql="WITH " + sql_pipeline(P_DEFAULT) + sql_incidents(P_DEFAULT)
    + "\nSELECT state, category, severity, count(*) AS incidents, CAST(sum(detection_count) AS BIGINT) AS detections FROM incidents GROUP BY ALL",
    headline=True,
)
def q_replay_defaults(spark, sf):
    """Every pass of the whole history at the service's defaults."""
    inc = R.incidents(spark, sf, P_DEFAULT)
    return inc.groupBy("state", "category", "severity").agg(
        F.count(F.lit(1)).alias("incidents"), F.sum("detection_count").alias("detections"))


@register(
    "schedule_bucket",
    sql="WITH " + sql_pipeline(P) + "\nSELECT DISTINCT pass_ts, CAST(floor(epoch(pass_ts) / 300) AS BIGINT) AS dedup_bucket FROM cand",
)
def q_schedule_bucket(spark, sf):
    from vigil.operators.metrics import schedule_bucket

    c = R.candidates(spark, sf, P)
    return c.select("pass_ts", schedule_bucket("pass_ts").alias("dedup_bucket")).distinct()


@register(
    "terminal_flags",
    sql=SQL_INCIDENTS + f"\nSELECT incident_id, state IN {tuple(I.TERMINAL)} AS is_terminal, state IN {tuple(I.IN_FLIGHT)} AS in_flight FROM incidents",
)
def q_terminal_flags(spark, sf):
    return I.terminal_flags(R.incidents(spark, sf, P)).select("incident_id", "is_terminal", "in_flight")


@register(
    "incident_list",
    sql=SQL_INCIDENTS + "\nSELECT incident_id, state, last_detected_at FROM incidents WHERE state = 'Recovered'"
    " ORDER BY last_detected_at DESC, incident_id LIMIT 50",
)
def q_incident_list(spark, sf):
    return I.incident_list(R.incidents(spark, sf, P), "Recovered", 50).select("incident_id", "state", "last_detected_at")


@register(
    "in_flight",
    sql=SQL_INCIDENTS + f"\nSELECT incident_id, state, first_detected_at FROM incidents WHERE state IN {tuple(I.IN_FLIGHT)}",
)
def q_in_flight(spark, sf):
    return I.in_flight(R.incidents(spark, sf, P)).select("incident_id", "state", "first_detected_at")


@register(
    "cluster_status",
    sql=SQL_INCIDENTS + f""",
{O.SQL_WORK_ITEMS},
os AS (SELECT state, count(*) AS n FROM incidents WHERE state IN {tuple(I.IN_FLIGHT)} GROUP BY state),
qd AS (SELECT state, count(*) AS n FROM wi GROUP BY state)
SELECT (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM os) AS open_incidents,
  (SELECT coalesce(string_agg(state || '=' || CAST(n AS VARCHAR), ';' ORDER BY state), '') FROM os) AS incidents_by_state,
  (SELECT coalesce(string_agg(state || '=' || CAST(n AS VARCHAR), ';' ORDER BY state), '') FROM qd) AS work_queue""",
)
def q_cluster_status(spark, sf):
    return I.cluster_status(R.incidents(spark, sf, P), RP.queue_depth(O.work_items(spark, sf)))


@register(
    "open_digest",
    sql=SQL_INCIDENTS + f"""
SELECT incident_id, '[' || severity || '] ' || category || ': ' || title AS line FROM incidents
WHERE state IN {tuple(I.IN_FLIGHT)} ORDER BY first_detected_at, incident_id LIMIT 10""",
)
def q_open_digest(spark, sf):
    return I.open_digest(R.incidents(spark, sf, P))
