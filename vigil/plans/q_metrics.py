"""Metric queries over the synthetic tables (keys of SURVEY §2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.config import replay_params
from vigil.operators import metrics as M
from vigil.operators.windows import sql_passes, sql_window_join
from vigil.plans.registry import register
from vigil.sources import testdata as T

P = replay_params()
SERIES = ["namespace", "service", "status_class"]
R6 = 6  # decimals kept for floating results compared with the oracle


def counter_increase(spark, sf):
    return M.increase(T.counter_samples(spark, sf), SERIES, P)


SQL_INCREASE_CTE = (
    T.sql_counter_samples()
    + f""",
cd AS (SELECT *, lag(value) OVER (PARTITION BY namespace, service, status_class ORDER BY ts, event_id) AS prev FROM counters),
cdd AS (SELECT *, CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END AS delta FROM cd),
cw AS (SELECT namespace, service, status_class, ts, event_id, delta, {sql_passes('ts', P)} FROM cdd, {sql_window_join(P)}),
inc AS (SELECT namespace, service, status_class, window_start, pass_ts,
  sum(delta) - arg_min(delta, (ts, event_id)) AS increase, count(*) AS samples FROM cw GROUP BY ALL)"""
)


@register(
    "status_class",
    sql="WITH " + T.sql_requests() + "\nSELECT event_id, service, status, status_class FROM requests",
)
def q_status_class(spark, sf):
    return T.requests(spark, sf).select("event_id", "service", "status", "status_class")


@register("ts_increase", sql="WITH " + SQL_INCREASE_CTE + "\nSELECT * FROM inc")
def q_ts_increase(spark, sf):
    return counter_increase(spark, sf)


def _sql_extrapolated() -> str:
    """The public rule in plain SQL over each window's first and last sample."""
    return f""",
ew AS (SELECT namespace, service, status_class, window_start, pass_ts, sum(delta) - arg_min(delta, (ts, event_id)) AS inc, count(*) AS samples,
  CAST(arg_min(value, (ts, event_id)) AS DOUBLE) AS fv, epoch_us(min(ts)) / 1e6 AS t0, epoch_us(max(ts)) / 1e6 AS t1, epoch_us(window_start) / 1e6 AS s0
  FROM (SELECT *, {sql_passes('ts', P)} FROM cdd, {sql_window_join(P)}) GROUP BY ALL HAVING count(*) > 1),
eg AS (SELECT *, t1 - t0 AS sampled, (t1 - t0) / (samples - 1) AS gap FROM ew),
ee AS (SELECT *, CASE WHEN t0 - s0 >= gap * 1.1 THEN gap / 2 ELSE t0 - s0 END AS b0,
  CASE WHEN s0 + {P.window_seconds} - t1 >= gap * 1.1 THEN gap / 2 ELSE s0 + {P.window_seconds} - t1 END AS a FROM eg),
ez AS (SELECT *, CASE WHEN inc > 0 AND fv >= 0 AND sampled * (fv / inc) < b0 THEN sampled * (fv / inc) ELSE b0 END AS b FROM ee)
SELECT namespace, service, status_class, window_start, pass_ts,
  round(CASE WHEN sampled > 0 THEN inc * ((sampled + b + a) / sampled) ELSE inc END, {R6}) AS increase, samples FROM ez"""


@register("ts_increase_extrapolated", sql="WITH " + SQL_INCREASE_CTE + _sql_extrapolated())
def q_ts_increase_extrapolated(spark, sf):
    inc = M.increase(T.counter_samples(spark, sf), SERIES, P, extrapolate=True)
    return inc.withColumn("increase", F.round("increase", R6))


@register(
    "ts_rate",
    sql="WITH " + SQL_INCREASE_CTE
    + f"\nSELECT namespace, service, status_class, pass_ts, round(increase / {float(P.window_seconds)}, {R6 + 3}) AS rate FROM inc",
)
def q_ts_rate(spark, sf):
    r = M.rate(counter_increase(spark, sf), P)
    return r.select(*SERIES, "pass_ts", F.round("rate", R6 + 3).alias("rate"))


@register(
    "ts_sum_by",
    sql="WITH " + SQL_INCREASE_CTE
    + "\nSELECT namespace, service, window_start, pass_ts, sum(increase) AS increase FROM inc GROUP BY ALL",
)
def q_ts_sum_by(spark, sf):
    return M.sum_by(counter_increase(spark, sf), ["namespace", "service"])


SQL_ERROR_RATE_CTE = (
    SQL_INCREASE_CTE
    + """,
er AS (SELECT namespace, service, window_start, pass_ts,
  coalesce(sum(CASE WHEN status_class = '5xx' THEN increase END), 0.0) AS errors, sum(increase) AS total
  FROM inc GROUP BY ALL HAVING sum(increase) IS NOT NULL AND sum(increase) <> 0)"""
)


@register(
    "http_error_rate",
    sql="WITH " + SQL_ERROR_RATE_CTE
    + f"\nSELECT namespace, service, window_start, pass_ts, errors, total, round(errors / total, {R6}) AS ratio FROM er",
)
def q_http_error_rate(spark, sf):
    r = M.http_error_rate(counter_increase(spark, sf))
    return r.withColumn("ratio", F.round("ratio", R6))


@register(
    "error_ratio_range",
    sql="WITH " + SQL_INCREASE_CTE
    + f"""
SELECT namespace, service, window_start, pass_ts, errors, total, round(errors / greatest(total, 1.0), {R6}) AS error_ratio FROM (
  SELECT namespace, service, window_start, pass_ts,
    coalesce(sum(CASE WHEN status_class = '5xx' THEN increase END), 0.0) AS errors, coalesce(sum(increase), 0.0) AS total
  FROM inc GROUP BY ALL)""",
)
def q_error_ratio_range(spark, sf):
    return M.error_ratio_range(counter_increase(spark, sf)).withColumn("error_ratio", F.round("error_ratio", R6))


@register(
    "known_services",
    sql="WITH " + T.sql_counter_samples() + "\nSELECT DISTINCT service FROM counters WHERE service IS NOT NULL AND service <> ''",
)
def q_known_services(spark, sf):
    return M.known_services(T.counter_samples(spark, sf))


BOUNDS_SQL = "[" + ", ".join(repr(b) for b in M.BUCKET_BOUNDS) + ", 'inf'::DOUBLE]"


def sql_histogram(source: str, by: str, alias: str) -> str:
    """Cumulative buckets per (by, window) from raw durations, long form."""
    return f"""{alias}_w AS (SELECT {by}, duration_s, {sql_passes('ts', P)} FROM {source}, {sql_window_join(P)}),
{alias} AS (SELECT {by}, window_start, pass_ts, b.le AS le,
  CAST(count(*) FILTER (WHERE duration_s <= b.le) AS DOUBLE) AS count
  FROM {alias}_w, (SELECT unnest({BOUNDS_SQL}) AS le) b GROUP BY ALL)"""


def sql_quantile(hist: str, by: str, q: float, out: str) -> str:
    """Bucket quantile in SQL: same rules as ``quantile_from_buckets``."""
    return f"""SELECT {by}, window_start, pass_ts,
  CASE WHEN max(total) IS NULL OR max(total) <= 0 THEN 'nan'::DOUBLE
       WHEN min(le) FILTER (WHERE le <> 'inf'::DOUBLE AND count >= {q} * total) IS NULL
         THEN max(le) FILTER (WHERE le <> 'inf'::DOUBLE)
       ELSE arg_min(CASE WHEN prev_le IS NULL THEN 0.0 + le * (({q} * total - 0.0) / (count - 0.0))
                         ELSE prev_le + (le - prev_le) * (({q} * total - prev_count) / (count - prev_count)) END,
                    le) FILTER (WHERE le <> 'inf'::DOUBLE AND count >= {q} * total) END AS {out}
FROM (SELECT *, lag(le) OVER (PARTITION BY {by}, window_start, pass_ts ORDER BY le) AS prev_le,
             lag(count) OVER (PARTITION BY {by}, window_start, pass_ts ORDER BY le) AS prev_count,
             max(count) OVER (PARTITION BY {by}, window_start, pass_ts) AS total FROM {hist}) h
GROUP BY ALL"""


@register(
    "requests_to_histogram",
    sql="WITH " + T.sql_requests() + ",\n" + sql_histogram("requests", "namespace, service", "hist")
    + "\nSELECT * FROM hist",
)
def q_requests_to_histogram(spark, sf):
    return M.observations_to_histogram(T.requests(spark, sf), ["namespace", "service"], P)


@register(
    "latency_p95",
    sql="WITH " + T.sql_requests() + ",\n" + sql_histogram("requests", "namespace, service", "hist")
    + f"\nSELECT namespace, service, window_start, pass_ts, round(p95, {R6}) AS p95 FROM ("
    + sql_quantile("hist", "namespace, service", 0.95, "p95") + ") WHERE NOT isnan(p95)",
)
def q_latency_p95(spark, sf):
    return M.latency_p95(T.requests(spark, sf), P).withColumn("p95", F.round("p95", R6))


@register(
    "histogram_quantile",
    sql="WITH " + T.sql_requests() + ",\n" + sql_histogram("requests", "namespace, operation", "hist")
    + f"\nSELECT namespace, operation, window_start, pass_ts, round(p50, {R6}) AS p50 FROM ("
    + sql_quantile("hist", "namespace, operation", 0.5, "p50") + ")",
)
def q_histogram_quantile(spark, sf):
    hist = M.observations_to_histogram(T.requests(spark, sf), ["namespace", "operation"], P)
    q = M.histogram_quantile(hist, ["namespace", "operation", "window_start", "pass_ts"], 0.5, "p50")
    return q.withColumn("p50", F.round("p50", R6))


@register(
    "dependency_latency_p95",
    sql="WITH " + T.sql_dep_calls() + ",\n" + sql_histogram("dep_calls", "namespace, service, dependency", "hist")
    + f"\nSELECT namespace, service, dependency, window_start, pass_ts, round(p95, {R6}) AS p95 FROM ("
    + sql_quantile("hist", "namespace, service, dependency", 0.95, "p95") + ") WHERE NOT isnan(p95)",
)
def q_dependency_latency_p95(spark, sf):
    return M.dependency_latency_p95(T.dep_calls(spark, sf), P).withColumn("p95", F.round("p95", R6))


SQL_DEP_FAIL_CTE = (
    T.sql_dep_calls()
    + f""",
df_w AS (SELECT namespace, service, dependency, coalesce(kind, 'unknown') AS kind, {sql_passes('ts', P)}
  FROM dep_calls, {sql_window_join(P)} WHERE outcome = 'failure'),
dfail AS (SELECT namespace, service, dependency, kind, window_start, pass_ts, CAST(count(*) AS DOUBLE) AS failures
  FROM df_w GROUP BY ALL HAVING count(*) > 0)"""
)


@register("dependency_failures", sql="WITH " + SQL_DEP_FAIL_CTE + "\nSELECT * FROM dfail")
def q_dependency_failures(spark, sf):
    return M.dependency_failures(T.dep_calls(spark, sf), P)


@register(
    "requests_to_counters",
    sql="WITH " + T.sql_requests()
    + """,
pm AS (SELECT namespace, service, operation, status_class, date_trunc('minute', ts) AS ts, count(*) AS n FROM requests GROUP BY ALL)
SELECT namespace, service, operation, status_class, ts,
  CAST(sum(n) OVER (PARTITION BY namespace, service, operation, status_class ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value
FROM pm""",
)
def q_requests_to_counters(spark, sf):
    return M.requests_to_counters(T.requests(spark, sf))


@register(
    "gauge_last",
    sql="WITH " + T.sql_events() + "\nSELECT namespace, service, arg_max(value, (ts, event_id)) AS last_value FROM ev GROUP BY ALL",
)
def q_gauge_last(spark, sf):
    e = T._events(spark, sf, T.DEFAULT_SERVICES)
    return M.gauge_last(e, ["namespace", "service"])


@register(
    "worker_progress",
    sql="WITH " + T.sql_dep_calls() + "\nSELECT service, outcome, count(*) AS processed FROM dep_calls GROUP BY ALL",
)
def q_worker_progress(spark, sf):
    return T.dep_calls(spark, sf).groupBy("service", "outcome").agg(F.count(F.lit(1)).alias("processed"))


@register(
    "traffic_total",
    sql="WITH " + SQL_INCREASE_CTE
    + "\nSELECT window_start, pass_ts, sum(increase) AS traffic, sum(increase) >= 10 AS traffic_ok FROM inc GROUP BY ALL",
)
def q_traffic_total(spark, sf):
    inc = counter_increase(spark, sf)
    return inc.groupBy("window_start", "pass_ts").agg(
        F.sum("increase").alias("traffic"),
        (F.sum("increase") >= 10).alias("traffic_ok"),
    )


@register(
    "minute_bucket",
    sql="WITH " + T.sql_events() + "\nSELECT event_id, strftime(ts, '%Y%m%d%H%M') AS minute_bucket,"
    " CAST(floor(epoch(ts) / 300) AS BIGINT) AS schedule_bucket FROM ev",
)
def q_minute_bucket(spark, sf):
    e = T._events(spark, sf, T.DEFAULT_SERVICES)
    return e.select("event_id", M.minute_bucket("ts").alias("minute_bucket"), M.schedule_bucket("ts").alias("schedule_bucket"))


@register(
    "dep_failures_range",
    sql="WITH " + SQL_DEP_FAIL_CTE + f"""
SELECT namespace, dependency, pass_ts, sum(failures) AS failures, round(sum(failures) / {float(P.window_seconds)}, 12) AS failure_rate
FROM dfail GROUP BY ALL""",
)
def q_dep_failures_range(spark, sf):
    """Dashboard series: failures per dependency per step, all callers summed."""
    f = M.dependency_failures(T.dep_calls(spark, sf), P)
    g = f.groupBy("namespace", "dependency", "pass_ts").agg(F.sum("failures").alias("failures"))
    return g.withColumn("failure_rate", F.round(F.col("failures") / float(P.window_seconds), 12))


@register(
    "dep_latency_range",
    sql="WITH " + T.sql_dep_calls() + ",\n" + sql_histogram("dep_calls", "namespace, dependency", "hist")
    + f"\nSELECT namespace, dependency, window_start, pass_ts, round(p95, {R6}) AS p95 FROM ("
    + sql_quantile("hist", "namespace, dependency", 0.95, "p95") + ") WHERE NOT isnan(p95)",
)
def q_dep_latency_range(spark, sf):
    """Dashboard series: p95 per dependency per step over all callers
    (buckets summed before the quantile)."""
    hist = M.observations_to_histogram(T.dep_calls(spark, sf), ["namespace", "dependency"], P, wide=True)
    p = hist.select("namespace", "dependency", "window_start", "pass_ts", M.quantile_from_buckets(0.95, F.col("buckets")).alias("p95"))
    return p.filter(~F.isnan("p95")).withColumn("p95", F.round("p95", R6))


@register(
    "targets_up",
    sql="WITH " + T.sql_pod_snapshots() + """
SELECT snapshot_ts AS pass_ts, CAST(sum(CAST(ready AS INTEGER)) AS BIGINT) AS targets_up, sum(CAST(ready AS INTEGER)) >= 5 AS ok FROM pods GROUP BY ALL""",
)
def q_targets_up(spark, sf):
    """Scrape targets that are up (``up == 1``) at each pass; the probe wants at least 5."""
    up = T.pod_snapshots(spark, sf).select(F.col("snapshot_ts").alias("pass_ts"), F.col("pod").alias("target"), F.col("ready").cast("int").alias("value"))
    return M.targets_up(up)


def sql_increase(source: str, series: str, alias: str, p=P) -> str:
    """Increase of every series in every pass, as CTEs ending in ``alias``."""
    return f"""{alias}_d AS (SELECT *, lag(value) OVER (PARTITION BY {series} ORDER BY ts, event_id) AS prev FROM {source}),
{alias}_w AS (SELECT {series}, ts, event_id, CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END AS delta,
  {sql_passes('ts', p)} FROM {alias}_d, {sql_window_join(p)}),
{alias} AS (SELECT {series}, window_start, pass_ts, sum(delta) - arg_min(delta, (ts, event_id)) AS increase FROM {alias}_w GROUP BY ALL)"""


@register(
    "latency_p95_from_buckets",
    sql="WITH " + T.sql_requests() + ",\n" + T.SQL_BUCKETS_ONLY.format(bounds=BOUNDS_SQL) + ",\n"
    + sql_increase("bks", "namespace, service, le", "binc")
    + ",\nbh AS (SELECT namespace, service, le, window_start, pass_ts, sum(increase) AS count FROM binc GROUP BY ALL)"
    + f"\nSELECT namespace, service, window_start, pass_ts, round(p95, {R6}) AS p95 FROM ("
    + sql_quantile("bh", "namespace, service", 0.95, "p95") + ") WHERE NOT isnan(p95)",
)
def q_latency_p95_from_buckets(spark, sf):
    return M.latency_p95_from_buckets(T.bucket_counters(spark, sf), P).select(
        "namespace", "service", "window_start", "pass_ts", F.round("p95", R6).alias("p95"))


@register(
    "dependency_failures_from_counters",
    sql="WITH " + T.sql_dep_calls() + ",\n" + T.SQL_FAILURE_COUNTERS_ONLY
    + ",\nfck AS (SELECT namespace, service, dependency, coalesce(kind, 'unknown') AS kind, ts, event_id, value FROM fcs),\n"
    + sql_increase("fck", "namespace, service, dependency, kind", "finc")
    + "\nSELECT namespace, service, dependency, kind, window_start, pass_ts, increase AS failures FROM finc WHERE increase > 0",
)
def q_dependency_failures_from_counters(spark, sf):
    return M.dependency_failures_from_counters(T.failure_counters(spark, sf), P)
