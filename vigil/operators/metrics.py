"""Time-series operators over metric samples and raw requests.

Counter semantics (``increase``): per series, ``delta = v`` when the counter
went down (a reset) else ``v - prev``; the first sample of a series has delta
0. The increase over a window is the sum of the deltas of the samples inside
it *minus the delta of the window's first sample*, because that delta crossed
the left edge. A window with one sample therefore has increase 0. By default
nothing is extrapolated to the window edges; with ``extrapolate`` it is, by
the public rule (``_extrapolated``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.config import Params
from vigil.operators.windows import expand_to_passes, running_sum, slide_bucket
from vigil.session import keyed

# Histogram bucket upper bounds in seconds (+Inf is implicit).
BUCKET_BOUNDS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0]


def _reset_delta(prev: Column, cur: Column) -> Column:
    return F.when(cur < prev, cur).otherwise(cur - prev)


def _extrapolated(increase: Column, first: Column, first_s: Column, last_s: Column, start_s: Column, n: Column, window: float) -> Column:
    """The increase scaled to the whole window: as if samples went on at their
    average gap up to an edge that is nearer than 1.1 gaps, else for half a
    gap; at the start not beyond the instant where the counter would have been 0.
    Null for fewer than two samples; unscaled where all are of one instant.
    """
    sampled = last_s - first_s
    gap = sampled / (n - 1)
    before = first_s - start_s
    before = F.when(before >= gap * 1.1, gap / 2).otherwise(before)
    to_zero = sampled * (first / increase)
    before = F.when((increase > 0) & (first >= 0) & (to_zero < before), to_zero).otherwise(before)
    after = start_s + window - last_s
    after = F.when(after >= gap * 1.1, gap / 2).otherwise(after)
    return F.when(n > 1, F.when(sampled > 0, increase * ((sampled + before + after) / sampled)).otherwise(increase))


def increase(
    samples: DataFrame, series: list[str], params: Params, ts: str = "ts", tiebreak: str = "event_id", extrapolate: bool = False
) -> DataFrame:
    """``increase(counter[window])`` for every series and every pass at once.

    The increase over a window is the sum of reset-aware deltas between
    consecutive samples that are both inside the window (this is the same as
    summing every sample's delta and dropping the one that crosses the left
    edge). It is computed without any per-series scan of the whole history:

    1. inside each (series, slide bucket): deltas between neighbours (a window
       function partitioned by series *and* bucket, so a hot series is split
       into one task per bucket), plus the bucket's first and last value; the
       samples are counted first, as the number of tasks follows them;
    2. buckets are expanded into the windows containing them (bucket rows,
       not raw rows);
    3. per (series, window): the in-bucket sums plus the deltas across
       adjacent non-empty buckets, from a sorted array of at most
       ``slides_per_window`` (first, last) pairs.

    Output: series..., window_start, pass_ts, increase, samples. With
    ``extrapolate`` windows of one sample have no row.
    """
    order = [F.col(ts), F.col(tiebreak)] if tiebreak else [F.col(ts)]
    key = F.struct(*order)
    # by one number: Spark does not reuse a partitioning by a fraction (as le), and would shuffle again
    d = samples.withColumn("__b", slide_bucket(ts, params.slide_seconds)).withColumn("__k", F.xxhash64(*series, "__b"))
    d = keyed(d, samples.count(), "__k")
    w = Window.partitionBy("__k", *series, "__b").orderBy(*order)
    prev = F.lag("value").over(w)
    d = d.withColumn("__d", F.when(prev.isNull(), F.lit(0.0)).otherwise(_reset_delta(prev, F.col("value"))))
    parts = d.groupBy("__k", *series, "__b").agg(
        F.sum("__d").alias("__in"),
        F.min_by("value", key).alias("__first"),
        F.max_by("value", key).alias("__last"),
        F.count(F.lit(1)).alias("__n"),
        *([F.min(_seconds(ts)).alias("__from"), F.max(_seconds(ts)).alias("__to")] if extrapolate else []),
    ).drop("__k").withColumn("__bk", F.col("__b"))
    x = expand_to_passes(parts, "__b", params)
    agg = x.groupBy(*series, "window_start", "pass_ts").agg(
        F.sum("__in").alias("__in"),
        F.sort_array(F.collect_list(F.struct("__bk", "__first", "__last"))).alias("__bs"),
        F.sum("__n").alias("samples"),
        *([F.min("__from").alias("__from"), F.max("__to").alias("__to")] if extrapolate else []),
    )
    n = F.size("__bs")
    cross = F.aggregate(
        F.zip_with(F.slice("__bs", 1, n - 1), F.slice("__bs", 2, n - 1),
                   lambda a, b: _reset_delta(a["__last"], b["__first"])),
        F.lit(0.0), lambda acc, v: acc + v,
    )
    total = F.col("__in") + F.when(n > 1, cross).otherwise(F.lit(0.0))
    if not extrapolate:
        return agg.select(*series, "window_start", "pass_ts", total.alias("increase"), "samples")
    agg = agg.filter(F.col("samples") > 1).withColumn("__total", total)
    scaled = _extrapolated(F.col("__total"), F.get("__bs", 0)["__first"].cast("double"), F.col("__from"), F.col("__to"), _seconds("window_start"),
                           F.col("samples"), float(params.window_seconds))
    return agg.select(*series, "window_start", "pass_ts", scaled.alias("increase"), "samples")


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def rate(inc: DataFrame, params: Params) -> DataFrame:
    return inc.withColumn("rate", F.col("increase") / F.lit(float(params.window_seconds)))


def sum_by(inc: DataFrame, by: list[str], value: str = "increase", out: str | None = None) -> DataFrame:
    return inc.groupBy(*by, "window_start", "pass_ts").agg(F.sum(value).alias(out or value))


def http_error_rate(counter_inc: DataFrame) -> DataFrame:
    """5xx increase / total increase per (namespace, service, pass).

    Rows whose total is NULL or 0 are dropped; missing 5xx counts as 0; 4xx
    is never an error.
    """
    agg = counter_inc.groupBy("namespace", "service", "window_start", "pass_ts").agg(
        F.coalesce(F.sum(F.when(F.col("status_class") == "5xx", F.col("increase"))), F.lit(0.0)).alias("errors"),
        F.sum("increase").alias("total"),
    )
    return agg.filter(F.col("total").isNotNull() & (F.col("total") != 0)).withColumn(
        "ratio", F.col("errors") / F.col("total")
    )


def error_ratio_range(counter_inc: DataFrame) -> DataFrame:
    """Dashboard form: 5xx / max(total, 1) per step, nothing dropped."""
    agg = counter_inc.groupBy("namespace", "service", "window_start", "pass_ts").agg(
        F.coalesce(F.sum(F.when(F.col("status_class") == "5xx", F.col("increase"))), F.lit(0.0)).alias("errors"),
        F.coalesce(F.sum("increase"), F.lit(0.0)).alias("total"),
    )
    return agg.withColumn("error_ratio", F.col("errors") / F.greatest(F.col("total"), F.lit(1.0)))


# --- histograms ----------------------------------------------------------------

def _cum_cols(duration: str) -> list[Column]:
    cols = [
        F.sum(F.when(F.col(duration) <= F.lit(b), 1).otherwise(0)).alias(f"__le{i}")
        for i, b in enumerate(BUCKET_BOUNDS)
    ]
    cols.append(F.count(F.lit(1)).alias(f"__le{len(BUCKET_BOUNDS)}"))
    return cols


def observations_to_histogram(
    obs: DataFrame, by: list[str], params: Params, duration: str = "duration_s", ts: str = "ts", wide: bool = False
) -> DataFrame:
    """Raw durations -> cumulative bucket counts per (by..., pass).

    One hash aggregate with 11 conditional counts per slide bucket, then the
    sliding expansion on those partials, then a stack to long form
    (by..., window_start, pass_ts, le, count) with le = +Inf for the total.
    """
    nb = len(BUCKET_BOUNDS) + 1
    parts = obs.groupBy(*by, slide_bucket(ts, params.slide_seconds).alias("__bucket")).agg(*_cum_cols(duration))
    w = expand_to_passes(parts, "__bucket", params)
    agg = w.groupBy(*by, "window_start", "pass_ts").agg(*[F.sum(f"__le{i}").alias(f"__le{i}") for i in range(nb)])
    bounds = BUCKET_BOUNDS + [float("inf")]
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"__le{i}").cast("double").alias("count")) for i, b in enumerate(bounds)])
    if wide:
        # one row per group with the bucket array: no further exchange needed
        return agg.select(*by, "window_start", "pass_ts", pairs.alias("buckets"))
    return agg.select(*by, "window_start", "pass_ts", F.inline(pairs))


def quantile_from_buckets(q: float, buckets: Column) -> Column:
    """histogram_quantile over an array<struct<le double, count double>> of
    cumulative buckets (any order). Rules: needs a +Inf bucket and a positive
    total, else NaN; rank = q * total; the first finite bucket whose count
    reaches the rank is interpolated linearly (lower bound 0 for the first
    bucket); if only +Inf reaches it, the highest finite bound is returned.
    """
    b = F.array_sort(buckets, lambda x, y: F.when(x["le"] < y["le"], -1).when(x["le"] > y["le"], 1).otherwise(0))
    n = F.size(b)
    last = F.try_element_at(b, F.lit(-1))
    total = last["count"]
    rank = F.lit(q) * total
    finite = F.slice(b, 1, n - 1)
    idx = F.array_position(F.transform(finite, lambda x: x["count"] >= rank), True)
    hit = F.element_at(b, F.greatest(idx, F.lit(1)).cast("int"))
    prev = F.element_at(b, F.greatest(idx - 1, F.lit(1)).cast("int"))
    start = F.when(idx == 1, F.lit(0.0)).otherwise(prev["le"])
    prev_count = F.when(idx == 1, F.lit(0.0)).otherwise(prev["count"])
    interp = start + (hit["le"] - start) * ((rank - prev_count) / (hit["count"] - prev_count))
    nan = F.lit(float("nan"))
    return (
        F.when((n < 2) | (last["le"] != F.lit(float("inf"))) | total.isNull() | (total <= 0), nan)
        .when(idx == 0, F.element_at(b, (n - 1).cast("int"))["le"])
        .when((idx == 1) & (hit["le"] <= 0), hit["le"])
        .otherwise(interp)
    )


def histogram_quantile(hist: DataFrame, by: list[str], q: float, out: str = "quantile") -> DataFrame:
    """Sum bucket counts by ``by`` + le first, then take the quantile."""
    summed = hist.groupBy(*by, "le").agg(F.sum("count").alias("count"))
    grouped = summed.groupBy(*by).agg(F.collect_list(F.struct("le", "count")).alias("__b"))
    return grouped.select(*by, quantile_from_buckets(q, F.col("__b")).alias(out))


def labelled(samples: DataFrame, labels: list[str]) -> DataFrame:
    """Series labels with ``unknown`` in place of NULL."""
    return samples.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in labels})


def p95_from_buckets(samples: DataFrame, by: list[str], series: list[str], params: Params, tiebreak: str | None = "event_id") -> DataFrame:
    """p95 per (by..., pass) from cumulative bucket counters: the increase of
    every bucket series (``series`` and ``le``), summed by ``le``, then the
    quantile; groups without traffic are dropped."""
    labels = [*dict.fromkeys([*series, "le"])]
    inc = increase(labelled(samples, [c for c in by if c != "namespace"]), labels, params, tiebreak=tiebreak)
    keys = [*by, "window_start", "pass_ts"]
    hist = sum_by(inc, [*by, "le"], out="count")
    return histogram_quantile(hist, keys, 0.95, "p95").filter(~F.isnan("p95"))


def latency_p95_from_buckets(samples: DataFrame, params: Params, series: list[str] = ["namespace", "service"]) -> DataFrame:  # noqa: B006
    """M7 from stored bucket counters (namespace, service, le, ts, value; ``series`` names further labels, as a pod)."""
    return p95_from_buckets(samples, ["namespace", "service"], series, params)


def dependency_p95_from_buckets(samples: DataFrame, params: Params, series: list[str] = ["namespace", "service", "dependency"]) -> DataFrame:  # noqa: B006
    """M9 from stored bucket counters (namespace, service, dependency, le, ts, value)."""
    return p95_from_buckets(samples, ["namespace", "service", "dependency"], series, params)


def dependency_failures_from_counters(samples: DataFrame, params: Params, tiebreak: str | None = "event_id") -> DataFrame:
    """M8 from stored failure counters (namespace, service, dependency, kind, ts, value): increases above 0."""
    keys = ["namespace", "service", "dependency", "kind"]
    inc = increase(labelled(samples, keys[1:]), keys, params, tiebreak=tiebreak)
    return inc.select(*keys, "window_start", "pass_ts", F.col("increase").alias("failures")).filter(F.col("failures") > 0)


def latency_p95(requests: DataFrame, params: Params) -> DataFrame:
    """p95 request seconds per (namespace, service, pass); NaN rows dropped."""
    hist = observations_to_histogram(requests, ["namespace", "service"], params, wide=True)
    p = hist.select("namespace", "service", "window_start", "pass_ts", quantile_from_buckets(0.95, F.col("buckets")).alias("p95"))
    return p.filter(~F.isnan("p95"))


def dependency_latency_p95(calls: DataFrame, params: Params) -> DataFrame:
    hist = observations_to_histogram(calls, ["namespace", "service", "dependency"], params, wide=True)
    p = hist.select("namespace", "service", "dependency", "window_start", "pass_ts",
                    quantile_from_buckets(0.95, F.col("buckets")).alias("p95"))
    return p.filter(~F.isnan("p95"))


def dependency_failures(calls: DataFrame, params: Params) -> DataFrame:
    """Failures by (service, dependency, kind) per pass; a NULL label is ``unknown``."""
    keys = ["namespace", "service", "dependency", "kind"]
    f = labelled(calls.filter(F.col("outcome") == "failure"), keys[1:])
    parts = f.groupBy(*keys, slide_bucket("ts", params.slide_seconds).alias("__bucket")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    w = expand_to_passes(parts, "__bucket", params)
    return (
        w.groupBy(*keys, "window_start", "pass_ts")
        .agg(F.sum("__n").cast("double").alias("failures"))
        .filter(F.col("failures") > 0)
    )


def known_services(samples: DataFrame) -> DataFrame:
    """Distinct non-empty service names, ordinal order."""
    return (
        samples.filter(F.col("service").isNotNull() & (F.col("service") != ""))
        .groupBy("service")
        .agg(F.count(F.lit(1)).alias("series_samples"))
        .select("service")
        .orderBy("service")
    )


def requests_to_counters(requests: DataFrame) -> DataFrame:
    """Raw requests -> per-minute counter samples (running totals) by
    (namespace, service, operation, status_class)."""
    keys = ["namespace", "service", "operation", "status_class"]
    per_min = requests.groupBy(*keys, F.date_trunc("minute", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(per_min, keys, ["ts"], "n", "value").select(*keys, "ts", F.col("value").cast("double"))


def gauge_last(samples: DataFrame, by: list[str], value: str = "value", ts: str = "ts", tiebreak: str = "event_id") -> DataFrame:
    return samples.groupBy(*by).agg(F.max_by(F.col(value), F.struct(ts, tiebreak)).alias("last_value"))


def minute_bucket(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, "yyyyMMddHHmm")


def schedule_bucket(ts, seconds: int = 300) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(c.cast("timestamp")) / F.lit(seconds)).cast("bigint")


def targets_up(up: DataFrame, at_least: int = 5) -> DataFrame:
    """Targets whose ``up`` sample is 1 at each pass (pass_ts, target, value), and whether they are enough."""
    n = F.count(F.when(F.col("value") == 1, 1))
    return up.groupBy("pass_ts").agg(n.alias("targets_up"), (n >= at_least).alias("ok"))


CONTAINER = ["namespace", "pod", "container"]


def memory_vs_limit(working_set: DataFrame, limits: DataFrame, params: Params) -> DataFrame:
    """Working-set samples of containers against their memory limit.

    Both are metric samples (namespace, pod, container, ts, value in bytes).
    A sample is compared with the container's last limit at or before it,
    within one window; limits that are not above 0 mean none, and samples without a limit are left out.
    """
    limit = limits.filter(F.col("value") > 0).select(*CONTAINER, "ts", F.lit(None).cast("double").alias("used"), F.col("value").cast("double").alias("limit"))
    used = working_set.select(*CONTAINER, "ts", F.col("value").cast("double").alias("used"), F.lit(None).cast("double").alias("limit"))
    # a limit counts in its own window and the one after it, so no task holds a container's whole history
    window = F.floor(_seconds("ts") / F.lit(params.window_seconds))
    both = used.withColumn("__w", window).unionByName(limit.select("*", F.explode(F.array(window, window + 1)).alias("__w")))
    order = Window.partitionBy(*CONTAINER, "__w").orderBy("ts", F.col("limit").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("limit").isNotNull(), F.struct("ts", "limit")), ignorenulls=True).over(order)
    j = both.withColumn("__last", last).filter(F.col("used").isNotNull() & F.col("__last").isNotNull())
    recent = j.filter(_seconds("ts") - F.unix_micros(F.col("__last.ts").cast("timestamp")) / F.lit(1e6) <= params.window_seconds)
    return recent.select(*CONTAINER, "ts", F.col("used").alias("working_set_bytes"), F.col("__last.limit").alias("limit_bytes"),
                         (F.col("used") / F.col("__last.limit")).alias("ratio"))
