"""Sliding-window plumbing shared by metric, log and detection operators.

A detection pass evaluates the window ``[pass_ts - window, pass_ts)``; passes
run every ``slide`` seconds, aligned to the epoch like Spark's ``window()``.
Instead of expanding raw rows into every window they fall in (x5 for the
5 min / 1 min default), rows are first aggregated into slide-sized buckets and
only those partial aggregates are expanded; the expansion factor then applies
to a far smaller table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.config import Params


def epoch_seconds(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_seconds(c.cast("timestamp"))


def slide_bucket(ts, slide_seconds: int) -> Column:
    """Start of the slide-aligned bucket containing ``ts``."""
    sec = epoch_seconds(ts)
    return F.timestamp_seconds(F.floor(sec / F.lit(slide_seconds)) * F.lit(slide_seconds))


def expand_to_passes(df: DataFrame, bucket_col: str, params: Params) -> DataFrame:
    """Replicate each bucket row into every window containing it.

    Adds ``window_start`` and ``pass_ts`` (= window end) and drops the bucket.
    """
    n = params.slides_per_window
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__k")
    out = df.select("*", k)
    start = F.timestamp_seconds(epoch_seconds(bucket_col) - F.col("__k") * F.lit(params.slide_seconds))
    return (
        out.withColumn("window_start", start)
        .withColumn("pass_ts", F.timestamp_seconds(epoch_seconds("window_start") + F.lit(params.window_seconds)))
        .drop("__k", bucket_col)
    )


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, ts: str = "ts",
                bucket: str = "hour") -> DataFrame:
    """Exact running sum per key; per-(key, hour) partial sums carry the
    offset, so a hot key is spread over one task per hour."""
    d = df.withColumn("__b", F.date_trunc(bucket, F.col(ts)))
    per = d.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"))
    w_days = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = per.withColumn("__off", F.coalesce(F.sum("__s").over(w_days), F.lit(0))).drop("__s")
    w_in = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        d.withColumn("__in", F.sum(value).over(w_in))
        .join(offs, on=[*keys, "__b"])
        .withColumn(out, F.col("__off") + F.col("__in"))
        .drop("__b", "__in", "__off")
    )


# --- SQL helpers for oracles -------------------------------------------------

def sql_passes(ts: str, params: Params) -> str:
    """SQL select-list fragment producing window_start/pass_ts via a lateral range."""
    s, w = params.slide_seconds, params.window_seconds
    start = f"(CAST(floor(epoch({ts}) / {s}) AS BIGINT) * {s} - k * {s})"
    return (
        f"make_timestamp({start} * 1000000) AS window_start, "
        f"make_timestamp(({start} + {w}) * 1000000) AS pass_ts"
    )


def sql_window_join(params: Params) -> str:
    return f"range(0, {params.slides_per_window}) AS kk(k)"
