"""Retention of stored telemetry: rows beyond an age are neither read nor kept.

Tables are partitioned by the day or hour of their rows. The cut-off follows
the newest row and is found when the query runs: a scalar subquery over the
newest partition, which then filters partitions before any file of them is
opened. ``expire`` removes whole partitions that lie beyond it; rows of the
partition in which it falls go by the filter until that partition is beyond it too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How long the service's stores keep logs and metric samples.
LOG_HOURS = 168
METRIC_HOURS = 6


@dataclass(frozen=True)
class Retention:
    """``column``: the partition column; ``unit``: what it holds, the ``day`` (date) or the ``hour`` (timestamp) of ``ts``."""

    hours: int
    column: str
    unit: str = "day"
    ts: str = "ts"

    def partition(self, at: Column) -> Column:
        return at.cast("date") if self.unit == "day" else F.date_trunc("hour", at).cast("timestamp")


LOGS = Retention(LOG_HOURS, "date")
METRICS = Retention(METRIC_HOURS, "hour", "hour")


def write_partitioned(df: DataFrame, path: str, rule: Retention, max_records: int = 1_000_000) -> None:
    dated = df.withColumn(rule.column, rule.partition(F.col(rule.ts)))
    dated.hint("rebalance", rule.column).write.mode("append").option("maxRecordsPerFile", max_records).partitionBy(rule.column).parquet(path)


def cut_off(table: DataFrame, rule: Retention) -> Column:
    """The oldest instant that is kept, as a scalar subquery; of the rows only the newest partition's ``ts`` is read."""
    newest = table.agg(F.max(rule.column)).scalar()
    last = table.filter(F.col(rule.column) == newest).agg(F.max(F.col(rule.ts).cast("timestamp"))).scalar()
    return last - F.make_dt_interval(hours=F.lit(rule.hours))


def retained(table: DataFrame, rule: Retention) -> DataFrame:
    cut = cut_off(table, rule)
    return table.filter((F.col(rule.column) >= rule.partition(cut)) & (F.col(rule.ts).cast("timestamp") >= cut))


def expire(spark: SparkSession, path: str, rule: Retention) -> list[str]:
    """Delete the partitions that hold no row to be kept; their folders' names. Doing it again changes nothing."""
    table = spark.read.parquet(path)
    keep_from = table.select(rule.partition(cut_off(table, rule)).alias("p")).limit(1)
    old = table.select(rule.column).distinct().crossJoin(keep_from).filter(F.col(rule.column) < F.col("p"))  # days or hours, and one row
    values = {r[0] for r in old.collect()}
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{rule.column}="):
            value = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name.split("=", 1)[1])
            if value in {_text(v) for v in values}:
                fs.delete(status.getPath(), True)
                gone.append(name)
    return sorted(gone)


def _text(value) -> str:
    """A partition value as Spark writes it into a folder's name."""
    return value.isoformat(sep=" ") if hasattr(value, "hour") else value.isoformat()
