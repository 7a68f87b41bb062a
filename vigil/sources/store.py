"""Stored tables that are upserted in place: Parquet in buckets, by a hash of the key or by a date in it.

A write reads and rewrites only the buckets that its rows fall into (Spark's
dynamic partition overwrite), so its cost follows the rows that come and the size
of a bucket, not the table. Dates suit rows that change for a while and then no more. Rows are merged by a function of the caller's; with no rows the
table stays as it is.

The merged buckets are first written beside the table, under the write's
name, and then put into it. A write that is repeated under its name after a failure
goes on from those rows instead of merging anew, so a bucket that was half
replaced loses nothing. Writers take turns; a reader during the second step may
miss a bucket that is being replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.session import stored

BUCKET = "key_bucket"


def newest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Per key the row with the largest version (struct order; nulls first)."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("row")).select(*key, "row.*")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table (empty if nothing was written yet), with its bucket column."""
    full = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
    return spark.read.schema(full).parquet(path) if _exists(spark, path) else spark.createDataFrame([], full)


def hash_bucket(key: list[str], buckets: int = 64) -> Column:
    """``buckets`` must not change in a table's life."""
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def date_bucket(at: str) -> Column:
    return F.date_format(F.coalesce(F.col(at), F.lit(0).cast("timestamp")), "yyyyMMdd").cast("int")


def upsert(path: str, rows: DataFrame, bucket: Column, merge: Callable[[DataFrame], DataFrame], name: str | None = None) -> int:
    """Merge ``rows`` into the table at ``path``; the number of buckets rewritten.

    ``merge`` gets the stored and the new rows of the buckets concerned and returns the rows that stay, with the same
    columns; it may rely on all rows of a key being there, as ``bucket`` follows from the key. ``name``: of the write, if it
    may be repeated.
    """
    spark = rows.sparkSession
    staged = f"{path}/_staged/{name or uuid.uuid4().hex}"
    if not _exists(spark, f"{staged}/_SUCCESS"):
        dealt = stored(rows.withColumn(BUCKET, bucket), "upsert")
        touched = [r[0] for r in dealt.select(BUCKET).distinct().collect()]  # the buckets of this write
        if not touched:
            return 0
        held = read(spark, path, rows.schema).filter(F.col(BUCKET).isin(touched))
        merged = merge(held.drop(BUCKET).unionByName(dealt.drop(BUCKET))).withColumn(BUCKET, bucket)
        merged.write.mode("overwrite").partitionBy(BUCKET).parquet(staged)
    full = T.StructType([*rows.schema.fields, T.StructField(BUCKET, T.IntegerType())])
    ready = spark.read.schema(full).parquet(staged)
    ready.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return ready.select(BUCKET).distinct().count()
