"""Readers for API-shaped JSON (metric vectors, log streams, Kubernetes
objects) and for container runtime (CRI) log files.

Everything is a Spark reader or a Column expression over a JSON text column:
explicit schemas, ``from_json`` / ``explode`` / ``inline``; no driver-side
parsing. Kubernetes lists can be JSON-lines (one object per line, the bulk
export form) or list documents (``{"items": [...]}``, one API page each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.sources.cri import cri_lines, logical_lines

# --- schemas -----------------------------------------------------------------------

CONTAINER_STATUS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("ready", T.BooleanType()),
    T.StructField("restartCount", T.IntegerType()),
    T.StructField("state", T.StructType([
        T.StructField("waiting", T.StructType([T.StructField("reason", T.StringType()), T.StructField("message", T.StringType())])),
    ])),
    T.StructField("lastState", T.StructType([
        T.StructField("terminated", T.StructType([
            T.StructField("reason", T.StringType()),
            T.StructField("exitCode", T.IntegerType()),
            T.StructField("finishedAt", T.TimestampType()),
        ])),
    ])),
])

POD = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    ])),
    T.StructField("spec", T.StructType([
        T.StructField("nodeName", T.StringType()),
        T.StructField("containers", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("resources", T.StructType([T.StructField("limits", T.MapType(T.StringType(), T.StringType()))])),
        ]))),
    ])),
    T.StructField("status", T.StructType([
        T.StructField("phase", T.StringType()),
        T.StructField("containerStatuses", T.ArrayType(CONTAINER_STATUS)),
    ])),
])

EVENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("count", T.IntegerType()),
    T.StructField("lastTimestamp", T.TimestampType()),
    T.StructField("eventTime", T.TimestampType()),
    T.StructField("firstTimestamp", T.TimestampType()),
    T.StructField("involvedObject", T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())])),
    T.StructField("metadata", T.StructType([T.StructField("namespace", T.StringType())])),
])

CONDITION = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("message", T.StringType()),
])

DEPLOYMENT = T.StructType([
    T.StructField("metadata", T.StructType([T.StructField("name", T.StringType()), T.StructField("namespace", T.StringType())])),
    T.StructField("spec", T.StructType([T.StructField("replicas", T.IntegerType())])),
    T.StructField("status", T.StructType([
        T.StructField("readyReplicas", T.IntegerType()), T.StructField("availableReplicas", T.IntegerType()),
        T.StructField("updatedReplicas", T.IntegerType()), T.StructField("conditions", T.ArrayType(CONDITION)),
    ])),
])

NODE = T.StructType([
    T.StructField("metadata", T.StructType([T.StructField("name", T.StringType()),
                                            T.StructField("labels", T.MapType(T.StringType(), T.StringType()))])),
    T.StructField("status", T.StructType([T.StructField("conditions", T.ArrayType(CONDITION))])),
])

VECTOR = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("resultType", T.StringType()),
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField("metric", T.MapType(T.StringType(), T.StringType())),
            T.StructField("value", T.ArrayType(T.StringType())),
        ]))),
    ])),
])

STREAMS = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("data", T.StructType([
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField("stream", T.MapType(T.StringType(), T.StringType())),
            T.StructField("values", T.ArrayType(T.ArrayType(T.StringType()))),
        ]))),
    ])),
])


def _list_of(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("items", T.ArrayType(schema))])


TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"


def read_objects(spark: SparkSession, path: str, schema: T.StructType, list_document: bool = False) -> DataFrame:
    """Kubernetes objects from JSON-lines, or from list documents (exploded).
    Timestamps are RFC 3339 with optional microseconds."""
    if list_document:
        doc = spark.read.schema(_list_of(schema)).option("multiLine", True).option("timestampFormat", TS_FORMAT).json(path)
        return doc.select(F.inline("items"))
    return spark.read.schema(schema).option("timestampFormat", TS_FORMAT).json(path)


def parse_objects(lines: DataFrame, schema: T.StructType, col: str = "value") -> DataFrame:
    """The same from a column of JSON text; a line that is no object gives no row."""
    o = F.from_json(F.col(col), schema, {"timestampFormat": TS_FORMAT})
    return lines.select(o.alias("o")).filter(F.col("o").isNotNull()).select("o.*")


# --- metric vectors / log streams ----------------------------------------------------

def parse_vector(doc: Column) -> Column:
    """Instant-vector JSON text -> array<struct<labels, value>>; samples whose
    value does not parse as a number are dropped ("NaN" and "+Inf" parse)."""
    parsed = F.from_json(doc, VECTOR)
    items = F.transform(
        F.coalesce(parsed["data"]["result"], F.array().cast(VECTOR["data"].dataType["result"].dataType)),
        lambda r: F.struct(r["metric"].alias("labels"), F.try_element_at(r["value"], F.lit(2)).alias("raw")),
    )
    typed = F.transform(items, lambda r: F.struct(r["labels"].alias("labels"), _to_double(r["raw"]).alias("value")))
    return F.filter(typed, lambda r: r["value"].isNotNull())


def _to_double(s: Column) -> Column:
    t = F.lower(F.trim(s))
    special = (
        F.when(t == "nan", F.lit(float("nan")))
        .when(t.isin("+inf", "inf"), F.lit(float("inf")))
        .when(t == "-inf", F.lit(float("-inf")))
    )
    return F.coalesce(special, s.try_cast("double"))


def parse_streams(doc: Column) -> Column:
    """Range-query JSON text -> array<struct<labels, ts, line>>; value pairs
    shorter than 2 are skipped; the nanosecond epoch is truncated to ms."""
    parsed = F.from_json(doc, STREAMS)
    res = F.coalesce(parsed["data"]["result"], F.array().cast(STREAMS["data"].dataType["result"].dataType))
    per_stream = F.transform(
        res,
        lambda s: F.transform(
            F.filter(F.coalesce(s["values"], F.array().cast("array<array<string>>")), lambda v: F.size(v) >= 2),
            lambda v: F.struct(
                s["stream"].alias("labels"),
                F.timestamp_millis(F.floor(v[0].try_cast("decimal(38,0)") / F.lit(1_000_000)).cast("bigint")).alias("ts"),
                v[1].alias("line"),
            ),
        ),
    )
    return F.flatten(per_stream)


# --- container runtime log files ----------------------------------------------------------

def cri_rejects(spark: SparkSession, path: str, exclude_prefix: str | None = None) -> DataFrame:
    """(file, rejected): lines per file that do not have the CRI shape; ``read_cri`` leaves them out."""
    bad = cri_lines(spark, path, exclude_prefix).filter("rejected")
    return bad.groupBy("file").agg(F.count(F.lit(1)).alias("rejected"))


def read_cri(spark: SparkSession, path: str, exclude_prefix: str | None = None, rejects: Observation | None = None) -> DataFrame:
    """CRI log files -> one row per logical line (see ``vigil.sources.cri``).

    Chunks are joined in the order of the file: stamps can be equal, cut off
    or wrong. ``stamp`` is the first chunk's, as written, ``ts`` the same as a
    timestamp (null if it is none). Lines of another shape are counted by
    ``cri_rejects``, or in the same pass by ``rejects``, an observation of
    ``lines`` and ``rejected``; ``exclude_prefix`` drops the collector's own files.
    """
    rows = cri_lines(spark, path, exclude_prefix)
    if rejects is not None:
        rows = rows.observe(rejects, F.count(F.lit(1)).alias("lines"), F.count_if("rejected").alias("rejected"))
    return logical_lines(rows)


def parse_app_json(df: DataFrame, col: str = "log") -> DataFrame:
    """Parse the application's JSON out of ``log``; non-JSON lines pass through, a ``ts`` that is no timestamp gives null."""
    v = F.try_parse_json(F.col(col))
    obj = F.when(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"), v)
    return df.withColumn("app", obj).withColumn(
        "app_ts", F.try_to_timestamp(F.try_variant_get(F.col("app"), "$.ts", "string"))
    )


def write_logs_by_label(logs: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """Store log lines partitioned by (date, namespace, level), the only index
    labels. Rebalancing lets Spark split a large label over tasks, and a file
    holds ``max_records`` lines at most."""
    labelled = logs.withColumn("date", F.to_date("ts"))
    labelled.hint("rebalance", "date", "namespace", "level").write.mode("overwrite").option(
        "maxRecordsPerFile", max_records).partitionBy("date", "namespace", "level").parquet(path)


def lift_kubernetes(df: DataFrame, prefix: str = "k8s_", renames: dict | None = None, drop: list | None = None) -> DataFrame:
    """Lift nested ``kubernetes.*`` fields to the top level with a prefix,
    rename and drop some."""
    inner = df.schema["kubernetes"].dataType.fieldNames()
    out = df.select("*", *[F.col(f"kubernetes.{f}").alias(prefix + f) for f in inner]).drop("kubernetes")
    if renames:
        out = out.withColumnsRenamed(renames)
    if drop:
        out = out.drop(*drop)
    return out
