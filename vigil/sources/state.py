"""Tables the service keeps: semantic memory and the restart counts of the last pass, both upserted bucket by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import memory as SM
from vigil.sources import store

RESTARTS = "namespace string, pod string, restart_count int, pass_ts timestamp"


def upsert_memory(path: str, writes: DataFrame, name: str | None = None) -> int:
    """Upsert memories by (kind, source_ref) into the table at ``path`` (see ``operators.memory.upsert``).

    ``writes`` has created_at, updated_at and a version; a stored row keeps its id, incident_id and created_at. Several
    writes to one key may come together. The number of buckets rewritten.
    """
    key = ["kind", "source_ref"]
    return store.upsert(path, writes, store.hash_bucket(key), lambda rows: SM.newest_memories(rows).select(writes.columns), name)


def save_restart_counts(path: str, pods: DataFrame, name: str | None = None) -> int:
    """Store the counts of passes (``RESTARTS``): those of a namespace's newest pass replace all it had.

    A namespace without pods in ``pods`` (the cluster was unreachable) keeps its counts.
    """
    def newest_pass(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("namespace").agg(F.max("pass_ts").alias("pass_ts"))
        return rows.join(last, ["namespace", "pass_ts"], "left_semi").dropDuplicates(["namespace", "pod"]).select(rows.columns)

    return store.upsert(path, pods, store.hash_bucket(["namespace"]), newest_pass, name)


def restart_counts(spark: SparkSession, path: str) -> DataFrame:
    return store.read(spark, path, spark.createDataFrame([], RESTARTS).schema).drop(store.BUCKET)
