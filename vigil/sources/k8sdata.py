"""Kubernetes-shaped objects derived from the pod snapshots / events tables.

Objects become JSON text and are parsed back by the schemas of ``json_api``
within the plan, so the source path (serialise -> parse -> nested HOFs) is
exercised without a job while the plan is built.

  pods         one object per pod snapshot: container 'app' carries the
               snapshot's readiness, restarts and reasons (the last
               termination is present once the pod has restarted, finished
               ``last_k`` minutes before the snapshot); a 'proxy' sidecar is
               always ready; pods whose name ends in 0 have no workload label
  events       one per event, with missing timestamps and planted secrets in
               some messages
  deployments  one per (namespace, workload, snapshot)
  nodes        three per snapshot (node-0 is the control plane), ready when
               all pods on them are ready
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.cluster import WORKLOAD_LABEL
from vigil.session import ensure_checkpoint_dir
from vigil.sources import json_api as J
from vigil.sources import testdata as TD


def _dir(spark: SparkSession, kind: str, sf: str) -> str:
    """A fresh folder per write: a DataFrame that already listed an earlier
    write must never see its files replaced underneath it."""
    h = hashlib.sha1(os.path.abspath(sf).encode()).hexdigest()[:10]
    return os.path.join(ensure_checkpoint_dir(spark), "sources", f"{kind}-{h}-{uuid.uuid4().hex[:12]}")


def through_json(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows as JSON text and back through a schema, as a JSON-lines source would give them."""
    text = df.select(F.to_json(F.struct(*df.columns), {"timestampFormat": J.TS_FORMAT}).alias("value"))
    return J.parse_objects(text, schema)


def _node(pod_col) -> F.Column:
    return F.concat(F.lit("node-"), (F.substring(pod_col, -1, 1).cast("int") % 3).cast("string"))


def pod_objects(spark: SparkSession, sf: str) -> DataFrame:
    p = TD.pod_snapshots(spark, sf)
    term = F.when(
        F.col("restart_count") > 0,
        F.struct(
            F.coalesce("last_termination_reason", F.lit("Error")).alias("reason"),
            F.when(F.col("last_termination_reason") == "OOMKilled", 137).otherwise(1).alias("exitCode"),
            (F.col("snapshot_ts") - F.make_interval(mins=F.col("last_k"))).alias("finishedAt"),
        ),
    )
    app = F.struct(
        F.lit("app").alias("name"), F.col("ready").alias("ready"), F.col("restart_count").alias("restartCount"),
        F.struct(F.when(F.col("waiting_reason").isNotNull(),
                        F.struct(F.col("waiting_reason").alias("reason"), F.lit("back-off restarting").alias("message"))).alias("waiting")).alias("state"),
        F.struct(term.alias("terminated")).alias("lastState"),
    )
    proxy = F.struct(F.lit("proxy").alias("name"), F.lit(True).alias("ready"), F.lit(0).alias("restartCount"),
                     F.lit(None).cast(J.CONTAINER_STATUS["state"].dataType).alias("state"),
                     F.lit(None).cast(J.CONTAINER_STATUS["lastState"].dataType).alias("lastState"))
    labels = F.when(F.col("pod").endswith("0"), F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit(WORKLOAD_LABEL), F.col("workload")))
    phase = F.when(F.col("ready") | F.col("waiting_reason").isNotNull(), "Running").otherwise("Pending")
    return p.select(
        F.struct(F.col("pod").alias("name"), F.col("namespace").alias("namespace"), labels.alias("labels")).alias("metadata"),
        F.struct(_node(F.col("pod")).alias("nodeName"),
                 F.array(F.struct(F.lit("app").alias("name"), F.struct(F.create_map(F.lit("memory"), F.lit("256Mi")).alias("limits")).alias("resources")),
                         F.struct(F.lit("proxy").alias("name"), F.struct(F.create_map().cast("map<string,string>").alias("limits")).alias("resources"))
                         ).alias("containers")).alias("spec"),
        F.struct(phase.alias("phase"), F.array(app, proxy).alias("containerStatuses")).alias("status"),
        F.col("snapshot_ts").alias("observed_at"),
    )


POD_ROW = T.StructType(J.POD.fields + [T.StructField("observed_at", T.TimestampType())])


def pods(spark: SparkSession, sf: str) -> DataFrame:
    return through_json(pod_objects(spark, sf), POD_ROW)


def event_objects(spark: SparkSession, sf: str) -> DataFrame:
    e = TD._events(spark, sf, TD.DEFAULT_SERVICES)
    err = F.col("event_type") == "error"
    secret = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit(" password="), F.lit("hunter"), F.col("event_id").cast("string"))).otherwise(F.lit(""))
    return e.select(
        F.when(err, "Warning").otherwise("Normal").alias("type"),
        F.when(err, "BackOff").otherwise("Scheduled").alias("reason"),
        F.concat(F.when(err, F.lit("Back-off restarting failed container app")).otherwise(F.lit("Successfully assigned pod")), secret).alias("message"),
        F.col("k").alias("count"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("lastTimestamp"),
        F.when((F.col("event_id") % 7 == 0) & (F.col("event_id") % 14 != 0), F.col("ts")).alias("eventTime"),
        (F.col("ts") - F.expr("INTERVAL 1 MINUTE")).alias("firstTimestamp"),
        F.struct(F.lit("Pod").alias("kind"), F.concat(F.col("service"), F.lit("-"), F.col("user_id").cast("string")).alias("name")).alias("involvedObject"),
        F.struct(F.col("namespace").alias("namespace")).alias("metadata"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return through_json(event_objects(spark, sf), J.EVENT)


DEPLOYMENT_ROW = T.StructType(J.DEPLOYMENT.fields + [T.StructField("observed_at", T.TimestampType())])


def deployment_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The Deployment of each workload as it was at each snapshot."""
    d = deployments(spark, sf)
    name = F.col("metadata.name")
    plain = d.withColumn("observed_at", F.to_timestamp(F.substring_index(name, "@", -1), "yyyyMMdd")).withColumn(
        "metadata", F.col("metadata").withField("name", F.substring_index(name, "@", 1)))
    return through_json(plain, DEPLOYMENT_ROW)


def deployments(spark: SparkSession, sf: str) -> DataFrame:
    p = TD.pod_snapshots(spark, sf)
    g = p.groupBy("namespace", "workload", "snapshot_ts").agg(
        F.count(F.lit(1)).cast("int").alias("replicas"),
        F.sum(F.col("ready").cast("int")).cast("int").alias("ready"),
        F.sum((F.col("restart_count") == 0).cast("int")).cast("int").alias("updated"),
    )
    cond = F.array(
        F.struct(F.lit("Progressing").alias("type"), F.lit("True").alias("status"), F.lit("NewReplicaSetAvailable").alias("reason"),
                 F.lit("progressing").alias("message")),
        F.struct(F.lit("Available").alias("type"), F.when(F.col("ready") == F.col("replicas"), "True").otherwise("False").alias("status"),
                 F.lit("MinimumReplicasUnavailable").alias("reason"), F.lit("Deployment does not have minimum availability.").alias("message")),
    )
    return g.select(
        F.struct(F.concat(F.col("workload"), F.lit("@"), F.date_format("snapshot_ts", "yyyyMMdd")).alias("name"),
                 F.col("namespace").alias("namespace")).alias("metadata"),
        F.struct(F.col("replicas").alias("replicas")).alias("spec"),
        F.struct(F.when(F.col("ready") > 0, F.col("ready")).alias("readyReplicas"), F.col("ready").alias("availableReplicas"),
                 F.col("updated").alias("updatedReplicas"), cond.alias("conditions")).alias("status"),
    )


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    p = TD.pod_snapshots(spark, sf).withColumn("node", _node(F.col("pod")))
    g = p.groupBy("snapshot_ts", "node").agg(F.bool_and("ready").alias("all_ready"))
    labels = F.when(F.col("node") == "node-0", F.create_map(F.lit("node-role.kubernetes.io/control-plane"), F.lit(""))).otherwise(
        F.create_map(F.lit("kubernetes.io/os"), F.lit("linux")))
    cond = F.array(F.struct(F.lit("Ready").alias("type"), F.when(F.col("all_ready"), "True").otherwise("False").alias("status"),
                            F.lit("KubeletReady").alias("reason"), F.lit("kubelet").alias("message")))
    return g.select("snapshot_ts", F.struct(F.col("node").alias("name"), labels.alias("labels")).alias("metadata"),
                    F.struct(cond.alias("conditions")).alias("status"))
