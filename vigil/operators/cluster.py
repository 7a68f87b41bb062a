"""Cluster-state operators over Kubernetes objects.

All per-pod logic runs on the nested container-status array with
higher-order functions (``aggregate``, ``forall``, ``filter``,
``array_max``): no explode, so a pod stays one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.config import Params
from vigil.functions import ids
from vigil.functions.ids import SOURCE_K8S
from vigil.functions.text import with_redaction

WORKLOAD_LABEL = "app.kubernetes.io/name"
RECENT_MINUTES = 15


def attribute_map(**values: Column) -> Column:
    """Evidence attributes: the given values that are not NULL."""
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))


def _first_nonempty(arr: Column) -> Column:
    return F.get(F.filter(arr, lambda r: r.isNotNull() & (r != "")), 0)


def pod_fields(pods: DataFrame) -> DataFrame:
    """Flat per-pod facts from the nested object (shared by K1, K2, K7)."""
    cs = F.coalesce(F.col("status.containerStatuses"), F.array().cast("array<struct<name:string,ready:boolean,restartCount:int,state:struct<waiting:struct<reason:string,message:string>>,lastState:struct<terminated:struct<reason:string,exitCode:int,finishedAt:timestamp>>>>"))
    return pods.select(
        "*",
        F.col("metadata.name").alias("pod"),
        F.col("metadata.namespace").alias("namespace"),
        F.coalesce(F.col("status.phase"), F.lit("Unknown")).alias("phase"),
        F.aggregate(cs, F.lit(0), lambda a, c: a + F.coalesce(c["restartCount"], F.lit(0))).alias("restarts"),
        ((F.size(cs) > 0) & F.forall(cs, lambda c: F.coalesce(c["ready"], F.lit(False)))).alias("ready"),
        _first_nonempty(F.transform(cs, lambda c: c["state"]["waiting"]["reason"])).alias("waiting_reason"),
        _first_nonempty(F.transform(cs, lambda c: c["lastState"]["terminated"]["reason"])).alias("last_termination_reason"),
        F.get(F.filter(F.transform(cs, lambda c: c["lastState"]["terminated"]["exitCode"]), lambda x: x.isNotNull()), 0).alias("last_exit_code"),
        F.array_max(F.transform(cs, lambda c: c["lastState"]["terminated"]["finishedAt"])).alias("last_terminated_at"),
        F.get(F.col("spec.containers"), 0)["resources"]["limits"]["memory"].alias("memory_limit"),
        F.coalesce(F.col("spec.nodeName"), F.lit("unassigned")).alias("node"),
        F.col("metadata.labels")[WORKLOAD_LABEL].alias("workload_label"),
    )


def pod_status(pods: DataFrame, now: str = "observed_at") -> DataFrame:
    """K1: one KubernetesState evidence row per pod, recency against ``now``."""
    p = pod_fields(pods)
    age_min = (F.unix_micros(F.col(now).cast("timestamp")) - F.unix_micros("last_terminated_at")) / F.lit(60_000_000.0)
    minutes = F.bround(age_min, 0).cast("bigint")
    recent = age_min < RECENT_MINUTES
    restart_txt = F.when(
        F.col("last_terminated_at").isNotNull(),
        F.concat(F.lit("last restart "), minutes.cast("string"), F.lit("m ago "),
                 F.when(minutes < RECENT_MINUTES, F.lit("(RECENT)"))
                 .otherwise(F.lit("(not recent - probably unrelated to any current problem)"))),
    )
    summary = F.concat_ws(
        ", ",
        F.concat(F.lit("pod "), F.col("pod"), F.lit(" phase="), F.col("phase"), F.lit(" ready="),
                 F.when(F.col("ready"), "True").otherwise("False"), F.lit(" restarts="), F.col("restarts").cast("string")),
        F.when(F.col("waiting_reason").isNotNull(), F.concat(F.lit("waiting="), F.col("waiting_reason"))),
        F.when(F.col("last_termination_reason").isNotNull(), F.concat(F.lit("lastTermination="), F.col("last_termination_reason"))),
        F.when(F.col("last_exit_code").isNotNull(), F.concat(F.lit("exitCode="), F.col("last_exit_code").cast("string"))),
        restart_txt,
    )
    # Optional facts are attribute strings, present only when they apply.
    return p.select(
        "namespace", "pod", "phase", "ready", "restarts", "waiting_reason", "last_termination_reason",
        F.col("last_exit_code").cast("string").alias("last_exit_code"),
        "last_terminated_at", "memory_limit", "node", F.col("workload_label").alias("workload"), F.col(now).alias("observed_at"),
        F.when(F.col("last_terminated_at").isNotNull(), minutes.cast("string")).alias("minutes_since_last_restart"),
        F.when(F.col("last_terminated_at").isNotNull(), F.when(recent, "true").otherwise("false")).alias("restart_is_recent"),
        summary.alias("summary"),
        ids.evidence_id("KubernetesState", SOURCE_K8S, F.col("namespace"), F.col("pod"), F.col("phase"),
                        F.col("restarts").cast("string"), F.col("waiting_reason"), F.col("last_termination_reason")).alias("evidence_id"),
        F.lit("KubernetesState").alias("kind"), F.lit(SOURCE_K8S).alias("source"),
        attribute_map(
            phase=F.col("phase"), ready=F.when(F.col("ready"), "true").otherwise("false"), restarts=F.col("restarts").cast("string"),
            node=F.col("node"), waitingReason=F.col("waiting_reason"), lastTerminationReason=F.col("last_termination_reason"),
            lastExitCode=F.col("last_exit_code").cast("string"),
            minutesSinceLastRestart=F.when(F.col("last_terminated_at").isNotNull(), minutes.cast("string")),
            restartIsRecent=F.when(F.col("last_terminated_at").isNotNull(), F.when(recent, "true").otherwise("false")),
            memoryLimit=F.col("memory_limit")).alias("attributes"),
    )


def select_workload(pods: DataFrame, workload: str | None) -> DataFrame:
    """The label selector ``app.kubernetes.io/name=<workload>``."""
    if workload is None:
        return pods
    return pods.filter(F.col("metadata.labels")[WORKLOAD_LABEL] == workload)


def restart_counts(pods: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """K2: flat restart info; workload = label, else the pod name."""
    p = pod_fields(pods)
    return p.select(*(keep or []), "namespace", "pod", F.coalesce("workload_label", "pod").alias("workload"),
                    F.col("restarts").alias("restart_count"), "ready", "waiting_reason", "last_termination_reason")


def unhealthy(pods: DataFrame) -> DataFrame:
    """K7: phase != Running or not ready."""
    p = pod_fields(pods)
    return p.filter((F.col("phase") != "Running") | ~F.col("ready")).select("namespace", "pod", "phase", "ready", "restarts")


def workload_names(deployments: DataFrame) -> DataFrame:
    """K5: the names of the Deployments of each namespace, in binary order."""
    d = deployments.select(F.col("metadata.namespace").alias("namespace"), F.col("metadata.name").alias("workload"))
    return d.distinct().orderBy("namespace", "workload")


MAX_NAME = 63  # characters of a workload name


def prefix_workloads(names: DataFrame, workloads: DataFrame) -> DataFrame:
    """(namespace, involved, workload): the workloads whose name begins each object name.

    Every prefix a workload can have is a row, so it is an equi-join.
    """
    d = names.select("namespace", "involved").distinct()
    lengths = F.sequence(F.lit(1), F.least(F.length("involved"), F.lit(MAX_NAME)))
    p = d.filter(F.col("involved") != "").select("namespace", "involved", F.explode(lengths).alias("n")).select(
        "namespace", "involved", F.col("involved").substr(F.lit(1), F.col("n")).alias("workload"))
    return p.join(workloads.select("namespace", "workload").distinct(), ["namespace", "workload"])


def k8s_events(events: DataFrame, workloads: DataFrame | None, since, limit: int | None = 200) -> DataFrame:
    """K3 for every workload at once: occurred = last ?? event ?? first time;
    drop NULL or older than ``since``; the involved object name must start
    with the workload name; newest first, ``limit`` per workload. Texts are made of what is left."""
    e = event_rows(events, workloads, since)
    if limit is None:
        return event_evidence(e)
    w = Window.partitionBy("namespace", "workload").orderBy(F.col("occurred_at").desc(), F.col("evidence_id"))
    return event_evidence(e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit), after=["rank"])


def _event_iso() -> Column:
    return F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS'+00:00'")


def event_rows(events: DataFrame, workloads: DataFrame | None, since) -> DataFrame:
    """The events of the workloads (all, if None) with occurred_at, involved, namespace, workload and evidence_id."""
    occurred = F.coalesce("lastTimestamp", "eventTime", "firstTimestamp")
    e = events.select("*", occurred.alias("occurred_at"), F.coalesce(F.col("involvedObject.name"), F.lit("")).alias("involved"),
                      F.col("metadata.namespace").alias("namespace"))
    e = e.filter(F.col("occurred_at").isNotNull() & (F.col("occurred_at") >= F.lit(since)))
    if workloads is not None:
        e = e.join(prefix_workloads(e, workloads), ["namespace", "involved"])
    else:
        e = e.withColumn("workload", F.lit(None).cast("string"))
    return e.withColumn("evidence_id", ids.evidence_id(
        "KubernetesEvent", SOURCE_K8S, F.col("namespace"), F.col("involved"), F.col("reason"), _event_iso()))


def event_evidence(rows: DataFrame, before: list[str] | None = None, after: list[str] | None = None) -> DataFrame:
    """``event_rows`` as evidence: redacted summary and attributes; ``before`` and ``after``: further columns to keep."""
    e = with_redaction(rows, "message", "redacted_message", "redacted_value_count")
    return e.select(
        *(before or []), "namespace", "workload", "involved", "occurred_at", "evidence_id",
        F.concat(F.lit("["), F.coalesce("type", F.lit("")), F.lit("] "), F.coalesce("reason", F.lit("")), F.lit(" on "),
                 F.coalesce(F.col("involvedObject.kind"), F.lit("")), F.lit(" "), F.col("involved"), F.lit(": "),
                 F.col("redacted_message")).alias("summary"),
        F.coalesce("count", F.lit(1)).alias("count"),
        "redacted_value_count",
        F.lit("KubernetesEvent").alias("kind"), F.lit(SOURCE_K8S).alias("source"),
        attribute_map(type=F.coalesce("type", F.lit("Normal")), reason=F.coalesce("reason", F.lit("Unknown")),
                      object=F.concat(F.coalesce(F.col("involvedObject.kind"), F.lit("")), F.lit("/"), F.col("involved")),
                      count=F.coalesce("count", F.lit(1)).cast("string"), occurredAtUtc=_event_iso()).alias("attributes"),
        *(after or []),
    )


def deployment_status(deps: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """K4: replica counts (NULL -> 0) and the first Available!=True condition."""
    desired = F.coalesce(F.col("spec.replicas"), F.lit(0))
    ready = F.coalesce(F.col("status.readyReplicas"), F.lit(0))
    avail = F.coalesce(F.col("status.availableReplicas"), F.lit(0))
    upd = F.coalesce(F.col("status.updatedReplicas"), F.lit(0))
    bad = F.get(F.filter(F.coalesce(F.col("status.conditions"), F.array().cast("array<struct<type:string,status:string,reason:string,message:string>>")),
                         lambda c: (c["type"] == "Available") & ((c["status"] != "True") | c["status"].isNull())), 0)
    summary = F.concat(
        F.lit("deployment "), F.col("metadata.name"), F.lit(": desired="), desired.cast("string"), F.lit(" ready="), ready.cast("string"),
        F.lit(" available="), avail.cast("string"), F.lit(" updated="), upd.cast("string"),
        F.when(bad.isNotNull(), F.concat(F.lit(" - "), F.coalesce(bad["reason"], F.lit("")), F.lit(": "), F.coalesce(bad["message"], F.lit("")))).otherwise(F.lit("")),
    )
    return deps.select(
        *(keep or []), F.col("metadata.namespace").alias("namespace"), F.col("metadata.name").alias("deployment"),
        desired.alias("desired"), ready.alias("ready"), avail.alias("available"), upd.alias("updated"), summary.alias("summary"),
        ids.evidence_id("KubernetesState", SOURCE_K8S, F.col("metadata.namespace"), F.col("metadata.name"), F.lit("deployment"),
                        F.concat_ws("/", desired.cast("string"), ready.cast("string"), avail.cast("string"))).alias("evidence_id"),
        F.lit("KubernetesState").alias("kind"), F.lit(SOURCE_K8S).alias("source"),
        attribute_map(desiredReplicas=desired.cast("string"), readyReplicas=ready.cast("string"),
                      availableReplicas=avail.cast("string"), updatedReplicas=upd.cast("string")).alias("attributes"),
    )


def k8s_bundle(pods: DataFrame, deployments: DataFrame, events: DataFrame, workloads: DataFrame, since, limit: int = 200) -> DataFrame:
    """Pods, deployments and the newest events of every workload, by
    section: (section, namespace, workload, evidence_id, summary)."""
    def part(df: DataFrame, section: str, workload: str = "workload") -> DataFrame:
        return df.select(F.lit(section).alias("section"), "namespace", F.col(workload).alias("workload"), "evidence_id", "summary")

    return (part(pod_status(pods), "pods").unionByName(part(deployment_status(deployments), "deployments", "deployment"))
            .unionByName(part(k8s_events(events, workloads, since, limit), "events")))


def node_status(nodes: DataFrame, by: list[str] | None = None, min_nodes: int = 3) -> DataFrame:
    """K8: role from label presence, Ready condition; the cluster is ready
    when every node is ready and there are at least ``min_nodes``."""
    by = by or []
    labels = F.coalesce(F.col("metadata.labels"), F.create_map().cast("map<string,string>"))
    role = F.when(F.map_contains_key(labels, "node-role.kubernetes.io/control-plane"), "control-plane").otherwise("worker")
    ready_c = F.get(F.filter(F.coalesce(F.col("status.conditions"), F.array().cast("array<struct<type:string,status:string,reason:string,message:string>>")),
                             lambda c: c["type"] == "Ready"), 0)
    n = nodes.select(*by, F.col("metadata.name").alias("node"), role.alias("role"),
                     F.coalesce(ready_c["status"] == "True", F.lit(False)).alias("ready"))
    return n.groupBy(*by).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.sum(F.col("ready").cast("int")).alias("ready_nodes"),
        F.sum((F.col("role") == "control-plane").cast("int")).alias("control_plane_nodes"),
        (F.bool_and("ready") & (F.count(F.lit(1)) >= min_nodes)).alias("cluster_ready"),
    )


NAME_RE = "^[a-z0-9]([-a-z0-9]{0,61}[a-z0-9])?$"


def namespace_guard(df: DataFrame, col: str, params: Params) -> DataFrame:
    """K9 as a data rule: default for blank, valid name, allow-listed."""
    ns = F.when(F.col(col).isNull() | (F.trim(F.col(col)) == ""), F.lit(params.default_namespace)).otherwise(F.col(col))
    return df.select("*", ns.alias("resolved_namespace")).withColumn(
        "valid_name", F.col("resolved_namespace").rlike(NAME_RE)
    ).withColumn("allowed", F.col("valid_name") & F.col("resolved_namespace").isin(*params.allowed_namespaces))


def clamp_requests(req: DataFrame, params: Params, ceiling: int | None = None) -> DataFrame:
    """K10 on a table of requests (start, end, limit): end <= start rejected,
    an over-long window is cut from the start, limits <= 0 -> ceiling, capped."""
    ceiling = ceiling or params.max_log_lines
    longest = params.max_range_minutes * 60
    start = F.greatest(F.col("start"), F.timestamp_seconds(F.unix_seconds(F.col("end").cast("timestamp")) - longest))
    lim = F.when(F.col("limit").isNull() | (F.col("limit") <= 0), F.lit(ceiling)).otherwise(F.least(F.col("limit"), F.lit(ceiling)))
    return req.select(
        "*",
        (F.col("end") <= F.col("start")).alias("rejected"),
        F.when(F.col("end") > F.col("start"), start).alias("clamped_start"),
        lim.alias("clamped_limit"),
    )
