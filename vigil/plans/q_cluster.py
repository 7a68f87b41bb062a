"""Cluster-state and source queries over Kubernetes-shaped
objects derived from the pod snapshots and events, read back through JSON."""

from __future__ import annotations

import os
import uuid
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from vigil.config import replay_params
from vigil.functions import text as X
from vigil.functions.ids import sql_evidence_id
from vigil.operators import cluster as K
from vigil.plans.registry import register
from vigil.session import ensure_checkpoint_dir
from vigil.sources import json_api as J
from vigil.sources import k8sdata as KD
from vigil.sources import retention as RT
from vigil.sources import testdata as T
from vigil.sources.cri import tail_cri
from vigil.streaming import detection as S

P = replay_params()
SINCE = datetime(2024, 1, 5)
DOCUMENT_LINES = 1000  # of a range-query document, on average

SQL_POD_FACTS = "WITH " + T.sql_pod_snapshots() + """,
pf AS (SELECT namespace, pod, snapshot_ts AS observed_at,
  CASE WHEN ready OR waiting_reason IS NOT NULL THEN 'Running' ELSE 'Pending' END AS phase, ready, restart_count AS restarts,
  waiting_reason, CASE WHEN restart_count > 0 THEN coalesce(last_termination_reason, 'Error') END AS last_termination_reason,
  CASE WHEN restart_count > 0 THEN CASE WHEN last_termination_reason = 'OOMKilled' THEN 137 ELSE 1 END END AS last_exit_code,
  CASE WHEN restart_count > 0 THEN CAST(last_k AS BIGINT) END AS minutes_since_last_restart,
  CASE WHEN restart_count > 0 THEN last_k < 15 END AS restart_is_recent,
  '256Mi' AS memory_limit, 'node-' || CAST(CAST(right(pod, 1) AS INTEGER) % 3 AS VARCHAR) AS node,
  CASE WHEN pod LIKE '%0' THEN NULL ELSE workload END AS workload FROM pods)"""

_SUMMARY = """concat_ws(', ', 'pod ' || pod || ' phase=' || phase || ' ready=' || CASE WHEN ready THEN 'True' ELSE 'False' END
  || ' restarts=' || CAST(restarts AS VARCHAR),
  CASE WHEN waiting_reason IS NOT NULL THEN 'waiting=' || waiting_reason END,
  CASE WHEN last_termination_reason IS NOT NULL THEN 'lastTermination=' || last_termination_reason END,
  CASE WHEN last_exit_code IS NOT NULL THEN 'exitCode=' || CAST(last_exit_code AS VARCHAR) END,
  CASE WHEN minutes_since_last_restart IS NOT NULL THEN 'last restart ' || CAST(minutes_since_last_restart AS VARCHAR) || 'm ago '
    || CASE WHEN minutes_since_last_restart < 15 THEN '(RECENT)' ELSE '(not recent - probably unrelated to any current problem)' END END)"""


@register(
    "pod_status",
    sql=SQL_POD_FACTS + f"""
SELECT namespace, pod, observed_at, phase, ready, restarts, waiting_reason, last_termination_reason,
  CAST(last_exit_code AS VARCHAR) AS last_exit_code, CAST(minutes_since_last_restart AS VARCHAR) AS minutes_since_last_restart,
  CASE WHEN restart_is_recent THEN 'true' WHEN NOT restart_is_recent THEN 'false' END AS restart_is_recent,
  memory_limit, node, workload, {_SUMMARY} AS summary,
  {sql_evidence_id('KubernetesState', 'kubernetes', 'namespace', 'pod', 'phase', 'CAST(restarts AS VARCHAR)', 'waiting_reason', 'last_termination_reason')} AS evidence_id
FROM pf""",
)
def q_pod_status(spark, sf):
    return K.pod_status(KD.pods(spark, sf)).select(
        "namespace", "pod", "observed_at", "phase", "ready", "restarts", "waiting_reason", "last_termination_reason",
        "last_exit_code", "minutes_since_last_restart", "restart_is_recent", "memory_limit", "node", "workload", "summary", "evidence_id",
    )


@register(
    "src_pods",
    sql=SQL_POD_FACTS + "\nSELECT namespace, pod, observed_at, node, memory_limit FROM pf",
)
def q_src_pods(spark, sf):
    p = KD.pods(spark, sf)
    return p.select(F.col("metadata.namespace").alias("namespace"), F.col("metadata.name").alias("pod"), "observed_at",
                    F.col("spec.nodeName").alias("node"), F.get(F.col("spec.containers"), 0)["resources"]["limits"]["memory"].alias("memory_limit"))


@register(
    "src_deployments",
    sql="WITH " + T.sql_pod_snapshots() + """
SELECT namespace, workload || '@' || strftime(snapshot_ts, '%Y%m%d') AS deployment, CAST(count(*) AS INTEGER) AS replicas,
  CASE WHEN sum(CAST(ready AS INTEGER)) > 0 THEN CAST(sum(CAST(ready AS INTEGER)) AS INTEGER) END AS ready_replicas,
  2 AS conditions FROM pods GROUP BY namespace, workload, snapshot_ts""",
)
def q_src_deployments(spark, sf):
    """Deployment objects (nested conditions) parsed by their schema."""
    d = KD.through_json(KD.deployments(spark, sf), J.DEPLOYMENT)
    return d.select(F.col("metadata.namespace").alias("namespace"), F.col("metadata.name").alias("deployment"),
                    F.col("spec.replicas").alias("replicas"), F.col("status.readyReplicas").alias("ready_replicas"),
                    F.size("status.conditions").alias("conditions"))


@register(
    "restart_counts",
    sql=SQL_POD_FACTS + "\nSELECT namespace, pod, observed_at, coalesce(workload, pod) AS workload, restarts AS restart_count, ready,"
    " waiting_reason, last_termination_reason FROM pf",
)
def q_restart_counts(spark, sf):
    return K.restart_counts(KD.pods(spark, sf), keep=["observed_at"]).select(
        "namespace", "pod", "observed_at", "workload", "restart_count", "ready", "waiting_reason", "last_termination_reason")


@register(
    "restart_history",
    sql=SQL_POD_FACTS + "\nSELECT pod, observed_at, restarts FROM pf",
)
def q_restart_history(spark, sf):
    return K.pod_status(KD.pods(spark, sf)).select("pod", "observed_at", "restarts")


@register(
    "workload_names",
    sql="WITH " + T.sql_pod_snapshots() + "\nSELECT DISTINCT namespace, workload || '@' || strftime(snapshot_ts, '%Y%m%d') AS workload FROM pods",
)
def q_workload_names(spark, sf):
    return K.workload_names(KD.deployments(spark, sf))


@register(
    "unhealthy_pods",
    sql=SQL_POD_FACTS + "\nSELECT namespace, pod, observed_at, phase, ready, restarts FROM pf WHERE phase <> 'Running' OR NOT ready",
)
def q_unhealthy_pods(spark, sf):
    p = KD.pods(spark, sf)
    f = K.pod_fields(p)
    return f.filter((F.col("phase") != "Running") | ~F.col("ready")).select("namespace", "pod", "observed_at", "phase", "ready", "restarts")


@register(
    "pod_summary",
    sql=SQL_POD_FACTS + "\nSELECT namespace, phase, count(*) AS pods, CAST(sum(CASE WHEN ready THEN 1 ELSE 0 END) AS BIGINT) AS ready_pods,"
    " CAST(sum(restarts) AS BIGINT) AS restarts FROM pf GROUP BY ALL",
)
def q_pod_summary(spark, sf):
    f = K.pod_fields(KD.pods(spark, sf))
    return f.groupBy("namespace", "phase").agg(F.count(F.lit(1)).alias("pods"), F.sum(F.col("ready").cast("int")).alias("ready_pods"),
                                               F.sum("restarts").alias("restarts"))


SQL_EVENT_OBJECTS = "WITH " + T.sql_events() + """,
ko AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Normal' END AS type,
  CASE WHEN event_type = 'error' THEN 'BackOff' ELSE 'Scheduled' END AS reason,
  CASE WHEN event_type = 'error' THEN 'Back-off restarting failed container app' ELSE 'Successfully assigned pod' END
    || CASE WHEN event_id % 10 = 0 THEN ' password=hunter' || CAST(event_id AS VARCHAR) ELSE '' END AS message,
  k AS count, CASE WHEN event_id % 7 <> 0 THEN ts END AS lastTimestamp,
  CASE WHEN event_id % 7 = 0 AND event_id % 14 <> 0 THEN ts END AS eventTime, ts - INTERVAL 1 MINUTE AS firstTimestamp,
  service || '-' || CAST(user_id AS VARCHAR) AS involved, namespace FROM ev)"""
SQL_EVENTS = SQL_EVENT_OBJECTS + """,
""" + X.sql_redaction_ctes("ko", "event_id, type, reason, count, lastTimestamp, eventTime, firstTimestamp, involved, namespace", "message") + """,
""" + T.SQL_PODS_ONLY + """,
wl AS (SELECT DISTINCT namespace, CASE WHEN pod LIKE '%0' THEN pod ELSE workload END AS workload FROM pods),
ke AS (SELECT r7.*, coalesce(lastTimestamp, eventTime, firstTimestamp) AS occurred_at, wl.workload FROM r7
  JOIN wl ON wl.namespace = r7.namespace AND starts_with(r7.involved, wl.workload)
  WHERE coalesce(lastTimestamp, eventTime, firstTimestamp) >= TIMESTAMP '2024-01-05 00:00:00'),
kx AS (SELECT namespace, workload, involved, occurred_at,
  'evt_' || left(sha256(concat_ws('|', 'KubernetesEvent', 'kubernetes', namespace, involved, reason,
    strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00')), 12) AS evidence_id,
  '[' || type || '] ' || reason || ' on Pod ' || involved || ': ' || regexp_replace(w, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '', 'g') AS summary,
  coalesce(count, 1) AS count, CAST(n AS INTEGER) AS redacted_value_count FROM ke)"""


@register(
    "src_events",
    sql=SQL_EVENT_OBJECTS + """
SELECT namespace, involved, type, reason, count, lastTimestamp AS last_ts, eventTime AS event_ts, firstTimestamp AS first_ts FROM ko""",
)
def q_src_events(spark, sf):
    """Event objects parsed by their schema."""
    e = KD.events(spark, sf)
    return e.select(F.col("metadata.namespace").alias("namespace"), F.col("involvedObject.name").alias("involved"), "type", "reason",
                    "count", F.col("lastTimestamp").alias("last_ts"), F.col("eventTime").alias("event_ts"), F.col("firstTimestamp").alias("first_ts"))


def _events(spark, sf):
    pods = KD.pods(spark, sf)
    wl = K.restart_counts(pods).select("namespace", "workload")
    return K.k8s_events(KD.events(spark, sf), wl, SINCE)


@register(
    "k8s_events",
    sql=SQL_EVENTS + """
SELECT namespace, workload, involved, occurred_at, evidence_id, summary, count, redacted_value_count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY namespace, workload ORDER BY occurred_at DESC, evidence_id) AS rank FROM kx) WHERE rank <= 200""",
)
def q_k8s_events(spark, sf):
    return _events(spark, sf).select("namespace", "workload", "involved", "occurred_at", "evidence_id", "summary", "count",
                                     "redacted_value_count", "rank")


@register(
    "deployment_status",
    sql="WITH " + T.sql_pod_snapshots() + """,
g AS (SELECT namespace, workload, snapshot_ts, CAST(count(*) AS INTEGER) AS replicas, CAST(sum(CAST(ready AS INTEGER)) AS INTEGER) AS ready,
  CAST(sum(CAST(restart_count = 0 AS INTEGER)) AS INTEGER) AS updated FROM pods GROUP BY ALL),
d AS (SELECT namespace, workload || '@' || strftime(snapshot_ts, '%Y%m%d') AS deployment, replicas AS desired, ready,
  ready AS available, updated FROM g)
SELECT namespace, deployment, desired, ready, available, updated,
  'deployment ' || deployment || ': desired=' || CAST(desired AS VARCHAR) || ' ready=' || CAST(ready AS VARCHAR) || ' available='
  || CAST(available AS VARCHAR) || ' updated=' || CAST(updated AS VARCHAR)
  || CASE WHEN ready <> desired THEN ' - MinimumReplicasUnavailable: Deployment does not have minimum availability.' ELSE '' END AS summary
FROM d""",
)
def q_deployment_status(spark, sf):
    return K.deployment_status(KD.deployments(spark, sf)).select("namespace", "deployment", "desired", "ready", "available", "updated", "summary")


@register(
    "node_status",
    sql="WITH " + T.sql_pod_snapshots() + """,
n AS (SELECT snapshot_ts, 'node-' || CAST(CAST(right(pod, 1) AS INTEGER) % 3 AS VARCHAR) AS node, bool_and(ready) AS r FROM pods GROUP BY ALL)
SELECT snapshot_ts, count(*) AS nodes, CAST(sum(CAST(r AS INTEGER)) AS BIGINT) AS ready_nodes, CAST(sum(CAST(node = 'node-0' AS INTEGER)) AS BIGINT) AS control_plane_nodes,
  bool_and(r) AND count(*) >= 3 AS cluster_ready FROM n GROUP BY ALL""",
)
def q_node_status(spark, sf):
    return K.node_status(KD.nodes(spark, sf), by=["snapshot_ts"]).select(
        "snapshot_ts", "nodes", F.col("ready_nodes").cast("bigint"), F.col("control_plane_nodes").cast("bigint"), "cluster_ready")


@register(
    "namespace_guard",
    sql=f"""WITH c AS (SELECT n_name AS candidate FROM nation UNION ALL SELECT lower(n_name) FROM nation
  UNION ALL SELECT lower(r_name) FROM region UNION ALL SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE 'prod' END FROM region)
SELECT candidate, coalesce(candidate, 'default') AS resolved_namespace,
  regexp_full_match(coalesce(candidate, 'default'), '{K.NAME_RE[1:-1]}') AS valid_name,
  regexp_full_match(coalesce(candidate, 'default'), '{K.NAME_RE[1:-1]}') AND coalesce(candidate, 'default') IN {tuple(P.allowed_namespaces)} AS allowed FROM c""",
)
def q_namespace_guard(spark, sf):
    n = T.read(spark, sf, "nation")
    r = T.read(spark, sf, "region")
    c = (n.select(F.col("n_name").alias("candidate"))
         .unionByName(n.select(F.lower("n_name").alias("candidate")))
         .unionByName(r.select(F.lower("r_name").alias("candidate")))
         .unionByName(r.select(F.when(F.col("r_regionkey") == 0, F.lit(None)).otherwise(F.lit("prod")).alias("candidate"))))
    return K.namespace_guard(c, "candidate", P)


@register(
    "clamp_window",
    sql=f"""WITH q AS (SELECT o_orderkey, o_orderdate AS "start", o_orderdate + to_minutes(CAST(o_orderkey % 300 AS BIGINT)) AS "end",
  CAST(o_custkey % 700 - 100 AS INTEGER) AS "limit" FROM orders)
SELECT o_orderkey, "end" <= "start" AS rejected,
  CASE WHEN "end" > "start" THEN greatest("start", "end" - to_seconds({P.max_range_minutes * 60})) END AS clamped_start,
  CASE WHEN "limit" IS NULL OR "limit" <= 0 THEN {P.max_log_lines} ELSE least("limit", {P.max_log_lines}) END AS clamped_limit FROM q""",
)
def q_clamp_window(spark, sf):
    o = T.read(spark, sf, "orders")
    q = o.select("o_orderkey", F.col("o_orderdate").alias("start"),
                 (F.col("o_orderdate") + F.make_interval(mins=(F.col("o_orderkey") % 300).cast("int"))).alias("end"),
                 (F.col("o_custkey") % 700 - 100).cast("int").alias("limit"))
    return K.clamp_requests(q, P).select("o_orderkey", "rejected", "clamped_start", "clamped_limit")


# --- API JSON sources ----------------------------------------------------------------------

def _src_dir(spark, kind, sf):
    return KD._dir(spark, kind, sf)


@register(
    "src_metric_vector",
    sql="WITH " + T.sql_requests() + """
SELECT namespace, date_trunc('day', ts) AS pass_ts, service, status_class, CAST(count(*) AS DOUBLE) AS value
FROM requests GROUP BY ALL""",
)
def q_src_metric_vector(spark, sf):
    """One instant-vector document per (namespace, day), values as strings
    (plus an unparsable and a NaN sample per document), parsed back."""
    r = T.requests(spark, sf).groupBy("namespace", F.date_trunc("day", "ts").alias("pass_ts"), "service", "status_class").agg(
        F.count(F.lit(1)).alias("n"))
    sample = F.struct(F.create_map(F.lit("service"), F.col("service"), F.lit("status_class"), F.col("status_class")).alias("metric"),
                      F.array(F.unix_seconds("pass_ts").cast("string"), F.col("n").cast("string")).alias("value"))
    junk = [F.struct(F.create_map(F.lit("service"), F.lit("junk")).alias("metric"), F.array(F.lit("0"), F.lit("not-a-number")).alias("value")),
            F.struct(F.create_map(F.lit("service"), F.lit("nan")).alias("metric"), F.array(F.lit("0")).alias("value"))]
    docs = r.groupBy("namespace", "pass_ts").agg(F.collect_list(sample).alias("result")).select(
        "namespace", "pass_ts",
        F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.lit("vector").alias("resultType"),
                  F.concat("result", F.array(*junk)).alias("result")).alias("data"))).alias("doc"))
    parsed = docs.select("namespace", "pass_ts", F.inline(J.parse_vector(F.col("doc"))))
    return parsed.select("namespace", "pass_ts", F.col("labels")["service"].alias("service"),
                         F.col("labels")["status_class"].alias("status_class"), "value").filter(F.col("service") != "junk")


@register(
    "src_log_streams",
    sql="WITH " + T.sql_logs() + """
SELECT namespace, container, level, make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts, line FROM logs""",
)
def q_src_log_streams(spark, sf):
    """Range-query documents of a (namespace, container, day): streams by level
    with [ns-epoch, line] pairs (plus a short pair that must be skipped). Like a
    query's limit, a document holds a bounded number of lines: a day of many
    lines is dealt over as many documents as it takes."""
    lg = T.logs(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    sizes = lg.groupBy("namespace", "container", "day").agg(F.ceil(F.count(F.lit(1)) / F.lit(DOCUMENT_LINES)).alias("documents"))
    lg = lg.join(sizes, ["namespace", "container", "day"]).withColumn("document", F.pmod(F.xxhash64("event_id"), F.col("documents")))
    pair = F.array((F.unix_micros("ts") * F.lit(1000)).cast("string"), F.col("line"))
    streams = lg.groupBy("namespace", "container", "day", "document", "level").agg(
        F.concat(F.collect_list(pair), F.array(F.array(F.lit("1")))).alias("values"))
    st = F.struct(F.create_map(F.lit("namespace"), F.col("namespace"), F.lit("container"), F.col("container"),
                               F.lit("level"), F.col("level")).alias("stream"), "values")
    docs = streams.groupBy("namespace", "container", "day", "document").agg(F.collect_list(st).alias("result")).select(
        F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.col("result").alias("result")).alias("data"))).alias("doc"))
    e = docs.select(F.inline(J.parse_streams(F.col("doc"))))
    return e.select(F.col("labels")["namespace"].alias("namespace"), F.col("labels")["container"].alias("container"),
                    F.col("labels")["level"].alias("level"), "ts", "line")


@register(
    "ingest_container_logs",
    sql="WITH " + T.sql_logs() + """
SELECT container, CAST(event_id AS VARCHAR) || ' ' || line AS log FROM logs""",
)
def q_ingest_container_logs(spark, sf):
    """Log lines written as CRI files (one folder per container; lines over
    40 characters split into a P and an F chunk; the collector's own file is
    excluded), then read back and re-joined."""
    lg = T.logs(spark, sf).withColumn("msg", F.concat(F.col("event_id").cast("string"), F.lit(" "), F.col("line")))
    ts1 = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    ts2 = F.date_format(F.col("ts") + F.expr("INTERVAL 1 MICROSECOND"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    long_ = F.length("msg") > 40
    chunks = F.when(long_, F.array(F.concat(ts1, F.lit(" stdout P "), F.substring("msg", 1, 40)),
                                   F.concat(ts2, F.lit(" stdout F "), F.substring("msg", 41, 1 << 30)))).otherwise(
        F.array(F.concat(ts1, F.lit(" stdout F "), F.col("msg"))))
    path = _src_dir(spark, "cri", sf)
    lines = lg.select("container", F.explode(chunks).alias("value"))
    own = spark.createDataFrame([("collector", "2024-01-01T00:00:00.000000Z stdout F own line")], "container string, value string")
    # a line's chunks are neighbours in their task, and so in the file it writes for the container
    lines.unionByName(own).write.mode("overwrite").partitionBy("container").text(path)
    got = J.read_cri(spark, path, exclude_prefix=None)
    got = got.withColumn("container", F.regexp_extract("file", r"container=([^/]+)/", 1)).filter(F.col("container") != "collector")
    return got.select("container", "log")


LINES_OF_FILE = 100_000  # at most, about: a file is sorted and written by one task


def _grow_files(lines, path: str, upto: int, files: int = 8) -> None:
    """Write the lines of the parts up to ``upto`` to ``files`` log files, in place, and of the part after them one
    line without its end. What a file held before stays at its place, so a repeated task changes nothing."""
    def write(batches):
        open_files, begun = {}, set()
        for batch in batches:
            rows = batch.to_pydict()
            for n, part, value in zip(rows["file_no"], rows["part"], rows["value"]):
                name = f"{path}/{n}.log"
                f = open_files.get(name)
                if f is None:
                    f = open_files[name] = open(name, "r+b" if os.path.exists(name) else "w+b")
                if part <= upto:
                    f.write(value.encode() + b"\n")
                elif name not in begun:
                    begun.add(name)
                    f.write(value.encode()[:30])
        for f in open_files.values():
            f.close()
        yield pa.record_batch({"files": pa.array([len(open_files)], pa.int32())})

    os.makedirs(path, exist_ok=True)
    spread = lines.filter(F.col("part") <= upto + 1).repartition(files, "file_no").sortWithinPartitions("file_no", "part", "event_id", "place")
    spread.select("file_no", "part", "value").mapInArrow(write, "files int").agg(F.sum("files")).collect()  # one number


@register(
    "ingest_tail_logs",
    sql="WITH " + T.sql_logs() + """
SELECT pod, CAST(event_id AS VARCHAR) || ' ' || line AS log FROM logs""",
)
def q_ingest_tail_logs(spark, sf):
    """Log files that grow between three triggers, the second and third of which resume from the checkpoint; a part ends
    within a line."""
    lg = T.logs(spark, sf).withColumn("msg", F.concat(F.col("event_id").cast("string"), F.lit(" "), F.col("pod"), F.lit(" "), F.col("line")))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    stream = F.when(F.col("event_id") % 3 == 0, "stderr").otherwise("stdout")

    def chunk(tag, text):
        return F.concat(stamp, F.lit(" "), stream, F.lit(f" {tag} "), text)

    chunks = F.when(F.length("msg") > 40, F.array(chunk("P", F.substring("msg", 1, 40)), chunk("F", F.substring("msg", 41, 1 << 30)))).otherwise(
        F.array(chunk("F", F.col("msg"))))
    files = max(8, -(-T.read(spark, sf, "events").count() // LINES_OF_FILE))
    lines = lg.select("event_id", (F.col("event_id") % files).alias("file_no"), F.floor((F.dayofmonth("ts") - 1) / 11).cast("int").alias("part"),
                      F.posexplode(chunks).alias("place", "value"))
    name = f"tail-logs-{uuid.uuid4().hex[:12]}"
    path = os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-files")
    for part in range(3):
        _grow_files(lines, path, part, files)
        S.run_upserts(tail_cri(spark, path, block_bytes=1 << 20), name, mode="append")
    got = S.read_step(spark, name)
    return got.select(F.regexp_extract("log", r"^\d+ (\S+) ", 1).alias("pod"), F.regexp_replace("log", r"^(\d+ )\S+ ", "$1").alias("log"))



@register(
    "ingest_parse_json",
    sql="WITH " + T.sql_logs() + """
SELECT event_id, CASE WHEN level <> 'debug' THEN line END AS msg FROM logs""",
)
def q_ingest_parse_json(spark, sf):
    lg = T.logs(spark, sf)
    raw = lg.select("event_id", F.when(F.col("level") != "debug", F.to_json(F.struct(F.col("line").alias("msg"),
                                                                                      F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))))
                    .otherwise(F.col("line")).alias("log"))
    p = J.parse_app_json(raw)
    return p.select("event_id", F.try_variant_get(F.col("app"), "$.msg", "string").alias("msg"))


@register(
    "ingest_lift_rename",
    sql="WITH " + T.sql_logs() + """
SELECT event_id, pod AS pod_name, namespace AS namespace_name, container AS k8s_container_name FROM logs""",
)
def q_ingest_lift_rename(spark, sf):
    lg = T.logs(spark, sf).select("event_id", "line", F.struct(
        F.col("pod").alias("pod_name"), F.col("namespace").alias("namespace_name"), F.col("container").alias("container_name"),
        F.lit("docker://x").alias("docker_id"), F.lit("sha256:0").alias("container_hash")).alias("kubernetes"))
    out = J.lift_kubernetes(lg, renames={"k8s_pod_name": "pod_name", "k8s_namespace_name": "namespace_name"},
                            drop=["k8s_docker_id", "k8s_container_hash", "line"])
    return out


@register(
    "sink_log_labels",
    sql="WITH " + T.sql_logs() + """
SELECT CAST(date_trunc('day', ts) AS DATE) AS date, namespace, level, count(*) AS lines FROM logs GROUP BY ALL""",
)
def q_sink_log_labels(spark, sf):
    """Logs written by label, read back and counted: every line of every label."""
    path = _src_dir(spark, "logs-by-label", sf)
    J.write_logs_by_label(T.logs(spark, sf), path)
    return spark.read.parquet(path).groupBy("date", "namespace", "level").agg(F.count(F.lit(1)).alias("lines"))


@register(
    "label_cardinality_audit",
    sql="WITH " + T.sql_counter_samples() + """,
lab AS (SELECT 'service' AS label, service AS v FROM counters UNION ALL SELECT 'status_class', status_class FROM counters
  UNION ALL SELECT 'namespace', namespace FROM counters)
SELECT label, count(DISTINCT v) AS distinct_values, label IN ('service', 'namespace', 'level') AS required,
  label IN ('pod_ip', 'correlation_id', 'user_id', 'order_id', 'status_class') AS forbidden,
  CASE label WHEN 'service' THEN array_to_string(list_filter(['billing', 'svc-0', 'svc-1'], lambda x: NOT list_contains(list(DISTINCT v), x)), ',') ELSE '' END AS missing_values,
  CASE WHEN label = 'status_class' THEN 'forbidden' WHEN label = 'service' THEN 'incomplete' ELSE 'ok' END AS verdict FROM lab GROUP BY label
UNION ALL SELECT 'level', 0, true, false, '', 'missing'""",
)
def q_label_cardinality_audit(spark, sf):
    c = T.counter_samples(spark, sf)
    m = c.select(F.create_map(F.lit("service"), F.col("service"), F.lit("status_class"), F.col("status_class"),
                              F.lit("namespace"), F.col("namespace")).alias("labels"))
    from vigil.operators.relabel import cardinality_audit

    return cardinality_audit(m, required=["service", "namespace", "level"],
                             forbidden=["pod_ip", "correlation_id", "user_id", "order_id", "Status_Class"],
                             expected={"service": ["svc-0", "svc-1", "billing"]})


@register(
    "relabel",
    sql="WITH " + T.sql_counter_samples() + """
SELECT service AS app, 'class_' || status_class AS klass, namespace, '10.0.0.1' AS pod_ip, '10.0.0.1' AS kept_meta
FROM counters WHERE regexp_full_match(service, 'svc-[0-3]') AND NOT regexp_full_match(status_class, '4xx')""",
)
def q_relabel(spark, sf):
    from vigil.operators import relabel as RL

    c = T.counter_samples(spark, sf)
    m = c.select(F.create_map(F.lit("service"), F.col("service"), F.lit("status_class"), F.col("status_class"),
                              F.lit("namespace"), F.col("namespace"), F.lit("__meta_pod_ip"), F.lit("10.0.0.1")).alias("labels"))
    rules = [
        RL.Rule("keep", source=["service"], regex="svc-[0-3]"),
        RL.Rule("drop", source=["status_class"], regex="4xx"),
        RL.Rule("labelmap", regex="__meta_(.*)", replacement="$1"),
        RL.Rule("replace", source=["status_class"], regex="(.*)", target="klass", replacement="class_$1"),
        RL.Rule("replace", source=["service"], regex="(.*)", target="app", replacement="$1"),
        RL.Rule("labeldrop", regex="service|status_class"),
    ]
    out = RL.apply(m, "labels", rules)
    label = F.col("labels")
    return out.select(label["app"].alias("app"), label["klass"].alias("klass"), label["namespace"].alias("namespace"),
                      label["pod_ip"].alias("pod_ip"), label["__meta_pod_ip"].alias("kept_meta"))


@register(
    "retention",
    sql="WITH " + T.sql_logs() + f"""
SELECT event_id FROM logs WHERE ts >= (SELECT max(ts) FROM logs) - INTERVAL {RT.LOG_HOURS} HOUR""",
)
def q_retention(spark, sf):
    """Logs stored by label; old days are expired, and what is read are the last 168 hours."""
    path = _src_dir(spark, "retained-logs", sf)
    J.write_logs_by_label(T.logs(spark, sf), path)
    RT.expire(spark, path, RT.LOGS)
    return RT.retained(spark.read.parquet(path), RT.LOGS).select("event_id")


@register(
    "retention_metrics",
    sql="WITH " + T.sql_counter_samples() + f"""
SELECT namespace, service, status_class, ts, value FROM counters WHERE ts >= (SELECT max(ts) FROM counters) - INTERVAL {RT.METRIC_HOURS} HOUR""",
)
def q_retention_metrics(spark, sf):
    """Metric samples stored by hour, of which the last 6 are kept."""
    path = _src_dir(spark, "retained-metrics", sf)
    RT.write_partitioned(T.counter_samples(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), path, RT.METRICS)
    RT.expire(spark, path, RT.METRICS)
    return RT.retained(spark.read.parquet(path), RT.METRICS).select("namespace", "service", "status_class", "ts", "value")
