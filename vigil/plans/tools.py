"""The nine investigation tools as DataFrame functions.

Each tool is a thin, validated entry point over the operators: arguments are
checked and clamped on the driver (minutes 1-60, tool defaults), the work is
a lazy Spark plan. Text queries arrive already embedded (vector arguments):
producing embeddings is outside the engine.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.config import Params
from vigil.operators import cluster as K
from vigil.operators import evidence as E
from vigil.operators import logs as L
from vigil.operators import memory as SM
from vigil.operators import metrics as M


def clamp_minutes(m: int | None, default: int, lo: int = 1, hi: int = 60) -> int:
    return max(lo, min(hi, default if m is None else m))


@dataclass
class Sources:
    """Telemetry tables the tools read (any may be None when unavailable)."""

    logs: DataFrame | None = None            # ts, namespace, container, level, pod, line [, event_id]
    pods: DataFrame | None = None            # pod objects (json_api.POD)
    k8s_events: DataFrame | None = None      # event objects (json_api.EVENT)
    deployments: DataFrame | None = None     # deployment objects (json_api.DEPLOYMENT)
    counters: DataFrame | None = None        # namespace, service, status_class, ts, event_id, value
    requests: DataFrame | None = None        # namespace, service, ts, duration_s
    dep_calls: DataFrame | None = None       # namespace, service, dependency, kind, outcome, ts, duration_s
    memory: DataFrame | None = None          # semantic memory rows


# What each tool returns of an absent source: no rows of these columns.
NO_LINES = "ts timestamp, namespace string, container string, level string, pod string, message string, redacted_value_count int"
NO_EVIDENCE = "evidence_id string, kind string, source string, observed_at timestamp, summary string, attributes map<string,string>"


def absent(schema: str) -> DataFrame:
    return SparkSession.active().createDataFrame([], schema)


class Tools:
    """Arguments are checked before anything else; a source that is absent gives an empty result."""

    def __init__(self, src: Sources, params: Params, namespace: str | None, now: datetime):
        self.src, self.p, self.now = src, params, now
        self.ns = L.require_namespace(namespace, params)

    def search_logs(self, workload: str, level: str | None = None, contains: str | None = None, minutes: int | None = None):
        m = clamp_minutes(minutes, 15)
        if self.src.logs is None:
            L.require_workload(workload), L.validate_level(level)
            return absent(NO_LINES)
        return L.search(self.src.logs, self.p, self.ns, self.now - timedelta(minutes=m), self.now,
                        container=workload, level=level, contains=contains, limit=40)

    def search_logs_around(self, ts: datetime, workload: str, before: int = 120, after: int = 60):
        L.require_workload(workload)
        if self.src.logs is None:
            return absent(NO_LINES)
        spark = self.src.logs.sparkSession
        moment = spark.createDataFrame([("m", self.ns, workload, ts)], "moment_id string, namespace string, workload string, moment_ts timestamp")
        return L.around(moment, self.src.logs, before, after, 40)

    def pod_status(self, workload: str | None = None):
        if self.src.pods is None:
            return absent(f"pod string, phase string, ready boolean, restarts int, last_termination_reason string, last_terminated_at timestamp, {NO_EVIDENCE}")
        p = K.select_workload(self.src.pods, workload).filter(F.col("metadata.namespace") == self.ns)
        return K.pod_status(p.withColumn("observed_at", F.lit(self.now)))

    def restart_history(self):
        return self.pod_status(None).select("pod", "restarts", "last_termination_reason", "last_terminated_at")

    def kubernetes_events(self, workload: str, minutes: int | None = None):
        m = clamp_minutes(minutes, 30)
        name = L.require_workload(workload)
        if self.src.k8s_events is None:
            return absent(f"namespace string, involved string, occurred_at timestamp, {NO_EVIDENCE}")
        spark = self.src.k8s_events.sparkSession
        wl = spark.createDataFrame([(self.ns, name)], "namespace string, workload string")
        return K.k8s_events(self.src.k8s_events, wl, self.now - timedelta(minutes=m))

    def deployment_status(self, workload: str):
        name = L.require_workload(workload)
        if self.src.deployments is None:
            return absent(f"namespace string, deployment string, desired int, ready int, available int, updated int, {NO_EVIDENCE}")
        d = K.deployment_status(self.src.deployments)
        return d.filter((F.col("namespace") == self.ns) & (F.col("deployment") == name))

    def service_metrics(self, workload: str, minutes: int | None = None):
        """One window that ends now, whatever the minute."""
        m = clamp_minutes(minutes, 15)
        p = self.p.with_(window_seconds=m * 60, slide_seconds=m * 60, recovery_seconds=max(self.p.recovery_seconds, m * 60),
                         cooldown_seconds=max(self.p.cooldown_seconds, m * 60 + self.p.recovery_seconds))
        w = L.require_workload(workload)
        start = self.now - timedelta(minutes=m)
        # windows lie on multiples of their length: move the rows so that one ends now
        end = (self.now.replace(tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()
        shift = F.make_dt_interval(secs=F.lit(-end % (m * 60)))

        def cut(df):
            here = (F.col("namespace") == self.ns) & (F.col("service") == w) & (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(self.now))
            return df.filter(here).withColumn("ts", F.col("ts").cast("timestamp") + shift)

        def now(df):
            return df.withColumn("pass_ts", F.lit(self.now))

        def cut_or_none(df):
            return None if df is None else cut(df)

        if self.src.counters is None and self.src.requests is None and self.src.dep_calls is None:
            return absent(f"namespace string, workload string, {NO_EVIDENCE}")
        counters, requests, calls = map(cut_or_none, (self.src.counters, self.src.requests, self.src.dep_calls))
        errors = None
        if counters is not None:
            tiebreak = "event_id" if "event_id" in counters.columns else None
            errors = now(M.http_error_rate(M.increase(counters, ["namespace", "service", "status_class"], p, tiebreak=tiebreak)))
        return E.service_metric_evidence(
            errors, None if requests is None else now(M.latency_p95(requests, p)), None if calls is None else now(M.dependency_failures(calls, p)),
            None if calls is None else now(M.dependency_latency_p95(calls, p)), m)

    def similar_incidents(self, query_vec: list[float], workload: str | None, exclude_incident_id: str | None = None):
        if self.src.memory is None:
            return absent(f"query_id string, source_ref string, retrieval_confidence double, {NO_EVIDENCE}")
        spark = self.src.memory.sparkSession
        q = spark.createDataFrame([("q", [float(x) for x in query_vec], "incident", workload, None, exclude_incident_id)],
                                  "query_id string, embedding array<double>, kind string, workload string, category string, exclude_incident_id string")
        return SM.to_evidence(SM.search(self.src.memory, q, self.p, relaxed=True), "HistoricalIncident")

    def runbooks(self, query_vec: list[float], category: str | None):
        if self.src.memory is None:
            return absent(f"query_id string, source_ref string, retrieval_confidence double, {NO_EVIDENCE}")
        spark = self.src.memory.sparkSession
        q = spark.createDataFrame([("q", [float(x) for x in query_vec], "runbook", None, category, None)],
                                  "query_id string, embedding array<double>, kind string, workload string, category string, exclude_incident_id string")
        return SM.to_evidence(SM.search(self.src.memory, q, self.p, relaxed=True), "Runbook")
