"""Report and work-queue analytics (read-side; nothing is scheduled here)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ["Pending", "Claimed"]


def clamp_limit(n: int | None, lo: int, hi: int) -> int:
    if n is None or n <= 0:
        return hi
    return max(lo, min(n, hi))


def latest(reports: DataFrame) -> DataFrame:
    return reports.orderBy(F.col("created_at").desc(), F.col("report_id").desc()).limit(1)


def newest(reports: DataFrame, n: int | None) -> DataFrame:
    return reports.orderBy(F.col("created_at").desc(), F.col("report_id").desc()).limit(clamp_limit(n, 1, 100))


def for_incident(reports: DataFrame) -> DataFrame:
    """Newest report per incident (max_by: one partial aggregate, no sort)."""
    r = reports.filter(F.col("incident_id").isNotNull())
    cols = [c for c in r.columns if c != "incident_id"]
    agg = r.groupBy("incident_id").agg(F.max_by(F.struct(*cols), F.struct("created_at", "report_id")).alias("r"))
    return agg.select("incident_id", "r.*")


def cited_evidence(reports: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows a report cites (cluster reports cite none)."""
    ex = reports.filter(F.col("kind") == "incident").select("report_id", "incident_id", F.explode("evidence_ids").alias("evidence_id"))
    return evidence.join(ex.dropDuplicates(["report_id", "evidence_id"]), ["incident_id", "evidence_id"], "inner")


def link_violations(reports: DataFrame) -> DataFrame:
    """Incident reports must link both an incident and an investigation."""
    return reports.filter((F.col("kind") == "incident") & (F.col("incident_id").isNull() | F.col("investigation_id").isNull()))


def agent_stats(execs: DataFrame) -> DataFrame:
    dur = F.unix_millis(F.col("finished_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    e = execs.withColumn("duration_ms", dur)
    return e.groupBy("agent").agg(
        F.count(F.lit(1)).alias("executions"),
        F.sum("duration_ms").alias("total_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.sum(F.size("tools")).alias("tool_calls"),
        F.sum(F.size(F.array_distinct("tools"))).alias("distinct_tool_calls"),
        F.sum(F.col("succeeded").cast("int")).alias("succeeded"),
    )


def report_rows(reports: DataFrame, incidents: DataFrame, triage: DataFrame) -> DataFrame:
    """Reports as they are stored, with their severity and workloads.

    An incident's report (``reports``: report_id, kind, incident_id,
    investigation_id, overall_status, workloads_reviewed, ...) takes both from
    ``triage`` (incident_id, severity, affected_workloads) where there was one,
    each by itself, else from ``incidents`` (the same columns). A cluster's report
    links neither and has its own status and reviewed workloads.
    """
    def of(df: DataFrame, tag: str) -> DataFrame:
        return df.select("incident_id", F.col("severity").alias(f"__{tag}_severity"), F.col("affected_workloads").alias(f"__{tag}_workloads"))

    cluster = F.col("kind") == "cluster"
    own = [c for c in reports.columns if c not in ("overall_status", "workloads_reviewed")]
    linked = reports.withColumns({c: F.when(~cluster, F.col(c)) for c in ("incident_id", "investigation_id")})
    j = linked.join(of(incidents, "i"), "incident_id", "left").join(of(triage, "t"), "incident_id", "left")
    return j.select(*own, F.when(cluster, F.col("overall_status")).otherwise(F.coalesce("__t_severity", "__i_severity")).alias("severity"),
                    F.when(cluster, F.col("workloads_reviewed")).otherwise(F.coalesce("__t_workloads", "__i_workloads")).alias("affected_workloads"))


# Outcomes that are stored with the reason.
WITH_REASON = ("Failed", "Inconclusive")


def investigation_rows(investigations: DataFrame, executions: DataFrame, unavailable: DataFrame) -> DataFrame:
    """One record per investigation.

    ``investigations``: investigation_id, incident_id, final_state,
    terminal_outcome (see ``grounding.final_state``); ``executions``:
    investigation_id, agent, started_at, finished_at, tools, succeeded;
    ``unavailable``: incident_id, source. The record says whether the evidence
    was complete and what it lacked, gives a failure reason only for failed and
    inconclusive ones, and lists the agents' executions in their order.
    """
    def millis(c: str) -> Column:
        return F.unix_millis(F.col(c).cast("timestamp"))

    run = F.struct("started_at", "agent", (millis("finished_at") - millis("started_at")).alias("duration_ms"),
                   F.size("tools").alias("tool_calls"), "tools", "succeeded")
    ex = executions.groupBy("investigation_id").agg(
        F.sort_array(F.collect_list(run)).alias("executions"), F.min("started_at").alias("started_at"), F.max("finished_at").alias("completed_at"))
    lacking = unavailable.groupBy("incident_id").agg(F.array_sort(F.collect_set("source")).alias("__lacking"))
    j = investigations.join(ex, "investigation_id", "left").join(lacking, "incident_id", "left")
    sources = F.coalesce("__lacking", F.array().cast("array<string>"))
    return j.select(
        "investigation_id", "incident_id", F.col("final_state").alias("state"), "started_at", "completed_at",
        F.coalesce(millis("completed_at") - millis("started_at"), F.lit(0)).alias("duration_ms"),
        F.when(F.col("final_state").isin(*WITH_REASON), F.col("terminal_outcome")).alias("failure_reason"),
        (F.size(sources) == 0).alias("evidence_complete"), sources.alias("unavailable_sources"),
        F.coalesce("executions", F.array().cast(ex.schema["executions"].dataType)).alias("executions"))


# --- queue -----------------------------------------------------------------------

def queue_depth(items: DataFrame) -> DataFrame:
    return items.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def enqueue_dedup(items: DataFrame, requests: DataFrame, order: str) -> DataFrame:
    """Requests that would create a row: first per (kind, dedup_key) (an
    aggregate, so a hot key is reduced map-side), and only when no active row
    holds that key."""
    cols = [c for c in requests.columns if c not in ("kind", "dedup_key")]
    first = requests.groupBy("kind", "dedup_key").agg(F.min_by(F.struct(*cols), F.col(order)).alias("__first"))
    first = first.select("kind", "dedup_key", *[F.col(f"__first.{c}").alias(c) for c in cols]).select(*requests.columns)
    active = items.filter(F.col("state").isin(*ACTIVE)).select("kind", "dedup_key")
    return first.join(active, ["kind", "dedup_key"], "left_anti")


def claimable(items: DataFrame, now: datetime, limit: int) -> DataFrame:
    due = ((F.col("state") == "Pending") & (F.col("available_at") <= F.lit(now))) | (
        (F.col("state") == "Claimed") & (F.col("leased_until") < F.lit(now))
    )
    return items.filter(due).orderBy("available_at", "id").limit(limit)


def retry_schedule(items: DataFrame, base_seconds: int = 30, cap_seconds: int = 900) -> DataFrame:
    """Outcome of a failure: exhausted -> Failed, else Pending after
    min(base * 2^(attempt-1), cap) seconds."""
    exhausted = F.col("attempt") >= F.col("max_attempts")
    delay = F.least(F.lit(float(base_seconds)) * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("attempt") - 1)), F.lit(float(cap_seconds)))
    return items.select(
        "id", "attempt",
        F.when(exhausted, "Failed").otherwise("Pending").alias("next_state"),
        F.when(exhausted, F.lit(0.0)).otherwise(delay).alias("delay_seconds"),
    )


def stranded(incidents: DataFrame, items: DataFrame, key: str = "dedup_key") -> DataFrame:
    """In-flight incidents with no active work item (left-anti join)."""
    from vigil.operators.incidents import IN_FLIGHT

    active = items.filter(F.col("state").isin(*ACTIVE)).select(F.col(key).alias("incident_id"))
    return incidents.filter(F.col("state").isin(*IN_FLIGHT)).join(active, "incident_id", "left_anti")


def stale_leases(items: DataFrame, worker: str) -> DataFrame:
    return items.filter((F.col("state") == "Claimed") & (F.col("leased_by") == worker))
