"""Evidence operators: bundle collection (interval joins of incidents with
each telemetry family), trimming by kind priority, de-duplication, grouping by
kind, completeness, and the per-incident text digest."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.config import Params
from vigil.functions.ids import KIND_PRIORITY, SOURCE_METRICS
from vigil.operators import cluster, logs
from vigil.operators.windows import expand_to_passes, slide_bucket
from vigil.session import stored

EPOCH = datetime(1970, 1, 1)
log = logging.getLogger(__name__)

EVIDENCE_COLUMNS = ["incident_id", "evidence_id", "kind", "source", "observed_at", "workload", "summary"]


def kind_priority(kind) -> Column:
    c = F.col(kind) if isinstance(kind, str) else kind
    pos = F.array_position(F.array(*[F.lit(k) for k in KIND_PRIORITY]), c)
    return F.when(pos == 0, F.lit(len(KIND_PRIORITY))).otherwise(pos - 1).cast("int")


def select(evidence: DataFrame, max_items: int, by: str = "incident_id") -> DataFrame:
    """Keep everything when an incident has at most ``max_items``; otherwise
    fill by kind priority, newest first within a kind (ties by id)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    order = Window.partitionBy(by).orderBy(kind_priority("kind"), F.col("observed_at").desc(), F.col("evidence_id"))
    return (
        evidence.withColumn("__n", n)
        .withColumn("__r", F.row_number().over(order))
        .filter((F.col("__n") <= max_items) | (F.col("__r") <= max_items))
        .drop("__n", "__r")
    )


def triage_select(evidence: DataFrame, max_items: int = 15) -> DataFrame:
    return select(evidence.filter(F.col("kind") != "Runbook"), max_items)


def dedup(evidence: DataFrame, order: list[str], by: str = "evidence_id") -> DataFrame:
    """First occurrence of an id wins (insert-or-ignore semantics).

    A ``min_by`` aggregate rather than a window: duplicates of a hot id are
    reduced map-side instead of being sorted in one task."""
    cols = [c for c in evidence.columns if c != by]
    first = evidence.groupBy(by).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__first"))
    return first.select(by, *[F.col(f"__first.{c}").alias(c) for c in cols]).select(*evidence.columns)


def insert_ignore(existing: DataFrame, incoming: DataFrame, order: list[str], key: str = "evidence_id") -> DataFrame:
    """Rows of ``incoming`` to append: first per key, and not already stored."""
    return dedup(incoming, order, key).join(existing.select(key), key, "left_anti")


def by_kind(evidence: DataFrame) -> DataFrame:
    """Per incident and kind: count and ids (newest first)."""
    return evidence.groupBy("incident_id", "kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.transform(
            F.sort_array(F.collect_list(F.struct(F.col("observed_at"), F.col("evidence_id"))), asc=False),
            lambda x: x["evidence_id"],
        ).alias("ids"),
    )


def completeness(evidence: DataFrame, incidents: DataFrame, failures: DataFrame) -> DataFrame:
    """Unavailable sources = those that failed (``failures``: incident_id,
    source); a source that answered with nothing is available. Complete when
    none failed. ``api_check``: complete, with cluster state and metrics."""
    kinds = evidence.groupBy("incident_id").agg(F.collect_set("kind").alias("kinds"))
    failed = failures.groupBy("incident_id").agg(F.array_sort(F.collect_set("source")).alias("failed"))
    j = incidents.select("incident_id").join(kinds, "incident_id", "left").join(failed, "incident_id", "left")
    none = F.array().cast("array<string>")
    have, failed = F.coalesce("kinds", none), F.coalesce("failed", none)
    complete = F.size(failed) == 0
    return j.select(
        "incident_id",
        failed.alias("unavailable_sources"),
        complete.alias("is_complete"),
        (complete & F.array_contains(have, "KubernetesState") & F.array_contains(have, "Metric")).alias("api_check"),
    )


# Evidence sections of the digest, in order, with their headings.
DIGEST_SECTIONS = [
    ("KubernetesState", "Cluster state (authoritative)"),
    ("KubernetesEvent", "Kubernetes events"),
    ("Metric", "Metrics"),
    ("LogSignature", "Repeated log patterns, with occurrence counts"),
    ("LogSample", "Individual log lines"),
    ("HistoricalIncident", "Similar past incidents (historical, not current evidence)"),
    ("Runbook", "Runbook extracts (guidance, not evidence of this incident)"),
]


def evidence_block(evidence: DataFrame) -> Column:
    """One evidence item as the text block the agents read."""
    n = F.coalesce(F.col("redacted_value_count"), F.lit(0)) if "redacted_value_count" in evidence.columns else F.lit(0)
    return F.concat(
        F.lit('<evidence id="'), F.col("evidence_id"), F.lit('" source="'), F.coalesce("source", F.lit("")),
        F.lit('" at="'), F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss'Z'"), F.lit('">\n'),
        F.coalesce("summary", F.lit("")), F.lit("\n"),
        F.when(n > 0, F.concat(F.lit("("), n.cast("string"), F.lit(" sensitive value(s) removed before you saw this)\n"))).otherwise(F.lit("")),
        F.lit("</evidence>\n"),
    )


def digest(evidence: DataFrame, max_items: int) -> DataFrame:
    """The evidence section of an incident's prompt, per incident.

    The evidence is trimmed by kind priority (E3) first, so a group is small.
    Sections follow ``DIGEST_SECTIONS`` (empty ones skipped), each a heading
    and the items newest first, each item an ``<evidence ...>`` block with a
    note when values were redacted.
    """
    evidence = select(evidence, max_items)
    kinds = [k for k, _ in DIGEST_SECTIONS]
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")).cast("int")
    heading = F.element_at(F.array(*[F.lit(h) for _, h in DIGEST_SECTIONS]), F.greatest(rank, F.lit(1)))
    items = F.struct(rank.alias("r"), (-F.unix_micros(F.col("observed_at").cast("timestamp"))).alias("t"),
                     F.col("evidence_id").alias("i"), heading.alias("h"), evidence_block(evidence).alias("b"))
    g = evidence.filter(rank > 0).groupBy("incident_id").agg(F.sort_array(F.collect_list(items)).alias("__it"),
                                                           F.count(F.lit(1)).alias("items"))
    blocks = F.transform("__it", lambda x, i: F.concat(
        F.when(i == 0, F.concat(F.lit("### "), x["h"], F.lit("\n")))
        .when(x["r"] != F.get("__it", i - 1)["r"], F.concat(F.lit("\n### "), x["h"], F.lit("\n"))).otherwise(F.lit("")), x["b"]))
    return g.select("incident_id", F.concat(F.array_join(blocks, ""), F.lit("\n")).alias("digest"), "items")


def prompt(incidents: DataFrame, digests: DataFrame) -> DataFrame:
    """The incident's header, its signals in key order, and its digest: the text an agent reads.

    ``incidents``: incident_id, category, severity, title, namespace,
    affected_workloads, first/last_detected_at, detection_count,
    detection_rule, signals.
    """
    def utc(c):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss'Z'")

    # The labels of the header, in order.
    fields = [("category", F.col("category")), ("detected severity", F.col("severity")), ("title", F.col("title")),
              ("namespace", F.col("namespace")), ("workloads showing symptoms", F.array_join("affected_workloads", ", ")),
              ("first detected", utc("first_detected_at")), ("most recently observed", utc("last_detected_at")),
              ("observed", F.concat(F.col("detection_count").cast("string"), F.lit(" time(s)"))), ("raised by rule", F.col("detection_rule"))]
    lines = [F.lit("## Incident")]
    for name, value in fields:
        lines.append(F.concat(F.lit(f"- {name}" + (" " if name == "observed" else ": ")), F.coalesce(value, F.lit(""))))
    signals = F.array_sort(F.map_entries("signals"))
    measured = F.concat(F.lit("\n\n### Measured values that triggered the rule\n"), F.array_join(
        F.transform(signals, lambda x: F.concat(F.lit("- "), x["key"], F.lit(": "), x["value"])), "\n"))
    head = F.concat(F.concat_ws("\n", *lines), F.when(F.size("signals") > 0, measured).otherwise(F.lit("")))
    j = incidents.join(digests, "incident_id", "left")
    return j.select("incident_id", F.concat(head, F.lit("\n\n## Evidence\n\n"), F.coalesce("digest", F.lit(""))).alias("prompt"))


# --- bundles ---------------------------------------------------------------------------

BUNDLE_COLUMNS = ["incident_id", "evidence_id", "kind", "source", "observed_at", "workload", "summary", "attributes"]
FAMILY_COLUMNS = ["evidence_id", "kind", "source", "observed_at", "summary", "attributes"]


@dataclass
class BundleSources:
    """What a bundle is collected from; None where the source is unavailable."""

    pods: DataFrame | None = None          # pod objects with observed_at
    deployments: DataFrame | None = None   # Deployment objects with observed_at
    events: DataFrame | None = None        # event objects
    metrics: DataFrame | None = None       # ``service_metric_evidence``
    logs: DataFrame | None = None          # stored lines


def _at_pass(moments: DataFrame, family: DataFrame, at: str) -> DataFrame:
    """Rows of the very pass of a moment."""
    f = family.select(F.col("namespace").alias("f_ns"), F.col("workload").alias("f_wl"), F.col(at).alias("f_at"), *FAMILY_COLUMNS)
    return moments.join(f, (F.col("namespace") == F.col("f_ns")) & (F.col("workload") == F.col("f_wl")) & (F.col("moment_ts") == F.col("f_at")))


def _as_of(moments: DataFrame, family: DataFrame) -> DataFrame:
    """Rows of the namespace's newest snapshot that is not after a moment."""
    snaps = family.select("namespace", F.col("observed_at").alias("t")).distinct().withColumn("snap", F.col("t"))
    asked = moments.select("namespace", F.col("moment_ts").alias("t")).distinct().withColumn("snap", F.lit(None).cast("timestamp"))
    # a snapshot sorts before a moment of the same instant; one row per snapshot and moment
    w = Window.partitionBy("namespace").orderBy("t", F.col("snap").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = snaps.unionByName(asked).withColumn("newest", F.last("snap", ignorenulls=True).over(w))
    at = both.filter(F.col("snap").isNull()).select("namespace", F.col("t").alias("moment_ts"), "newest")
    timed = moments.join(at, ["namespace", "moment_ts"])
    f = family.select(F.col("namespace").alias("f_ns"), F.col("workload").alias("f_wl"), *FAMILY_COLUMNS)
    return timed.join(f, (F.col("namespace") == F.col("f_ns")) & (F.col("workload") == F.col("f_wl")) & (F.col("newest") == F.col("observed_at")))


def newest_in_window(moments: DataFrame, rows: DataFrame, params: Params, limit: int, ts: str, order: list[Column]) -> DataFrame:
    """The newest ``limit`` rows of a moment's workload in [moment - window, moment).

    Moments are passes, so a window is a whole number of slide buckets, and no
    bucket needs more than its own newest ``limit`` rows: a hot workload is
    cut down per bucket before it meets a moment.
    """
    b = rows.withColumn("__b", slide_bucket(ts, params.slide_seconds))
    per = Window.partitionBy("namespace", "workload", "__b").orderBy(*order)
    few = b.withColumn("__r", F.row_number().over(per)).filter(F.col("__r") <= limit).drop("__r")
    met = expand_to_passes(few, "__b", params).drop("window_start").withColumnRenamed("pass_ts", "moment_ts").join(
        moments, ["namespace", "workload", "moment_ts"])
    best = Window.partitionBy("incident_id").orderBy(*order)
    return met.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= limit).drop("__r")


def bundle(moments: DataFrame, src: BundleSources, params: Params, max_log_samples: int | None = None,
           whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The evidence of many incidents at once, and what could not be had.

    ``moments``: (incident_id, namespace, workload, moment_ts), moment_ts a
    pass. Six families: pods, Deployments and events of the cluster, the
    service's metrics of the pass, its error signatures, and its newest error
    lines. Text work (redaction, hashing) is done on what is left after the
    limits. The second result, (incident_id, source), names the families
    whose source is missing or failed, in planning or while it was read; the others are still collected.
    With ``whole`` such a family is an error: for results that have no place to say what they lack.
    """
    samples = params.max_log_samples if max_log_samples is None else min(max_log_samples, params.max_log_samples)
    m = moments.select("incident_id", "namespace", "workload", "moment_ts")

    def pods():
        return _as_of(m, cluster.pod_status(src.pods))

    def deployments():
        return _as_of(m, cluster.deployment_status(src.deployments, keep=["observed_at"]).withColumnRenamed("deployment", "workload"))

    def events():
        every = cluster.event_rows(src.events, m.select("namespace", "workload"), EPOCH)
        few = newest_in_window(m, every, params, params.max_items, "occurred_at", [F.col("occurred_at").desc(), F.col("evidence_id")])
        return cluster.event_evidence(few, before=["incident_id"]).withColumn("observed_at", F.col("occurred_at"))

    def metrics():
        return _at_pass(m, src.metrics, "observed_at")

    def signatures():
        asked = m.select("namespace", F.col("workload").alias("container"), F.col("moment_ts").alias("pass_ts"))
        s = logs.error_signatures(src.logs, params, top=params.max_signatures, by_workload=True, passes=asked)
        return _at_pass(m, logs.signature_evidence(s), "pass_ts")

    def lines():
        stored = src.logs.filter(F.col("level") == "error").withColumn("workload", F.col("container"))
        few = newest_in_window(m, stored, params, samples, "ts", logs.newest_first(src.logs))
        return logs.to_sample_evidence(logs.messages(few.drop("workload")).withColumnRenamed("container", "workload"))

    # Names of the sources in an incomplete bundle.
    families = [("kubernetes pod state", src.pods, pods), ("kubernetes deployment state", src.deployments, deployments),
                ("kubernetes events", src.events, events), ("service metrics", src.metrics, metrics),
                ("log signatures", src.logs, signatures), ("error log samples", src.logs, lines)]
    parts, missing = [], []
    for name, given, build in families:
        try:
            if given is None:
                raise ValueError("no such source")
            parts.append(stored(build().select(*BUNDLE_COLUMNS), "evidence"))  # read now: a source may fail while it is read
        except Exception as error:  # noqa: BLE001 - a failing source must not cost the others
            if whole:
                raise RuntimeError(f"the bundles would lack {name}: {error}") from error
            log.warning("%s left out of the bundles: %s", name, error)
            missing.append(f"{name} ({type(error).__name__})")
    if not parts:
        raise ValueError("no evidence source is available")
    failed = m.select("incident_id", F.explode(F.array(*map(F.lit, missing)).cast("array<string>")).alias("source"))
    return reduce(DataFrame.unionByName, parts), failed


def service_metric_evidence(error_rate: DataFrame | None, p95: DataFrame | None, failures: DataFrame | None,
                            dep_p95: DataFrame | None, window_minutes: int) -> DataFrame:
    """The four metric families as Metric evidence rows, per pass.

    Ids follow the service's layout (kind, source, service, family parts,
    observation minute); texts use integer-rounded numbers so every engine
    prints the same digits.
    """
    from vigil.functions.ids import evidence_id
    from vigil.operators.detect import fixed_double, fixed_ratio
    from vigil.operators.metrics import minute_bucket

    def rows(df: DataFrame, parts: list[Column], summary: Column, **attributes: Column) -> DataFrame:
        return df.select(
            "namespace", F.col("service").alias("workload"), F.col("pass_ts").alias("observed_at"),
            evidence_id("Metric", SOURCE_METRICS, F.col("service"), *parts, minute_bucket("pass_ts")).alias("evidence_id"),
            F.lit("Metric").alias("kind"), F.lit(SOURCE_METRICS).alias("source"), summary.alias("summary"),
            cluster.attribute_map(**attributes).alias("attributes"))

    def whole(c: str) -> Column:
        return F.col(c).cast("bigint").cast("string")

    out = []
    if error_rate is not None:
        out.append(rows(
            error_rate, [F.lit("http_error_rate")],
            F.concat(F.col("service"), F.lit(": "), fixed_ratio(F.col("errors") * 100, F.col("total"), 1),
                     F.lit(f" % of requests returned 5xx over the last {window_minutes} minutes ("), whole("total"), F.lit(" requests)")),
            errorRatio=fixed_ratio("errors", "total", 4), totalRequests=whole("total"), windowMinutes=F.lit(str(window_minutes))))
    if p95 is not None:
        out.append(rows(p95, [F.lit("latency_p95")],
                        F.concat(F.col("service"), F.lit(": 95th percentile request duration "), fixed_double("p95", 3), F.lit("s")),
                        p95Seconds=fixed_double("p95", 4)))
    if failures is not None:
        out.append(rows(
            failures, [F.col("dependency"), F.col("kind")],
            F.concat(F.col("service"), F.lit(": "), whole("failures"), F.lit(" '"), F.col("kind"), F.lit("' failures calling "), F.col("dependency")),
            dependency=F.col("dependency"), failureKind=F.col("kind"), count=whole("failures")))
    if dep_p95 is not None:
        out.append(rows(
            dep_p95, [F.col("dependency"), F.lit("latency")],
            F.concat(F.col("service"), F.lit(": calls to "), F.col("dependency"), F.lit(" take "), fixed_double("p95", 3), F.lit("s at the 95th percentile")),
            dependency=F.col("dependency"), p95Seconds=fixed_double("p95", 4)))
    return reduce(DataFrame.unionByName, out)


def cluster_health(evidence: DataFrame, open_incidents: DataFrame, max_items: int) -> DataFrame:
    """What a cluster report rests on, per scope: the trimmed evidence and
    the impact text. ``evidence``: bundles of every Deployment, with the
    report's id as ``incident_id``; ``open_incidents``: (incident_id, n)."""
    kept = select(evidence, max_items)
    facts = kept.groupBy("incident_id").agg(F.count(F.lit(1)).alias("facts"))
    j = facts.join(open_incidents, "incident_id", "left")
    return j.select("incident_id", "facts", F.concat(
        F.coalesce("n", F.lit(0)).cast("string"), F.lit(" open incident(s), "), F.col("facts").cast("string"),
        F.lit(" evidence item(s) examined")).alias("impact"))
