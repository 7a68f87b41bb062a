"""Log operators: validation, search, interval join around moments, error
signatures per pass, enrichment of JSON lines, evidence projection.

A stored line goes one way through all of them: parse, enrich (``messages``),
and redact whatever leaves the engine. Signatures hash the enriched message,
searches and samples return its redacted text; the raw line is returned by
none of them.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.config import Params
from vigil.functions import ids, text
from vigil.functions.ids import SOURCE_LOGS
from vigil.operators.windows import expand_to_passes, slide_bucket
from vigil.session import spread, stored

# The closed set of log levels.
LEVELS = ["trace", "debug", "info", "warn", "error", "fatal"]
# Framework level name -> short name written into log lines.
LEVEL_NAMES = {
    "Trace": "trace",
    "Debug": "debug",
    "Information": "info",
    "Warning": "warn",
    "Error": "error",
    "Critical": "fatal",
}
_WORKLOAD_RE = re.compile(r"^[a-z0-9]([-a-z0-9]{0,61}[a-z0-9])?$")
SAMPLE_CHARS = 500


class QueryRejected(ValueError):
    """A caller argument was refused (raised on the driver, before any job)."""


def require_namespace(ns: str | None, params: Params) -> str:
    ns = ns if ns and ns.strip() else params.default_namespace
    if not _WORKLOAD_RE.match(ns) or ns not in params.allowed_namespaces:
        raise QueryRejected(f"namespace {ns!r} is not allowed")
    return ns


def require_workload(w: str | None) -> str:
    if w is None or not _WORKLOAD_RE.match(w):
        raise QueryRejected(f"invalid workload {w!r}")
    return w


def validate_level(level: str | None) -> str | None:
    if level is None or not level.strip():
        return None
    if level not in LEVELS:
        raise QueryRejected(f"unknown log level {level!r}; known: {' '.join(LEVELS)}")
    return level


def clamp_window(start: datetime, end: datetime, params: Params) -> tuple[datetime, datetime]:
    """end <= start is refused; an over-long window is cut from the start."""
    if end <= start:
        raise QueryRejected("end must be after start")
    longest = timedelta(minutes=params.max_range_minutes)
    if end - start > longest:
        start = end - longest
    return start, end


def clamp_limit(limit: int | None, ceiling: int) -> int:
    if limit is None or limit <= 0:
        return ceiling
    return min(limit, ceiling)


def level_name(framework_level) -> Column:
    c = F.col(framework_level) if isinstance(framework_level, str) else framework_level
    m = F.create_map(*[x for kv in LEVEL_NAMES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(m[c], F.lit("none"))


# --- enrichment -------------------------------------------------------------

def _json_string(v: Column, field: str) -> Column:
    """A JSON field only when it is a string (numbers etc. are ignored)."""
    item = F.try_variant_get(v, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(item) == F.lit("STRING"), item.cast("string"))


def enrich(raw: DataFrame, line: str = "line", labels: str = "labels") -> DataFrame:
    """Level / workload / pod / message from a raw line plus stream labels.

    Stream labels win over JSON fields; ``msg`` replaces the line; the
    operation, dependency, correlationId and errorMessage strings are appended
    as ``(operation=..., dependency=..., correlationId=..., error=...)``. Lines
    that are not JSON objects pass through unchanged.
    """
    v = F.try_parse_json(F.col(line))
    is_obj = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    d = raw.withColumn("__v", F.when(is_obj, v))
    jv = F.col("__v")
    # a field that is missing makes its part null, and concat_ws leaves nulls out
    suffix_parts = [F.concat(F.lit(f"{name}="), _json_string(jv, field)) for name, field in (
        ("operation", "operation"), ("dependency", "dependency"), ("correlationId", "correlationId"), ("error", "errorMessage"))]
    suffix = F.concat_ws(", ", *suffix_parts)
    base_msg = F.coalesce(_json_string(jv, "msg"), F.col(line))
    message = F.when(jv.isNull(), F.col(line)).when(suffix == "", base_msg).otherwise(
        F.concat(base_msg, F.lit(" ("), suffix, F.lit(")"))
    )
    lab = F.col(labels)
    return d.select(
        *[c for c in raw.columns],
        F.coalesce(lab["level"], _json_string(jv, "level")).alias("level_resolved"),
        F.coalesce(lab["container"], _json_string(jv, "service")).alias("workload"),
        _json_string(jv, "pod").alias("pod_resolved"),
        message.alias("message"),
    )


def messages(logs: DataFrame) -> DataFrame:
    """Stored lines (ts, namespace, container, level, pod, line, ...) with the
    enriched ``message``; container, level and pod are filled from the line
    where the stored labels have none."""
    labels = F.create_map(F.lit("level"), F.col("level"), F.lit("container"), F.col("container"))
    cols = [c for c in logs.columns if c not in ("level", "container", "pod", "message")]
    e = enrich(logs.withColumn("__labels", labels), "line", "__labels")
    return e.select(*cols, F.col("level_resolved").alias("level"), F.col("workload").alias("container"),
                    F.coalesce("pod", "pod_resolved").alias("pod"), "message")


def redacted(lines: DataFrame) -> DataFrame:
    """Replace ``message`` by its redacted text; adds ``redacted_value_count``."""
    return text.with_redaction(lines, "message", "__red", "redacted_value_count").drop("message").withColumnRenamed("__red", "message")


def newest_first(lines: DataFrame) -> list[Column]:
    """Total order of lines, newest first; ties by event id where there is one, else by pod and line."""
    ties = ["event_id"] if "event_id" in lines.columns else ["pod", "line"]
    return [F.col("ts").desc(), *(F.col(c).desc() for c in ties)]


# --- evidence projection (log samples) ------------------------------------------

def iso_o(ts) -> Column:
    """Round-trip ('O') timestamp text with 7 fraction digits and +00:00."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS'+00:00'")


def to_sample_evidence(df: DataFrame, message: str = "message", workload: str = "workload", pod: str = "pod",
                       level: str = "level", ts: str = "ts") -> DataFrame:
    d = text.with_redaction(df, message, "__red", "redacted_value_count")
    return d.select(
        *(c for c in df.columns if c not in (message, "line")),
        ids.evidence_id("LogSample", SOURCE_LOGS, iso_o(ts), F.col(workload), F.col(pod), text.log_signature(F.col(message))).alias("evidence_id"),
        F.lit("LogSample").alias("kind"),
        F.lit(SOURCE_LOGS).alias("source"),
        F.col(ts).alias("observed_at"),
        F.concat(F.lit("["), F.coalesce(F.col(level), F.lit("info")), F.lit("] "), text.truncate("__red", SAMPLE_CHARS)).alias("summary"),
        F.create_map(F.lit("level"), F.coalesce(F.col(level), F.lit("unknown")), F.lit("pod"), F.coalesce(F.col(pod), F.lit("unknown")),
                     F.lit("timestampUtc"), iso_o(ts)).alias("attributes"),
        "redacted_value_count",
    )


# --- search -------------------------------------------------------------------

def find(logs: DataFrame, params: Params, namespace: str | None, start: datetime, end: datetime,
         container: str | None = None, level: str | None = None, contains: str | None = None,
         limit: int | None = None) -> DataFrame:
    """The newest matching lines, unredacted and with their enriched message
    (an input of ``to_sample_evidence``; ``search`` is what callers get).

    Equality filters (pushed to the scan / partitions), case-sensitive
    substring of the stored line, window, newest first, limit
    (TakeOrderedAndProject); only the lines that are left get parsed."""
    ns = require_namespace(namespace, params)
    start, end = clamp_window(start, end, params)
    n = clamp_limit(limit, params.max_log_lines)
    cond = (F.col("namespace") == ns) & (F.col("ts") >= F.lit(start)) & (F.col("ts") <= F.lit(end))
    if container is not None and container.strip():
        cond &= F.col("container") == require_workload(container)
    lv = validate_level(level)
    if lv:
        cond &= F.col("level") == lv
    if contains:
        cond &= F.col("line").contains(contains)
    return messages(logs.filter(cond).orderBy(*newest_first(logs)).limit(n))


def search(logs: DataFrame, params: Params, *args, **kw) -> DataFrame:
    """``find`` with redacted messages and without the stored lines."""
    return redacted(find(logs, params, *args, **kw)).drop("line")


def errors_panel(logs: DataFrame, limit: int = 100) -> DataFrame:
    """The newest error and warning lines, enriched and redacted."""
    hit = logs.filter(F.col("level").isin("error", "warn")).orderBy(*newest_first(logs)).limit(limit)
    return redacted(messages(hit)).drop("line")


def around(moments: DataFrame, logs: DataFrame, before_s: int, after_s: int, limit: int,
           moment_ts: str = "moment_ts") -> DataFrame:
    """Lines of the same (namespace, workload) in [moment - before, moment + after],
    newest first, at most ``limit`` per moment, enriched and redacted. A
    moment without a workload takes the lines of all workloads.

    Interval join without a nested loop: both sides carry a time bucket of
    width ``before + after``; a moment is replicated into the (at most two)
    buckets its interval touches, then an equi-join on (namespace, workload,
    bucket) plus the exact range predicate.
    """
    before_s = max(10, min(900, before_s))
    after_s = max(10, min(900, after_s))
    span = (before_s + after_s) * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    m = moments.withColumn("__lo", micros(moment_ts) - before_s * 1_000_000).withColumn(
        "__hi", micros(moment_ts) + after_s * 1_000_000
    )
    m = m.withColumn(
        "__bucket", F.explode(F.sequence(F.floor(F.col("__lo") / span), F.floor(F.col("__hi") / span)))
    )
    lg = logs.withColumn("__e", micros("ts")).withColumn("__bucket", F.floor(F.col("__e") / span))
    same = ((F.col("m.namespace") == F.col("l.namespace")) & (F.col("m.__bucket") == F.col("l.__bucket"))
            & F.col("l.__e").between(F.col("m.__lo"), F.col("m.__hi")))
    cols = [F.col("m.moment_id").alias("moment_id"), F.col(f"m.{moment_ts}").alias(moment_ts),
            *(F.col(f"l.{c}").alias(c) for c in logs.columns)]
    everywhere = F.col("workload").isNull() | (F.trim("workload") == "")
    one = m.filter(~everywhere).alias("m").join(lg.alias("l"), same & (F.col("m.workload") == F.col("l.container"))).select(*cols)
    every = m.filter(everywhere).alias("m").join(lg.alias("l"), same).select(*cols)
    out = one.unionByName(every)
    w = Window.partitionBy("moment_id").orderBy(*newest_first(logs))
    ranked = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return redacted(messages(ranked)).drop("line")


# --- signatures -------------------------------------------------------------------

def error_signatures(logs: DataFrame, params: Params, top: int | None = None, by_workload: bool = False,
                     passes: DataFrame | None = None) -> DataFrame:
    """Repeated error/warn signatures per (namespace, pass), or per (namespace,
    workload, pass); with ``top``, the most frequent ones only (a listing:
    rules take them all); with ``passes`` (namespace, [container,] pass_ts) those passes only.

    Grouped by the hash of the normalised enriched message across workloads; workload, level and text come from
    the newest line of the group (ties: larger pod, larger message). Distinct pods counts a
    NULL pod as one value. Only numbers are aggregated: rows are counted per
    (slide bucket, hash, pod), which is written to the shared folder, expanded and
    summed per pass. The newest lines' texts are fetched for the signatures that are left,
    from the lines that have their namespace and instant.
    """
    scope = ["namespace", "container"] if by_workload else ["namespace"]
    # a stored level decides, so lines that have another one need no parsing
    logs = logs.filter(F.col("level").isNull() | F.col("level").isin("error", "warn"))

    def signed(raw: DataFrame) -> DataFrame:
        lines = messages(raw).filter(F.col("level").isin("error", "warn")).withColumn("normalised", text.normalise(F.col("message")))
        return lines.withColumn("signature_hash", text.signature_hash("normalised"))

    parts = signed(spread(logs)).groupBy(*scope, "signature_hash", "pod", slide_bucket("ts", params.slide_seconds).alias("__bucket")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("ts").alias("__first"), F.max("ts").alias("__last"))
    w = expand_to_passes(stored(parts, "signature-counts"), "__bucket", params)
    if passes is not None:
        w = w.join(passes.select(*scope, "pass_ts").distinct(), [*scope, "pass_ts"], "left_semi")
    out = w.groupBy(*scope, "window_start", "pass_ts", "signature_hash").agg(
        F.sum("__n").alias("occurrences"),
        F.min("__first").alias("first_seen"),
        F.max("__last").alias("last_seen"),
        (F.count_distinct("pod") + F.max(F.col("pod").isNull().cast("int"))).alias("distinct_pods"),
    )
    if top is not None:
        rw = Window.partitionBy(*scope, "pass_ts").orderBy(F.col("occurrences").desc(), F.col("signature_hash"))
        out = out.withColumn("rank", F.row_number().over(rw)).filter(F.col("rank") <= top).drop("rank")

    newest = out.select("namespace", F.col("last_seen").alias("ts")).distinct()
    sample = F.struct("level", F.col("container").alias("workload"), "normalised")
    samples = signed(logs.join(newest, ["namespace", "ts"], "left_semi")).groupBy(*scope, "signature_hash", F.col("ts").alias("last_seen")).agg(
        F.max_by(sample, F.struct("pod", "message", "level", "container")).alias("s"))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*scope, "signature_hash", "last_seen")]  # a container may be missing
    return out.alias("o").join(samples.alias("n"), reduce(Column.__and__, same)).select(
        *(f"o.{c}" for c in ("namespace", "window_start", "pass_ts", "signature_hash", "occurrences", "first_seen", "last_seen", "distinct_pods")),
        F.col("n.s.level").alias("level"), F.col("n.s.workload").alias("workload"), F.col("n.s.normalised").alias("normalised"))


def signature_evidence(sigs: DataFrame) -> DataFrame:
    """Signatures as LogSignature evidence; the text is redacted."""
    d = text.with_redaction(sigs, "normalised", "__red", "redacted_value_count")
    return d.select(
        *(c for c in sigs.columns if c != "normalised"),
        ids.evidence_id("LogSignature", SOURCE_LOGS, F.col("signature_hash"), F.col("workload")).alias("evidence_id"),
        F.lit("LogSignature").alias("kind"),
        F.lit(SOURCE_LOGS).alias("source"),
        F.col("last_seen").alias("observed_at"),
        F.concat(F.col("occurrences").cast("string"), F.lit("x ["), F.coalesce(F.col("level"), F.lit("")), F.lit("] "), F.col("__red")).alias("summary"),
        F.create_map(F.lit("occurrences"), F.col("occurrences").cast("string"), F.lit("signatureHash"), F.col("signature_hash"),
                     F.lit("level"), F.coalesce("level", F.lit("unknown")), F.lit("firstSeenUtc"), iso_o("first_seen"),
                     F.lit("lastSeenUtc"), iso_o("last_seen"), F.lit("distinctPods"), F.col("distinct_pods").cast("string")).alias("attributes"),
        "redacted_value_count",
    )


def camel_keys(m) -> Column:
    """Lower-case the first character of each key; drop NULL values."""
    c = F.col(m) if isinstance(m, str) else m
    kept = F.map_filter(c, lambda k, v: v.isNotNull())
    return F.transform_keys(kept, lambda k, v: F.concat(F.lower(F.substring(k, 1, 1)), F.substring(k, 2, 1 << 30)))
