"""Detection rules, candidate suppression and pass summaries.

Every rule reads the per-pass inputs for *all* (namespace, pass) at once and
emits the shared candidate schema; ``pass_ts`` is a grouping column
throughout, so batch replay and streaming use the same plan.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.config import Params
from vigil.functions import ids
from vigil.session import stored

log = logging.getLogger(__name__)

# Incident categories, severities and precedence.
HTTP_ERROR_RATE = "http_error_rate"
DEPENDENCY_LATENCY = "dependency_latency"
DEPENDENCY_UNAVAILABLE = "dependency_unavailable"
POD_RESTART_LOOP = "pod_restart_loop"
READINESS_FAILURE = "readiness_failure"
OUT_OF_MEMORY = "out_of_memory"
REPEATED_ERROR_SIGNATURE = "repeated_error_signature"

SEVERITIES = ["Low", "Medium", "High", "Critical"]
# Most explanatory first; a category not in the list sorts before all of them.
PRECEDENCE = [
    OUT_OF_MEMORY,
    DEPENDENCY_UNAVAILABLE,
    DEPENDENCY_LATENCY,
    POD_RESTART_LOOP,
    READINESS_FAILURE,
    HTTP_ERROR_RATE,
    REPEATED_ERROR_SIGNATURE,
]
EXPLANATORY = PRECEDENCE[:-1]

CANDIDATE_COLUMNS = [
    "namespace", "pass_ts", "fingerprint", "category", "severity", "severity_rank", "title",
    "detection_rule", "detected_at", "affected_workloads", "signals", "occurrences",
]


def severity_rank(sev) -> Column:
    c = F.col(sev) if isinstance(sev, str) else sev
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c).cast("int") - 1


def severity_name(rank) -> Column:
    c = F.col(rank) if isinstance(rank, str) else rank
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (c + 1).cast("int"))


def precedence_index(cat) -> Column:
    c = F.col(cat) if isinstance(cat, str) else cat
    return F.array_position(F.array(*[F.lit(p) for p in PRECEDENCE]), c).cast("int") - 1


def fixed_ratio(num, den, decimals: int) -> Column:
    """num/den as text with ``decimals`` places, half-up, by integer arithmetic
    (no binary-float formatting, so every engine prints the same digits)."""
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    scale = 10**decimals
    scaled = F.floor((F.lit(2 * scale) * n + d) / (F.lit(2) * d)).cast("bigint")
    whole = (scaled / F.lit(scale)).cast("bigint").cast("string")
    if decimals == 0:
        return whole
    frac = F.lpad((scaled % F.lit(scale)).cast("string"), decimals, "0")
    return F.concat(whole, F.lit("."), frac)


def fixed_double(x, decimals: int) -> Column:
    """Non-negative double as text with ``decimals`` places, rounded half-up
    on the binary value (identical digits in every engine)."""
    c = F.col(x) if isinstance(x, str) else x
    scale = 10**decimals
    scaled = F.floor(c * F.lit(scale) + F.lit(0.5)).cast("bigint")
    whole = (scaled / F.lit(scale)).cast("bigint").cast("string")
    if decimals == 0:
        return scaled.cast("string")
    return F.concat(whole, F.lit("."), F.lpad((scaled % F.lit(scale)).cast("string"), decimals, "0"))


def _cand_struct(category, severity, title, rule: str, workloads, signals, signature=None, occurrences=None) -> Column:
    """One candidate as a struct in the shared schema (column order = CANDIDATE_COLUMNS)."""
    cat = category if isinstance(category, Column) else F.lit(category)
    return F.struct(
        F.col("namespace").alias("namespace"),
        F.col("pass_ts").alias("pass_ts"),
        ids.fingerprint(cat, F.col("namespace"), workloads, signature).alias("fingerprint"),
        cat.alias("category"),
        severity.alias("severity"),
        severity_rank(severity).alias("severity_rank"),
        title.alias("title"),
        F.lit(rule).alias("detection_rule"),
        F.col("pass_ts").alias("detected_at"),
        ids.clean_workloads(workloads).alias("affected_workloads"),
        signals.alias("signals"),
        (occurrences if occurrences is not None else F.lit(None).cast("int")).alias("occurrences"),
    )


def _candidate(df: DataFrame, *args, **kw) -> DataFrame:
    return df.select(_cand_struct(*args, **kw).alias("c")).select("c.*")


def _emit(df: DataFrame, specs: list[tuple[Column, Column]]) -> DataFrame:
    """Several rules over one facts table in one pass: each (condition,
    candidate struct) pair contributes a candidate where its condition holds."""
    arr = F.array_compact(F.array(*[F.when(cond, st) for cond, st in specs]))
    return df.select(F.explode(arr).alias("c")).select("c.*")


def signals_text(signals="signals") -> Column:
    """Signals as ``key=value`` lines in key order."""
    c = F.col(signals) if isinstance(signals, str) else signals
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), "\n")


def _smap(**kv) -> Column:
    return F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(str(v)))])


def _spec_http_error_rate(params: Params) -> tuple[Column, Column]:
    t = params.thresholds
    cond = F.coalesce((F.col("total") >= t.min_request_sample) & (F.col("ratio") >= t.http_error_rate), F.lit(False))
    sev = F.when(F.col("ratio") >= 0.5, "Critical").when(F.col("ratio") >= 0.25, "High").otherwise("Medium")
    pct = fixed_ratio(F.col("errors") * 100, F.col("total"), 1)
    title = F.concat(F.col("service"), F.lit(" is returning "), pct, F.lit(" % server errors"))
    signals = _smap(
        errorRatio=fixed_ratio("errors", "total", 4),
        threshold=f"{t.http_error_rate:.4f}",
        totalRequests=F.col("total").cast("bigint"),
        windowMinutes=params.window_minutes,
    )
    return cond, _cand_struct(HTTP_ERROR_RATE, sev, title, "http-error-rate", F.array("service"), signals)


def rule_http_error_rate(error_rate: DataFrame, params: Params) -> DataFrame:
    cond, st = _spec_http_error_rate(params)
    return _emit(error_rate, [(cond, st)])


def _spec_latency(params: Params) -> tuple[Column, Column]:
    """p95 over threshold, only where the same service's error-rate row
    (``total``) shows enough traffic."""
    t = params.thresholds
    cond = F.coalesce(~F.isnan("p95") & (F.col("p95") >= t.latency_p95_seconds) & (F.col("total") >= t.min_request_sample),
                      F.lit(False))
    sev = F.when(F.col("p95") >= t.latency_p95_seconds * 3, "High").otherwise("Medium")
    title = F.concat(F.col("service"), F.lit(" 95th percentile latency is "), fixed_double("p95", 2), F.lit("s"))
    signals = _smap(
        p95Seconds=fixed_double("p95", 3),
        thresholdSeconds=f"{t.latency_p95_seconds:.3f}",
        windowMinutes=params.window_minutes,
    )
    return cond, _cand_struct(DEPENDENCY_LATENCY, sev, title, "request-latency", F.array("service"), signals)


RATE_KEYS = ["namespace", "service", "window_start", "pass_ts"]


def rule_latency(p95: DataFrame, error_rate: DataFrame, params: Params) -> DataFrame:
    j = p95.join(error_rate.select(*RATE_KEYS, "total"), RATE_KEYS)
    cond, st = _spec_latency(params)
    return _emit(j, [(cond, st)])


def rules_on_rates(error_rate: DataFrame, p95: DataFrame, params: Params) -> DataFrame:
    """D1 and D2 from one full outer join of the two per-(service, pass)
    aggregates. Both sides are already hash-partitioned on the join keys,
    so the join adds no exchange, and the raw samples are read once."""
    j = error_rate.join(p95.select(*RATE_KEYS, "p95"), RATE_KEYS, "full")
    return _emit(j, [_spec_http_error_rate(params), _spec_latency(params)])


def rule_dependency_failure(failures: DataFrame, params: Params) -> DataFrame:
    t = params.thresholds
    g = failures.groupBy("namespace", "pass_ts", "dependency", "kind").agg(
        F.sum("failures").alias("total"), F.array_sort(F.collect_set("service")).alias("callers")
    ).filter(F.col("total") >= t.dependency_failure_count)
    cat = F.when(F.col("kind") == "timeout", F.lit(DEPENDENCY_LATENCY)).otherwise(F.lit(DEPENDENCY_UNAVAILABLE))
    sev = F.when(F.size("callers") > 1, "High").otherwise("Medium")
    title = F.concat(
        F.col("total").cast("bigint").cast("string"), F.lit(" '"), F.col("kind"), F.lit("' failures calling "),
        F.col("dependency"), F.lit(" from "), F.array_join("callers", ", "),
    )
    signals = _smap(
        dependency=F.col("dependency"), failureKind=F.col("kind"), failureCount=F.col("total").cast("bigint"),
        threshold=t.dependency_failure_count, callerCount=F.size("callers"),
    )
    sig = F.concat(F.col("dependency"), F.lit(":"), F.col("kind"))
    return _candidate(g, cat, sev, title, "dependency-failure", F.col("callers"), signals, signature=sig)


def restart_delta(pods: DataFrame) -> DataFrame:
    """Restart increase since the namespace's previous *non-empty* pass.

    A pod absent from that pass (new pod) has increase 0; a pass without pods
    leaves the remembered counts untouched (it simply is not a pass here).
    """
    passes = pods.select("namespace", F.col("snapshot_ts").alias("pass_ts")).distinct()
    seq = passes.withColumn("pass_seq", F.row_number().over(Window.partitionBy("namespace").orderBy("pass_ts")))
    p = pods.withColumnRenamed("snapshot_ts", "pass_ts").join(seq, ["namespace", "pass_ts"])
    w = Window.partitionBy("namespace", "pod").orderBy("pass_seq")
    prev_seq = F.lag("pass_seq").over(w)
    prev_cnt = F.lag("restart_count").over(w)
    previous = F.when(prev_seq == F.col("pass_seq") - 1, prev_cnt).otherwise(F.col("restart_count"))
    return p.withColumn("previous_restart_count", previous).withColumn(
        "restart_increase", F.greatest(F.lit(0), F.col("restart_count") - F.col("previous_restart_count"))
    )


def pod_facts(pods_delta: DataFrame) -> DataFrame:
    """Per (namespace, pass, workload): everything D4 and D5 need, in one aggregation."""
    reason = F.coalesce("last_termination_reason", "waiting_reason")
    unready = (~F.col("ready")) & ~F.coalesce(F.col("waiting_reason") == "CrashLoopBackOff", F.lit(False)) & ~F.coalesce(
        F.col("last_termination_reason") == "OOMKilled", F.lit(False)
    )
    return pods_delta.groupBy("namespace", "pass_ts", "workload").agg(
        F.sum("restart_increase").alias("increase"),
        F.bool_or(F.coalesce(F.col("waiting_reason") == "CrashLoopBackOff", F.lit(False))).alias("crash"),
        F.bool_or(F.coalesce(F.col("last_termination_reason") == "OOMKilled", F.lit(False))).alias("oom"),
        F.count(F.lit(1)).alias("pod_count"),
        F.min_by(reason, F.when(reason.isNotNull() & (reason != ""), F.col("pod"))).alias("reason"),
        F.sum(unready.cast("int")).alias("unready"),
        F.sum("restart_count").alias("restarts"),
    )


def _spec_pod_restart(params: Params) -> tuple[Column, Column]:
    t = params.thresholds
    cond = (F.col("increase") >= t.pod_restart_increase) | F.col("crash") | F.col("oom")
    cat = F.when(F.col("oom"), F.lit(OUT_OF_MEMORY)).otherwise(F.lit(POD_RESTART_LOOP))
    sev = F.when(F.col("oom") | F.col("crash"), "High").otherwise("Medium")
    title = F.when(F.col("oom"), F.concat(F.col("workload"), F.lit(" was terminated for exceeding its memory limit"))).otherwise(
        F.concat(F.col("workload"), F.lit(" restarted "), F.col("increase").cast("string"), F.lit(" time(s)"),
                 F.when(F.col("crash"), F.lit(" and is in CrashLoopBackOff")).otherwise(F.lit("")))
    )
    base = _smap(
        restartIncrease=F.col("increase"), threshold=t.pod_restart_increase,
        crashLoopBackOff=F.when(F.col("crash"), "true").otherwise("false"),
        oomKilled=F.when(F.col("oom"), "true").otherwise("false"), podCount=F.col("pod_count"),
    )
    signals = F.when(F.col("reason").isNotNull(), F.map_concat(base, F.create_map(F.lit("reason"), F.col("reason")))).otherwise(base)
    return cond, _cand_struct(cat, sev, title, "pod-restarts", F.array("workload"), signals, signature=F.col("reason"))


def _spec_readiness(params: Params) -> tuple[Column, Column]:
    t = params.thresholds
    cond = F.col("unready") >= t.unready_pod_count
    all_un = F.col("unready") == F.col("pod_count")
    sev = F.when(all_un, "High").otherwise("Medium")
    title = F.when(all_un, F.concat(F.lit("every "), F.col("workload"), F.lit(" pod is failing its readiness probe"))).otherwise(
        F.concat(F.col("unready").cast("string"), F.lit(" of "), F.col("pod_count").cast("string"), F.lit(" "),
                 F.col("workload"), F.lit(" pods are not ready"))
    )
    signals = _smap(
        unreadyPods=F.col("unready"), totalPods=F.col("pod_count"),
        allReplicasUnready=F.when(all_un, "true").otherwise("false"), restartsObserved=F.col("restarts"),
    )
    return cond, _cand_struct(READINESS_FAILURE, sev, title, "readiness-failure", F.array("workload"), signals)


def rule_pod_restart(pods_delta: DataFrame, params: Params) -> DataFrame:
    return _emit(pod_facts(pods_delta), [_spec_pod_restart(params)])


def rule_readiness(pods: DataFrame, params: Params) -> DataFrame:
    return _emit(pod_facts(pods), [_spec_readiness(params)])


def rules_on_pods(pods_delta: DataFrame, params: Params) -> DataFrame:
    """D4 and D5 from one aggregation of the pod snapshots."""
    return _emit(pod_facts(pods_delta), [_spec_pod_restart(params), _spec_readiness(params)])


def rule_repeated_signature(sigs: DataFrame, params: Params) -> DataFrame:
    t = params.thresholds
    from vigil.operators.logs import signature_evidence

    hit = signature_evidence(sigs.filter((F.col("occurrences") >= t.repeated_signature_count) & (F.col("level") == "error")))
    hit = hit.withColumn("workload", F.coalesce("workload", F.lit("unknown")))
    sev = F.when(F.col("occurrences") >= t.repeated_signature_count * 5, "High").otherwise("Medium")
    title = F.concat(F.col("workload"), F.lit(" logged the same error "), F.col("occurrences").cast("string"), F.lit(" times"))
    signals = _smap(
        occurrences=F.col("occurrences"), threshold=t.repeated_signature_count,
        signatureHash=F.coalesce(F.col("signature_hash"), F.lit("unknown")), sample=F.col("summary"),
    )
    return _candidate(hit, REPEATED_ERROR_SIGNATURE, sev, title, "repeated-error-signature", F.array("workload"), signals,
                      signature=F.col("signature_hash"), occurrences=F.col("occurrences").cast("int"))


@dataclass
class Snapshot:
    """Lazily built per-pass inputs; any may be None when its source is absent."""

    error_rate: DataFrame | None = None
    latency_p95: DataFrame | None = None
    dependency_failures: DataFrame | None = None
    pods: DataFrame | None = None  # with restart_increase, pass_ts
    signatures: DataFrame | None = None
    unavailable_sources: tuple[str, ...] = ()


# Names of the sources, and the inputs that come from each.
SOURCE_INPUTS = {"prometheus": ("error_rate", "latency_p95", "dependency_failures"), "kubernetes": ("pods",), "loki": ("signatures",)}


def gathered(snap: Snapshot) -> Snapshot:
    """``snap`` with its inputs evaluated one after another into the shared folder.

    A source that fails while it is read costs its own inputs only: they are
    left out, so their rules do not fire, and its name joins ``unavailable_sources``.
    """
    out, failed = {}, list(snap.unavailable_sources)
    for source, inputs in SOURCE_INPUTS.items():
        for name in inputs:
            df = getattr(snap, name)
            try:
                out[name] = None if df is None else stored(df, f"input-{name}")
            except Exception as error:  # noqa: BLE001 - a failing source must not cost the others
                log.warning("%s was unavailable: %s", source, error)
                out[name] = None
                failed.append(source)
    return replace(snap, **out, unavailable_sources=tuple(dict.fromkeys(failed)))


def unavailable_by_pass(snap: Snapshot, passes: DataFrame, seen: Observation | None = None) -> DataFrame:
    """``passes`` (namespace, pass_ts, ...) with ``unavailable_sources``: those that failed, and those of which no input has
    a row in the pass. ``seen`` counts ``passes``, and per source those without it, as the rows go by."""
    out = passes
    flags = []
    for source, inputs in SOURCE_INPUTS.items():
        given = [getattr(snap, n).select("namespace", "pass_ts") for n in inputs if getattr(snap, n) is not None]
        missing = F.lit(True)
        if given and source not in snap.unavailable_sources:
            here = reduce(DataFrame.unionByName, given).distinct().withColumn(f"__{source}", F.lit(True))
            out = out.join(here, ["namespace", "pass_ts"], "left")
            missing = F.col(f"__{source}").isNull()
        flags.append((source, missing))
    out = out.select(*passes.columns, F.array_compact(F.array(*(F.when(m, F.lit(s)) for s, m in flags))).alias("unavailable_sources"))
    if seen is not None:
        out = out.observe(seen, F.count(F.lit(1)).alias("passes"), *(
            F.count_if(F.array_contains("unavailable_sources", s)).alias(s) for s in SOURCE_INPUTS))
    return out


RULES: dict[str, Callable[[Snapshot, Params], DataFrame | None]] = {
    "http-error-rate": lambda s, p: rule_http_error_rate(s.error_rate, p) if s.error_rate is not None else None,
    "request-latency": lambda s, p: rule_latency(s.latency_p95, s.error_rate, p)
    if s.latency_p95 is not None and s.error_rate is not None else None,
    "dependency-failure": lambda s, p: rule_dependency_failure(s.dependency_failures, p)
    if s.dependency_failures is not None else None,
    "pod-restarts": lambda s, p: rule_pod_restart(s.pods, p) if s.pods is not None else None,
    "readiness-failure": lambda s, p: rule_readiness(s.pods, p) if s.pods is not None else None,
    "repeated-error-signature": lambda s, p: rule_repeated_signature(s.signatures, p) if s.signatures is not None else None,
}


def _combined_rules(s: Snapshot, p: Params) -> dict:
    """Rules that share their input evaluate together (one pass over it)."""
    out = {}
    if s.error_rate is not None and s.latency_p95 is not None:
        out["http-error-rate+request-latency"] = lambda s, p: rules_on_rates(s.error_rate, s.latency_p95, p)
    else:
        out["http-error-rate"] = RULES["http-error-rate"]
        out["request-latency"] = RULES["request-latency"]
    out["dependency-failure"] = RULES["dependency-failure"]
    out["pod-restarts+readiness-failure"] = lambda s, p: rules_on_pods(s.pods, p) if s.pods is not None else None
    out["repeated-error-signature"] = RULES["repeated-error-signature"]
    return out


def detect_all(snap: Snapshot, params: Params, rules: dict | None = None) -> tuple[DataFrame | None, list[str]]:
    """Union of every rule's candidates; a rule that fails to plan is skipped
    and reported, the others still run. Without an explicit rule set, rules
    that read the same input are evaluated together."""
    out, failed = None, []
    for name, rule in (rules or _combined_rules(snap, params)).items():
        try:
            df = rule(snap, params)
        except Exception:  # noqa: BLE001 - isolation between rules is the point
            failed.append(name)
            continue
        if df is None:
            continue
        df = df.select(*CANDIDATE_COLUMNS)
        out = df if out is None else out.unionByName(df)
    return out, failed


def _pass_window():
    return Window.partitionBy("namespace", "pass_ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def suppress_explained(candidates: DataFrame) -> DataFrame:
    """Drop repeated-signature candidates whose every workload is already
    covered by an explanatory category in the same pass (a pass with at most
    one candidate is untouched). Adds ``pass_candidates`` for the next steps."""
    wall = _pass_window()
    is_rep = F.col("category") == REPEATED_ERROR_SIGNATURE
    explanatory = F.col("category").isin(*EXPLANATORY)
    c = candidates.withColumn("pass_candidates", F.count(F.lit(1)).over(wall)).withColumn(
        "__explained",
        F.array_distinct(F.flatten(F.collect_list(F.when(explanatory, F.col("affected_workloads"))).over(wall))),
    )
    covered = F.forall("affected_workloads", lambda x: F.array_contains(F.col("__explained"), x))
    return c.filter((F.col("pass_candidates") <= 1) | ~is_rep | ~covered).drop("__explained")


def suppress_collapse(explained: DataFrame) -> DataFrame:
    """Of the remaining signatures keep the most frequent per workload
    list (ties: smaller fingerprint)."""
    is_rep = F.col("category") == REPEATED_ERROR_SIGNATURE
    key = F.when(is_rep, F.array_join("affected_workloads", ",")).otherwise(F.col("fingerprint"))
    wk = Window.partitionBy("namespace", "pass_ts", "__key").orderBy(
        F.coalesce(F.col("occurrences"), F.lit(0)).desc(), F.col("fingerprint")
    )
    c = explained.withColumn("__key", key).withColumn("__top", F.row_number().over(wk))
    return c.filter((F.col("pass_candidates") <= 1) | ~is_rep | (F.col("__top") == 1)).drop("__key", "__top")


def suppress_order(collapsed: DataFrame) -> DataFrame:
    """Queue order per pass - severity desc, then category precedence
    (unknown first), then fingerprint."""
    ordered = Window.partitionBy("namespace", "pass_ts").orderBy(
        F.col("severity_rank").desc(), precedence_index("category"), F.col("fingerprint")
    )
    return collapsed.withColumn("queue_rank", F.row_number().over(ordered)).drop("pass_candidates")


def suppress(candidates: DataFrame) -> DataFrame:
    """D9-D11 in sequence. Every step is a window over the same
    (namespace, pass) partitioning, so the plan has a single exchange."""
    return suppress_order(suppress_collapse(suppress_explained(candidates)))
