"""Evaluation against gold data: retrieval gold cases, report scoring,
scenario signal checks. Everything is a join with the gold table plus
Column predicates; no result is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words ignored when comparing categories, and the phrases that
# blame a workload for a failure.
NOISE_WORDS = ["the", "a", "of", "and", "is", "was"]
BLAME_PHRASES = ["root cause is {v}", "root cause is the {v}", "caused by {v}", "{v} is the root cause"]
INVENTED_POD_FAILURE = ["crashloop", "oomkill", "pod crash", "restarted repeatedly"]


def retrieval_eval(results: DataFrame, gold: DataFrame) -> DataFrame:
    """results: (query_id, rank, source_ref); gold: (query_id,
    expected_source_prefix, must_not_rank_first). Per case: hit rank, whether
    the confusable ranked first, and pass."""
    j = gold.join(results, "query_id", "left")
    agg = j.groupBy("query_id", "expected_source_prefix", "must_not_rank_first").agg(
        F.min(F.when(F.col("source_ref").startswith(F.col("expected_source_prefix")), F.col("rank"))).alias("hit_rank"),
        F.max(F.when((F.col("rank") == 1) & F.col("must_not_rank_first").isNotNull()
                     & F.col("source_ref").startswith(F.col("must_not_rank_first")), 1).otherwise(0)).alias("__wrong"),
        F.count("rank").alias("returned"),
    )
    return agg.select(
        "query_id", "hit_rank", (F.col("__wrong") == 1).alias("wrong_first"),
        ((F.col("returned") > 0) & F.col("hit_rank").isNotNull() & (F.col("__wrong") == 0)).alias("passed"),
    )


def category_words(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.split(F.replace(F.lower(F.coalesce(col, F.lit(""))), F.lit("-"), F.lit("_")), "_"))


def category_overlap(reported, expected) -> Column:
    common = F.array_except(F.array_intersect(category_words(reported), category_words(expected)),
                            F.array(*[F.lit(w) for w in NOISE_WORDS]))
    return F.size(common) > 0


def blames_victim(text, victims) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    v = F.col(victims) if isinstance(victims, str) else victims

    return F.exists(v, lambda x: F.exists(
        F.array(*[F.concat(F.lit(p.split("{v}")[0]), x, F.lit(p.split("{v}")[1])) for p in BLAME_PHRASES]),
        lambda ph: t.contains(ph)))


def report_score(reports: DataFrame, expected: DataFrame, resolved: DataFrame) -> DataFrame:
    """reports: (report_id, scenario, title, summary, impact, likely_root_cause,
    root_cause_category, cited); expected: (scenario, root_cause_workload,
    root_cause_category, victims, expect_disruption); resolved: (report_id, resolved)."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ["title", "summary", "impact", "likely_root_cause"]]))
    r = reports.withColumn("__text", text).join(
        expected.withColumnRenamed("root_cause_category", "expected_category"), "scenario"
    ).join(resolved, "report_id", "left")
    names = F.col("__text").contains(F.lower("root_cause_workload"))
    cat = category_overlap("root_cause_category", "expected_category")
    victim = ~blames_victim("__text", "victims")
    cites = (F.col("cited") > 0) & (F.col("cited") == F.coalesce("resolved", F.lit(0)))
    invented = F.exists(F.array(*[F.lit(w) for w in INVENTED_POD_FAILURE]), lambda w: F.col("__text").contains(w))
    no_invented = F.when(F.col("expect_disruption"), F.lit(None).cast("boolean")).otherwise(~invented)
    return r.select(
        "report_id", "scenario", names.alias("names_culprit"), cat.alias("category_matches"), victim.alias("no_victim_blamed"),
        cites.alias("citations_resolve"), no_invented.alias("no_invented_pod_failure"),
        (names & cat & victim & cites & F.coalesce(no_invented, F.lit(True))).alias("passed"),
    )


def scenario_signal(observed: DataFrame, scenarios: DataFrame, lines: DataFrame, candidates: list[str]) -> DataFrame:
    """observed: (scenario, condition) rows; scenarios: (scenario,
    expected_conditions, expected_log_substrings, expect_disruption);
    lines: (scenario, line). A line only contributes which of the (small,
    fixed) candidate substrings it contains, so no group ever holds the lines."""
    low = F.lower(F.col("line"))
    hits = lines.select("scenario", F.explode(F.filter(F.array(*[F.lit(c) for c in candidates]),
                                                       lambda c: low.contains(F.lower(c)))).alias("hit")).distinct()
    seen_sub = hits.groupBy("scenario").agg(F.collect_set(F.lower("hit")).alias("found"))
    seen_cond = observed.groupBy("scenario").agg(F.collect_set("condition").alias("conditions"))
    j = scenarios.join(seen_sub, "scenario", "left").join(seen_cond, "scenario", "left")
    cond = F.coalesce("conditions", F.array().cast("array<string>"))
    found = F.coalesce("found", F.array().cast("array<string>"))
    cond_ok = F.when(F.size("expected_conditions") == 0, True).otherwise(F.arrays_overlap("expected_conditions", cond))
    logs_ok = F.forall("expected_log_substrings", lambda s: F.array_contains(found, F.lower(s)))
    disrupted = F.filter(cond, lambda c: c != "NotReady")  # not ready alone is no disruption
    calm_ok = F.col("expect_disruption") | (F.size(disrupted) == 0)
    return j.select("scenario", F.coalesce(cond_ok, F.lit(False)).alias("condition_seen"), logs_ok.alias("log_substrings_seen"),
                    calm_ok.alias("no_unexpected_disruption"), (F.coalesce(cond_ok, F.lit(False)) & logs_ok & calm_ok).alias("passed"))


def pod_reasons(pods: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Per pod snapshot: NotReady / Restarted / waiting / last-termination
    reasons. A pod that the baseline does not know had no restarts then; a
    termination counts if the pod restarted since, or without a baseline."""
    if baseline is None:
        j = pods.withColumn("base_restarts", F.lit(0))
    else:
        j = pods.join(baseline.select("namespace", "pod", F.col("restart_count").alias("base_restarts")), ["namespace", "pod"], "left")
    restarted = F.col("restart_count") > F.coalesce("base_restarts", F.lit(0))
    ended = restarted if baseline is not None else F.lit(True)
    reasons = F.array_compact(F.array(
        F.when(~F.col("ready"), F.lit("NotReady")),
        F.when(restarted, F.lit("Restarted")),
        F.col("waiting_reason"),
        F.when(ended, F.col("last_termination_reason")),
    ))
    return j.select("namespace", "pod", "snapshot_ts", reasons.alias("reasons"))
