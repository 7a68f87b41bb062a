"""Grounding: agent claims are checked against the evidence ids that exist.

A hypothesis keeps only the cited ids that exist (citation order and
duplicates kept); ids that do not exist are "invented" (distinct, in order of
first citation); a hypothesis with no real citation is rejected. Accepted
hypotheses are ranked by clamped confidence. Reports keep their real
citations and may end up citing nothing (then a problem is recorded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.operators.detect import SEVERITIES, severity_rank
from vigil.operators.detect import fixed_double


def _shorten(col: Column, n: int = 60) -> Column:
    return F.when(F.length(col) <= n, col).otherwise(F.concat(F.substring(col, 1, n), F.lit("...")))


def check_citations(claims: DataFrame, evidence: DataFrame, key: str, scope: str | None = "incident_id",
                    ids: str = "evidence_ids") -> DataFrame:
    """Claims with real_ids, invented_ids (distinct) and cited_count, in citation order.

    The ids that exist in a claim's scope meet its citations in one join. An
    incident's evidence is trimmed before it is shown, so its set of ids is
    small. Without a scope (cluster reports, which may cite whatever they were
    given) the evidence is unbounded: each cited id is looked up on its own.
    """
    cited = F.filter(F.coalesce(F.col(ids), F.array().cast("array<string>")), lambda x: x.isNotNull())
    if scope is None:
        known = evidence.select(F.col("evidence_id").alias("__id")).distinct()
        hit = claims.select(F.col(key).alias("__key"), F.explode(F.array_distinct(cited)).alias("__id")).join(known, "__id")
        have = hit.groupBy("__key").agg(F.collect_set("__id").alias("__known"))
        j = claims.join(have, F.col(key) == F.col("__key"), "left")
    else:
        have = evidence.groupBy(F.col(scope).alias("__key")).agg(F.collect_set("evidence_id").alias("__known"))
        j = claims.join(have, F.col(scope) == F.col("__key"), "left")
    known = F.coalesce("__known", F.array().cast("array<string>"))
    return j.withColumns({
        "real_ids": F.filter(cited, lambda x: F.array_contains(known, x)),
        "invented_ids": F.array_distinct(F.filter(cited, lambda x: ~F.array_contains(known, x))),
        "cited_count": F.size(cited).cast("bigint"),
    }).drop("__key", "__known")


def ground_hypotheses(hyps: DataFrame, evidence: DataFrame) -> DataFrame:
    """hyps: (hypothesis_id, investigation_id, incident_id, position, statement,
    confidence, evidence_ids, ...). Adds real/invented ids, ``rejected`` and the
    problem messages."""
    h = check_citations(hyps, evidence, "hypothesis_id")
    short = _shorten(F.col("statement"))
    invented_msg = F.when(
        F.size("invented_ids") > 0,
        F.concat(F.lit("hypothesis '"), short, F.lit("' cited "), F.size("invented_ids").cast("string"),
                 F.lit(" evidence id(s) that do not exist: "), F.array_join(F.slice("invented_ids", 1, 3), ", ")),
    )
    rejected_msg = F.when(
        F.size("real_ids") == 0, F.concat(F.lit("hypothesis '"), short, F.lit("' was rejected because no cited evidence exists"))
    )
    return h.withColumn("rejected", F.size("real_ids") == 0).withColumn(
        "problems", F.array_compact(F.array(invented_msg, rejected_msg))
    )


def clamp01(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def rank_accepted(grounded: DataFrame) -> DataFrame:
    """Accepted hypotheses per investigation, clamped confidence, rank 1.. by
    confidence desc (ties keep citation position order)."""
    acc = grounded.filter(~F.col("rejected")).withColumn("confidence", clamp01(F.when(F.isnan("confidence"), 0.0).otherwise(F.col("confidence"))))
    w = Window.partitionBy("investigation_id").orderBy(F.col("confidence").desc(), F.col("position"))
    return acc.withColumn("rank", F.row_number().over(w))


def conclusive(grounded: DataFrame, results: DataFrame) -> DataFrame:
    """results: (investigation_id, conclusive). Conclusive only with >=1 accepted."""
    acc = grounded.groupBy("investigation_id").agg(F.sum((~F.col("rejected")).cast("int")).alias("accepted"))
    j = results.join(acc, "investigation_id", "left")
    return j.select(
        "investigation_id",
        (F.col("conclusive") & (F.coalesce("accepted", F.lit(0)) > 0)).alias("conclusive"),
        F.coalesce("accepted", F.lit(0)).cast("bigint").alias("accepted"),
    )


def ground_report(reports: DataFrame, evidence: DataFrame, cluster: bool = False) -> DataFrame:
    """Reports with their real citations and problems. A cluster report belongs
    to no incident: ``evidence`` is what cluster reports were given."""
    r = check_citations(reports, evidence, "report_id", None if cluster else "incident_id")
    if cluster:
        dropped = F.col("cited_count") - F.size("real_ids")
        problems = F.array_compact(F.array(F.when(
            dropped > 0, F.concat(F.lit("cluster report cited "), dropped.cast("string"), F.lit(" evidence id(s) that do not exist")))))
    else:
        problems = F.array_compact(F.array(
            F.when(F.size("invented_ids") > 0, F.concat(F.lit("report cited "), F.size("invented_ids").cast("string"),
                                                         F.lit(" evidence id(s) that do not exist"))),
            F.when(F.size("real_ids") == 0, F.lit("report cites no real evidence")),
        ))
    return r.withColumn("problems", problems)


def triage_floor(proposed, detected) -> tuple[Column, Column]:
    """(effective severity, problem) — unknown names keep the detected
    severity; triage may raise but never lower it (names compared
    case-insensitively)."""
    p = F.col(proposed) if isinstance(proposed, str) else proposed
    d = F.col(detected) if isinstance(detected, str) else detected
    canon = F.array(*[F.lit(s) for s in SEVERITIES])
    # names case-insensitively, surrounding blanks ignored; the numeric values 0-3 also parse
    pt = F.lower(F.trim(F.coalesce(p, F.lit(""))))
    p_rank = F.when(pt.rlike("^[0-3]$"), pt.cast("int")).otherwise(
        F.array_position(F.transform(canon, lambda s: F.lower(s)), pt) - 1)
    known = p_rank >= 0
    d_rank = severity_rank(d)
    eff_rank = F.when(known, F.greatest(p_rank, d_rank)).otherwise(d_rank)
    eff = F.element_at(canon, (eff_rank + 1).cast("int"))
    p_name = F.element_at(canon, (F.greatest(p_rank, F.lit(0)) + 1).cast("int"))
    problem = F.when(~known, F.concat(F.lit("triage returned an unknown severity '"), F.coalesce(p, F.lit("")),
                                      F.lit("'; the detected severity is kept"))).when(
        p_rank < d_rank,
        F.concat(F.lit("triage proposed "), p_name, F.lit(" but detection measured "), d,
                 F.lit("; the higher severity is kept")),
    )
    return eff, problem


def final_state(inv: DataFrame) -> DataFrame:
    """Terminal state from stage flags: recovered, triage result present,
    actionable, investigation result present, conclusive (after grounding),
    hypotheses accepted, report present."""
    st = (
        F.when(F.col("recovered"), "Recovered")
        .when(~F.col("triage_ok"), "Failed")
        .when(~F.col("actionable"), "Ignored")
        .when(~F.col("investigation_ok"), "Failed")
        .when(~F.col("conclusive"), "Inconclusive")
        .when(~F.col("report_ok"), "Failed")
        .otherwise("Reported")
    )
    reason = (
        F.when(F.col("recovered"), F.lit("the incident recovered before the investigation started"))
        .when(~F.col("triage_ok"), F.lit("the investigation ended without reaching a conclusion, most likely because an agent call failed"))
        .when(~F.col("actionable"), F.lit("triage judged the incident not actionable"))
        .when(~F.col("investigation_ok"), F.lit("the investigation agent returned no result"))
        .when(~F.col("conclusive") & (F.col("accepted") == 0), F.lit("no hypothesis was supported by collected evidence"))
        .when(~F.col("conclusive"), F.lit("the evidence did not distinguish between possible causes"))
        .when(~F.col("report_ok"), F.lit("the report agent did not return a usable result"))
    )
    return inv.withColumn("final_state", st).withColumn("terminal_outcome", reason)


def findings_text(ranked: DataFrame) -> DataFrame:
    """Numbered lines per investigation: ``n. [p %] statement (category: c,
    suspected workload: w, evidence: ids)``."""
    pct = fixed_double(F.col("confidence") * 100, 0)
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". ["), pct, F.lit(" %] "), F.col("statement"), F.lit(" (category: "),
        F.coalesce("root_cause_category", F.lit("")), F.lit(", suspected workload: "), F.coalesce("suspected_workload", F.lit("")),
        F.lit(", evidence: "), F.array_join("real_ids", ", "), F.lit(")"),
    )
    return ranked.groupBy("investigation_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("findings")
    )
