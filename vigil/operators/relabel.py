"""Label relabelling rules and the label-cardinality audit for metric series.

A rule list is compiled into Column expressions over a ``map<string,string>``
of labels (no UDF): ``keep`` / ``drop`` filter series whose joined source
labels fully match a regex; ``replace`` writes a target label from the joined
source labels (only when the regex matches); ``labelmap`` copies labels whose
name matches to a new name, over a label that has it, and keeps them; ``labeldrop`` / ``labelkeep`` remove label names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    action: str
    source: list[str] = field(default_factory=list)
    regex: str = "(.*)"
    target: str | None = None
    replacement: str = "$1"
    separator: str = ";"


def _joined(labels: Column, rule: Rule) -> Column:
    return F.concat_ws(rule.separator, *[F.coalesce(labels[s], F.lit("")) for s in rule.source])


def apply(df: DataFrame, col: str, rules: list[Rule]) -> DataFrame:
    out = df
    for r in rules:
        labels = F.col(col)
        anchored = f"^(?:{r.regex})$"
        if r.action in ("keep", "drop"):
            m = _joined(labels, r).rlike(anchored)
            out = out.filter(m if r.action == "keep" else ~m)
        elif r.action == "replace":
            src = _joined(labels, r)
            new = F.regexp_replace(src, anchored, r.replacement)
            out = out.withColumn(col, F.when(src.rlike(anchored), F.map_concat(
                F.map_filter(labels, lambda k, v: k != F.lit(r.target)), F.create_map(F.lit(r.target), new))).otherwise(labels))
        elif r.action == "labelmap":
            hit = F.array_sort(F.map_entries(F.map_filter(labels, lambda k, v: k.rlike(anchored))))
            new = F.transform(hit, lambda e: F.struct(F.regexp_replace(e["key"], anchored, r.replacement).alias("key"), e["value"].alias("value")))
            out = out.withColumn("__new", new)
            # of several labels that get one name, the last in label order stays
            last = F.filter("__new", lambda e, i: ~F.exists(F.slice("__new", i + 2, F.size("__new")), lambda x: x["key"] == e["key"]))
            names = F.transform("__new", lambda e: e["key"])
            out = out.withColumn(col, F.map_concat(F.map_filter(labels, lambda k, v: ~F.array_contains(names, k)),
                                                   F.map_from_entries(last))).drop("__new")
        elif r.action == "labeldrop":
            out = out.withColumn(col, F.map_filter(labels, lambda k, v: ~k.rlike(anchored)))
        elif r.action == "labelkeep":
            out = out.withColumn(col, F.map_filter(labels, lambda k, v: k.rlike(anchored)))
        else:
            raise ValueError(f"unknown relabel action {r.action!r}")
    return out


def cardinality_audit(series: DataFrame, required: list[str], forbidden: list[str], col: str = "labels",
                      expected: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per label name in use or required: distinct values, flags, the
    ``expected`` values that do not occur, and a verdict (missing, forbidden,
    incomplete, ok). Forbidden names are compared in lower case. Exact
    distinct counts (partial aggregation per label name and value first)."""
    spark = series.sparkSession
    kv = series.select(F.explode(F.col(col)).alias("label", "v")).distinct()
    wanted = [(k, v) for k, vs in (expected or {}).items() for v in vs]
    wanted = spark.createDataFrame(wanted, "label string, v string")  # given by the caller
    absent = wanted.join(kv, ["label", "v"], "left_anti").groupBy("label").agg(
        F.array_join(F.array_sort(F.collect_set("v")), ",").alias("missing_values"))
    counted = kv.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(x,) for x in required], "label string")
    every = counted.join(names, "label", "full").join(absent, "label", "left")
    is_required = F.col("label").isin(*required)
    is_forbidden = F.lower("label").isin(*[x.lower() for x in forbidden])
    lacking = F.coalesce("missing_values", F.lit(""))
    return every.select(
        "label", F.coalesce("n", F.lit(0)).alias("distinct_values"), is_required.alias("required"), is_forbidden.alias("forbidden"),
        lacking.alias("missing_values"),
        F.when(F.col("n").isNull(), "missing").when(is_forbidden, "forbidden").when(lacking != "", "incomplete").otherwise("ok").alias("verdict"))
