"""Cross-site boilerplate lines by distinct-site spread.

A line's spread is the number of distinct sites it stands on. HyperLogLog
sketches, one per line hash, merge by aggregation; lines whose estimate is
clearly above or below the threshold are decided by it, and only lines near
the threshold get an exact distinct count. The boilerplate lines are then
removed from every document but for their first place (smallest id, then line
number), so text that was copied as a whole survives once.

Lines are compared without blanks at their ends, by a 64-bit and a 32-bit
hash. Blank lines are never boilerplate and stay.

A line that stands in a third of all documents is one row per task after
partial aggregation; where its places are joined back, the join is one that
Spark can split.

Defined results: a null text stays null and has no lines; a null site is a
site of its own; rows with equal id and text get equal results, and the first
place of a line may be in several of them; null ids come before others; an
empty table gives an empty table; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import quoted, stored, unused

LOG_K = 10  # sketch size
ERROR = 3 * 1.04 / 2 ** (LOG_K / 2)  # three standard errors of an estimate
BLANKS = " \t\r\x0b\x0c"


def _line_hashes(text: Column) -> Column:
    """(number, h1, h2) of the lines that hold something."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    hashed = F.transform(lines, lambda x, i: F.struct(
        i.alias("line"), F.xxhash64(x).alias("h1"), F.hash(x).alias("h2"), (x == "").alias("blank")))
    return F.filter(hashed, lambda x: ~x["blank"])


def places(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per line that holds something: id, site, text hash, line number and line hashes."""
    id_c, site, text = (F.col(quoted(c)) for c in (id_col, site_col, text_col))
    found = docs.select(id_c.alias("id"), site.alias("site"), F.xxhash64(text).alias("text_hash"), F.explode(_line_hashes(text)).alias("x"))
    return found.select("id", "site", "text_hash", "x.line", "x.h1", "x.h2")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, first): lines on at least ``min_sites`` sites, with their first place."""
    # a null site hashes like any value, so it counts as one site
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(F.lit(1), "site"), F.lit(LOG_K))).alias("estimate"),
        F.min(F.struct("id", "line")).alias("first"))
    spread = stored(spread.filter(F.col("estimate") >= min_sites * (1 - ERROR) - 1), "spread")
    sure = F.col("estimate") > min_sites * (1 + ERROR) + 1
    near = lines.select("h1", "h2", "site").join(spread.filter(~sure).select("h1", "h2"), ["h1", "h2"], "left_semi")
    exact = near.distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return spread.filter(sure).select("h1", "h2", "first").union(
        spread.filter(~sure).join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10) -> DataFrame:
    """The documents with all their columns, the text without boilerplate lines; adds _lines and _removed (line counts;
    the names get underscores behind them while the documents have such columns)."""
    lines = places(docs, id_col, text_col, site_col)
    known = stored(boilerplate(lines, min_sites), "boilerplate")
    gone = lines.join(known, ["h1", "h2"]).filter(
        ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line") == F.col("first.line"))))
    gone = gone.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("gone")).select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "gone")
    # a document's own columns travel as one struct, so their names meet no others
    id_c, text_c = F.col(quoted(id_col)), F.col(quoted(text_col))
    whole = docs.select(F.struct("*").alias("doc"), id_c.alias("id"), text_c.alias("text"), F.xxhash64(text_c).alias("text_hash"))
    met = whole.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    split = F.split("text", "\n", -1)
    # the lines between one that goes and the next, in turn: one pass over the text, however many go
    ends = F.concat("gone", F.array(F.size(split)))
    between = F.transform(ends, lambda end, k: F.slice(split, F.coalesce(F.get("gone", k - 1), F.lit(-1)) + 2,
                                                       end - F.coalesce(F.get("gone", k - 1), F.lit(-1)) - 1))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(between), "\n"))
    return met.select(
        *(text.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias(unused("_lines", docs)),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(unused("_removed", docs)))


def oracle_sql(min_sites: int = 10) -> str:
    return f"""
WITH s AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, source, unnest(parts) AS raw, generate_subscripts(parts, 1) AS n FROM s),
t AS (SELECT doc_id, source, n, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
b AS (SELECT line, min(doc_id * 1000000 + n) AS first FROM t WHERE line <> ''
      GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
k AS (SELECT t.doc_id, t.n, t.raw, b.line IS NOT NULL AND t.doc_id * 1000000 + t.n <> b.first AS gone
      FROM t LEFT JOIN b ON t.line = b.line)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS text,
       count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed
FROM k GROUP BY doc_id"""
