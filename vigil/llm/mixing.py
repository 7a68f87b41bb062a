"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised.
The exponent (1: as found, 0: all sources alike, above 1: large sources favoured) is
bisected until the weights have a target entropy, or until no source is
repeated more than a limit. Each
job evaluates all midpoints of several bisection steps at once, as sums over
the table of sources, so that table may be of any length.

The weights are realised as budgets of tokens. Documents are dealt into
blocks; a source's whole epochs take all of its blocks, and its last epoch
takes blocks in the order of that epoch's permutation until the budget is
spent, the block in which it ends by documents. Positions in a permutation
and running token sums are taken in two levels (slices of the order, then
blocks in a slice), so no task holds all blocks of a large source.

Tokens are words between ASCII blanks. Order keys are MD5 digests, so the
result does not depend on how rows are spread over tasks.

Defined results: a null text has no tokens and follows its block; a null
source is a source of its own; a source without tokens has weight 0 and its
documents appear once if every document is to be covered, else not at all;
repeated rows are dealt like others; an empty table gives an empty table;
other columns are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import BLANK, quoted, stored, unused

STEPS = 6    # bisection steps evaluated per job
ROUNDS = 5   # jobs: the exponent is found to 2 ** -30
SLICES = 256
STEEPEST = 1024  # the largest exponent tried


@dataclass(frozen=True)
class Target:
    """``entropy``: share (0 to 1) of the entropy of equal weights; ``repetition``: most epochs of any source.

    The entropy is met from above: the exponent is the largest (to 2 ** -30 of its bracket) whose weights have that much or
    more, up to ``STEEPEST``; sources that are all alike are left as found. ``budget``:
    tokens to realise, as a multiple of all tokens; None: as many as it takes
    for every source to have at least one whole epoch.
    """

    entropy: float | None = None
    repetition: float | None = None
    budget: float | None = 1.0


def document_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def _unit(*parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 that MD5 gives to the parts."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def find_exponent(sources: DataFrame, target: Target) -> float:
    """Bisect the exponent over (source, tokens > 0)."""
    if (target.entropy is None) == (target.repetition is None):
        raise ValueError("give either a target entropy or a repetition limit")
    total, n, largest = sources.agg(F.sum("tokens"), F.count("*"), F.max("tokens")).first()
    if not n or n == 1:
        return 1.0

    def met(points: list[float]) -> list[bool]:
        share = F.col("tokens") / F.lit(float(largest))  # of the largest source, so that no power of all of them vanishes
        weight = F.pow(share, F.col("a"))
        epochs = weight / share  # up to a factor common to all sources
        sums = sources.withColumn("a", F.explode(F.array(*map(F.lit, points)))).groupBy("a").agg(
            F.sum(weight).alias("z"), F.sum(weight * F.log(share)).alias("l"), F.max(epochs).alias("high"), F.min(epochs).alias("low"))
        if target.entropy is not None:
            ok = F.log("z") - F.col("a") * F.col("l") / F.col("z") >= F.lit(target.entropy) * F.log(F.lit(float(n)))
        elif target.budget is None:
            ok = F.col("high") / F.col("low") <= target.repetition
        else:
            ok = F.col("high") / F.col("z") * F.lit(float(total) / float(largest)) * target.budget <= target.repetition
        found = {r["a"]: r["ok"] for r in sums.select("a", ok.alias("ok")).collect()}  # one row per midpoint
        return [found[p] for p in points]

    # more entropy wants a smaller exponent, less repetition a larger one
    if target.entropy is not None:
        points = [0.0, *(float(1 << k) for k in range(STEEPEST.bit_length()))]
        ok = met(points)
        last = max((k for k, good in enumerate(ok) if good), default=0)
        if last == len(points) - 1:
            return 1.0  # alike at every exponent
        return _narrow(met, points[last], points[last + 1], True)
    ends = met([0.0, 1.0])
    if ends[1]:
        return 0.0 if ends[0] else _narrow(met, 0.0, 1.0, False)
    return 1.0


def _narrow(met, low: float, high: float, wants_small: bool) -> float:
    for _ in range(ROUNDS):
        cells = 1 << STEPS
        points = [low + (high - low) * i / cells for i in range(1, cells)]
        ok = met(points)
        inner = [low, *points, high]
        if wants_small:  # the last point that meets the target
            i = max((k for k, good in enumerate(ok, 1) if good), default=0)
        else:  # the last point that does not
            i = max((k for k, good in enumerate(ok, 1) if not good), default=0)
        low, high = inner[i], inner[i + 1]
    return low if wants_small else high


def weights(sources: DataFrame, target: Target) -> DataFrame:
    """(source, tokens, docs) to these and share, weight, budget (tokens), epochs (whole ones), rest (tokens of the last)."""
    live = sources.filter("tokens > 0")
    exponent = find_exponent(live, target)
    total = float(live.agg(F.sum("tokens")).first()[0] or 0)
    share = F.col("tokens") / F.lit(total)
    live = live.withColumn("share", share).withColumn("_w", F.pow("share", F.lit(exponent)))
    z, least = live.agg(F.sum("_w"), F.min(F.col("_w") / F.col("share"))).first()
    weight = F.col("_w") / F.lit(float(z or 1))
    if target.budget is None:  # so that the least repeated source has one epoch
        budget = F.greatest(F.round(F.col("tokens") * (F.col("_w") / F.col("share")) / F.lit(float(least or 1))).cast("long"), F.col("tokens"))
    else:
        budget = F.floor(weight * F.lit(total * target.budget)).cast("long")
    live = live.withColumn("weight", weight).withColumn("budget", budget).drop("_w")
    empty = sources.filter("tokens = 0").withColumn("share", F.lit(0.0)).withColumn("weight", F.lit(0.0)).withColumn(
        "budget", F.lit(0).cast("long"))
    every = live.unionByName(empty)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(
        1 if target.budget is None else 0).cast("int")
    return every.withColumn("epochs", epochs).withColumn(
        "rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0).cast("long"))


def mix(docs: DataFrame, target: Target, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        block_docs: int = 256, seed: int = 1) -> DataFrame:
    """A row per document and epoch it is taken in: all columns, and _tokens, _epoch, _block, _block_rank (place of the
    block in the epoch's permutation of its source, from 0; the names get underscores behind them while the documents have
    such columns)."""
    id_c, source_c, text_c = (F.col(quoted(c)) for c in (id_col, source_col, text_col))
    # the id may repeat or be missing, so the text takes part in where a document goes
    facts = [id_c.alias("id"), source_c.alias("source"), document_tokens(text_c).alias("tokens"), F.xxhash64(text_c).alias("text_hash"),
             _unit(F.lit(seed), F.lit("block"), id_c, F.md5(text_c)).alias("deal")]
    sized = stored(docs.select(*facts), "sizes")
    sources = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = stored(weights(sources, target).withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("long")), "weights")
    plan = plan.select(F.col("source").alias("_source"), "epochs", "rest", "blocks")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_block", F.col("deal") % F.col("blocks"))

    per_block = dealt(sized).groupBy("_source", "_block").agg(
        F.sum("tokens").alias("tokens"), F.max("epochs").alias("epochs"), F.max("rest").alias("rest"))
    # every block in every epoch it can be in, in the order of that epoch
    orders = per_block.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    orders = orders.withColumn("place", _unit(F.lit(seed), F.lit("epoch"), F.col("_source"), F.col("_epoch"), F.col("_block")))
    orders = stored(orders.withColumn("slice", F.floor(F.col("place") / (2**32 // SLICES)).cast("int")), "orders")
    epoch = ["_source", "_epoch"]
    slices = orders.groupBy(*epoch, "slice").agg(F.sum("tokens").alias("slice_tokens"), F.count("*").alias("slice_blocks"))
    before = Window.partitionBy(*epoch).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*epoch, "slice", F.coalesce(F.sum("slice_tokens").over(before), F.lit(0)).alias("tokens_before"),
                           F.coalesce(F.sum("slice_blocks").over(before), F.lit(0)).alias("blocks_before"))
    inside = Window.partitionBy(*epoch, "slice").orderBy("place", "_block")
    ranked = orders.join(slices.withColumnRenamed("_source", "_s").withColumnRenamed("_epoch", "_e").withColumnRenamed("slice", "_i"),
                         F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_epoch") == F.col("_e")) & (F.col("slice") == F.col("_i")))
    ranked = ranked.withColumn("_block_rank", F.col("blocks_before") + F.row_number().over(inside) - 1).withColumn(
        "spent", F.col("tokens_before") + F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # left: tokens of the last epoch's budget that the block may use; null: all of the block is taken
    last = F.col("_epoch") == F.col("epochs")
    ranked = ranked.withColumn("left", F.when(last & (F.col("spent") + F.col("tokens") > F.col("rest")), F.col("rest") - F.col("spent")))
    ranked = stored(ranked.filter("left IS NULL AND (_epoch < epochs OR rest > 0) OR left > 0").select(
        "_source", "_epoch", "_block", "_block_rank", "left"), "permutations")

    # the block in which a budget ends is spent document by document
    ending = dealt(sized).select("id", "source", "tokens", "text_hash", "_block").join(
        ranked.filter("left IS NOT NULL").withColumnRenamed("_block", "_b"),
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_b")))
    spending = Window.partitionBy("_source", "_b").orderBy("place", "id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    ending = ending.withColumn("place", _unit(F.lit(seed), F.lit("document"), F.col("id"))).withColumn(
        "spent", F.sum("tokens").over(spending)).filter("spent <= left")
    # equal rows are alike: so many of each are taken
    ending = ending.groupBy("_source", "_epoch", "_b", "_block_rank", "id", "text_hash").agg(F.count("*").alias("taken"))

    # a document's own columns travel as one struct, so their names meet no others
    rows = dealt(docs.select(F.struct("*").alias("doc"), *facts)).select("doc", "id", "source", "tokens", "text_hash", "_block")
    whole = ranked.filter("left IS NULL").groupBy("_source", "_block").agg(
        F.sort_array(F.collect_list(F.struct("_epoch", "_block_rank"))).alias("taken")).withColumnRenamed("_block", "_b")
    in_whole = rows.join(whole, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_b")))
    in_whole = in_whole.select("doc", "tokens", "_block", F.explode("taken").alias("t")).select(
        "doc", "tokens", "t._epoch", "_block", "t._block_rank")
    ending = ending.select("_source", "_epoch", "_b", "_block_rank", "taken", F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
    in_last = rows.join(ending, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_b"))
                        & F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    in_last = in_last.withColumn("copy", F.row_number().over(
        Window.partitionBy("_source", "_b", "_id", "_hash").orderBy("_hash"))).filter("copy <= taken")
    taken = in_whole.unionByName(in_last.select("doc", "tokens", "_epoch", "_block", "_block_rank"))
    added = {"_tokens": "tokens", "_epoch": "_epoch", "_block": "_block", "_block_rank": "_block_rank"}
    return taken.select(*(F.col("doc")[c].alias(c) for c in docs.columns), *(F.col(c).alias(unused(name, docs)) for name, c in added.items()))


def oracle_sql(entropy: float, budget: float = 1.0, block_docs: int = 256, seed: int = 1) -> str:
    """The same rows for a target entropy, bisecting step by step and with plain running sums (DuckDB)."""
    unit = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
    block = unit.format(f"'{seed}|block|' || t.doc_id || '|' || t.digest")
    place = unit.format(f"'{seed}|epoch|' || source || '|' || epoch || '|' || block")
    doc_place = unit.format(f"'{seed}|document|' || doc_id")
    z = "list_sum(list_transform(ps, lambda p: pow(p, {a})))"
    h = f"(ln({z}) - {{a}} * list_sum(list_transform(ps, lambda p: pow(p, {{a}}) * ln(p))) / {z}) >= {entropy} * ln(len(ps))"
    at_mid = h.format(a="((low + high) / 2)")
    at_points = " UNION ALL ".join(f"SELECT {a}::DOUBLE AS a, {h.format(a=f'{a}::DOUBLE')} AS ok FROM ps"
                                   for a in [0.0, *(float(1 << k) for k in range(STEEPEST.bit_length()))])
    return f"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, coalesce(md5(text), '~') AS digest, coalesce(len(regexp_extract_all(text, '[^{BLANK}]+')), 0)::BIGINT AS tokens FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS docs FROM t GROUP BY source),
al AS (SELECT sum(tokens)::DOUBLE AS total FROM s),
ps AS (SELECT list(tokens / largest) AS ps FROM s, (SELECT max(tokens)::DOUBLE AS largest FROM s) WHERE tokens > 0),
pt AS ({at_points}),
br AS (SELECT coalesce(max(a) FILTER (WHERE ok), 0.0) AS low FROM pt),
e(step, low, high, ps) AS (
  SELECT 0, low, CASE WHEN low = 0 THEN 1.0::DOUBLE ELSE 2 * low END, ps FROM ps, br
  UNION ALL
  SELECT step + 1, CASE WHEN {at_mid} THEN (low + high) / 2 ELSE low END,
         CASE WHEN {at_mid} THEN high ELSE (low + high) / 2 END, ps FROM e WHERE step < {STEPS * ROUNDS}),
a AS (SELECT CASE WHEN len(ps) < 2 OR low >= {STEEPEST} THEN 1.0 ELSE low END AS a FROM e WHERE step = {STEPS * ROUNDS}),
w AS (SELECT source, tokens, docs, pow(tokens / total, a) AS w FROM s, al, a WHERE tokens > 0),
b AS (SELECT source, tokens, ceil(docs / {block_docs}.0)::BIGINT AS blocks,
             floor(w / (SELECT sum(w) FROM w) * (SELECT total FROM al) * {budget})::BIGINT AS budget FROM w),
p AS (SELECT source, blocks, (budget // tokens)::BIGINT AS epochs, budget - (budget // tokens) * tokens AS rest FROM b),
d AS (SELECT t.doc_id, t.source, t.tokens, {block} % p.blocks AS block, p.epochs, p.rest FROM t JOIN p ON t.source = p.source),
k AS (SELECT source, block, sum(tokens) AS tokens, max(epochs) AS epochs, max(rest) AS rest FROM d GROUP BY source, block),
o AS (SELECT *, {place} AS place FROM (SELECT *, unnest(range(0, epochs + 1)) AS epoch FROM k)),
r AS (SELECT *, row_number() OVER q - 1 AS block_rank,
             coalesce(sum(tokens) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
      FROM o WINDOW q AS (PARTITION BY source, epoch ORDER BY place, block)),
f AS (SELECT source, epoch, block, block_rank,
             CASE WHEN epoch = epochs AND spent + tokens > rest THEN rest - spent END AS remain, rest, epochs FROM r),
u AS (SELECT d.doc_id, d.source, d.tokens, f.epoch, f.block, f.block_rank, f.remain,
             sum(d.tokens) OVER (PARTITION BY d.source, f.epoch, f.block ORDER BY {doc_place.replace('doc_id', 'd.doc_id')}, d.doc_id) AS used
      FROM f JOIN d ON d.source = f.source AND d.block = f.block
      WHERE (f.remain IS NULL AND (f.epoch < f.epochs OR f.rest > 0)) OR f.remain > 0)
SELECT doc_id, source, tokens, epoch::INTEGER AS epoch, block, block_rank::BIGINT AS block_rank
FROM u WHERE remain IS NULL OR used <= remain"""
