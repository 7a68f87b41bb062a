"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 in the order of the MD5 of their columns, the numbers
are permuted by a keyed Feistel network, and the place p a row comes to is slot
``p div shards`` of shard ``p % shards``. So shards differ by one row at most
(the law ``rows``), and shard and slot of any number, or the number at any
shard and slot, follow from the row count and the seed alone (``locate``,
``row_at``): no table of places is kept.

The network works on pairs (left, right) below side = ceil(sqrt(rows)); its
domain, side * side, is larger than the rows by at most 2 * side, so a place
beyond them is rare and is sent through the network again until it is one of
them (cycle walking). A walk of ``WALK`` steps suffices for certain up to 2,209 rows
and fails with a chance below 1e-130 beyond; it would end the job, not
give a wrong place.

Numbers are counted in two levels (buckets of the order, slices of buckets),
so no task holds all rows. Rows equal in all columns are interchangeable: they are
counted before the shuffle and dealt in chunks of ``CHUNK`` over the buckets,
so a row that makes up a third of the table is no hot key.

Defined results: null is a value like others, as are empty and very long
texts; each of several equal rows has a place of its own; an empty table gives
an empty table; the columns travel in one struct, so their names meet no
others. Equal texts are not kept in one shard: a permutation spreads rows evenly
whatever they hold, and only the row numbers decide. Columns must be of types
that Spark can group by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored

ROUNDS = 6
WALK = 96
CHUNK = 4096          # copies of one row that are dealt together
BUCKET_ROWS = 65_536  # rows numbered together, on average
SLICE = 1024          # buckets of a slice


def _side(rows: int) -> int:
    return math.isqrt(max(rows, 1) - 1) + 1


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _round_value(seed: int, k: Column, half: Column) -> Column:
    """The round function: 32 bits of the MD5 of ``seed|round|half``."""
    text = F.concat_ws("|", F.lit(str(seed)), k.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _feistel(x: Column, side: int, seed: int, inverse: bool) -> Column:
    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def one(s: Column, k: Column) -> Column:
        if inverse:
            return F.struct(F.pmod(s["r"] - _round_value(seed, k, s["l"]), F.lit(side)).alias("l"), s["l"].alias("r"))
        return F.struct(s["r"].alias("l"), ((s["l"] + _round_value(seed, k, s["r"])) % side).alias("r"))

    start = F.struct(_div(x, side).alias("l"), (x % side).alias("r"))
    return F.aggregate(F.array(*map(F.lit, rounds)), start, one, lambda s: s["l"] * side + s["r"])


def permuted(number: Column, rows: int, seed: int = 1, inverse: bool = False) -> Column:
    """The place of a row number below ``rows`` (``inverse``: the number at a place)."""
    side = _side(rows)
    number = number.cast("long")
    steps = F.sequence(F.lit(1), F.lit(WALK))

    def walked(x: Column) -> Column:
        end = F.aggregate(steps, x, lambda y, _: F.when(y < rows, y).otherwise(_feistel(y, side, seed, inverse)))
        return F.when(x < rows, x).otherwise(end)

    # an array of one element names the first place, so that it is computed once
    place = F.get(F.transform(F.array(_feistel(number, side, seed, inverse)), walked), 0)
    return F.get(F.transform(F.array(place), lambda p: F.when(p < rows, p).otherwise(
        F.raise_error(F.lit("the walk did not end")).cast("long"))), 0)


def locate(number: Column, rows: int, shards: int, seed: int = 1) -> Column:
    """struct(shard int, slot long) of a row number."""
    place = permuted(number, rows, seed)
    return F.get(F.transform(F.array(place), lambda p: F.struct((p % shards).cast("int").alias("shard"), _div(p, shards).alias("slot"))), 0)


def row_at(shard: Column, slot: Column, rows: int, shards: int, seed: int = 1) -> Column:
    """The row number that ``locate`` puts there."""
    return permuted(slot.cast("long") * shards + shard.cast("long"), rows, seed, inverse=True)


def number_rows(rows: DataFrame) -> tuple[DataFrame, int]:
    """(row struct, row_number long) in the order of the rows' MD5, and the number of rows."""
    names = [F.col(f"`{c.replace('`', '``')}`") for c in rows.columns]
    identity = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("~")) for c in names))
    same = rows.select(F.struct(*names).alias("row"), F.md5(identity).alias("same")).groupBy("same", "row").agg(F.count("*").alias("copies"))
    dealt = same.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("copies") - 1, CHUNK))))
    dealt = dealt.withColumn("copies", F.least(F.lit(CHUNK), F.col("copies") - F.col("chunk") * CHUNK)).withColumn(
        "place", F.md5(F.concat_ws("|", "same", F.col("chunk").cast("string"))))
    dealt = stored(dealt.select("row", "copies", "place", F.xxhash64("row").alias("tie")), "rows")
    total, chunks = dealt.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()

    buckets = max(1, -(-chunks // BUCKET_ROWS))
    upper = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    dealt = dealt.withColumn("bucket", F.shiftright(upper * F.lit(buckets), 32))
    per = dealt.groupBy("bucket").agg(F.sum("copies").alias("n")).withColumn("slice", _div(F.col("bucket"), SLICE))
    # one row per SLICE * BUCKET_ROWS rows of the table
    slices = per.groupBy("slice").agg(F.sum("n").alias("n"))
    slices = slices.select("slice", (F.sum("n").over(Window.orderBy("slice")) - F.col("n")).alias("slices_before"))
    inner = Window.partitionBy("slice").orderBy("bucket")
    per = per.withColumn("buckets_before", F.sum("n").over(inner) - F.col("n")).join(slices, "slice")
    per = per.select("bucket", (F.col("slices_before") + F.col("buckets_before")).alias("before"))

    order = Window.partitionBy("bucket").orderBy("place", "tie").rowsBetween(Window.unboundedPreceding, 0)
    first = dealt.withColumn("inside", F.sum("copies").over(order) - F.col("copies")).join(per, "bucket")
    first = first.select("row", "copies", (F.col("before") + F.col("inside")).alias("first"))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return first.select("row", "first", copy.alias("copy")).select("row", (F.col("first") + F.col("copy")).alias("row_number")), int(total)


def assign(rows: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    """(row struct of all columns, row_number long, shard int, slot long): one row per input row."""
    if shards < 1:
        raise ValueError("shards must be positive")
    numbered, total = number_rows(rows)
    return numbered.withColumn("_at", locate(F.col("row_number"), total, shards, seed)).select("row", "row_number", "_at.shard", "_at.slot")


def write_shards(rows: DataFrame, path: str, shards: int = 40, seed: int = 1, file_rows: int = 100_000) -> None:
    """All rows as Parquet, a folder per shard; a file holds consecutive slots in their order."""
    placed = assign(rows, shards, seed).withColumn("_file", _div(F.col("slot"), file_rows))
    spread = placed.repartition("shard", "_file").sortWithinPartitions("shard", "slot")
    spread.drop("_file").write.partitionBy("shard").parquet(path)


def text_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size: UTF-8 bytes of the text and 16, text_crc32): what places need of a document, without its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def oracle_sql(shards: int = 40, seed: int = 1) -> str:
    """The query's rows by one sort of the whole table and a recursion over rounds (DuckDB)."""
    return f"""
WITH RECURSIVE bits AS (  -- CRC-32 of each byte value, by its rule
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY b) AS t FROM range(256) r(b)),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size,
        xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
      FROM documents, bits),
c AS (SELECT *, md5(concat_ws('|', coalesce(doc_id::VARCHAR, '~'), size, text_crc32)) AS same,
        (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // {CHUNK} AS chunk FROM d),
o AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY md5(concat_ws('|', same, chunk))) - 1 AS number FROM c),
z AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS side FROM o),
w(number, l, r, k) AS (
  SELECT number, number // side, number % side, 0 FROM o, z
  UNION ALL
  SELECT number, r, (l + ('0x' || substr(md5(concat_ws('|', '{seed}', k % {ROUNDS}, r)), 1, 8))::BIGINT) % side, k + 1
  FROM w, z WHERE k = 0 OR k % {ROUNDS} <> 0 OR l * side + r >= n)
SELECT doc_id, size, text_crc32, 'rows' AS law, ((l * side + r) % {shards})::INTEGER AS shard, (l * side + r) // {shards} AS slot,
       NULL::INTEGER AS grown_shard
FROM o JOIN w USING (number), z WHERE k > 0 AND k % {ROUNDS} = 0 AND l * side + r < n"""
