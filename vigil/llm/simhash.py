"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: the majority, bit by bit, over the 64-bit hashes of a text's
word shingles. Two fingerprints link at ``max_bits`` or fewer differing bits.

The 64 bits are cut into a ring of m segments. If two fingerprints differ in
at most k bits, some segment starts a chain in which the differences of the
first l segments sum to at most l*k/m, for every l (the pigeonring principle;
the plain pigeonhole principle is its l = 1). Two uses:

* candidates: such a chain holds e = m - k equal segments in one of a few
  patterns, so fingerprints meet on keys made of a pattern and its segments;
* pruning: among those that meet, only pairs with a full chain within the
  proportional budgets get the Hamming check.

Equal fingerprints are one node, so copies make no pairs. The fingerprints of
one key are linked by a spanning forest, not by all pairs. A key with more
than ``max_run`` fingerprints is cut into blocks, and pairs of blocks are
compared in tasks of their own; nothing is dropped.

Defined results: a null or empty text, or one of blanks, has the fingerprint
zero and links like any other; a text of fewer words than a shingle is one
shingle; repeated rows and ids each get a row; null ids are allowed and never
name a component that has another id; an empty table gives an empty table;
columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import quoted, stored, text_bytes
from vigil.llm.components import components

SEED = 42


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of a UTF-8 text (A-Z lower-cased) as a signed 64-bit number."""
    from xxhash import xxh64_digest

    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    votes = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 1 << 14):
        part = shingles[i:i + (1 << 14)]
        hashes = np.frombuffer(b"".join(map(xxh64_digest, part, repeat(SEED))), np.uint8).reshape(-1, 8)
        votes += np.unpackbits(hashes, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(shingles)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp, text_hash) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t, words) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp, pa.int64())],
                                             names=[id_col, "text_hash", "fp"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()),
                           T.StructField("fp", T.LongType())])
    return docs.select(quoted(id_col), quoted(text_col), F.xxhash64(F.col(quoted(text_col))).alias("text_hash")).mapInArrow(run, schema)


# --- the ring ------------------------------------------------------------------

def ring(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; the first ones take the odd bits."""
    width, odd = divmod(64, segments)
    out, at = [], 0
    for i in range(segments):
        out.append((at, width + (i < odd)))
        at += width + (i < odd)
    return out


def chain_keys(segments: int, max_bits: int) -> list[tuple[int, ...]]:
    """Sets of segments such that any two fingerprints within ``max_bits`` agree on one whole set.

    From each start, the shortest chain that must hold ``segments - max_bits``
    equal segments; a set of that many offsets counts if the segments outside
    it, one bit each at least, fit the budget of every prefix.
    """
    equal = segments - max_bits
    if equal < 1:
        raise ValueError("need more segments than bits")
    budget = [n * max_bits // segments for n in range(segments + 1)]
    length = next(n for n in range(1, segments + 1) if n - budget[n] >= equal)
    sets = set()
    for offsets in combinations(range(length), equal):
        if all(n - sum(o < n for o in offsets) <= budget[n] for n in range(1, length + 1)):
            sets.update(tuple(sorted((s + o) % segments for o in offsets)) for s in range(segments))
    return sorted(sets)


def within(difference: np.ndarray, segments: int, max_bits: int) -> np.ndarray:
    """For XORs of fingerprints: first the chain budgets, then the Hamming distance."""
    difference = difference.view(np.uint64)
    bits = np.stack([np.bitwise_count(difference >> np.uint64(at) & np.uint64((1 << width) - 1))
                     for at, width in ring(segments)]).astype(np.int64)
    good = np.zeros(len(difference), bool)
    for start in range(segments):
        spent = np.cumsum(np.roll(bits, -start, axis=0)[:-1], axis=0)
        limit = np.arange(1, segments)[:, None] * max_bits
        good |= (spent * segments <= limit).all(0)
    at = np.flatnonzero(good)
    return at[np.bitwise_count(difference[at]) <= max_bits]


def forest(left: np.ndarray, right: np.ndarray | None, segments: int, max_bits: int) -> list[tuple[int, int]]:
    """Spanning links among ``left``, or between ``left`` and ``right``, found by breadth-first search."""
    every = left if right is None else np.concatenate([left, right])
    side = np.arange(len(every)) < len(left)
    free = np.ones(len(every), bool)
    links = []
    for root in range(len(every)):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(free if right is None else free & (side != side[at]))
            near = rest[within(every[rest] ^ every[at], segments, max_bits)]
            free[near] = False
            links += [(int(every[at]), int(every[x])) for x in near]
            queue += near.tolist()
    return links


_LINKS = "a long, b long, block int"  # block: null for a link; else fingerprint a of key b belongs to that block


def _link_runs(segments: int, max_bits: int, max_run: int):
    """Batches sorted by (key, fp) to links inside each run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_kept = fp_kept = np.zeros(0, np.int64)
        blocks = 0  # blocks of the run at hand already given out

        def out(a, b, block=None):
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.nulls(len(a), pa.int32()) if block is None else pa.array(np.full(len(a), block), pa.int32())],
                names=["a", "b", "block"])

        def close(keys, fps):
            """Links of whole runs."""
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            pair = starts[sizes == 2]
            near = pair[within(fps[pair] ^ fps[pair + 1], segments, max_bits)]
            yield out(fps[near], fps[near + 1])
            links = []
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                links += forest(fps[s:s + n], None, segments, max_bits)
            if links:
                yield out(*zip(*links))

        for batch in batches:
            keys = np.concatenate([key_kept, batch.column(0).to_numpy()])
            fps = np.concatenate([fp_kept, batch.column(1).to_numpy()])
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            if blocks and last:  # the long run has ended: its rest is its last block
                end = int(np.searchsorted(keys, keys[0], side="right"))
                yield out(fps[:end], keys[:end], blocks)
                keys, fps, last, blocks = keys[end:], fps[end:], last - end, 0
            if last:
                yield from close(keys[:last], fps[:last])
            key_kept, fp_kept = keys[last:], fps[last:]
            while len(fp_kept) > max_run:
                yield out(fp_kept[:max_run], key_kept[:max_run], blocks)
                key_kept, fp_kept, blocks = key_kept[max_run:], fp_kept[max_run:], blocks + 1
        if blocks:
            yield out(fp_kept, key_kept, blocks)
        elif len(fp_kept):
            yield from close(key_kept, fp_kept)

    return run


def links(prints: DataFrame, max_bits: int = 4, segments: int | None = None, max_run: int = 2048) -> DataFrame:
    """(a, b): links that connect every two fingerprints (column fp) within ``max_bits`` of each other, directly or by others."""
    segments = segments or max_bits + 3
    parts = ring(segments)

    def key(number: int, members: tuple[int, ...]):
        value = F.lit(number).cast("long")
        for m in members:
            at, width = parts[m]
            value = F.shiftleft(value, width).bitwiseOR(
                F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        return value

    sets = chain_keys(segments, max_bits)
    if len(sets).bit_length() + sum(sorted((w for _, w in parts), reverse=True)[:len(sets[0])]) > 63:
        raise ValueError("keys need over 63 bits; take fewer segments")
    distinct = prints.select("fp").distinct()
    keyed = distinct.select(F.explode(F.array(*(key(i, s) for i, s in enumerate(sets)))).alias("key"), "fp")
    found = stored(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(
        _link_runs(segments, max_bits, max_run), _LINKS), "simhash")

    # blocks of long runs: every pair of blocks, and each block in itself, is one group
    hot = found.filter("block IS NOT NULL")
    count = hot.groupBy("b").agg((F.max("block") + 1).alias("blocks"))
    paired = hot.join(count, "b").select(
        "a", "block", F.col("b").alias("key"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = paired.select("a", "block", "key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))

    def compare(group):
        first = group["block"] == group["first"]
        left = group["a"][first].to_numpy()
        right = None if group["first"].iat[0] == group["second"].iat[0] else group["a"][~first].to_numpy()
        import pandas as pd

        return pd.DataFrame(forest(left, right, segments, max_bits), columns=["a", "b"], dtype="int64")

    return found.filter("block IS NULL").select("a", "b").union(
        paired.groupBy("key", "first", "second").applyInPandas(compare, "a long, b long"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """(id, text_hash, fp, group_fp, component_id) per row: the group's own key and its smallest id."""
    prints = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    per_fp = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    group_of = components(links(per_fp, max_bits))
    per_fp = per_fp.join(group_of, per_fp["fp"] == group_of["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("group_fp"))
    smallest = per_fp.groupBy("group_fp").agg(F.min("least").alias("component_id"))
    named = per_fp.select("fp", "group_fp").join(smallest, "group_fp")
    return prints.join(named, "fp").select(id_col, "text_hash", "fp", "group_fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id (null ids last), then text hash.

    The texts are shuffled once, to meet the chosen ids.
    """
    rows = groups(docs, id_col, text_col, words, max_bits)
    chosen = rows.groupBy("group_fp").agg(
        F.min(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), "text_hash")).alias("one"))
    chosen = chosen.select(F.col("one.id").alias("_id"), F.col("one.text_hash").alias("_hash"))
    # a document's own columns travel as one struct, so their names meet no others
    whole = docs.select(F.struct("*").alias("doc"), F.col(quoted(id_col)).alias("id"), F.xxhash64(F.col(quoted(text_col))).alias("text_hash"))
    met = whole.join(chosen, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    # equal rows all meet the chosen id: the first of them stays
    first = Window.partitionBy("_id", "_hash").orderBy("_hash")
    return met.withColumn("copy", F.row_number().over(first)).filter("copy = 1").select("doc.*")
