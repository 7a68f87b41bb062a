"""Stupid-backoff scores of documents under the corpus' own n-gram counts.

A word is scored by the longest n-gram that ends at it and is in the tables:
its count over the count of its first n-1 words, times ``backoff`` for every
order skipped; a lone word by its share of all words. N-grams of two words or
more are in the tables from ``min_count`` occurrences: at 1 every n-gram of the
corpus would be found and nothing skipped; at 2 those seen only where they are
scored are skipped. A document's score is the sum of the logarithms.

The work is relational, on packed rows. Documents are dealt into blocks of
bounded size, each compressed. A block's exploded n-grams are aggregated where they arise: one
64-bit hash and count per distinct n-gram, sorted, cut into hash ranges, the
hashes written as differences. A row holds one block's n-grams of one range. Grouped by range, these rows make
that partition of the count table, which is joined back to the same rows: each
gets the total counts of its n-grams. Grouped by block, the totals meet the
block's documents, and are summed per document. Nothing grows with a hot
n-gram, as every block sends it once; the number of blocks and ranges grows
with the corpus.

Words are what stands between ASCII blanks, A-Z lower-cased; n-grams do not
cross documents.

Defined results: a null or empty text has no words and score 0; repeated rows
and ids each count and get a row; a null id stays null; an empty table gives an
empty table; columns other than id and text are not looked at. Should the rows
not come from a stored table, store them first: blocks follow the order in
which rows are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import BLANK, mix64, text_bytes

SLICE = 1 << 21  # bytes hashed at a time
BASE = np.uint64(0x9FB21C651E98DF25)
STEP = np.uint64(0x9E3779B97F4A7C15)


# --- one block (numpy) ------------------------------------------------------------------

def _word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text in lower case."""
    chars = np.frombuffer(text, np.uint8)
    blank = (chars == 32) | ((chars >= 9) & (chars <= 13))
    begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(begins):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    inside = np.arange(len(chars)) - np.repeat(begins, np.diff(np.r_[begins, len(chars)])) if begins[0] == 0 else None
    if inside is None:
        chars, blank, ends, begins = chars[begins[0]:], blank[begins[0]:], ends - begins[0], begins - begins[0]
        inside = np.arange(len(chars)) - np.repeat(begins, np.diff(np.r_[begins, len(chars)]))
    powers = np.cumprod(np.full(int((ends - begins).max()) + 1, BASE))
    inside[blank] = 0
    value = powers[inside] * (chars.astype(np.uint64) + np.uint64(1))
    value[blank] = 0
    return mix64(np.add.reduceat(value, begins) + (ends - begins).astype(np.uint64) * STEP)


def ngrams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(words per text; per order the hash of the n-gram that ends at each word; words before it in its text)."""
    hashes, sizes = [], []
    at = 0
    while at < len(texts):  # many short texts, or one long text, at a time
        part, size = [], 0
        while at < len(texts) and (not part or size + len(texts[at]) <= SLICE):
            part.append(texts[at])
            size += len(texts[at])
            at += 1
        sizes += [len(t.split()) for t in part]
        hashes.append(_word_hashes(b"\n".join(part).lower()))
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    sizes = np.array(sizes, np.int64)
    before = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = [words]
    for n in range(2, order + 1):
        longer = np.zeros_like(words)
        longer[1:] = mix64(grams[-1][:-1] * STEP + words[1:] + np.uint64(n))
        grams.append(longer)
    return sizes, grams, before


def _distinct(grams: list[np.ndarray], before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, index of each n-gram in them, counts); the n-grams of all orders in turn."""
    every = np.concatenate([g[before >= n] for n, g in enumerate(grams)])
    return np.unique(every, return_inverse=True, return_counts=True)


def _squeeze(raw: np.ndarray) -> bytes:
    """Bytes behind their number, compressed."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw.tobytes(), asbytes=True)


def _expand(squeezed: bytes) -> np.ndarray:
    size = int.from_bytes(squeezed[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(squeezed[8:], size, asbytes=True), np.uint8)


LOW = 5  # bytes of a difference of hashes that are as good as random in a full block


def _pack_hashes(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted hashes as differences: the low bytes as they are, the high ones, which are small, compressed."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return steps[:, :LOW].tobytes(), _squeeze(steps[:, LOW:].T.ravel())


def _unpack_hashes(low: bytes, high: bytes) -> np.ndarray:
    steps = np.empty((len(low) // LOW, 8), np.uint8)
    steps[:, :LOW] = np.frombuffer(low, np.uint8).reshape(-1, LOW)
    steps[:, LOW:] = _expand(high).reshape(8 - LOW, -1).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as a byte each, compressed; those from 255 as (255, full count in a list of its own)."""
    return _squeeze(np.minimum(counts, 255).astype(np.uint8)), counts[counts >= 255].astype("<i8").tobytes()


def _unpack(small: bytes, large: bytes) -> np.ndarray:
    counts = _expand(small).astype(np.int64)
    counts[counts == 255] = np.frombuffer(large, "<i8")
    return counts


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the equal hash ranges begins in sorted hashes, and the end."""
    return np.searchsorted(hashes, np.array([(i << 64) // parts for i in range(parts)], np.uint64)).tolist() + [len(hashes)]


def block_scores(texts: list[bytes], totals: np.ndarray, n_words: int, order: int, backoff: float, min_count: int) -> list[tuple[int, int, float]]:
    """(words, words scored by a shorter n-gram than they had, log score) of each text."""
    sizes, grams, before = ngrams(texts, order)
    _, index, _ = _distinct(grams, before)
    log = np.log(totals)[index]
    counts = totals[index]
    ends = np.cumsum([(before >= n).sum() for n in range(order)])
    place = [np.cumsum(before >= n) - 1 + (ends[n - 1] if n else 0) for n in range(order)]  # of a word's n-gram in ``index``
    score = log[place[0]] - math.log(max(n_words, 1)) if len(before) else np.zeros(0)
    found = np.zeros(len(before), np.int64)  # order of the longest n-gram in the tables, from 0
    for n in range(1, order):
        known = np.flatnonzero(before >= n)
        known = known[counts[place[n][known]] >= min_count]
        score[known] = log[place[n][known]] - log[place[n - 1][known - 1]]
        found[known] = n
    skipped = np.minimum(before, order - 1) - found
    score = score + skipped * math.log(backoff)
    edges = np.r_[0, np.cumsum(sizes)]
    return [(int(n), int((skipped[a:b] > 0).sum()), float(score[a:b].sum()) if n else 0.0)
            for n, a, b in zip(sizes, edges[:-1], edges[1:])]


# --- Spark ------------------------------------------------------------------------------------

_GRAMS = "block int, range int, low binary, high binary, small binary, large binary"
_TOTALS = "block int, range int, small binary, large binary"


def score(docs: DataFrame, order: int = 2, backoff: float = 0.4, min_count: int = 2, id_col: str = "doc_id", text_col: str = "text",
          block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: id, n_words, n_backoff (words scored by a shorter n-gram), log_score."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("bytes"),
                    F.sum(F.regexp_count(F.col(text_col), F.lit(f"[^{BLANK}]+")).cast("long")).alias("words")).first()
    n_words, parts = size["words"] or 0, max(1, -(-(size["bytes"] or 0) // block_bytes))
    spread = F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col)), F.monotonically_increasing_id() % 1024)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(spread, F.lit(parts)).cast("int").alias("block"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_squeeze(np.frombuffer(t, np.uint8)) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(2)], names=["id", "text", "block"])

    def texts_of(block: pa.Table) -> list[bytes]:
        return [_expand(t.as_py()).tobytes() for t in block["text"]]

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = rows.mapInArrow(squeeze, f"id {id_type}, text binary, block int").repartition("block")

    def explode(block: pa.Table) -> pa.Table:
        _, grams, before = ngrams(texts_of(block), order)
        hashes, _, counts = _distinct(grams, before)
        edges = _ranges(hashes, parts)
        out: dict[str, list] = {"range": [], "low": [], "high": [], "small": [], "large": []}
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                for name, value in zip(out, (i, *_pack_hashes(hashes[a:b]), *_pack(counts[a:b]))):
                    out[name].append(value)
        n = len(out["range"])
        return pa.table({"block": pa.array([block["block"][0].as_py()] * n, pa.int32()), "range": pa.array(out["range"], pa.int32()),
                         **{c: pa.array(out[c], pa.binary()) for c in ("low", "high", "small", "large")}})

    def count(group: pa.Table) -> pa.Table:
        # one partition of the count table, joined back to the rows that made it
        each = [_unpack_hashes(a.as_py(), b.as_py()) for a, b in zip(group["low"], group["high"])]
        table, index = np.unique(np.concatenate(each), return_inverse=True)
        counts = np.concatenate([_unpack(s.as_py(), x.as_py()) for s, x in zip(group["small"], group["large"])])
        totals = np.zeros(len(table), np.int64)
        np.add.at(totals, index, counts)
        packed, at = [], 0
        for x in each:
            packed.append(_pack(totals[index[at:at + len(x)]]))
            at += len(x)
        return pa.table({"block": group["block"], "range": group["range"], "small": pa.array([p[0] for p in packed], pa.binary()),
                         "large": pa.array([p[1] for p in packed], pa.binary())})

    def summed(block: pa.Table, totals: pa.Table) -> pa.Table:
        totals = totals.sort_by("range")
        counts = [_unpack(s.as_py(), x.as_py()) for s, x in zip(totals["small"], totals["large"])]
        found = block_scores(texts_of(block), np.concatenate(counts) if counts else np.zeros(0, np.int64),
                             n_words, order, backoff, min_count)
        words, back, log = zip(*found) if found else ((), (), ())
        return pa.table({"id": block["id"], "n_words": pa.array(words, pa.int64()), "n_backoff": pa.array(back, pa.int64()),
                         "log_score": pa.array(log, pa.float64())})

    grams = rows.groupBy("block").applyInArrow(explode, _GRAMS)
    totals = grams.groupBy("range").applyInArrow(count, _TOTALS)
    totals = totals.select(F.col("block").alias("b"), "range", "small", "large")
    out = rows.groupBy("block").cogroup(totals.groupBy("b")).applyInArrow(
        summed, f"id {id_type}, n_words long, n_backoff long, log_score double")
    return out.select(F.col("id").alias(id_col), "n_words", "n_backoff", "log_score")


def oracle_sql(order: int = 2, backoff: float = 0.4, min_count: int = 2) -> str:
    if order == 3:
        return _trigram_sql(backoff, min_count)
    if order != 2:
        raise ValueError("written for bigrams and trigrams")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^{BLANK}]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, unnest([NULL] || words[:-2]) AS v FROM t WHERE len(words) > 0),
u AS (SELECT w, count(*) AS c FROM w GROUP BY w),
b AS (SELECT v, w, count(*) AS c FROM w WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= {min_count}),
s AS (SELECT w.doc_id, w.v IS NOT NULL AND b.c IS NULL AS back,
        CASE WHEN b.c IS NOT NULL THEN ln(b.c) - ln(x.c)
             ELSE ln(u.c) - ln((SELECT count(*) FROM w)) + CASE WHEN w.v IS NULL THEN 0 ELSE ln({backoff}) END END AS s
      FROM w JOIN u ON u.w = w.w LEFT JOIN u x ON x.w = w.v LEFT JOIN b ON b.v = w.v AND b.w = w.w),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE back) AS k, sum(s) AS s FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_backoff, round(coalesce(s, 0.0), 6)::DOUBLE AS log_score
FROM t LEFT JOIN g ON g.doc_id = t.doc_id"""



def _trigram_sql(backoff: float, min_count: int) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^{BLANK}]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, unnest(([NULL] || words)[:len(words)]) AS v, unnest(([NULL, NULL] || words)[:len(words)]) AS u
      FROM t WHERE len(words) > 0),
n1 AS (SELECT w, count(*) AS c FROM w GROUP BY w),
n2 AS (SELECT v, w, count(*) AS c FROM w WHERE v IS NOT NULL GROUP BY v, w),
n3 AS (SELECT u, v, w, count(*) AS c FROM w WHERE u IS NOT NULL GROUP BY u, v, w HAVING count(*) >= {min_count}),
s AS (SELECT w.doc_id, CASE WHEN w.u IS NOT NULL THEN n3.c IS NULL WHEN w.v IS NOT NULL THEN b.c < {min_count} ELSE false END AS back,
        CASE WHEN n3.c IS NOT NULL THEN ln(n3.c) - ln(x.c)
             WHEN b.c >= {min_count} THEN ln(b.c) - ln(y.c) + CASE WHEN w.u IS NULL THEN 0 ELSE ln({backoff}) END
             ELSE ln(a.c) - ln((SELECT count(*) FROM w)) + CASE WHEN w.v IS NULL THEN 0 WHEN w.u IS NULL THEN 1 ELSE 2 END * ln({backoff}) END AS s
      FROM w JOIN n1 a ON a.w = w.w LEFT JOIN n1 y ON y.w = w.v LEFT JOIN n2 b ON b.v = w.v AND b.w = w.w
      LEFT JOIN n2 x ON x.v = w.u AND x.w = w.v LEFT JOIN n3 ON n3.u = w.u AND n3.v = w.v AND n3.w = w.w),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE back) AS k, sum(s) AS s FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_backoff, round(coalesce(s, 0.0), 6)::DOUBLE AS log_score
FROM t LEFT JOIN g ON g.doc_id = t.doc_id"""
