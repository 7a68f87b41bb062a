"""Quality rules by distribution divergence.

A document is rejected by a plain length or repetition rule, or when its
character classes or its common words are distributed unlike every reference
language: the Jensen-Shannon distance (base 2, 0 to 1) to the nearest
reference is over a bound. Histograms of little text are noisy, so each
comparison needs a minimum length; below it the comparison does not count.
Common words are compared only with languages the text may be in: those of
whose usual share of common words it has half. A text that matches none (a
language without a reference) is not judged by its common words.

The references and the bounds are learned from all labelled documents
(``learn``), none are built in: a bound is ``margin`` times the distance that a
share ``inside`` of the good documents keeps to. Given them, everything about a document follows from its own text, so the rules
run where the rows lie: no shuffle, one Arrow batch in memory.

Defined results: a null text has no words and is rejected (fewer than
``min_words``); rows are judged one by one, so repeated rows and ids give
repeated verdicts; a null id stays null; an empty table gives an empty table;
columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import quoted, stored, text_bytes

LETTER, UPPER, DIGIT, SPACE, SYMBOL, PUNCTUATION, OTHER, CONTINUATION = range(8)
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:!?'\"()-"


def _classes() -> np.ndarray:
    """Class of each UTF-8 byte; a character outside ASCII counts as one letter (its first byte)."""
    kind = np.full(256, OTHER, np.uint8)
    kind[0x80:0xC0] = CONTINUATION
    kind[0xC0:] = LETTER
    for group, k in ((b"abcdefghijklmnopqrstuvwxyz", LETTER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER),
                     (b"0123456789", DIGIT), (b" \t\n\v\f\r", SPACE), (SYMBOLS, SYMBOL), (STOPS, PUNCTUATION)):
        kind[list(group)] = k
    return kind


@dataclass(frozen=True)
class Rules:
    min_words: int = 50                # fewer words: rejected
    max_repeat_percent: int = 50       # of words in repeated three-word windows
    min_chars_for_classes: int = 200   # characters before the class histogram counts
    min_words_for_common: int = 100    # words before the common-word histogram counts
    min_common_percent: int = 50       # of a language's usual share of common words; with less a text is not in it


@dataclass(frozen=True)
class References:
    """Histograms of each language, words without the share of all others, and the bounds of the distances to them."""

    words: dict[str, dict[bytes, float]]
    classes: dict[str, tuple[float, ...]]
    max_class_distance: float = math.inf   # to the nearest language; beyond it a document is rejected
    max_common_distance: float = math.inf


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, over the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0)
        right = np.where(q > 0, q * np.log2(q / m), 0.0)
    return np.sqrt(np.maximum(0.0, (left + right).sum(-1) / 2))


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found at least twice (``ids``: one number per word)."""
    if len(ids) < 4:
        return 0
    if int(ids.max()) < 1 << 21:
        key = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:  # too many different words for one 64-bit key: number the pairs first
        pair = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1]
        key = pair[:-1] << 32 | ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines holding a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


class Judge:
    """Measures texts against rules and references; one per task."""

    def __init__(self, rules: Rules, references: References):
        self.rules, self.kind = rules, _classes()
        self.langs = list(references.words)
        self.max_class, self.max_common = references.max_class_distance, references.max_common_distance
        vocabulary = sorted({w for x in references.words.values() for w in x})
        self.vocabulary = {w: i for i, w in enumerate(vocabulary)}
        self.word_shares = np.array([[references.words[k].get(w, 0.0) for w in vocabulary] for k in self.langs]).reshape(
            len(self.langs), len(vocabulary))
        # a language is compared on its own words; all others fall together
        self.masks = self.word_shares > 0
        self.class_shares = np.array([references.classes[k] for k in self.langs])

    def measure(self, text: bytes) -> tuple:
        r = self.rules
        words = text.split()
        n = len(words)
        classes = np.bincount(self.kind[np.frombuffer(text, np.uint8)], minlength=8)
        chars = int(classes[:CONTINUATION].sum())
        seen: dict[bytes, int] = {}
        ids = np.fromiter(map(seen.setdefault, words, count()), np.int64, n)
        if n >= 1 << 21:  # first-seen positions become dense numbers
            ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        repeat = repeated_words(ids)
        failed = n < r.min_words or 100 * repeat > r.max_repeat_percent * n
        class_distance = common_distance = None
        if self.langs and chars >= r.min_chars_for_classes:
            shares = classes[:CONTINUATION] / chars
            class_distance = float(js_distance(shares[None, :], self.class_shares).min())
        if n >= r.min_words_for_common:
            common_distance = self._common(words, n)
        kept = not failed and (class_distance is None or class_distance <= self.max_class) and (
            common_distance is None or common_distance <= self.max_common)
        return (n, chars - int(classes[SPACE]), int(classes[SYMBOL]), repeated_lines(text), repeat, failed, kept,
                class_distance, common_distance)

    def _common(self, words: list[bytes], n: int) -> float | None:
        counts = np.zeros(len(self.vocabulary))
        for w, k in Counter(w.strip(STOPS) for w in map(bytes.lower, words)).items():
            i = self.vocabulary.get(w)
            if i is not None:
                counts[i] = k
        own = np.where(self.masks, counts / n, 0.0)
        match = 100 * own.sum(1) >= self.rules.min_common_percent * self.word_shares.sum(1)
        if not match.any():
            return None
        own, usual = own[match], self.word_shares[match]
        mine = np.concatenate([own, 1 - own.sum(1, keepdims=True)], axis=1)
        theirs = np.concatenate([usual, 1 - usual.sum(1, keepdims=True)], axis=1)
        return float(js_distance(mine, theirs).min())


COUNTS = "lang string, word binary, class int, n long"


def quantile(values: DataFrame, column: str, share: float, cells: int = 4096) -> float | None:
    """The exact quantile of a column's values that are not null, between two neighbours in proportion; None without values.

    Cells are counted and the one that holds the wanted rank is cut again, so neither a task nor the driver ever
    gets more than ``cells`` cells or values.
    """
    x = values.select(F.col(column).alias("x")).filter("x IS NOT NULL")
    n, low, high = x.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    below, part = math.modf((n - 1) * share)[::-1]
    rank, last = int(below), high  # ``last``: the least value known to follow the interval
    while low < high and n > cells:
        cell = F.least(F.floor((F.col("x") - low) / F.lit((high - low) / cells)), F.lit(cells - 1))
        found = sorted(x.filter(F.col("x").between(low, high)).groupBy(cell.alias("cell")).agg(
            F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect())
        i = 0
        while rank >= found[i]["n"]:
            rank -= found[i]["n"]
            i += 1
        if i + 1 < len(found):
            last = found[i + 1]["low"]
        _, n, low, high = found[i]
    inside = [low] * n if low == high else sorted(r["x"] for r in x.filter(F.col("x").between(low, high)).collect())
    at, after = inside[rank], inside[rank + 1] if rank + 1 < n else last
    return at if part == 0 else at * (1 - part) + after * part


BLOCK = 1 << 15  # bits in a row of Spark's bitmap functions


def listed(docs: DataFrame, good: DataFrame, bits_per_id: int = 16, probes: int = 8, max_bits: int = 1 << 28) -> DataFrame:
    """The rows of ``docs`` whose ``id`` is among ``good._good``: a semi join that moves ids only, no other column.

    The ids found in both make a Bloom filter, which every task holds; the ids that pass it by chance are
    found by an anti join of ids and taken out again, so the result is exact whatever the filter lets
    through. The filter has ``bits_per_id`` bits an id and never more than ``max_bits``: with more ids than those
    suit more pass by chance, and where these are too many to broadcast, Spark shuffles what has passed.
    """
    ids = docs.select("id").filter("id IS NOT NULL")
    known = stored(ids.join(good, F.col("id") == F.col("_good"), "left_semi").distinct(), "reference-ids")
    n_bits = BLOCK * max(1, -(-min(bits_per_id * known.count(), max_bits) // BLOCK))
    key = F.xxhash64("id")
    first, step = key.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(key, 32).bitwiseOR(F.lit(1))
    at = known.select(F.explode(F.array(*((first + step * i) % n_bits + 1 for i in range(probes)))).alias("at"))
    at = at.select(F.bitmap_bucket_number("at").alias("block"), F.bitmap_bit_position("at").alias("bit")).repartition("block")
    bits = np.zeros(n_bits // 8, np.uint8)
    for block, part in at.groupBy("block").agg(F.bitmap_construct_agg("bit")).collect():
        bits[(block - 1) * BLOCK // 8 : block * BLOCK // 8] = np.frombuffer(part, np.uint8)

    def passes(keys: pd.Series) -> pd.Series:
        x = keys.to_numpy(np.int64)
        first, step = x & 0xFFFFFFFF, x >> 32 & 0xFFFFFFFF | 1
        found = np.ones(len(x), bool)
        for i in range(probes):
            at = (first + step * i) % n_bits
            found &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return pd.Series(found)

    passed = F.pandas_udf(passes, "boolean")(key)
    chance = stored(ids.filter(passed).join(known, "id", "left_anti").distinct(), "reference-chance")
    return docs.filter("id IS NOT NULL").filter(passed).join(chance, "id", "left_anti")


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int | None = None, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", common: int = 20, min_words: int = 1000, rules: Rules = Rules(), inside: float = 0.999, margin: float = 1.5) -> References:
    """References of the languages, and bounds, of all documents labelled quality = 1.

    ``sample_docs``: only about so many of them, taken by a hash of their ids.
    ``common``: most frequent words of a language that make its histogram, of those with two
    thousandths of its words or more. A language with less than ``min_words`` words in them
    gets no reference. The bounds are ``margin`` times the quantile ``inside`` of the distances
    of those documents that pass the plain rules; without such, nothing is out of bounds.
    """
    good = labels.filter("quality = 1").select(F.col(id_col).alias("_good")).filter("_good IS NOT NULL").distinct()
    if sample_docs is not None:
        per_million = -(-sample_docs * 1_000_000 // max(1, good.count()))
        good = good.filter(F.pmod(F.xxhash64("_good"), F.lit(1_000_000)) < per_million)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    chosen = stored(listed(chosen.filter("lang IS NOT NULL"), good).select("lang", "text"), "reference-documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _classes()
        for batch in batches:
            words: dict[str, Counter] = {}
            found: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words.setdefault(lang, Counter()).update(text.lower().split())
                classes = np.bincount(kind[np.frombuffer(text, np.uint8)], minlength=8)
                found.update({(lang, None, k): int(n) for k, n in enumerate(classes[:CONTINUATION]) if n})
            for lang, counted in words.items():
                for w, n in counted.items():
                    found[lang, w.strip(STOPS), None] += n
            langs, words, kinds = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(kinds, pa.int32()), pa.array(found.values(), pa.int64())],
                names=["lang", "word", "class", "n"])

    counts = stored(chosen.mapInArrow(run, COUNTS).groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "reference-counts")
    # what is collected is bounded by the number of languages: their class sums, and words over a share
    totals = counts.filter("word IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("words")).filter(F.col("words") >= min_words)
    usual = counts.join(F.broadcast(totals), "lang").filter("word IS NULL OR word <> X'' AND n * 500 >= words").collect()
    words: dict[str, dict[bytes, float]] = {}
    classes: dict[str, list[float]] = {}
    for r in sorted((r for r in usual if r["word"] is not None), key=lambda r: (r["lang"], -r["n"], bytes(r["word"]))):
        if len(own := words.setdefault(r["lang"], {})) < common:
            own[bytes(r["word"])] = r["n"] / r["words"]
    for r in usual:
        if r["word"] is None:
            classes.setdefault(r["lang"], [0.0] * CONTINUATION)[r["class"]] = float(r["n"])
    found = References({k: words[k] for k in sorted(words)}, {k: tuple(x / sum(v) for x in v) for k, v in classes.items()})
    distances = ("class_distance", "common_distance")
    measured = stored(measure(chosen, found, "lang", "text", rules).filter("NOT base_failed").select(*distances), "reference-distances")
    usual = {c: quantile(measured, c, inside) for c in distances}
    return replace(found, **{f"max_{c}": margin * x for c, x in usual.items() if x is not None})


MEASURES = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()), T.StructField("class_distance", T.DoubleType()),
    T.StructField("common_distance", T.DoubleType()),
])
_ARROW = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
          ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
          ("class_distance", pa.float64()), ("common_distance", pa.float64())]


def measure(docs: DataFrame, references: References, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: its id, the measures and the verdict ``kept``."""
    id_field = docs.schema[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules, references)
        for batch in batches:
            found = [judge.measure(t) for t in text_bytes(batch.column(1))]
            columns = list(zip(*found)) or [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, _ARROW))],
                names=[id_col, *(n for n, _ in _ARROW)])

    schema = T.StructType([T.StructField(id_col, id_field.dataType), *MEASURES])
    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, schema)


def keep(docs: DataFrame, references: References, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns, in one pass and without a join."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(rules, references)
        for batch in batches:
            yield batch.filter(pa.array([judge.measure(t)[6] for t in text_bytes(batch.column(at))], pa.bool_()))

    # by place: names with dots cannot be passed to Python
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
