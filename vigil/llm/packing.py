"""Packing documents into sequences with a grouping genetic algorithm.

Documents become token ids (a vocabulary file names the tokenizer), documents
over the capacity are cut, and only the pieces' lengths go on: a full piece is
a sequence of its own, the others are dealt into blocks of bounded size. Each
block is evolved by several islands, which are rows and so run as separate
tasks. Between epochs the best individual of an island migrates to the next
island of its block by a join; each epoch is written to the shared folder.

An individual is a grouping of a block's pieces into bins. Crossover injects
whole well-filled bins of one parent into the other, removes the bins that
held the same pieces, and places the displaced pieces by best fit. Fitness:
fewer bins, then fuller ones (sum of squared fills). An island starts from
groupings by differently shuffled orders and runs all its generations, also
when it is down to the lower bound of bins: from there on its fuller bins
leave fewer pieces for the next turn. Bins that stay below ``settled`` of the
capacity are opened once more and their pieces meet in new blocks, so that a
block's last bins cost little.

Defined results: a null or empty text has the end id alone; each row is packed,
so repeated rows and ids give repeated pieces; a null id stays null; an empty
table gives an empty table; columns other than id and text are not looked at.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import shared_dir, stored, text_bytes, total

END_ID = 0


def default_vocabulary() -> str:
    """A public tokenizer file that is installed with its package; any other file can be given."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- tokens ---------------------------------------------------------------------

class Words(dict):
    """Token ids (little-endian uint32 bytes) of a text's chunks.

    The tokenizer never joins characters across ASCII white space, parts
    letters from the signs after them, and lowers case. So a text is cut into
    chunks at white space and before signs that end a word, its ids are the
    chunks' ids in order, and each chunk is encoded once per task. A chunk of
    Latin-1 letters needs none of the tokenizer's normalising: such chunks are
    encoded many at a time, with a chunk between them that is one known id.
    All others go one by one.
    """

    MARK = b"0"
    MOST = 600_000  # chunks remembered per task
    # signs that end a word, right after an ASCII letter or digit or a Latin-1 letter
    SIGNS = re.compile(rb"[S](?:(?<=[a-z0-9][S])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][S]))[S]*(?=[\x20\x09-\x0d]|$)".replace(
        b"[S]", rb"[!-&(-/:-@\[-`{-~]"))
    # a special token, or letters in which lowering and composing could meet: such texts keep their case
    DELICATE = (b"<|", b"\xcc", b"\xcd")
    LATIN = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")

    def __init__(self, vocabulary: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        full = Tokenizer.from_file(vocabulary)
        self.encode = full.encode
        letters = Tokenizer(full.model)
        letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode_letters = letters.encode_batch_fast
        self.mark = self.ids(self.MARK)
        if len(self.mark) != 4:
            raise ValueError(f"the vocabulary has no single id for {self.MARK!r}")

    def ids(self, chunk: bytes) -> bytes:
        return np.array(self.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def chunks(self, text: bytes) -> list[bytes]:
        if any(x in text for x in self.DELICATE):
            return text.split()
        return self.SIGNS.sub(rb" \g<0>", text.lower()).split()

    def learn(self, texts: list[list[bytes]]) -> None:
        if len(self) > self.MOST:
            self.clear()
        new = set(chain.from_iterable(texts)).difference(self)
        plain = [x for x in new if x.isalpha() and x.islower()]  # bytes: ASCII letters only
        self._learn_letters(plain, plain)
        latin, lower = [], []
        for chunk in new.difference(plain):
            text = chunk.decode()
            if self.LATIN.fullmatch(text):
                latin.append(chunk)
                lower.append(text.lower().encode())
            else:
                self[chunk] = self.ids(chunk)
        self._learn_letters(latin, lower)

    def _learn_letters(self, chunks: list[bytes], lower: list[bytes]) -> None:
        starts = range(0, len(chunks), 1000)
        mark = np.frombuffer(self.mark, "<u4")[0]
        joined = [(b" " + self.MARK + b" ").join(lower[i:i + 1000]).decode() for i in starts]
        for i, found in zip(starts, self.encode_letters(joined, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(ids == mark)
            group = chunks[i:i + 1000]
            if len(ends) != len(group) - 1:
                raise ValueError("a chunk of letters holds the mark's id")
            data, ends = ids.tobytes(), 4 * ends
            self.update(zip(group, map(data.__getitem__, map(slice, [0, *(ends + 4).tolist()], [*ends.tolist(), len(data)]))))


PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                       T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and the end id, cut at the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                texts = [words.chunks(t) for t in text_bytes(batch.column(1))]
                words.learn(texts)
                source, piece, start, length, crc = [], [], [], [], []
                for row, text in enumerate(texts):
                    ids = memoryview(b"".join(map(words.__getitem__, text)) + end)
                    for k, low in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[low:low + 4 * capacity]
                        source.append(row)
                        piece.append(k)
                        start.append(low // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[id_col, *PIECES.names])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *PIECES])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


# --- the genetic algorithm --------------------------------------------------------

class Fit:
    """Best fit: bins by free space, a bit per free space in use."""

    def __init__(self, capacity: int, bins: list[list[int]], lengths: list[int]):
        self.capacity, self.lengths, self.bins = capacity, lengths, bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0
        for i, b in enumerate(bins):
            self._open(i, capacity - sum(lengths[x] for x in b))

    def _open(self, i: int, space: int) -> None:
        if space:
            self.free[space].append(i)
            self.used |= 1 << space

    def place(self, items: list[int]) -> None:
        for x in items:
            need = self.lengths[x]
            fitting = self.used >> need
            if fitting:
                space = need + (fitting & -fitting).bit_length() - 1
                i = self.free[space].pop()
                if not self.free[space]:
                    self.used &= ~(1 << space)
                self.bins[i].append(x)
            else:
                space, i = self.capacity, len(self.bins)
                self.bins.append([x])
            self._open(i, space - need)


def fill(b: list[int], lengths: list[int]) -> int:
    return sum(lengths[x] for x in b)


def fitness(bins: list[list[int]], lengths: list[int]) -> tuple[int, int]:
    """Greater is better: fewer bins, then more unequal, so fuller, ones."""
    return -len(bins), sum(fill(b, lengths) ** 2 for b in bins)


def crossover(rng: random.Random, into: list[list[int]], giver: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    by_fill = sorted(giver, key=lambda b: -fill(b, lengths))
    well = by_fill[:max(1, len(by_fill) // 2)]
    injected = rng.sample(well, rng.randint(1, max(1, len(well) // 4)))
    inside = {x for b in injected for x in b}
    kept, displaced = [], []
    for b in into:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [x for x in b if x not in inside]
    displaced.sort(key=lambda x: -lengths[x])
    fit = Fit(capacity, [list(b) for b in injected] + kept, lengths)
    fit.place(displaced)
    return fit.bins


def mutate(rng: random.Random, bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Open the emptiest bins and a few others and place their pieces anew."""
    order = sorted(range(len(bins)), key=lambda i: fill(bins[i], lengths))
    opened = set(order[:2]) | set(rng.sample(order, min(len(order), 2 + len(order) // 50)))
    displaced = [x for i in opened for x in bins[i]]
    displaced.sort(key=lambda x: -lengths[x] * rng.uniform(0.9, 1.1))
    fit = Fit(capacity, [list(b) for i, b in enumerate(bins) if i not in opened], lengths)
    fit.place(displaced)
    return fit.bins


def evolve(lengths: list[int], immigrants: list[list[list[int]]], seed: int, capacity: int, population: int, generations: int,
           seen: dict | None = None) -> list[list[int]]:
    """The best grouping that one island finds in an epoch. ``seen`` counts its crossovers, and the children that were
    better than the best before them."""
    rng = random.Random(seed)
    people = [[list(b) for b in x] for x in immigrants]
    spread = 0.0 if not people else 0.2
    while len(people) < population:
        order = sorted(range(len(lengths)), key=lambda x: -lengths[x] * rng.uniform(1 - spread, 1 + spread))
        fit = Fit(capacity, [], lengths)
        fit.place(order)
        people.append(fit.bins)
        spread += 0.2
    ranked = sorted(((fitness(p, lengths), p) for p in people), key=lambda x: x[0], reverse=True)
    seen = {} if seen is None else seen
    for _ in range(generations):
        (_, a), (_, b) = rng.sample(ranked[:max(2, population // 2)], 2)
        child = mutate(rng, crossover(rng, a, b, lengths, capacity), lengths, capacity)
        seen["crossovers"] = seen.get("crossovers", 0) + 1
        scored = (fitness(child, lengths), child)
        seen["better"] = seen.get("better", 0) + (scored[0] > ranked[0][0])
        ranked[-1] = scored  # the worst makes room
        ranked.sort(key=lambda x: x[0], reverse=True)
    return ranked[0][1]


def _as_numbers(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for i, b in enumerate(bins):
        out[b] = i
    return out


def _as_bins(numbers: np.ndarray) -> list[list[int]]:
    order = np.argsort(numbers, kind="stable")
    cuts = np.flatnonzero(np.diff(numbers[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(numbers) else []


# crossovers, better, migrants: what an epoch did on an island
_ISLAND = "block long, island int, lengths array<int>, best array<int>, bins int, squares double, crossovers int, better int, migrants int"


def _epoch(islands: DataFrame, count: int, epoch: int, capacity: int, population: int, generations: int) -> DataFrame:
    """Evolve every one of ``count`` islands: (block, island, lengths, best and the immigrants' groupings) to its new best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = row["lengths"]
                start = [_as_bins(np.array(x, np.int32)) for x in row["immigrants"] or []]
                seen = {"crossovers": 0, "better": 0}
                best = evolve(lengths, start, hash((row["block"], row["island"], epoch)), capacity, population, generations, seen)
                n, squares = fitness(best, lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]], pa.int64()), pa.array([row["island"]], pa.int32()),
                     pa.array([lengths], pa.list_(pa.int32())), pa.array([_as_numbers(best, len(lengths))], pa.list_(pa.int32())),
                     pa.array([-n], pa.int32()), pa.array([float(squares)], pa.float64()), pa.array([seen["crossovers"]], pa.int32()),
                     pa.array([seen["better"]], pa.int32()), pa.array([max(0, len(start) - 1)], pa.int32())],
                    names=["block", "island", "lengths", "best", "bins", "squares", "crossovers", "better", "migrants"])

    # a number of its own: by bytes Spark would put all islands into one task
    tasks = max(1, min(count, 8 * islands.sparkSession.sparkContext.defaultParallelism))
    return stored(islands.repartition(tasks, "block", "island").mapInArrow(run, _ISLAND), "islands")


def group(items: DataFrame, capacity: int, block_items: int = 4096, islands: int = 2, epochs: int = 2, population: int = 3,
          generations: int = 4, settled: float = 0.97, seed: int = 1, passes: int = 2) -> DataFrame:
    """(item, sequence_id, offset) for (item long, length): ``item`` distinct, lengths from 1 to the capacity."""
    out = None
    for turn in range(passes):
        n = total(items, F.lit(1))
        if turn and not n:
            break
        blocks = max(1, -(-n // block_items))
        dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(seed + turn)), F.lit(blocks)).alias("block"))
        members = stored(dealt.groupBy("block").agg(F.sort_array(F.collect_list(
            F.struct(F.col("length").cast("int").alias("length"), "item")), asc=False).alias("members")), "blocks")
        islet = members.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                               F.col("members.length").alias("lengths"))
        state = _epoch(islet.withColumn("immigrants", F.lit(None).cast("array<array<int>>")), blocks * islands, 0, capacity, population, generations)
        for epoch in range(1, epochs):
            guests = state.select("block", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.col("best").alias("guest"))
            met = state.join(guests, ["block", "island"]).select(
                "block", "island", "lengths", F.array("best", "guest").alias("immigrants"))
            state = _epoch(met, blocks * islands, epoch, capacity, population, generations)
        best = state.groupBy("block").agg(F.min(F.struct("bins", -F.col("squares"), "island", "best")).alias("one"))
        placed = stored(_places(best.select("block", "one.best").join(members, "block"), turn, passes), "places")
        last = turn == passes - 1
        done = placed if last else placed.filter(F.col("filled") >= settled * capacity)
        done = done.select("item", "sequence_id", "offset")
        out = done if out is None else out.union(done)
        items = None if last else placed.filter(F.col("filled") < settled * capacity).select("item", "length")
    return out


def _places(best: DataFrame, turn: int, passes: int) -> DataFrame:
    """A block's grouping to the place of each item; ``filled``: tokens in its sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                numbers = np.array(row["best"], np.int64)
                length = np.array([m["length"] for m in row["members"]], np.int64)
                item = np.array([m["item"] for m in row["members"]], np.int64)
                order = np.argsort(numbers, kind="stable")
                ends = np.cumsum(length[order])
                first = np.r_[True, np.diff(numbers[order]) != 0]
                before = (ends - length[order])[first]
                which = np.cumsum(first) - 1
                filled = np.diff(np.r_[before, ends[-1]])
                sequence = ((row["block"] * passes + turn) << 20) + which
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item[order]), pa.array(length[order]), pa.array(sequence),
                     pa.array(ends - length[order] - before[which]), pa.array(filled[which])],
                    names=["item", "length", "sequence_id", "offset", "filled"])

    return best.mapInArrow(run, "item long, length long, sequence_id long, offset long, filled long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    shared_dir(docs.sparkSession)
    cut = stored(pieces(docs, vocabulary, capacity, id_col, text_col), "pieces")
    cut = stored(cut.withColumn("item", F.monotonically_increasing_id()), "numbered")
    whole = cut.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    parts = cut.filter(F.col("length") < capacity)
    places = group(parts.select("item", "length"), capacity, **options)
    return whole.drop("item").unionByName(parts.join(places, "item").drop("item"))
