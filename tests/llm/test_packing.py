import random
import zlib

import numpy as np
import pytest

from tests.conftest import SF0001
from vigil.llm import packing
from vigil.llm.queries import op5_best_fit_packing


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check(rows, docs, encode, capacity=2048):
    """Every document's ids come back piece by piece, and sequences are gapless and within the capacity."""
    expected = []
    for r in docs:
        ids = encode(r.text)
        for k, low in enumerate(range(0, len(ids), capacity)):
            part = ids[low:low + capacity]
            expected.append((str(r.doc_id), k, low, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def test_odd_texts(odd, encode):
    check(packing.pack(odd, packing.default_vocabulary()).collect(), odd.collect(), encode)


def test_small_capacity_and_blocks_lose_nothing(odd, encode):
    rows = packing.pack(odd, packing.default_vocabulary(), capacity=16, block_items=8, islands=2).collect()
    check(rows, odd.collect(), encode, 16)


def test_query_uses_few_sequences(spark, encode):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    used, bound = check(op5_best_fit_packing(spark, SF0001).collect(), docs, encode)
    assert used <= bound * 1.01 + 1


def test_chunks_equal_the_tokenizer(encode):
    words = packing.Words(packing.default_vocabulary())
    texts = ["it's DON'T we'll <|endoftext|> x<|startoftext|>, <|ENDOFTEXT|> ÀÉ×÷ß. foo... bar?! éa 12a3 a0 Kİ 日本\xa0x y ﬁ İ", "",
             "\"quoted\", (paren) a--b c_d `x` \x1c\x1d 0 00 'S 's", "é å, ́x"]
    for t in texts:
        chunks = t.encode().split()
        words.learn([chunks])
        assert b"".join(map(words.__getitem__, chunks)) + b"\0" * 4 == encode(t).tobytes()


def test_evolution_beats_or_equals_best_fit():
    rng = random.Random(4)
    for _ in range(5):
        lengths = [rng.randrange(200, 900) for _ in range(120)]
        fit = packing.Fit(2048, [], lengths)
        fit.place(sorted(range(120), key=lambda x: -lengths[x]))
        best = packing.evolve(lengths, [], 1, 2048, 6, 40)
        assert sorted(x for b in best for x in b) == list(range(120))
        assert all(packing.fill(b, lengths) <= 2048 for b in best)
        assert len(best) <= len(fit.bins)


def test_crossover_injects_whole_bins_and_keeps_every_piece():
    rng = random.Random(7)
    lengths = [rng.randrange(1, 60) for _ in range(80)]
    a, b = (packing.Fit(100, [], lengths) for _ in range(2))
    a.place(list(range(80)))
    b.place(list(range(79, -1, -1)))
    child = packing.crossover(rng, a.bins, b.bins, lengths, 100)
    assert sorted(x for c in child for x in c) == list(range(80))
    assert all(packing.fill(c, lengths) <= 100 for c in child)
    assert any(sorted(c[:len(x)]) == sorted(x) for c in child for x in b.bins)


def test_no_documents(none):
    assert packing.pack(none, packing.default_vocabulary()).count() == 0


def islands_of(spark, run):
    """What the islands of the packings that ``run`` makes did."""
    import os

    from vigil.llm.common import shared_dir

    base = os.path.join(shared_dir(spark), "vigil")
    before = set(os.listdir(base)) if os.path.exists(base) else set()
    result = run()
    new = [d for d in os.listdir(base) if d not in before and d.startswith("islands-")]
    return result, [spark.read.parquet(os.path.join(base, d)) for d in new]


def test_the_query_evolves_over_several_tasks(spark):
    from pyspark.sql import functions as F

    _, epochs = islands_of(spark, lambda: op5_best_fit_packing(spark, SF0001).collect())
    assert len(epochs) >= 2
    done = [e.agg(F.sum("crossovers"), F.sum("migrants"), F.count("*")).first() for e in epochs]
    assert all(crossed == 4 * islands for crossed, _, islands in done)
    assert sum(migrants for _, migrants, _ in done) > 0
    items = spark.range(30_000).select(F.col("id").alias("item"), (F.col("id") * 7919 % 900 + 100).alias("length"))
    rows, epochs = islands_of(spark, lambda: packing.group(items, 2048).collect())
    assert len(rows) == 30_000
    most = max(epochs, key=lambda e: e.count())
    assert most.count() == 2 * 8 and most.select(F.input_file_name()).distinct().count() >= 4  # islands spread over tasks


def test_crossover_decides_where_best_fit_misses_the_bound(monkeypatch):
    """Triples that fill bins exactly: best fit needs more bins than evolution, and evolution without crossover too."""
    rng = random.Random(11)
    lengths = []
    for _ in range(60):
        a, b = rng.randint(25, 40), rng.randint(25, 40)
        lengths += [a, b, 100 - a - b]
    rng.shuffle(lengths)
    fit = packing.Fit(100, [], lengths)
    fit.place(sorted(range(len(lengths)), key=lambda x: -lengths[x]))
    seen = {}
    with_it = packing.evolve(lengths, [], 1, 100, 8, 1500, seen)
    assert seen["crossovers"] == 1500 and seen["better"] > 0
    monkeypatch.setattr(packing, "crossover", lambda rng, into, giver, lengths, capacity: [list(b) for b in into])
    without = packing.evolve(lengths, [], 1, 100, 8, 1500)
    assert len(with_it) < len(without) <= len(fit.bins) and len(fit.bins) > 60
