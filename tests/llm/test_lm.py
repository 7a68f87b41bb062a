import math
import re
from collections import Counter

import pytest

from vigil.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, order, backoff, least):
    docs = [words_of(t) for t in texts]
    counts = Counter(tuple(d[i:i + n]) for d in docs for n in range(1, order + 1) for i in range(len(d) - n + 1))
    total = sum(map(len, docs))
    out = []
    for d in docs:
        score, back = 0.0, 0
        for i in range(len(d)):
            most = min(order, i + 1)
            n = next(n for n in range(most, 0, -1) if n == 1 or counts[tuple(d[i - n + 1:i + 1])] >= least)
            gram = tuple(d[i - n + 1:i + 1])
            score += math.log(counts[gram] / (counts[gram[:-1]] if n > 1 else total)) + (most - n) * math.log(backoff)
            back += n < most
        out.append((len(d), back, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("block_bytes", [300, 8 << 20])
def test_scores_equal_brute_force(spark, odd, order, block_bytes):
    text = "the cat sat on the mat and the dog sat on the log"
    rows = [(100 + i, " ".join(text.split()[i % 7:][: 3 + i % 9]) + (" Sat on\tTHE mat" if i % 3 else ""), None, None) for i in range(60)]
    docs = odd.filter("length(text) < 1000 OR text IS NULL").union(spark.createDataFrame(rows, odd.schema))
    collected = docs.collect()
    expected = sorted(zip((str(r.doc_id) for r in collected), brute([r.text for r in collected], order, 0.4, 2)))
    got = sorted((str(r.doc_id), (r.n_words, r.n_backoff, r.log_score)) for r in lm.score(docs, order, block_bytes=block_bytes).collect())
    assert [(i, x[:2]) for i, x in got] == [(i, x[:2]) for i, x in expected]
    assert [x[2] for _, x in got] == pytest.approx([x[2] for _, x in expected], abs=1e-8)


def test_counts_of_any_size_are_packed():
    import numpy as np

    counts = np.array([1, 254, 255, 256, 2**40, 3])
    assert (lm._unpack(*lm._pack(counts)) == counts).all()


def test_very_long_texts(odd):
    long = odd.filter("length(text) >= 1000")
    collected = {r.doc_id: r for r in lm.score(long).collect()}
    assert collected[7].n_words == 40_000 and collected[8].n_words == 1


def test_no_documents(none):
    assert lm.score(none).count() == 0


def test_packed_hashes_come_back():
    import numpy as np

    for n in (1, 2, 5000):
        hashes = np.unique(np.random.default_rng(n).integers(0, 2**64, n, np.uint64))
        hashes[-1] = 2**64 - 1
        assert (lm._unpack_hashes(*lm._pack_hashes(hashes)) == hashes).all()
    assert len(lm._unpack_hashes(*lm._pack_hashes(hashes[:0]))) == 0


def test_query_scores_by_trigrams_as_brute_force_and_its_sql(spark):
    import duckdb

    from tests.conftest import SF0001
    from vigil.llm.queries import ORACLE_SQL, op8_backoff_scores

    collected = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    expected = sorted(zip((r.doc_id for r in collected), brute([r.text for r in collected], 3, 0.4, 2)))
    got = sorted((r.doc_id, (r.n_words, r.n_backoff, r.log_score)) for r in op8_backoff_scores(spark, SF0001).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF0001}/documents.parquet')")
    twin = sorted((r[0], r[1:]) for r in con.execute(ORACLE_SQL["op8_backoff_scores"]).fetchall())
    for found in (got, twin):
        assert [(i, x[:2]) for i, x in found] == [(i, x[:2]) for i, x in expected]
        assert [x[2] for _, x in found] == pytest.approx([x[2] for _, x in expected], abs=2e-6)
