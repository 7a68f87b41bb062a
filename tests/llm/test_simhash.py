import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from vigil.llm import simhash
from vigil.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def plain_fingerprint(text, size=4):
    words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    votes = [0] * 64
    for s in shingles:
        h = xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute_components(prints, bits):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        words = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.choice([0, 1, 3, 4, 5, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            if len(words) > 50 and rng.random() < 0.8:
                words = list(words)
                words[rng.randrange(len(words))] = "changed"
            sep = rng.choice([" ", "\n", "\t ", "\x0b"])
            rows.append((len(rows), sep.join(words), "x"))
    rows += [(900, None, None), (901, "", "x"), (902, " \n", "x"), (5, rows[5][1], "x"), (None, "Ünï çode wörd A B", "y"),
             (903, "w " * 30_000 + "long", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string")


def test_groups_equal_brute_force(docs):
    rows = docs.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    roots = brute_components(prints, 4)
    best = {}
    for r, c in zip(rows, roots):
        if r.doc_id is not None:
            best[c] = min(best.get(c, r.doc_id), r.doc_id)
    expected = sorted((str(r.doc_id), p, best.get(c)) for r, p, c in zip(rows, prints, roots))
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.groups(docs).collect())
    assert got == expected


def test_one_of_each_group_stays_with_all_columns(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = docs.collect()
    n = len(set(brute_components([plain_fingerprint(r.text) for r in rows], 4)))
    assert kept.count() == n


def test_every_pair_within_the_bits_shares_a_key():
    rng = random.Random(1)
    parts, sets = simhash.ring(7), simhash.chain_keys(7, 4)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        equal = {i for i, (at, w) in enumerate(parts) if not x >> at & (1 << w) - 1}
        assert any(set(s) <= equal for s in sets)
        assert len(simhash.within(np.array([x], np.uint64), 7, 4)) == 1
    far = np.array([sum(1 << b for b in rng.sample(range(64), rng.randrange(5, 64))) for _ in range(500)], np.uint64)
    assert len(simhash.within(far, 7, 4)) == 0


@pytest.mark.parametrize("max_run", [3, 8])
def test_long_runs_in_blocks_lose_no_link(spark, max_run):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(40), rng.randrange(5))) for _ in range(60)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, max_run=max_run))
    named = {r.node: r.component for r in got.collect()}
    roots = brute_components(prints, 4)
    for i, p in enumerate(signed):
        for j, q in enumerate(signed[:i]):
            assert (roots[i] == roots[j]) == (named.get(p, p) == named.get(q, q))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b")
    rows = components(links).collect()
    assert len(rows) == 200 and {r.component for r in rows} == {0}
