import math
import random
from collections import Counter

import duckdb
import pytest

from vigil.llm import mixing
from vigil.llm.mixing import Target


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = []
    for source, n in (("hot", 900), ("mid", 120), ("low", 40), (None, 60), ("one", 1), ("empty", 3)):
        for _ in range(n):
            words = 0 if source == "empty" else rng.randrange(1, 60)
            rows.append((len(rows), " ".join(["w"] * words), source, 5))
    rows += [(3, rows[3][1], "hot", 5)] * 4 + [(None, "a b c", "hot", 5), (9000, None, "mid", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epochs long").repartition(5).cache()


def shares(docs):
    size = Counter()
    for r in docs.collect():
        size[r.source] += len((r.text or "").split())
    return {s: n for s, n in size.items() if n}


def weights(size, a):
    total = sum(size.values())
    w = {s: (n / total) ** a for s, n in size.items()}
    return {s: x / sum(w.values()) for s, x in w.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values() if x)


def bisect(ok, wants_small):
    low, high = 0.0, 1.0
    while wants_small and ok(high):
        low, high = high, 2 * high
    for _ in range(50):
        mid = (low + high) / 2
        if ok(mid) == wants_small:
            low = mid
        else:
            high = mid
    return low


def test_exponent_for_an_entropy(docs):
    size = shares(docs)
    goal = 0.8
    a = bisect(lambda a: entropy(weights(size, a)) >= goal * math.log(len(size)), True)
    table = docs.sparkSession.createDataFrame(list(size.items()), "source string, tokens long")
    assert mixing.find_exponent(table, Target(entropy=goal)) == pytest.approx(a, abs=1e-6)
    for goal in (0.01, 0.2, 0.3):  # less than the sources have: the exponent is above 1
        a = bisect(lambda a: entropy(weights(size, a)) >= goal * math.log(len(size)), True)
        assert a > 1 and mixing.find_exponent(table, Target(entropy=goal)) == pytest.approx(a, abs=1e-6)
    alike = docs.sparkSession.createDataFrame([("a", 5), ("b", 5)], "source string, tokens long")
    assert mixing.find_exponent(alike, Target(entropy=0.5)) == 1.0


def test_exponent_for_a_repetition_limit(docs):
    size = shares(docs)
    total = sum(size.values())
    table = docs.sparkSession.createDataFrame(list(size.items()), "source string, tokens long")
    for limit in (2.0, 5.0):
        a = mixing.find_exponent(table, Target(repetition=limit))
        most = max(w * total / size[s] for s, w in weights(size, a).items())
        assert most <= limit + 1e-6 and (a == 0 or most >= limit - 1e-4)


def test_budgets_are_met_by_whole_epochs_and_one_partial(docs):
    size = shares(docs)
    mixed = mixing.mix(docs, Target(entropy=0.8), block_docs=16).collect()
    a = bisect(lambda a: entropy(weights(size, a)) >= 0.8 * math.log(len(size)), True)
    spent, seen = Counter(), Counter()
    for r in mixed:
        spent[r.source] += r._tokens
        seen[r.source, r.doc_id, r.text, r._epoch] += 1
    total = sum(size.values())
    for s, w in weights(size, a).items():
        assert w * total - 60 <= spent[s] <= w * total + 1, s
    have = Counter((r.source, r.doc_id, r.text) for r in docs.collect())
    epochs = {s: int(spent[s] // size[s]) for s in size}
    for (s, i, t), n in have.items():
        for e in range(epochs.get(s, 0)):
            assert seen[s, i, t, e] == n  # whole epochs hold every row
    assert all(n <= have[k[:3]] for k, n in seen.items())


def test_every_document_is_covered(docs):
    mixed = mixing.mix(docs, Target(repetition=1.5, budget=None), block_docs=16)
    assert mixed.columns[:4] == docs.columns
    count = Counter((r.source, r.doc_id, r.text) for r in mixed.collect())
    have = Counter((r.source, r.doc_id, r.text) for r in docs.collect())
    assert set(count) == set(have)
    assert all(have[k] <= n <= 2 * have[k] for k, n in count.items())
    hot = Counter(k[0] for k in count.elements())["hot"]
    assert hot == sum(n for k, n in have.items() if k[0] == "hot")


def test_blocks_follow_their_permutation(docs):
    rows = mixing.mix(docs, Target(entropy=0.8), block_docs=16).collect()
    place = {}
    for r in rows:
        place.setdefault((r.source, r._epoch), {}).setdefault(r._block_rank, set()).add(r._block)
    for ranks in place.values():
        assert sorted(ranks) == list(range(len(ranks))) and all(len(b) == 1 for b in ranks.values())


def test_equals_the_sql_form(docs):
    plain = docs.filter("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL AND source <> 'empty'").dropDuplicates(["doc_id"]).cache()
    con = duckdb.connect()
    con.register("documents", plain.toPandas())
    expected = Counter(con.execute(mixing.oracle_sql(0.9, block_docs=16)).fetchall())
    got = Counter((r.doc_id, r.source, r._tokens, r._epoch, r._block, r._block_rank)
                  for r in mixing.mix(plain, Target(entropy=0.9), block_docs=16).collect())
    assert got == expected and len(got) > 500


def test_a_target_below_what_the_sources_have(docs):
    """The SQL form too; and rows without an id are spread over blocks by their texts."""
    plain = docs.filter("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL AND source <> 'empty'").dropDuplicates(["doc_id"]).cache()
    con = duckdb.connect()
    con.register("documents", plain.toPandas())
    got = mixing.mix(plain, Target(entropy=0.2), block_docs=16).collect()
    assert Counter(con.execute(mixing.oracle_sql(0.2, block_docs=16)).fetchall()) == Counter(
        (r.doc_id, r.source, r._tokens, r._epoch, r._block, r._block_rank) for r in got)
    assert {r.source for r in got if r._epoch > 0} == {"hot"}
    spark = docs.sparkSession
    rows = spark.createDataFrame([(None, f"text {i}", "s") for i in range(600)], "doc_id long, text string, source string")
    blocks = Counter(r._block for r in mixing.mix(rows, Target(repetition=1.5, budget=None), block_docs=32).collect())
    assert len(blocks) >= 15 and max(blocks.values()) < 100


def test_odd_and_no_documents(odd, none):
    for target in (Target(entropy=0.9), Target(repetition=2.0, budget=None)):
        assert mixing.mix(none, target).count() == 0
        assert mixing.mix(odd, target).count() >= 0
    cover = mixing.mix(odd, Target(repetition=2.0, budget=None))
    assert {r.text for r in cover.collect()} == {r.text for r in odd.collect()}


def test_targets_are_checked(odd):
    with pytest.raises(ValueError):
        mixing.mix(odd, Target())


def test_clashing_names(clashing):
    mixed = mixing.mix(clashing, Target(repetition=2.0, budget=None))
    assert mixed.columns == [*clashing.columns, "_tokens_", "_epoch_", "_block_", "_block_rank_"]
    at = clashing.columns.index("a.b")
    assert {(r.doc_id, r.text, r[at], r._tokens) for r in mixed.collect()} == {(r.doc_id, r.text, r[at], 3) for r in clashing.collect()}
