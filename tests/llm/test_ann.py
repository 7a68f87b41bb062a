import math
import random

import numpy as np
import pytest

from tests.conftest import SF0001
from vigil.llm import ann
from vigil.llm.queries import op1_graph_ann

SMALL = ann.Graph(shard_vectors=150, degree=16, build_beam=32, batch=64)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, queries, k=5):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and usable(v)})
    out = {}
    for q, v in queries:
        if q is None or not usable(v):
            continue
        a = np.array(v, float)
        found = []
        for i, w in rows:
            if i != q and len(w) == len(v):
                b = np.array(w, float)
                found.append((-float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum()))), i))
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(found, exact):
    hit = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in e}) for q, e in exact.items())
    return hit / sum(map(len, exact.values()))


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()]
    exact = brute(rows, [r for r in rows if r[0] % 50 == 0])
    found = by_query(op1_graph_ann(spark, SF0001))
    assert set(found) == set(exact)
    assert recall(found, exact) >= 0.95
    for q, e in exact.items():
        scores = dict(e)
        assert all(s == pytest.approx(scores[i], abs=1e-12) for i, s in found[q] if i in scores)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(700)]
    centre = rng.normal(size=24)
    rows += [(1000 + i, (centre + 0.05 * rng.normal(size=24)).tolist()) for i in range(200)]  # a tight cluster
    rows += [(2000 + i, rows[0][1]) for i in range(300)]  # a hot vector
    rows += [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [None] + [1.0] * 23), (3004, [math.nan] * 24), (3005, [math.inf] * 24),
             (None, rows[3][1]), (3006, [1.0, 2.0]), (3007, [2.0, 1.0]), (3008, [3.0] * 5), (50, rows[50][1])]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3).cache()


def test_shards_ties_and_unusable_vectors(planted):
    rows = [(r.vec_id, r.embedding) for r in planted.collect()]
    asked = planted.filter("vec_id % 50 = 0 OR vec_id >= 3000 OR vec_id IS NULL")
    exact = brute(rows, [(r.vec_id, r.embedding) for r in asked.collect()])
    index = ann.index(planted, graph=SMALL)
    assert index.select("shard").distinct().count() > 3
    found = by_query(ann.search(index, asked, block=20))
    assert recall(found, exact) >= 0.95
    for q in (2000, 2050):  # the hot vector: exact ties, smallest ids first
        assert [i for i, _ in found[q]] == [i for i, _ in exact[q]] == [i for i in (0, 2000, 2001, 2002, 2003, 2004) if i != q][:5]
    assert [i for i, _ in found[3006]] == [3007] and 3008 not in found
    assert not {3000, 3001, 3002, 3003, 3004, 3005, None} & set(found)


def test_every_vector_is_indexed_once(planted):
    index = ann.index(planted, graph=SMALL)
    held = {tuple(r.vector) for r in index.collect()}
    assert held == {tuple(r.embedding) for r in planted.collect() if r.vec_id is not None and usable(r.embedding)}
    assert index.count() == len(held)


def test_no_vectors(planted):
    assert ann.search(ann.index(planted.limit(0)), planted.limit(0)).count() == 0
    assert ann.search(ann.index(planted.limit(0)), planted).count() == 0


def shards_of(kind, n=16_384, dims=64, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "gauss":
        return rng.normal(size=(n, dims))
    centres = rng.normal(size=(kind, dims))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(0, kind, n)] + 0.02 * rng.normal(size=(n, dims))
    x[rng.random(n) < 0.1] = x[0]  # a hot vector
    return x


@pytest.mark.parametrize("kind", [30, 60, 200, "gauss"])
def test_recall_of_full_shards(spark, kind):
    """Two shards or more of the production size; every 50th row is a query."""
    x = shards_of(kind).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = ann.index(df)
    assert index.select("shard").distinct().count() >= 2
    found = by_query(ann.search(index, df.filter("vec_id % 50 = 0")))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits, none = 0, 0
    asked = range(0, len(x), 50)
    for q in asked:
        s = np.round(unit @ unit[q], 12)
        s[q] = -2
        best = np.lexsort((np.arange(len(x)), -s))[:5]
        hit = len({i for i, _ in found[q]} & set(best.tolist()))
        hits, none = hits + hit, none + (hit == 0)
    assert none == 0 and hits / (5 * len(asked)) >= 0.95


def test_more_neighbours_than_the_index_keeps(planted):
    index = ann.index(planted, graph=SMALL)
    with pytest.raises(ValueError):
        ann.search(index, planted, k=6)
    found = by_query(ann.search(ann.index(planted, graph=SMALL, keep_ids=21), planted.filter("vec_id = 2000"), k=20))
    assert [i for i, _ in found[2000]] == [0, *range(2001, 2020)]


def test_squares_beyond_double_range(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e-200, 1e-201]), (3, [0.0, 5e-324]), (4, [-1e300, 1e299]), (5, [3.0, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = by_query(ann.search(ann.index(df), df))
    assert [i for i, _ in found[2]] == [5, 1, 3, 4] and all(math.isfinite(s) for f in found.values() for _, s in f)
    assert found[2][0][1] == pytest.approx(1.0, abs=1e-12)
