"""Semantic memory search cases (FIXTURES F7)."""

import pytest
from pyspark.sql import functions as F

from vigil.config import Params
from vigil.operators import memory as SM

DIM = 8
C_SCHEMA = "id string, kind string, incident_id string, source_ref string, workload string, category string, embedding array<float>"
Q_SCHEMA = "query_id string, embedding array<double>, kind string, workload string, category string, exclude_incident_id string"


def vec(*xs):
    return list(map(float, xs)) + [0.0] * (DIM - len(xs))


def P(**kw):
    base = dict(window_seconds=300, slide_seconds=60, cooldown_seconds=900, recovery_seconds=600, embedding_dim=DIM)
    base.update(kw)
    return Params(**base)


def run(spark, corpus, queries, relaxed=False, blocks=3, **kw):
    c = spark.createDataFrame(corpus, C_SCHEMA)
    q = spark.createDataFrame(queries, Q_SCHEMA)
    rows = SM.search(c, q, P(**kw), relaxed=relaxed, blocks=blocks).orderBy("query_id", "rank").collect()
    return [(r.query_id, r.id, r.mode) for r in rows], rows


def mem(i, v, kind="incident", inc=None, wl=None, cat=None):
    return (i, kind, inc, f"{kind}/{i}", wl, cat, vec(*v))


def test_ranking_and_cutoff(spark):
    corpus = [mem("close", (1, .05, 0)), mem("unrelated", (0, 1, 0)), mem("opposite", (-1, 0, 0))]
    out, _ = run(spark, corpus, [("q", vec(1, 0, 0), "incident", None, None, None)], max_distance=2.0)
    assert [o[1] for o in out] == ["close", "unrelated", "opposite"]
    corpus = [mem("close", (1, .02, 0)), mem("unrelated", (0, 1, 0))]
    out, _ = run(spark, corpus, [("q", vec(1, 0, 0), "incident", None, None, None)], max_distance=0.3)
    assert [o[1] for o in out] == ["close"]


def test_facet_and_self_exclusion(spark):
    corpus = [mem("same", (.6, .8, 0), wl="order-api"), mem("other", (1, 0, 0), wl="payment-simulator"),
              mem("self", (1, 0, 0), inc="inc-1", wl="order-api")]
    out, _ = run(spark, corpus, [("q", vec(1, 0, 0), "incident", "order-api", None, "inc-1")], max_distance=2.0)
    assert [o[1] for o in out] == ["same"]


def test_confidence(spark):
    _, rows = run(spark, [mem("same", (1, 0, 0))], [("q", vec(1, 0, 0), "incident", None, None, None)], top_k=1)
    df = spark.createDataFrame([(rows[0].distance,)], "d double")
    (c,) = df.select(SM.retrieval_confidence("d").alias("c")).collect()
    assert 0.99 < c.c <= 1.0


@pytest.mark.parametrize("blocks", [1, 4])
def test_relaxed_fallback(spark, blocks):
    corpus = [mem("rb", (1, 0), kind="runbook", cat="dependency_latency")]
    q = [("q", vec(1, 0), "runbook", None, "http_error_rate", None)]
    strict, _ = run(spark, corpus, q, blocks=blocks, max_distance=0.65)
    relaxed, _ = run(spark, corpus, q, blocks=blocks, relaxed=True, max_distance=0.65)
    assert strict == [] and relaxed == [("q", "rb", "relaxed")]
    corpus = [mem("oom", (0, 1), kind="runbook", cat="out_of_memory")]
    out, _ = run(spark, corpus, [("q", vec(1, 0), "runbook", None, None, None)], relaxed=True, max_distance=0.3)
    assert out == []




@pytest.mark.parametrize("tiles", [(2, 50), (256, 8192)])
def test_top_k_across_blocks_matches_brute_force(spark, tiles, monkeypatch):
    import random

    monkeypatch.setattr(SM, "QUERY_TILE", tiles[0])
    monkeypatch.setattr(SM, "MEMORY_TILE", tiles[1])
    random.seed(3)
    corpus = [mem(f"m{i:03d}", [random.uniform(-1, 1) for _ in range(DIM)]) for i in range(300)]
    queries = [(f"q{j}", vec(*[random.uniform(-1, 1) for _ in range(DIM)]), "incident", None, None, None) for j in range(7)]
    out, rows = run(spark, corpus, queries, max_distance=2.0, top_k=5)
    c = spark.createDataFrame(corpus, C_SCHEMA)
    q = spark.createDataFrame(queries, Q_SCHEMA).withColumnRenamed("embedding", "qv")
    from pyspark.sql import Window, functions as F

    bf = c.crossJoin(q.select("query_id", "qv")).withColumn("d", SM.cosine_distance("embedding", "qv"))
    bf = bf.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))).filter("r <= 5")
    want = sorted((r.query_id, r.id) for r in bf.collect())
    assert sorted((a, b) for a, b, _ in out) == want


def test_sections_and_hash(spark):
    md = "intro dropped\n# Title \n## Symptoms\nline one\n\n## Empty\n\n## \nno title, dropped\n## Last\n## Causes\ncause\r\n"
    df = spark.createDataFrame([("out-of-memory", md)], "file_name string, markdown string")
    s = SM.runbook_category(SM.split_sections(df)).orderBy("section_no").collect()
    assert [(r.heading, r.body, r.source_ref) for r in s] == [
        ("Symptoms", "line one", "out-of-memory#symptoms"), ("Empty", "", "out-of-memory#empty"),
        ("Causes", "cause", "out-of-memory#causes")]
    assert s[0].doc_title == "Title" and s[0].category == "out_of_memory"
    assert s[0].content == "Title\nSymptoms\n\nline one"


def test_ann_recall_against_exact(spark):
    """Cells + exact re-rank: distances are exact, recall is high, facets and
    self-exclusion hold, and far fewer pairs are looked at than there are."""
    import random

    random.seed(11)
    centers = [[random.gauss(0, 1) for _ in range(DIM)] for _ in range(6)]
    corpus = []
    for i in range(400):
        c = centers[i % 6]
        corpus.append(mem(f"m{i:03d}", [x + random.gauss(0, 0.15) for x in c], inc=f"inc-{i}", wl=f"w{i % 2}"))
    queries = [(f"q{j}", vec(*[x + random.gauss(0, 0.15) for x in centers[j % 6]]), "incident", "w1" if j % 3 else None, None, f"inc-{j}")
               for j in range(12)]
    c = spark.createDataFrame(corpus, C_SCHEMA)
    q = spark.createDataFrame(queries, Q_SCHEMA)
    p = P(max_distance=0.5, top_k=5, ann_cells=24, ann_probes=6)
    exact_rows = SM.search(c, q, p, relaxed=True).collect()
    exact = {(r.query_id, r.id): r.distance for r in exact_rows}
    approx = SM.ann_search(c, q, p).collect()
    for r in approx:
        assert r.incident_id != "inc-" + r.query_id[1:]
        if (r.query_id, r.id) in exact:
            assert abs(r.distance - exact[(r.query_id, r.id)]) < 1e-9
    recall = len({(r.query_id, r.id) for r in approx} & set(exact)) / len(exact)
    assert recall >= 0.9, recall
    index, cells = SM.ann_index(c, p)
    assert (len(cells.centres), cells.probes, cells.survivors) == (24, 6, 20)
    left = SM.survivors(index, cells, q)
    assert left.count() < 0.1 * 400 * 12
    # cells and probes by themselves
    trained = SM.ann_index(c, P(max_distance=0.5, top_k=5))[1]
    assert len(trained.centres) == 12 and trained.probes <= 4
    assert SM.ann_index(c.limit(0), p) is None and SM.ann_search(c.limit(0), q, p).count() == 0


def clustered(spark, n=3000, dims=16, groups=30, seed=4):
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    x = centres[rng.integers(0, groups, n)] + rng.normal(scale=0.05, size=(n, dims))
    rows = [(f"m{i:05d}", "incident", f"i{i}", f"s{i}", None, None, v.tolist()) for i, v in enumerate(x)]
    rows += [("zero", "incident", None, "z", None, None, [0.0] * dims), ("none", "incident", None, "n", None, None, None),
             ("nan", "incident", None, "n", None, None, [float("nan")] * dims)]
    queries = [(f"q{i}", x[i * 7].tolist(), "incident", None, None, f"i{i * 7}") for i in range(20)]
    queries += [("qzero", [0.0] * dims, "incident", None, None, None)]
    return spark.createDataFrame(rows, C_SCHEMA), spark.createDataFrame(queries, Q_SCHEMA), x


def test_blocks_that_cannot_hold_a_match_are_skipped(spark, monkeypatch):
    """The same rows as with one block; most (query, block) pairs are left out; a block is cut at a number of rows."""
    import numpy as np

    from vigil.operators import vectors as V

    monkeypatch.setattr(V, "CELL_ROWS", 64)
    monkeypatch.setattr(V, "QUERY_ROWS", 8)
    c, q, x = clustered(spark)
    p = P(max_distance=2.0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for i in range(20):
        d = 1 - unit @ unit[i * 7]
        d[i * 7] = np.inf
        want += [(f"q{i}", f"m{j:05d}") for j in sorted(range(len(x)), key=lambda j: (round(d[j], 12), j))[:p.top_k]]
    for blocks in (1, 40):
        assert sorted((r.query_id, r.id) for r in SM.search(c, q, p, blocks=blocks).collect()) == sorted(want)
    cells = V.train(c.select("id", "embedding"), 5, cells=40, probes=1)
    rows = V.in_cells(V.nonzero(c), cells, codes=False)
    radius = {r.cell: r.r for r in rows.groupBy("cell").agg(F.max("angle").alias("r")).collect()}
    some = V.sample(rows, 3000, [k for k in SM.CORPUS_COLUMNS if k != "source_ref"], 2048)
    needed = SM.needed_cells(V.nonzero(q), cells, radius, some, p).count()
    assert needed < 0.2 * 20 * len(radius)
    parts = V.in_parts(rows)[0].groupBy("cell", "part").count()
    assert parts.agg(F.max("count")).first()[0] < 150


def test_estimates_come_from_codes(spark):
    """A code takes a quarter of a byte a dimension, and estimated cosines are close to the true ones."""
    import numpy as np

    from vigil.operators import vectors as V

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 30))
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>")
    cells = V.train(df, 5)
    unit = V.unit_rows(x)
    cell = V.nearest(unit, cells.centres)[0]
    codes = cells.encode(unit, cell)
    assert codes.shape == (2000, 8) and codes.dtype == np.uint8
    for k in range(3):
        rows = np.flatnonzero(cell == k)
        got = cells.scores(unit[:50], k, codes[rows])
        assert np.abs(got - unit[:50] @ unit[rows].T).std() < 0.06
    assert 0 < cells.probes <= len(cells.centres)


def test_queries_are_copied_to_their_cells_by_spark(spark):
    """A Python task gives one row a query, however many cells it needs."""
    import numpy as np
    import pandas as pd

    from vigil.operators import vectors as V

    angles = np.linspace(0, 2 * np.pi, 8, endpoint=False)
    centres = np.zeros((8, DIM))
    centres[:, 0], centres[:, 1] = np.cos(angles), np.sin(angles)
    q = spark.createDataFrame([("q0", vec(1.0), "incident", None, None, None)], Q_SCHEMA)
    p = P(max_distance=2.0, top_k=5)
    found = SM.needed_cells(q, V.Cells(centres, np.zeros((0, 0, 0)), 1, 1), dict.fromkeys(range(8), 0.1), pd.DataFrame(), p)
    assert sorted(r.cell for r in found.collect()) == list(range(8))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(cells") < plan.index("MapInPandas")


def test_a_query_returns_its_best_rows_once_a_task_not_once_a_cell(spark, monkeypatch):
    c, q, _ = clustered(spark)
    p = P(max_distance=2.0, ann_cells=40, ann_probes=40)
    index, cells = SM.ann_index(c, p)
    seen, passing = [], SM._passing_by
    monkeypatch.setattr(SM, "_passing_by", lambda *a: seen.append(passing(*a)) or seen[-1])
    left = SM.survivors(index, cells, q)
    assert (len(cells.centres), cells.probes) == (40, 40)
    assert seen[0].count() == left.count() == 20 * cells.survivors


def test_nearest_keeps_the_best_by_score_and_id(monkeypatch):
    """Against a plain sort, with ties, facets, cells that a query does not need, and few rows waiting at a time."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(SM, "WAITING", 50)
    monkeypatch.setattr(SM, "QUERY_TILE", 3)
    monkeypatch.setattr(SM, "MEMORY_TILE", 16)
    rng = np.random.default_rng(1)
    queries = pd.DataFrame({"query_id": [f"q{i}" for i in range(7)], "kind": ["a", "b", None, "a", " ", "a", "z"],
                            "workload": ["w0", None, "w1", "", "w0", "w2", None], "category": [None, "c1", None, None, "c0", None, None],
                            "exclude_incident_id": ["i3", None, "i5", "i9", None, "none", None]})
    n = 90
    part = pd.DataFrame({"id": [f"m{i * 7 % n:02d}" for i in range(n)], "kind": [["a", "b", None][i % 3] for i in range(n)],
                         "incident_id": [None if i % 4 == 0 else f"i{i % 11}" for i in range(n)],
                         "workload": [None if i % 5 == 0 else f"w{i % 2}" for i in range(n)], "category": [None if i % 2 else f"c{i % 3}" for i in range(n)]})
    cell, needed = np.arange(n) // 30, rng.random((7, 3)) < 0.7
    score = rng.integers(0, 6, (7, n)) / 4.0
    base, strict = SM._allowed(queries, part)
    for i, r in queries.iterrows():
        for j, m in part.iterrows():
            own = (r.kind is None or not r.kind.strip() or r.kind == m.kind) and (
                r.exclude_incident_id is None or m.incident_id is None or r.exclude_incident_id != m.incident_id)
            like = all(not (r[f] or "").strip() or m[f] is None or r[f] == m[f] for f in ("workload", "category"))
            assert (base[i, j], strict[i, j]) == (own, own and like)
    near = SM.Nearest(queries, 4, 1.0, True, ["id"])
    for a in range(0, n, 45):
        near.meet(part.iloc[a:a + 45], cell[a:a + 45], needed, lambda at, some: score[at][:, a + some])
    got = {(r.query_id, r.mode, r.id, r.score) for r in near.best().itertuples()}
    want = set()
    for i in range(7):
        for mode, mask in (("strict", strict[i]), ("relaxed", base[i] & SM._facetted(queries)[i])):
            best = sorted((score[i, j], part["id"][j]) for j in range(n) if mask[j] and needed[i, cell[j]] and score[i, j] <= 1.0)[:4]
            want |= {(f"q{i}", mode, k, s) for s, k in best}
    assert got == want
