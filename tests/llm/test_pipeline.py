"""Each stage on its own input against a plain form of its rule, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF0001
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_packing import check as check_packing
from tests.llm.test_packing import encode  # noqa: F401
from tests.llm.test_simhash import brute_components, plain_fingerprint
from vigil.llm import quality
from vigil.llm.common import stored


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF0001), name))
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "source_mixing", "best_fit_packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert all(s.schema.simpleString() == stages[0].schema.simpleString() for s in stages[:-1])


def test_quality_rules(stages):
    spark = stages[0].sparkSession
    learned = quality.learn(stages[0], spark.read.parquet(f"{SF0001}/labels.parquet"))
    judge = quality.Judge(quality.Rules(), learned)
    expected = sorted(r.doc_id for r in stages[0].collect() if judge.measure((r.text or "").encode())[6])
    assert sorted(r.doc_id for r in stages[1].collect()) == expected
    assert 0 < len(expected) < stages[0].count()


def test_line_dedup(stages):
    expected = {i: t for i, t, _, _ in brute_lines(stages[1].collect(), corpus_pipeline.MIN_SITES)}
    rows = stages[2].collect()
    assert {str(r.doc_id): r.text for r in rows} == expected
    assert all(r.n_chars == len(r.text) for r in rows)


def test_near_duplicates(stages):
    rows = sorted(stages[2].collect(), key=lambda r: r.doc_id)
    roots = brute_components([plain_fingerprint(r.text) for r in rows], 4)
    first = {}
    for r, c in zip(rows, roots):
        first.setdefault(c, r)
    kept = {r.doc_id: r for r in stages[3].collect()}
    assert kept == {r.doc_id: r for r in first.values()}
    assert stages[3].count() == len(kept)


def test_source_mixing(stages):
    before, after = stages[3].collect(), stages[4].collect()
    copies = {}
    for r in after:
        copies[r] = copies.get(r, 0) + 1
    assert set(copies) == set(before)  # every document stays
    assert max(copies.values()) <= 2
    size, taken = {}, {}
    for rows, to in ((before, size), (after, taken)):
        for r in rows:
            to[r.source] = to.get(r.source, 0) + len((r.text or "").split())
    assert all(taken[s] <= corpus_pipeline.MAX_REPETITION * size[s] + 1 for s in size if size[s])


def test_packing(stages, encode):  # noqa: F811
    used, bound = check_packing(stages[5].collect(), stages[4].collect(), encode)
    assert used <= bound * 1.02 + 1


def test_run_and_registration(spark, stages):
    from vigil.llm.queries import QUERIES

    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES if k.startswith("op")}
    found = QUERIES["pipeline"](spark, SF0001)
    assert found.columns == stages[-1].columns
    assert abs(found.count() - stages[-1].count()) == 0


def test_no_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF0001)
    assert docs.count() == 0


def test_odd_texts_under_clashing_names(spark, clashing):
    """Every stage keeps the documents' own columns, whatever their names, and the values of what it keeps."""
    docs = clashing.withColumn("lang", F.lit("en"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF0001)
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString(), name
        own = [c for c in docs.columns if c not in ("text", "n_chars")]
        at = [docs.columns.index(c) for c in own]
        values = {tuple(r[i] for i in at) for r in before.collect()}
        assert {tuple(r[i] for i in at) for r in after.collect()} <= values, name
        before = stored(after, name) if name != "quality_rules" else before  # the rules reject most odd texts; the others get them all
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF0001)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}


def test_mixing_evens_sources_of_unlike_size(spark):
    sources = spark.createDataFrame([("a", 100_000, 10), ("b", 190_000, 10)], "source string, tokens long, docs long")
    from vigil.llm import mixing

    weights = mixing.weights(sources, mixing.Target(repetition=corpus_pipeline.MAX_REPETITION, budget=None))
    assert {r.source: r.budget for r in weights.collect()} == {"a": 190_000, "b": 190_000}
