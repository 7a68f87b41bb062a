import math
from fractions import Fraction

import numpy as np
import pytest

from vigil.llm import queries, whitening
from tests.conftest import SF0001

SCHEMA = "vec_id long, embedding array<float>, n int, whitened string"  # the last two clash with results


def orthogonal(d, seed):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]


@pytest.mark.parametrize("values", [
    np.arange(1, 25) ** 2.0,
    np.r_[np.full(6, 5.0), np.arange(1, 19)],                      # equal values
    5 + np.r_[np.arange(12) * 1e-9, np.arange(1, 13)],             # a cluster below float32
    np.r_[np.arange(4) * 1e-9 + 1, np.arange(4) * 1e-8 + 2, 1e-12 * np.arange(1, 17)],  # several, and a wide range
    np.zeros(5), np.array([3.0]), np.r_[np.zeros(7), 1.0],
])
def test_eigenvectors_hold_to_double_precision(values):
    q = orthogonal(len(values), 3).astype(np.longdouble)
    for _ in range(3):  # orthogonal beyond double precision
        q = q @ (1.5 * np.eye(len(values)) - q.T @ q / 2)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined_eigen(a)
    size = max(1e-300, np.abs(values).max())
    assert np.abs(np.sort(values)[::-1] - found).max() <= 1e-16 * size
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-16
    assert np.abs(a @ x - x * found).max() <= 1e-16 * size
    # single eigenvectors too, where a value stands apart by 1e-9 or more
    order = np.argsort(-values, kind="stable")
    for i, j in enumerate(order):
        apart = np.abs(np.delete(values, j) - values[j]).min(initial=np.inf)
        if apart >= 1e-9 * size:
            assert min(np.abs(x[:, i] - q[:, j]).max(), np.abs(x[:, i] + q[:, j]).max()) < 1e-16 * size / apart + 1e-16


def test_float32_alone_would_not_do():
    values = 5 + np.arange(8) * 1e-8
    q = orthogonal(8, 1)
    a = (q * values) @ q.T
    rough = np.linalg.eigh(a.astype(np.float32))[1]
    fine = whitening.refined_eigen(a.astype(np.longdouble))[1]
    off = lambda v: np.abs(v.T @ (a - 5 * np.eye(8)) @ v - np.diag(np.diag(v.T @ (a - 5 * np.eye(8)) @ v))).max()
    assert off(fine) < 1e-15 and off(rough.astype(float)) > 1e-9


def brute(rows):
    """Exact whole numbers and fractions, eigenvectors by LAPACK in double precision."""
    good = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in x])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    return [i for i, _ in good], n, deviation, centred, values[::-1], vectors[:, ::-1], np.trace(covariance)


def compare(found, rows):
    ids, n, deviation, centred, values, vectors, trace = brute(rows)
    k = min(8, int((values > trace * 1e-12).sum()))
    assert len(found) == len(ids) * k
    want_deviation = sorted(zip(map(str, ids), deviation))
    for c in range(1, k + 1):
        part = [r for r in found if r.component == c]
        assert sorted((str(r.vec_id), r.deviation) for r in part) == want_deviation
        assert {r.n for r in part} == {n}
        explained = part[0].explained
        assert abs(explained - values[c - 1] / trace) <= 1e-9 * explained
        onto = centred @ vectors[:, c - 1] / math.sqrt(values[c - 1])
        got, want = (sorted(zip(map(str, i), w)) for i, w in (([r.vec_id for r in part], [r.whitened for r in part]), (ids, onto)))
        signs = [s for s in (1, -1) if np.allclose([w for _, w in sorted((i, s * w) for i, w in got)],
                                                   [w for _, w in sorted(want)], atol=1e-7)]
        assert signs
    if found:
        white = np.array([[r.whitened for r in found if r.component == c] for c in range(1, k + 1)])
        assert len({r.identity_error for r in found}) == 1 and found[0].identity_error <= 1e-9
        assert abs(np.abs(white @ white.T / n - np.eye(k)).max()) <= 1e-9


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()]
    compare(queries.op11_whitening(spark, SF0001).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6)]) for i in range(300)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (7, rows[7][1]), (7, rows[7][1]), (901, [0.0] * 6), (902, [-0.0009765625] * 6)]
    odd = [(910, None), (911, []), (912, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (913, [float("nan")] * 6), (914, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], SCHEMA).repartition(7)
    compare(whitening.per_component(df).collect(), rows)


def test_partial_sums_meet_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=4)]) for i in range(200)]
    compare(whitening.per_component(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(9)).collect(), rows)


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(c)) * 3e6 for c in rng.normal(size=3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    _, n, deviation, *_ = brute(rows)
    assert {r.vec_id: int(r.deviation) for r in whitening.whiten(df, model).collect()} == dict(zip(range(40), deviation))
    assert max(deviation) > 2**63  # beyond a long: null in the query
    assert all(r.deviation is None or r.deviation < 2**63 for r in whitening.per_component(df).collect())
    huge = spark.createDataFrame([*rows, (99, [1e300, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(huge, whitening.fit(huge)).count() == 40


def test_other_lengths_and_rows_all_alike(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0]), (4, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    assert {r.vec_id for r in whitening.per_component(df).collect()} == {1, 2}
    alike = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    model = whitening.fit(alike)
    assert len(model.values) == 0 and [r.whitened for r in whitening.whiten(alike, model).collect()] == [[], []]
    assert whitening.per_component(alike).count() == 0
    empty = whitening.per_component(alike.limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
