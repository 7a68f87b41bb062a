"""Whitening of vectors by eigenvectors refined in mixed precision.

Entries become whole numbers, floor(scale * c) + shift, so sums over all rows
are exact. Tasks add up products of vectors centred on the whole numbers
nearest to the means; a sum is kept as a pair of doubles, and the pairs of all
tasks are added in two levels by Spark. The covariance that results is of the size
dimensions x dimensions, whatever the number of rows, and is all that the driver sees.

Its eigenvectors are first taken in float32. Each step of Ogita and Aishima's
refinement then corrects them by matrix products in higher precision (numpy's
long double) and doubles their right digits. Where eigenvalues lie closer
than the step can tell apart, the step corrects only the cluster's space; the
covariance, shifted by the cluster's mean, is projected on that space and
solved there, which tells the members apart (sub-solves).

Defined results: a row takes no part if its vector is null or empty, holds a null, NaN or
infinite entry, or one whose whole number does not fit (2**62); vectors of another length than most
(ties: the longer) take no part either. Repeated rows count each and give the same
result; a null id is kept. Components of eigenvalue 0 (to double precision) are left out, so rows that are
all alike, or a single one, give empty ``whitened``; an empty table gives
an empty table. A deviation of 39 digits or more is null. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm import common  # noqa: F401  functions travel to workers by value

FAN = 64  # partial sums added together in the first level


@dataclass(frozen=True)
class Model:
    """``components``: unit eigenvectors as columns, by falling eigenvalue; ``identity_error``: largest absolute
    entry of the whitened rows' covariance minus the identity, measured over all rows."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    scale: int = 1024
    shift: int = 100_000
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def usable(vector: Column, scale: int) -> Column:
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) * scale < float(2**62), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & good


def _whole(batch: pa.RecordBatch, scale: int, shift: int) -> np.ndarray:
    column = batch.column("vector")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).astype(np.int64).reshape(len(column), -1) + shift


def _two_sum(high, low, more_high, more_low):
    """The sum of two pairs of doubles as a pair (without rounding, but in the last place of the lower)."""
    s = high + more_high
    b = s - high
    rest = (high - (s - b)) + (more_high - b) + low + more_low
    top = s + rest
    return top, rest - (top - s)


# --- sums over all rows ----------------------------------------------------------------

def _sums(rows: DataFrame, dims: int, scale: int, shift: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            x = _whole(batch, scale, shift)
            n += len(x)
            total += (x >> 31).sum(0).astype(object) * (1 << 31) + (x & (2**31 - 1)).sum(0).astype(object)
        if n:
            yield pa.record_batch({"dim": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims, pa.int64()),
                                   "total": pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))})

    parts = rows.select("vector").mapInArrow(run, "dim int, n long, total decimal(38,0)")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()  # a row per dimension
    return int(found[0]["n"]), [int(r["total"]) for r in found]


def _products(rows: DataFrame, dims: int, centre: list[int], scale: int, shift: int) -> np.ndarray:
    """Sum over rows of y y' (y: the vector less ``centre``), in long double."""
    schema = "i int, slot int, high array<double>, low array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((dims, dims)), np.zeros((dims, dims))
        about = np.array(centre, np.int64)
        for batch in batches:
            y = (_whole(batch, scale, shift) - about).astype(np.float64)
            high, low = _two_sum(high, low, y.T @ y, 0.0)
        yield _triangle(np.arange(dims), TaskContext.get().partitionId() // FAN, [high[i, i:] for i in range(dims)],
                        [low[i, i:] for i in range(dims)])

    def add(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1)
        high, low = (np.array(first[c][0].as_py()) for c in ("high", "low"))
        for r in range(1, group.num_rows):
            high, low = _two_sum(high, low, *(group[c][r].values.to_numpy() for c in ("high", "low")))
        return pa.Table.from_batches([_triangle(first["i"].to_numpy(), 0, [high], [low])])

    parts = rows.select("vector").mapInArrow(run, schema)
    for key in (["i", "slot"], ["i"]):
        parts = parts.groupBy(*key).applyInArrow(add, schema)
    out = np.zeros((dims, dims), np.longdouble)
    for r in parts.collect():  # a row per dimension
        out[r["i"], r["i"]:] = np.array(r["high"], np.longdouble) + np.array(r["low"], np.longdouble)
    return np.triu(out) + np.triu(out, 1).T


def _triangle(i: np.ndarray, slot: int, high: list[np.ndarray], low: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch({"i": pa.array(i, pa.int32()), "slot": pa.array([slot] * len(high), pa.int32()),
                            "high": pa.array(high, pa.list_(pa.float64())), "low": pa.array(low, pa.list_(pa.float64()))})


# --- eigenvectors ------------------------------------------------------------------------

def refined_eigen(matrix: np.ndarray, steps: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, both in long double."""
    size = np.abs(matrix).max(initial=0)
    if size == 0:
        return np.zeros(len(matrix), np.longdouble), np.eye(len(matrix), dtype=np.longdouble)
    a = matrix.astype(np.longdouble) / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    before = np.inf
    for _ in range(steps):
        x, values, close, change = _correct(a, x)
        x = _solve_clusters(a, x, values, close)
        if change <= np.finfo(np.longdouble).eps * len(a) or (change < 1e-12 and change > before / 2):
            break
        before = change
    # values closer than precision can part leave their vectors free to lean on each other: made orthogonal at the end
    for _ in range(2):
        x = x + x @ (np.eye(len(a), dtype=np.longdouble) - x.T @ x) / 2
    values = np.diag(x.T @ (a @ x))
    order = np.argsort(-values)
    return values[order] * size, x[:, order]


def _correct(a: np.ndarray, x: np.ndarray):
    """One refinement step: better vectors, their values, the distance below which values count as close, the change."""
    r = np.eye(len(a), dtype=np.longdouble) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    close = 2 * (np.linalg.norm(off.astype(np.float64)) + np.linalg.norm(a.astype(np.float64)) * np.linalg.norm(r.astype(np.float64)))
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > close
    e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
    np.fill_diagonal(e, np.diag(r) / 2)
    return x + x @ e, values, close, np.abs(e).max()


def _solve_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, close: float) -> np.ndarray:
    """Members of clusters told apart in the cluster's own space."""
    order = np.argsort(values)
    ends = np.flatnonzero(np.diff(values[order]) > close) + 1
    for members in np.split(order, ends):
        if len(members) > 1:
            v = x[:, members]
            t = v.T @ (a @ v - values[members].mean() * v)
            t = (t + t.T) / 2
            size = np.abs(t).max()
            if size > 0:
                x[:, members] = v @ np.linalg.eigh((t / size).astype(np.float64))[1].astype(np.longdouble)
    return x


# --- the operator --------------------------------------------------------------------------

def _rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return rows.filter(usable(F.col("vector"), scale))


def _centred(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """x less the whole numbers nearest to the means, x less the means, and the sums that the first leave."""
    centre = [_nearest(s, model.n) for s in model.sums]
    left = [s - model.n * c for s, c in zip(model.sums, centre)]
    y = x - np.array(centre, np.int64)
    return y, y - np.array([d / model.n for d in left]), left


def _nearest(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def fit(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024,
        shift: int = 100_000) -> Model | None:
    """The first ``k`` components over all usable rows; None if there are none."""
    rows = _rows(vectors, id_col, vector_col, scale)
    most = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if most is None:
        return None
    dims = most["dims"]
    rows = rows.filter(F.size("vector") == dims)
    n, sums = _sums(rows, dims, scale, shift)
    centre = [_nearest(s, n) for s in sums]
    left = np.array([s - n * c for s, c in zip(sums, centre)], np.longdouble) / n
    covariance = _products(rows, dims, centre, scale, shift) / n - np.outer(left, left)
    values, components = refined_eigen(covariance)
    trace = np.trace(covariance)
    kept = np.flatnonzero(values > trace * 1e-15)[:k]
    model = Model(n, tuple(sums), components[:, kept].astype(np.float64), values[kept].astype(np.float64), float(trace), scale, shift)
    return Model(**{**model.__dict__, "identity_error": _identity_error(rows, model)})


def _projection(model: Model) -> np.ndarray:
    return model.components / np.sqrt(model.values)[None, :]


def _identity_error(rows: DataFrame, model: Model) -> float:
    k, onto = len(model.values), _projection(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _centred(_whole(batch, model.scale, model.shift), model)[1] @ onto
            total += w.sum(0)
            squares += w.T @ w
        i, j = np.indices((k, k))
        yield pa.record_batch({"i": pa.array(np.append(i.ravel(), np.full(k, -1)), pa.int32()),
                               "j": pa.array(np.append(j.ravel(), np.arange(k)), pa.int32()), "value": np.append(squares.ravel(), total)})

    if not k:
        return 0.0
    mean, square = np.zeros(k), np.zeros((k, k))
    found = rows.select("vector").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    for r in found.collect():  # k * (k + 1) numbers
        if r["i"] < 0:
            mean[r["j"]] = r["value"] / model.n
        else:
            square[r["i"], r["j"]] = r["value"] / model.n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(<id>, deviation decimal(38,0), whitened array<double>): a row per usable row.

    ``deviation``: the sum over dimensions of (n * x - S) ** 2, exact.
    """
    rows = _rows(vectors, id_col, vector_col, model.scale).filter(F.size("vector") == len(model.sums))
    onto, n, limit = _projection(model), model.n, 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, centred, left = _centred(_whole(batch, model.scale, model.shift), model)
            # (n y - d)' (n y - d) from whole numbers; 64 bits where they hold the sums, Python's own beyond
            most = int(np.abs(y).max()) + 1
            wide = y.shape[1] * most * max(most, *(abs(d) for d in left)) >= 2**63
            whole = y.astype(object) if wide else y
            d = np.array(left, object if wide else np.int64)
            deviation = (n * n) * (whole * whole).sum(1).astype(object) - (2 * n) * (whole * d).sum(1).astype(object) + sum(v * v for v in left)
            whitened = centred @ onto
            yield pa.record_batch({
                id_col: batch.column("id"), "deviation": pa.array([Decimal(int(v)) if v < limit else None for v in deviation], pa.decimal128(38, 0)),
                "whitened": pa.array(list(whitened), pa.list_(pa.float64()))})

    id_type = vectors.select(id_col).schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, deviation decimal(38,0), whitened array<double>")


def per_component(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit and whiten: a row per usable row and component."""
    model = fit(vectors, k, id_col, vector_col)
    if model is None:
        model = Model(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    found = whiten(vectors, model, id_col, vector_col)
    share = F.array(*map(F.lit, model.explained)).cast("array<double>")
    each = found.select(id_col, "deviation", F.posexplode("whitened").alias("i", "value"))
    return each.select(id_col, (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                       F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.col("value").alias("whitened"),
                       F.get(share, F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
