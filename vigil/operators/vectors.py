"""Cells, codes and blocks for vector search, trained on a bounded sample.

Vectors count by their direction: everything here works on unit vectors, and
null, empty and zero vectors take no part. ``train`` reads the
``SAMPLE`` vectors with the smallest hash of their id (all, if there are
fewer), so what it costs and what it returns does not grow with the table; every
row is then assigned to a cell, by numpy on Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 32_768
SUB = 4            # dimensions of one code byte
BOOK = 256         # values of one code byte
COVER = 0.98       # share of the sample's neighbours that the probed cells must hold
CELL_ROWS = 65_536  # rows of a block of a cell
SLICE_ROWS = 1 << 19  # rows that pass by a group of queries in one task
QUERY_ROWS = 16_384  # queries of a group: the memories are copied once for each of them


def unit_rows(vectors) -> np.ndarray:
    x = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nonzero(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Rows whose vector has a direction."""
    has = F.exists(F.col(col), lambda x: x != 0) & ~F.exists(F.col(col), lambda x: F.coalesce(~(F.abs(x) < float("inf")), F.lit(True)))
    return df.filter(F.col(col).isNotNull() & has)


def sample(df: DataFrame, count: int, columns: list[str], size: int = SAMPLE) -> pd.DataFrame:
    """The ``size`` rows with the smallest hash of their id."""
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    part = df.filter(order < math.ceil(min(1.0, 1.2 * size / max(count, 1)) * (1 << 20)))
    return part.orderBy(F.xxhash64("id"), "id").limit(size).select(*columns).toPandas()


def kmeans(x: np.ndarray, k: int, steps: int = 12, spherical: bool = False) -> np.ndarray:
    """Lloyd's algorithm from rows at equal distances; an empty centre moves to the row farthest from its own."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(steps):
        near, far = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = sums / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-far)[:len(empty)]]
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-30)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, tile: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every row, and the squared distance to it."""
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    sizes = (centres * centres).sum(1)
    for a in range(0, len(x), tile):
        d = sizes[None, :] - 2 * (x[a:a + tile] @ centres.T)
        near[a:a + tile] = d.argmin(1)
        far[a:a + tile] = d.min(1) + (x[a:a + tile] ** 2).sum(1)
    return near, far


@dataclass(frozen=True)
class Cells:
    """``centres``: unit vectors; ``books``: per ``SUB`` dimensions, the values of a code byte for what a vector has
    beside its centre; ``probes``: cells a query looks into; ``survivors``: of a query, compared exactly."""

    centres: np.ndarray
    books: np.ndarray
    probes: int
    survivors: int

    def residuals(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """(rows, sub-spaces, SUB), zero-padded."""
        rest = unit - self.centres[cell]
        return np.pad(rest, ((0, 0), (0, -rest.shape[1] % SUB))).reshape(len(rest), -1, SUB)

    def encode(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = self.residuals(unit, cell)
        return np.stack([nearest(rest[:, m], self.books[m])[0] for m in range(rest.shape[1])], axis=1).astype(np.uint8)

    def order(self, unit: np.ndarray) -> np.ndarray:
        """Cells of each row, nearest first."""
        return np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")

    def scores(self, unit: np.ndarray, cell: np.ndarray | int, codes: np.ndarray) -> np.ndarray:
        """Estimated cosines of queries to coded vectors of one cell, or of a cell each."""
        padded = np.pad(unit, ((0, 0), (0, -unit.shape[1] % SUB))).reshape(len(unit), -1, SUB)
        held, at = np.unique(np.broadcast_to(cell, len(codes)), return_inverse=True)
        out = (self.centres[held] @ unit.T)[at]  # a row per vector: whole rows are copied faster
        for m in range(codes.shape[1]):
            out += (self.books[m] @ padded[:, m].T)[codes[:, m]]
        return np.ascontiguousarray(out.T)


def train(df: DataFrame, top_k: int, cells: int = 0, probes: int = 0) -> Cells | None:
    """Cells of a table (id, embedding); None if no row has a direction.

    ``cells``: 0 takes the square root of the number of rows, but 32 sampled rows a cell at least; ``probes``: 0 takes
    as many as hold ``COVER`` of the nearest neighbours within the sample.
    """
    rows = nonzero(df)
    count = rows.count()
    if not count:
        return None
    x = unit_rows(sample(rows, count, ["embedding"])["embedding"])
    k = min(len(x), cells) if cells else max(1, min(round(math.sqrt(count)), len(x) // 32))
    centres = kmeans(x, k, spherical=True)
    cell = nearest(x, centres)[0]
    found = Cells(centres, np.zeros((0, 0, 0)), 0, 0)
    rest = found.residuals(x, cell)
    books = np.stack([kmeans(rest[:, m], min(BOOK, len(x))) for m in range(rest.shape[1])])
    if not probes:
        asked = np.arange(0, len(x), max(1, len(x) // 256))
        close = x[asked] @ x.T
        close[np.arange(len(asked)), asked] = -2
        best = np.argsort(-close, axis=1)[:, :min(top_k, len(x) - 1)]
        place = np.argsort(found.order(x[asked]), axis=1)  # rank of each cell for each query
        ranks = np.take_along_axis(place, cell[best], axis=1)
        probes = int(np.quantile(ranks, COVER, method="higher")) + 1 if ranks.size else 1
    survivors = top_k * (4 + max(0, math.ceil(math.log2(count / 1024))))
    return Cells(centres, books, min(k, probes), survivors)


def in_cells(df: DataFrame, cells: Cells, codes: bool) -> DataFrame:
    """``df`` (with a unit-able ``embedding``) and each row's cell, its code or its angle to the centre."""
    schema = f"{df.schema.simpleString()[7:-1]},cell:int," + ("code:binary" if codes else "angle:double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = unit_rows(batch["embedding"])
                cell = nearest(unit, cells.centres)[0]
                if codes:
                    batch = batch.assign(cell=cell.astype(np.int32), code=[c.tobytes() for c in cells.encode(unit, cell)])
                else:
                    cosine = np.clip(np.einsum("nd,nd->n", unit, cells.centres[cell]), -1, 1)
                    batch = batch.assign(cell=cell.astype(np.int32), angle=np.arccos(cosine))
                yield batch

    return df.mapInPandas(run, schema)


def walk(centres: np.ndarray) -> list[int]:
    """The centres in an order in which neighbours are near: each next to the one before, as far as any are left."""
    left, out = np.ones(len(centres), bool), [0]
    left[0] = False
    while left.any():
        out.append(int(np.where(left, centres @ centres[out[-1]], -np.inf).argmax()))
        left[out[-1]] = False
    return out


def in_parts(df: DataFrame, rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``part``, by which a cell is cut into pieces of about ``rows`` rows, and (cell, parts)."""
    parts = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("int").alias("parts"))
    return df.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts"), parts
