"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Vectors are dealt into shards of bounded size. In each shard, nodes are
inserted in batches: a greedy beam search over the graph so far proposes
neighbours, relaxed distance pruning (drop c if a chosen p is ``alpha`` times
nearer to c than the node is) keeps diverse edges, and reverse edges are
pruned the same way. Queries run a beam search in every shard, in blocks, and
the shards' nearest are merged.

Equal vectors are one node that carries the smallest ids of its rows, one
more than a query returns: enough for exact ties, so a vector that a third of
all rows share is one node. The graph works on unit vectors in single
precision; the returned scores are cosines of the original vectors in double
precision, and all beam candidates are ranked by them.

Defined results: a null id, or a vector that is null, empty, zero or holds a
null or non-finite component takes no part, neither as a query nor as a
candidate; vectors of different lengths are never compared; repeated rows
count once; ties go to the smaller id; a query with fewer candidates returns
them all; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import stored


@dataclass(frozen=True)
class Graph:
    degree: int = 32
    build_beam: int = 64
    alpha: float = 1.2
    batch: int = 512
    entries: int = 256        # start nodes of a search, each as far as can be from those before it
    shard_vectors: int = 8192


# --- a shard's graph (numpy) ---------------------------------------------------------

def _search(unit: np.ndarray, near: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once: (nodes, similarities), best first, padded with -1 and -inf.

    The beam begins with the start nodes nearest to the query. Every round
    expands each query's best node that is not expanded yet, until no node in
    its beam is left.
    """
    n = len(queries)
    rows = np.arange(n)
    seen = np.zeros((n, len(unit)), bool)
    starts = np.unique(starts)
    nodes = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    first = queries @ unit[starts].T
    kept = min(beam, len(starts))
    best = np.argpartition(-first, kept - 1, axis=1)[:, :kept]
    nodes[:, :kept] = starts[best]
    sims[:, :kept] = np.take_along_axis(first, best, 1)
    done[:, :kept] = False
    seen[:, starts] = True
    while True:
        best = np.where(done, -np.inf, sims).argmax(1)
        live = rows[~done[rows, best]]
        if not len(live):
            break
        at = best[live]
        done[live, at] = True
        around = near[nodes[live, at]]
        fresh = (around >= 0) & ~seen[live[:, None], around]
        row, column = np.nonzero(fresh)
        seen[live[row], around[row, column]] = True
        sim = np.einsum("bd,brd->br", queries[live], unit[around])
        sim[~fresh] = -np.inf
        all_nodes = np.concatenate([nodes[live], np.where(fresh, around, -1)], 1)
        all_sims = np.concatenate([sims[live], sim], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        order = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        nodes[live] = np.take_along_axis(all_nodes, order, 1)
        sims[live] = np.take_along_axis(all_sims, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def _prune(unit: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Relaxed distance pruning of each point's candidates (-1: none) to at most ``degree`` of them."""
    sims = np.einsum("bd,bmd->bm", unit[points], unit[candidates])
    sims[(candidates < 0) | (candidates == points[:, None])] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
    alive = np.isfinite(sims)
    vectors = unit[candidates]
    distance = np.maximum(2 - 2 * sims, 0)  # squared, from the point
    rows = np.arange(len(points))
    chosen = np.full((len(points), degree), -1, np.int64)
    for k in range(degree):
        pick = alive.argmax(1)
        some = alive[rows, pick]
        if not some.any():
            break
        chosen[some, k] = candidates[rows[some], pick[some]]
        between = np.maximum(2 - 2 * np.einsum("bd,bmd->bm", vectors[rows, pick], vectors), 0)
        alive &= alpha * alpha * between > distance
        alive[rows, pick] = False
    return chosen


def build(unit: np.ndarray, graph: Graph, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of each node, padded with -1; start nodes).

    The start nodes are inserted first. They lie in every part of the shard, so a search is not caught in a tight
    cluster that its query does not belong to.
    """
    n = len(unit)
    near = np.full((n, graph.degree), -1, np.int64)
    starts = _spread(unit, graph.entries)
    rest = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([starts, rest[~np.isin(rest, starts)]])
    at = 1
    while at < n:
        points = order[at:at + min(graph.batch, at)]
        found, _ = _search(unit, near, order[:min(at, len(starts))], unit[points], graph.build_beam)
        at += len(points)
        # points of one batch may be each other's neighbours too
        own = np.argpartition(-(unit[points] @ unit[points].T), min(8, len(points)) - 1, axis=1)[:, :8]
        near[points] = _prune(unit, points, _distinct(np.concatenate([found, points[own]], 1)), graph.degree, graph.alpha)
        _link_back(unit, near, points, graph)
    return near, np.unique(starts)


def _spread(unit: np.ndarray, count: int) -> np.ndarray:
    """The most central vector, and then the one farthest from all chosen before it, ``count`` in all."""
    chosen = [int((unit @ unit.mean(0)).argmax())]
    closest = unit @ unit[chosen[0]]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, unit @ unit[chosen[-1]])
        closest[chosen] = np.inf
    return np.array(chosen)


def _distinct(candidates: np.ndarray) -> np.ndarray:
    out = np.sort(candidates, axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


def _link_back(unit: np.ndarray, near: np.ndarray, points: np.ndarray, graph: Graph) -> None:
    """Add the reverse of the points' edges; nodes with too many are pruned."""
    target, source = near[points].ravel(), np.repeat(points, graph.degree)
    source, target = source[target >= 0], target[target >= 0]
    sims = np.einsum("ed,ed->e", unit[source], unit[target])
    order = np.lexsort((-sims, target))  # of a node's new edges the nearest first
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    most = 4 * graph.degree
    for low in range(0, len(nodes), graph.batch):
        some, begin, size = nodes[low:low + graph.batch], first[low:low + graph.batch], count[low:low + graph.batch]
        # of a hub's new edges, those beyond the ``most`` nearest stay one-way
        column = np.arange(min(most, int(size.max())))
        index = begin[:, None] + column
        new = np.where(column < size[:, None], source[np.minimum(index, len(source) - 1)], -1)
        wanted = _distinct(np.concatenate([near[some], new], 1))
        over = (wanted >= 0).sum(1) > graph.degree
        wanted = -np.sort(-wanted, axis=1)  # -1 to the end
        fitting = wanted[:, :graph.degree]
        if fitting.shape[1] < graph.degree:
            fitting = np.pad(fitting, ((0, 0), (0, graph.degree - fitting.shape[1])), constant_values=-1)
        near[some[~over]] = fitting[~over]
        if over.any():
            near[some[over]] = _prune(unit, some[over], wanted[over], graph.degree, graph.alpha)


# --- Spark ------------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) \
        & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _vectors(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """Scaled by a power of two each, which changes no cosine but keeps squares from overflowing or vanishing."""
    x = _matrix(column, n)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]) if n else x


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
    return (vectors / norms[:, None]).astype(np.float32), norms


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep_ids: int = 6, graph: Graph = Graph()) -> DataFrame:
    """The graphs, written to the shared folder: (shard, dims, node, vector, ids, near, start, keep_ids).

    ``ids``: the ``keep_ids`` smallest ids of the rows that hold the vector; a search can return one less.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("hash", F.xxhash64("vector"))
    # the first rows of each (hash, vector) are taken map-side too, so a hot vector is cut before the shuffle
    first = Window.partitionBy("hash", "vector").orderBy("id")
    rows = rows.distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= keep_ids)
    nodes = stored(rows.groupBy("hash", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn(
        "dims", F.size("vector")), "vectors")
    shards = max(1, -(-nodes.count() // graph.shard_vectors))
    id_type = vectors.schema[id_col].dataType.simpleString()
    vector_type = vectors.schema[vector_col].dataType.simpleString()

    def run(shard: pa.Table) -> pa.Table:
        unit, _ = _unit(_vectors(shard["vector"], shard.num_rows))
        near, starts = build(unit, graph)
        is_start = np.zeros(len(unit), bool)
        is_start[starts] = True
        lists = pa.ListArray.from_arrays(np.arange(len(unit) + 1, dtype=np.int32) * near.shape[1], near.astype(np.int32).ravel())
        return pa.table({"shard": shard["shard"], "dims": shard["dims"], "node": pa.array(np.arange(len(unit), dtype=np.int32)),
                         "vector": shard["vector"], "ids": shard["ids"], "near": lists, "start": pa.array(is_start)})

    dealt = nodes.withColumn("shard", F.pmod(F.col("hash"), F.lit(shards)).cast("int")).select("shard", "dims", "vector", "ids")
    return stored(dealt.groupBy("shard", "dims").applyInArrow(
        run, f"shard int, dims int, node int, vector {vector_type}, ids array<{id_type}>, near array<int>, start boolean").withColumn("keep_ids", F.lit(keep_ids)), "graph")


def search(graphs: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
           beam: int = 128, block: int = 20_000) -> DataFrame:
    """(query_id, rank, <id>, score): the ``k`` nearest found of each query, itself left out.

    The index must have been made for that many: equal vectors carry ``keep_ids`` ids.
    """
    kept = graphs.agg(F.min("keep_ids")).first()[0]
    if kept is not None and k >= kept:
        raise ValueError(f"the index keeps {kept} ids of equal vectors, so it can return {kept - 1} of them, not {k}")
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query"))
    asked = asked.filter(F.col("query_id").isNotNull() & usable(F.col("query"))).distinct()
    asked = asked.withColumn("dims", F.size("query")).withColumn("hash", F.xxhash64("query_id", "query"))
    blocks = max(1, -(-asked.count() // block))
    # every block of queries meets every shard: a stated query set against all rows
    shards = graphs.select(F.col("shard").alias("s"), F.col("dims").alias("d")).distinct()
    asked = stored(asked.withColumn("block", F.pmod(F.col("hash"), F.lit(blocks)).cast("int")), "queries")
    asked = asked.join(shards, F.col("dims") == F.col("d")).select(
        F.col("s").alias("shard"), F.col("d").alias("dims"), "block", "query_id", "hash", "query")
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    id_type = queries.schema[id_col].dataType.simpleString()
    out_schema = f"query_id {id_type}, hash long, id {id_type}, score double"

    def run(shard: pa.Table, ask: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "hash": [], "id": [], "score": []}
        types = {"query_id": ask.schema.field("query_id").type, "hash": pa.int64(),
                 "id": shard.schema.field("ids").type.value_type, "score": pa.float64()}
        if shard.num_rows and ask.num_rows:
            shard = shard.sort_by("node")
            vectors = _vectors(shard["vector"], shard.num_rows)
            unit, norms = _unit(vectors)
            near = _matrix(shard["near"], shard.num_rows).astype(np.int64)
            starts = np.flatnonzero(shard["start"].to_numpy())
            ids = shard["ids"].to_pylist()
            wanted = _vectors(ask["query"], ask.num_rows)
            unit_wanted, norms_wanted = _unit(wanted)
            names, hashes = ask["query_id"].to_pylist(), ask["hash"].to_pylist()
            for low in range(0, len(wanted), 256):
                nodes, _ = _search(unit, near, starts, unit_wanted[low:low + 256], beam)
                for row, near_nodes in enumerate(nodes, low):
                    near_nodes = near_nodes[near_nodes >= 0]
                    scores = (vectors[near_nodes] * wanted[row]).sum(1) / (norms[near_nodes] * norms_wanted[row])
                    ranked = sorted((-s, i) for s, node in zip(scores.tolist(), near_nodes.tolist()) for i in ids[node] if i != names[row])
                    for s, i in ranked[:k]:
                        found["query_id"].append(names[row])
                        found["hash"].append(hashes[row])
                        found["id"].append(i)
                        found["score"].append(-s)
        return pa.table({c: pa.array(v, types[c]) for c, v in found.items()})

    key = ["shard", "dims", "block"]
    each = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, out_schema)
    best = Window.partitionBy("query_id", "hash").orderBy(F.col("score").desc(), "id")
    return each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
