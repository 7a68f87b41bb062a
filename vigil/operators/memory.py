"""Semantic memory: cosine distance, exact faceted top-K search (with the
relaxed fallback), runbook section splitting, content hashing and the
re-index delta, plus an approximate search over coded cells with exact re-rank.

Exact search layout
-------------------
One plan for any number of queries and memories. Memories fall into cells
around centres trained on a bounded sample, and a cell is cut into blocks of
a bounded number of rows. The angle between vectors is a metric, so a cell of
radius r around c holds nothing nearer to a query q than angle(q, c) - r: cells
beyond the query's limit are skipped. The limit is the distance
of its K-th match within the sample, or ``max_distance`` if the sample has fewer. Queries
of near cells form groups of a bounded number; the
blocks that a group needs meet it one by one, and are scanned
by tiles with numpy (matrix product, facet masks, top-K by (distance, id)), so
a task's memory depends on neither the corpus nor the batch. A memory is
copied once for each group that needs its cell; no (query, memory) pair becomes a row. Every block's
top-K contains the global top-K restricted to it, so a final ``row_number`` over these small results
is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vigil.config import Params
from vigil.operators import vectors as V
from vigil.session import stored

SEARCH_SCHEMA = (
    "query_id string, id string, kind string, source_ref string, workload string, category string, "
    "incident_id string, distance double, mode string, has_facet boolean"
)
QUERY_TILE, MEMORY_TILE = 256, 8192  # a tile of distances is 16 MB

# Runbook file name -> incident category.
RUNBOOK_CATEGORY = {
    "dependency-latency": "dependency_latency",
    "pod-crash-loop": "pod_restart_loop",
    "out-of-memory": "out_of_memory",
    "database-unavailable": "dependency_unavailable",
    "readiness-failure": "readiness_failure",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def cosine_distance(a, b) -> Column:
    """1 - cos(a, b), in [0, 2]; NULL/NaN when either vector is all zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.lit(1.0) - dot(a, b) / norms).otherwise(F.lit(float("nan")))


def retrieval_confidence(distance) -> Column:
    """round(clamp(1 - d, 0, 1), 3), half-even."""
    return F.bround(F.least(F.greatest(F.lit(1.0) - _c(distance), F.lit(0.0)), F.lit(1.0)), 3)


def _blank(s: pd.Series) -> np.ndarray:
    return s.isna().to_numpy() | (s.fillna("").str.strip() == "").to_numpy()


class Facets:
    """Which memories each query may have: by kind and self-exclusion, and by the facets too. Values are compared by numbers."""

    # of a query, of a memory
    PAIRS = (("kind", "kind"), ("exclude_incident_id", "incident_id"), ("workload", "workload"), ("category", "category"))

    def __init__(self, queries: pd.DataFrame):
        self.asked, self.known = {}, {}
        for name, held in self.PAIRS:
            codes, values = pd.factorize(queries[name].to_numpy(dtype=object))  # -1: NULL
            self.asked[held], self.known[held] = codes.astype(np.int32), pd.Index(values)
        self.blank = {name: _blank(queries[name]) for name in ("kind", "workload", "category")}

    def numbers(self, part: pd.DataFrame) -> dict[str, np.ndarray]:
        """A memory's values as the numbers that queries have for them; -2: no query has it, -3: NULL."""
        out = {}
        for _, held in self.PAIRS:
            column = part[held].to_numpy(dtype=object)
            found = self.known[held].get_indexer(column) if len(self.known[held]) else np.full(len(column), -1)
            out[held] = np.where(pd.isna(column), -3, np.where(found < 0, -2, found)).astype(np.int32)
        return out

    def allowed(self, at: slice, numbers: dict[str, np.ndarray], rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        def same(name):
            return self.asked[name][at, None] == numbers[name][None, rows]

        def equal(name):  # a blank facet of the query matches all, a NULL one of the memory too
            return same(name) | self.blank[name][at, None] | (numbers[name][rows] == -3)[None, :]

        base = (same("kind") | self.blank["kind"][at, None]) & ~same("incident_id")
        return base, base & equal("workload") & equal("category")


def _allowed(queries: pd.DataFrame, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    facets = Facets(queries)
    return facets.allowed(slice(None), facets.numbers(part))


def _facetted(queries: pd.DataFrame) -> np.ndarray:
    return ~(_blank(queries["workload"]) & _blank(queries["category"]))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])


def _cosine_distances(Q: np.ndarray, A: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - (Q @ A.T) / np.outer(np.linalg.norm(Q, axis=1), np.linalg.norm(A, axis=1))


MODES = ("strict", "relaxed")
WAITING = 1_000_000  # rows found that are kept before the best of them are taken


class Nearest:
    """The ``keep`` best memories of some queries in each mode, by (score, id), of those that pass by; less is better."""

    def __init__(self, queries: pd.DataFrame, keep: int, worst: float, relaxed: bool, columns: list[str]):
        self.queries, self.keep, self.columns = queries.reset_index(drop=True), keep, columns
        self.facet, self.modes, self.facets = _facetted(queries), 1 + relaxed, Facets(self.queries)
        self.worst = np.full((len(MODES), len(queries)), worst)  # scores beyond it are out
        self.found, self.waiting = [], 0

    def meet(self, part: pd.DataFrame, cell: np.ndarray, needed: np.ndarray, scores: Callable[[slice, np.ndarray], np.ndarray]) -> None:
        """Each query meets the rows of ``part`` whose ``cell`` it has ``needed`` (queries x cells); ``scores``: of some queries
        and some rows."""
        taken = pa.Table.from_pandas(part[self.columns], schema=pa.schema([(c, pa.string()) for c in self.columns]), preserve_index=False)
        numbers = self.facets.numbers(part)
        for a in range(0, len(self.queries), QUERY_TILE):
            at = slice(a, a + QUERY_TILE)
            rows = np.flatnonzero(needed[at].any(0)[cell])
            for b in range(0, len(rows), MEMORY_TILE):
                some = rows[b:b + MEMORY_TILE]
                score = scores(at, some)
                base, strict = self.facets.allowed(at, numbers, some)
                met = needed[at][:, cell[some]]
                for mode, mask in enumerate((strict, base & self.facet[at, None])[:self.modes]):
                    hit = mask & met & (score <= self.worst[mode, at][:, None])
                    if np.count_nonzero(hit) > self.keep * len(hit):
                        masked = np.where(hit, score, np.inf)
                        n = min(self.keep, masked.shape[1])
                        hit &= masked <= np.partition(masked, n - 1, axis=1)[:, n - 1:n]
                    qi, ci = np.nonzero(hit)
                    if len(qi):
                        self.found.append(taken.take(pa.array(some[ci])).append_column("_score", pa.array(score[qi, ci])).append_column(
                            "_of", pa.array((a + qi) * len(MODES) + mode)))
                        self.waiting += len(qi)
                if self.waiting > WAITING:
                    self.settle()

    def settle(self) -> None:
        """Only the best stay, and the last of them bounds what may follow."""
        if not self.found:
            return
        every = pa.concat_tables(self.found)
        keys = [("_of", "ascending"), ("_score", "ascending"), ("id", "ascending")]
        every = every.take(pc.sort_indices(every, sort_keys=keys, null_placement="at_start"))
        of = every["_of"].to_numpy()
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        place = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
        last = np.flatnonzero(place == self.keep - 1)
        self.worst[of[last] % len(MODES), of[last] // len(MODES)] = every["_score"].to_numpy()[last]
        self.found, self.waiting = [every.filter(pa.array(place < self.keep))], 0

    def best(self) -> pd.DataFrame | None:
        """A row per query, mode and memory: query_id, mode, has_facet, score and the memory's columns."""
        self.settle()
        if not self.found:
            return None
        out = self.found[0].to_pandas()
        of = out.pop("_of").to_numpy()
        q = of // len(MODES)
        return out.rename(columns={"_score": "score"}).assign(
            query_id=self.queries["query_id"].to_numpy()[q], mode=np.array(MODES, dtype=object)[of % len(MODES)], has_facet=self.facet[q])


def _best(partial: DataFrame, params: Params, relaxed: bool) -> DataFrame:
    """Top-K per query and mode; the relaxed rows only where a facetted query has no strict one."""
    w = Window.partitionBy("query_id", "mode").orderBy("distance", "id")
    ranked = partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= params.top_k)
    if not relaxed:
        return ranked.filter(F.col("mode") == "strict").drop("has_facet")
    wq = Window.partitionBy("query_id")
    ranked = ranked.withColumn("__has_strict", F.max((F.col("mode") == "strict").cast("int")).over(wq) == 1)
    has_strict = F.col("__has_strict")
    keep = ((F.col("mode") == "strict") & (has_strict | ~F.col("has_facet"))) | (
        (F.col("mode") == "relaxed") & F.col("has_facet") & ~has_strict
    )
    return ranked.filter(keep).drop("has_facet", "__has_strict")


CORPUS_COLUMNS = ["id", "kind", "incident_id", "source_ref", "workload", "category", "embedding"]
QUERY_COLUMNS = ["query_id", "embedding", "kind", "workload", "category", "exclude_incident_id"]


def _grouped(queries: DataFrame, cells: V.Cells) -> tuple[DataFrame, int]:
    """The usable queries in groups of about ``V.QUERY_ROWS``, those of near cells together, and the number of groups."""
    q = stored(V.in_cells(V.nonzero(queries.select(*QUERY_COLUMNS)), cells, codes=False).drop("angle"), "queries")
    sizes = {r["cell"]: r["count"] for r in q.groupBy("cell").count().collect()}  # no more than there are cells
    before, n = [], 0
    for c in V.walk(cells.centres):
        if c in sizes:
            before.append((int(c), n, sizes[c]))
            n += sizes[c]
    groups = max(1, -(-n // V.QUERY_ROWS))
    places = q.sparkSession.createDataFrame(before, "cell int, before long, held long")
    within = F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)) * F.col("held") / F.lit(float(1 << 20))
    group = F.least(F.floor((F.col("before") + within) * groups / F.lit(max(1, n))), F.lit(groups - 1)).cast("int")
    return q.join(F.broadcast(places), "cell").select(*QUERY_COLUMNS, group.alias("query_group"), F.col("cell").alias("home")), groups


def needed_cells(queries: DataFrame, cells: V.Cells, radius: dict[int, float], some: pd.DataFrame, params: Params) -> DataFrame:
    """``queries`` once for each cell that may hold one of its top K (``cell``), by the triangle inequality on angles.

    ``some``: rows of the corpus whose K-th match bounds each query's distance.
    """
    held = np.array(sorted(radius))
    around = np.array([radius[c] for c in held])

    def need(tile: pd.DataFrame) -> np.ndarray:
        unit = V.unit_rows(tile["embedding"])
        limit = np.full(len(tile), params.max_distance)
        if len(some) >= params.top_k:
            # rows outside the facets do not count, so fewer than K of them leave max_distance as the limit
            dist = np.where(_allowed(tile, some)[1], _cosine_distances(unit, _matrix(some["embedding"])), np.inf)
            limit = np.minimum(limit, np.partition(dist, params.top_k - 1, axis=1)[:, params.top_k - 1])
        angle = np.arccos(np.clip(unit @ cells.centres[held].T, -1, 1))
        widest = np.arccos(np.clip(1 - limit, -1, 1))
        return angle - around[None, :] <= widest[:, None] + 1e-9

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), QUERY_TILE):
                tile = batch.iloc[a:a + QUERY_TILE]
                yield tile.assign(cells=[held[row].astype(np.int32) for row in need(tile)])

    return _one_row_a_cell(queries.mapInPandas(run, f"{queries.schema.simpleString()[7:-1]},cells:array<int>"))


def _one_row_a_cell(queries: DataFrame) -> DataFrame:
    """``queries`` once for each of their ``cells``: copied by Spark, so that a Python task holds each vector once."""
    return queries.select("*", F.explode("cells").alias("cell")).drop("cells")


def _tiled(n: int, rows: Callable[[slice], np.ndarray]) -> np.ndarray:
    """``rows`` of all queries, taken by tiles."""
    return np.vstack([rows(slice(a, a + QUERY_TILE)) for a in range(0, n, QUERY_TILE)])


def _for_groups(memories: DataFrame, needs: DataFrame) -> DataFrame:
    """``memories`` once for each ``query_group`` that ``needs`` names for their cell."""
    by_cell = needs.select("query_group", "cell").distinct().groupBy("cell").agg(F.collect_list("query_group").alias("query_groups"))
    return memories.join(by_cell, "cell").withColumn("query_group", F.explode("query_groups")).drop("query_groups")


def _passing_by(queries: DataFrame, groups: int, needs: DataFrame, memories: DataFrame, count: int, scan: Callable, schema: str) -> DataFrame:
    """Every group of ``queries`` meets the ``count`` memories of the cells that ``needs`` (query_group, cell) names for it.

    ``scan``: from the queries of a group (their vector in ``vector``) to a function that takes some memories, and one that
    gives the result. Memories come cell by cell, behind the queries; a group has several tasks where memories are many or
    groups are few.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    slices = max(-(-count // V.SLICE_ROWS), min(-(-cores // groups), -(-count // MEMORY_TILE)), 1)
    held = _for_groups(V.in_parts(memories)[0], needs).withColumn("slice", F.pmod(F.col("cell") + F.col("part"), F.lit(slices))).drop("part")
    asked = queries.withColumnRenamed("embedding", "vector").withColumn("cell", F.lit(-1)).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    task = ["query_group", "slice"]
    both = asked.withColumn("place", F.col("home") - F.lit(1 << 30)).drop("home").unionByName(held.withColumn("place", F.col("cell")), allowMissingColumns=True)
    both = both.repartition(3 * groups * slices, *task).sortWithinPartitions(*task, "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, first, meet, best = None, [], None, None
        for batch in batches:
            marks = np.column_stack([batch[task].to_numpy(), batch["cell"].to_numpy() < 0])
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)] if len(batch) else []):
                if tuple(marks[a, :2]) != now:
                    if best is not None and (out := best()) is not None:
                        yield out
                    now, first, meet, best = tuple(marks[a, :2]), [], None, None
                if marks[a, 2]:
                    first.append(batch.iloc[a:b])
                else:
                    if meet is None:
                        meet, best = scan(pd.concat(first, ignore_index=True))
                        first = []
                    meet(batch.iloc[a:b])
        if best is not None and (out := best()) is not None:
            yield out

    return both.mapInPandas(run, schema)


def search(corpus: DataFrame, queries: DataFrame, params: Params, relaxed: bool = False, blocks: int | None = None) -> DataFrame:
    """Exact faceted nearest-neighbour search for a batch of queries.

    Filters (as in the service): kind equal; workload / category either NULL
    on the memory or equal; the query's own incident excluded; distance at
    most ``max_distance``; top ``top_k`` by distance (ties by id). With
    ``relaxed=True`` a query that gave a facet but found nothing is answered
    without the facets (kind and self-exclusion still apply); both result
    sets come from the same pass. A query without an id gets no rows. ``blocks``: cells of the corpus (default: one for each ``CELL_ROWS`` rows, 1,024 at most).
    """
    c = V.nonzero(corpus.select(*CORPUS_COLUMNS))
    count = c.count()
    n = blocks or min(1024, -(-count // V.CELL_ROWS))
    cells = V.train(c.select("id", "embedding"), params.top_k, cells=max(1, n), probes=1)
    if cells is None:
        return _best(c.sparkSession.createDataFrame([], SEARCH_SCHEMA), params, relaxed)
    c = stored(V.in_cells(c, cells, codes=False), "cells")
    radius = {r["cell"]: r["r"] for r in c.groupBy("cell").agg(F.max("angle").alias("r")).collect()}  # 1,024 at most
    c = c.drop("angle")
    q, groups = _grouped(queries.filter("query_id IS NOT NULL"), cells)
    some = V.sample(c, count, [x for x in CORPUS_COLUMNS if x != "source_ref"], size=2048)
    columns = ["id", "kind", "source_ref", "workload", "category", "incident_id"]
    names = [x.split(" ")[0] for x in SEARCH_SCHEMA.split(", ")]

    def block(memories: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = None
        if len(memories) and len(asked):
            Q, A = _matrix(asked["embedding"]), _matrix(memories["embedding"])
            near = Nearest(asked, params.top_k, params.max_distance, relaxed, columns)
            near.meet(memories, np.zeros(len(memories), int), np.ones((len(asked), 1), bool), lambda at, x: _cosine_distances(Q[at], A[x]))
            found = near.best()
        return pd.DataFrame(columns=names) if found is None else found.rename(columns={"score": "distance"})[names]

    q = needed_cells(q.drop("home"), cells, radius, some, params)
    c, parts = V.in_parts(c)
    c = _for_groups(c, q)
    q = q.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    key = ["cell", "part", "query_group"]
    partial = c.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(block, SEARCH_SCHEMA)
    return _best(partial, params, relaxed)


def to_evidence(matches: DataFrame, kind: str) -> DataFrame:
    """SM6: matches as HistoricalIncident / Runbook evidence rows: id from the
    source ref, observed at the remembered time, a summary that says plainly
    it is memory (with the retrieval confidence as a whole percent) followed
    by the title and the content cut at 900 characters."""
    from vigil.functions import ids
    from vigil.functions.text import truncate
    from vigil.operators.cluster import attribute_map
    from vigil.operators.detect import fixed_double

    conf = retrieval_confidence("distance")
    label = ("PAST INCIDENT (not evidence about the current one, retrieval confidence "
             if kind == "HistoricalIncident" else "RUNBOOK GUIDANCE (documentation, not an observation, retrieval confidence ")
    cols = set(matches.columns)
    title = F.col("title") if "title" in cols else F.col("source_ref")
    content = F.col("content") if "content" in cols else F.lit("")
    return matches.select(
        "query_id",
        ids.evidence_id(kind, ids.SOURCE_MEMORY, F.col("source_ref")).alias("evidence_id"),
        F.lit(kind).alias("kind"),
        F.col("source_ref"),
        conf.alias("retrieval_confidence"),
        fixed_double("distance", 3).alias("distance_label"),
        F.lit(ids.SOURCE_MEMORY).alias("source"),
        (F.col("occurred_at") if "occurred_at" in cols else F.lit(None).cast("timestamp")).alias("observed_at"),
        attribute_map(
            sourceRef=F.col("source_ref"), retrievalDistance=fixed_double("distance", 3), retrievalConfidence=fixed_double(conf, 3),
            historicalIncidentId=F.col("incident_id"), rootCauseCategory=F.col("category"), workload=F.col("workload"),
            **({"occurredAtUtc": F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS'+00:00'")} if "occurred_at" in cols else {}),
        ).alias("attributes"),
        F.concat(F.lit(label), fixed_double(conf * 100, 0), F.lit(" %): "), title, F.lit("\n"), truncate(content, 900)).alias("summary"),
    )


# --- runbook sections ----------------------------------------------------------

def split_sections(docs: DataFrame, file_col: str = "file_name", text_col: str = "markdown") -> DataFrame:
    """Markdown -> one row per ``## `` section.

    Document title = first ``# `` line (else the file name); lines before the
    first heading are dropped; a heading with a title followed by at least one
    line (even a blank one) yields a section whose body is the trimmed text; a
    heading without a title ends a section and opens none. All within the
    document's row, by array functions.
    source_ref = ``file#heading-lower-with-dashes``.
    """
    from vigil.functions.text import trim_ws

    lines = F.split(F.col(text_col), "\n")
    own = docs.select(
        file_col, lines.alias("__l"),
        F.coalesce(
            trim_ws(F.substring(F.get(F.filter(lines, lambda l: l.startswith("# ")), 0), 3, 1 << 30)),
            F.col(file_col),
        ).alias("doc_title"),
        F.filter(F.transform(lines, lambda l, i: F.when(l.startswith("## "), i)), lambda i: i.isNotNull()).alias("__h"),
    )
    sec = own.select(file_col, "doc_title", "__l", F.size("__l").alias("__n"), "__h", F.posexplode("__h").alias("__k", "__at"))
    end = F.coalesce(F.get("__h", F.col("__k") + 1), F.col("__n"))
    sec = sec.select(
        file_col, "doc_title", (F.col("__k") + 1).cast("long").alias("section_no"),
        trim_ws(F.substring(F.get("__l", F.col("__at")), 4, 1 << 30)).alias("heading"),
        F.slice("__l", F.col("__at") + 2, end - F.col("__at") - 1).alias("__body"),
    ).filter((F.col("heading") != "") & (F.size("__body") > 0))
    out = sec.select(
        file_col, "section_no", "doc_title", "heading",
        trim_ws(F.array_join("__body", "\n")).alias("body"),
        F.concat(F.col(file_col), F.lit("#"), F.regexp_replace(F.lower("heading"), " ", "-")).alias("source_ref"),
        F.concat_ws(" - ", "doc_title", "heading").alias("title"),
    )
    return out.withColumn("content", F.concat_ws("\n", "doc_title", "heading", F.lit(""), "body"))


def runbook_category(sections: DataFrame, file_col: str = "file_name") -> DataFrame:
    spark = sections.sparkSession
    m = spark.createDataFrame(list(RUNBOOK_CATEGORY.items()), f"{file_col} string, category string")
    return sections.join(F.broadcast(m), file_col, "left")


def incident_memories(incidents: DataFrame, reports: DataFrame) -> DataFrame:
    """SM10: what is remembered of reported incidents: (kind, source_ref, incident_id, title, content, workload, category,
    root_cause_category, severity, occurred_at).

    ``incidents``: incident_id, title, category, affected_workloads, severity,
    first_detected_at; ``reports``: incident_id, title, summary,
    root_cause_category, likely_root_cause, impact, recommended_actions. An
    incident without a report leaves no memory. The text names symptoms first, then the cause
    found; a missing field is an empty text there.
    """
    r = reports.select("incident_id", *(F.col(c).alias(f"r_{c}") for c in (
        "title", "summary", "root_cause_category", "likely_root_cause", "impact", "recommended_actions")))
    j = incidents.join(r, "incident_id")

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    # The labels of the remembered text.
    content = F.concat(
        F.lit("Incident: "), text("r_title"), F.lit("\nCategory: "), text("category"),
        F.lit("\nAffected workloads: "), F.array_join("affected_workloads", ", "), F.lit("\nSeverity: "), text("severity"),
        F.lit("\n\nSymptoms: "), text("title"), F.lit("\n"), text("r_summary"),
        F.lit("\n\nRoot cause ("), text("r_root_cause_category"), F.lit("): "), text("r_likely_root_cause"),
        F.lit("\n\nImpact: "), text("r_impact"), F.lit("\n\nResolution guidance: "), F.array_join("r_recommended_actions", " "))
    return j.select(F.lit("incident").alias("kind"), F.col("incident_id").alias("source_ref"), "incident_id", F.col("r_title").alias("title"),
                    content.alias("content"), F.get("affected_workloads", 0).alias("workload"), "category",
                    F.col("r_root_cause_category").alias("root_cause_category"), "severity", F.col("first_detected_at").alias("occurred_at"))


def content_hash(content) -> Column:
    from vigil.functions.text import trim_ws

    return F.sha2(trim_ws(F.replace(_c(content), F.lit("\r\n"), F.lit("\n"))), 256)


def reindex_delta(sections: DataFrame, stored: DataFrame) -> DataFrame:
    """Sections whose (kind, source_ref, content_hash) is not already stored."""
    s = sections.withColumn("content_hash", content_hash("content")).withColumn("kind", F.lit("runbook"))
    return s.join(stored.select("kind", "source_ref", "content_hash"), ["kind", "source_ref", "content_hash"], "left_anti")


def newest_memories(rows: DataFrame, version: str = "version") -> DataFrame:
    """One row per (kind, source_ref): the newest version wins, but ``id``, ``incident_id`` and ``created_at`` stay those
    of the row created first."""
    key = ["kind", "source_ref"]
    kept = ["id", "incident_id", "created_at"]
    rest = [c for c in rows.columns if c not in key + kept + [version]]
    first = F.struct("created_at", version)
    return rows.groupBy(*key).agg(
        F.min_by(F.struct(*kept), first).alias("__first"), F.max_by(F.struct(F.lit(1).alias("__"), *rest), version).alias("__last"),
        F.max(version).alias(version),
    ).select(*key, "__first.*", *(F.col(f"__last.{c}").alias(c) for c in rest), version)


def upsert(existing: DataFrame, incoming: DataFrame, version: str = "version") -> DataFrame:
    """Upsert by (kind, source_ref), see ``newest_memories``; ``vigil.sources.state.upsert_memory`` does it to a stored table."""
    return newest_memories(existing.unionByName(incoming, allowMissingColumns=True), version)


def dim_check(vectors: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    return vectors.withColumn("dim_ok", F.size(col) == dim)


def ann_index(corpus: DataFrame, params: Params) -> tuple[DataFrame, V.Cells] | None:
    """The corpus by cells, each memory with its code, in the shared folder; None if no memory has a direction."""
    rows = V.nonzero(corpus.select(*CORPUS_COLUMNS))
    cells = V.train(rows.select("id", "embedding"), params.top_k, params.ann_cells, params.ann_probes)
    return None if cells is None else (stored(V.in_cells(rows, cells, codes=True), "ann-index"), cells)


def survivors(index: DataFrame, cells: V.Cells, queries: DataFrame, relaxed: bool = True) -> DataFrame:
    """(query_id, id, mode, has_facet, query): what is left of a query's nearest cells by the codes' estimate.

    Per query and mode the ``cells.survivors`` memories with the largest estimated cosine that facets and
    self-exclusion allow.
    """
    q, groups = _grouped(queries, cells)
    schema = "query_id string, id string, mode string, has_facet boolean, estimate double"

    def nearest_cells(vectors: pd.Series) -> np.ndarray:
        return _tiled(len(vectors), lambda x: cells.order(V.unit_rows(vectors.iloc[x]))[:, :cells.probes].astype(np.int32))

    def probed(batches):
        for batch in batches:
            if len(batch):
                yield batch[["query_group"]].assign(cells=list(nearest_cells(batch["embedding"])))

    def scan(asked: pd.DataFrame):
        unit = V.unit_rows(asked["vector"])
        needed = np.zeros((len(asked), len(cells.centres)), bool)
        np.put_along_axis(needed, nearest_cells(asked["vector"]), True, axis=1)
        near = Nearest(asked, cells.survivors, np.inf, relaxed, ["id"])

        def meet(part: pd.DataFrame) -> None:
            cell, codes = part["cell"].to_numpy(), np.vstack([np.frombuffer(c, np.uint8) for c in part["code"]])
            near.meet(part, cell, needed, lambda at, some: -cells.scores(unit[at], cell[some], codes[some]))

        def best() -> pd.DataFrame | None:
            found = near.best()
            return None if found is None else found.assign(estimate=-found["score"])[["query_id", "id", "mode", "has_facet", "estimate"]]

        return meet, best

    needs = _one_row_a_cell(q.mapInPandas(probed, "query_group int, cells array<int>"))
    found = _passing_by(q, groups, needs, index.drop("embedding", "source_ref"), index.count(), scan, schema)
    w = Window.partitionBy("query_id", "mode").orderBy(F.desc("estimate"), "id")
    found = found.repartition("query_id").withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= cells.survivors).drop("__n", "estimate")
    # a facetted query's memories may survive in both modes; they are compared once
    return found.groupBy("query_id", "id", "has_facet").agg(F.sort_array(F.collect_set("mode")).alias("modes"))


def rerank(left: DataFrame, index: DataFrame, queries: DataFrame, params: Params, relaxed: bool = True) -> DataFrame:
    """Exact distances of the survivors, and the ranks of ``search`` among them."""
    # ids meet their vectors first, so that vectors are shuffled once, to their query, and stay there for the ranks
    pairs = left.join(index.select(*CORPUS_COLUMNS), "id").join(queries.select("query_id", F.col("embedding").alias("query")), "query_id")
    near = pairs.withColumn("distance", cosine_distance("query", "embedding")).filter(F.col("distance") <= params.max_distance)
    partial = near.select("query_id", "id", "kind", "source_ref", "workload", "category", "incident_id", "distance",
                          F.explode("modes").alias("mode"), "has_facet")
    return _best(partial, params, relaxed)


def ann_search(corpus: DataFrame, queries: DataFrame, params: Params, relaxed: bool = True) -> DataFrame:
    """Approximate search: a query looks into its nearest cells, where codes of a quarter of a byte a dimension estimate
    the cosines; only the best of these estimates are compared exactly. Facets, self-exclusion, distances and ranks are those of ``search``.
    """
    found = ann_index(corpus, params)
    if found is None:
        return _best(corpus.sparkSession.createDataFrame([], SEARCH_SCHEMA), params, relaxed)
    return rerank(survivors(*found, queries, relaxed), found[0], queries, params, relaxed)
