"""Semantic-memory queries over the embeddings and documents tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vigil.config import replay_params
from vigil.functions.text import sql_trim_ws
from vigil.operators import memory as SM
from vigil.plans.registry import register
from vigil.session import ensure_checkpoint_dir, stored
from vigil.sources import state as ST
from vigil.sources import store
from vigil.sources import testdata as T

P = replay_params(embedding_dim=64)
R6 = 6


def _dist_sql(a: str, b: str) -> str:
    a, b = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return f"(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def _search_sql(queries_cte: str, relaxed: bool, select: str) -> str:
    base = f"""WITH {T.SQL_MEMORY},
{queries_cte},
pairs AS (SELECT q.query_id, m.id, m.kind, m.source_ref, m.workload, m.category, m.incident_id,
  {_dist_sql('q.embedding', 'm.embedding')} AS distance,
  NOT (q.workload IS NULL AND q.category IS NULL) AS has_facet,
  (q.workload IS NULL OR m.workload IS NULL OR m.workload = q.workload)
  AND (q.category IS NULL OR m.category IS NULL OR m.category = q.category) AS facet_ok
  FROM queries q JOIN mem m ON (q.kind IS NULL OR m.kind = q.kind)
   AND (q.exclude_incident_id IS NULL OR m.incident_id IS NULL OR m.incident_id <> q.exclude_incident_id)),
ok AS (SELECT * FROM pairs WHERE distance <= {P.max_distance}),
s5 AS (SELECT * FROM (SELECT *, 'strict' AS mode, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
  FROM ok WHERE facet_ok) WHERE rank <= {P.top_k}),
r5 AS (SELECT * FROM (SELECT *, 'relaxed' AS mode, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
  FROM ok) WHERE rank <= {P.top_k}),
res AS (SELECT * FROM s5"""
    if relaxed:
        base += " UNION ALL SELECT * FROM r5 WHERE has_facet AND query_id NOT IN (SELECT query_id FROM s5)"
    return base + ")\n" + select


OUT_SQL = f"SELECT query_id, id, source_ref, round(distance, {R6}) AS distance, mode, rank FROM res"


def _out(df):
    return df.select("query_id", "id", "source_ref", F.round("distance", R6).alias("distance"), "mode", "rank")


@register(
    "cosine_distance",
    sql=f"""WITH {T.SQL_MEMORY}, {T.sql_memory_queries()}
SELECT m.id, round({_dist_sql('q.embedding', 'm.embedding')}, {R6}) AS distance FROM mem m JOIN queries q ON q.category = m.category""",
)
def q_cosine_distance(spark, sf):
    m = T.memory(spark, sf)
    q = T.memory_queries(spark, sf).select("category", F.col("embedding").alias("q"))
    j = m.join(q, "category")
    return j.select("id", F.round(SM.cosine_distance("embedding", "q"), R6).alias("distance"))


@register("memory_search", sql=_search_sql(T.sql_memory_queries(), False, OUT_SQL))
def q_memory_search(spark, sf):
    return _out(SM.search(T.memory(spark, sf), T.memory_queries(spark, sf), P))


@register("memory_search_relaxed", sql=_search_sql(T.sql_memory_queries(), True, OUT_SQL))
def q_memory_search_relaxed(spark, sf):
    return _out(SM.search(T.memory(spark, sf), T.memory_queries(spark, sf), P, relaxed=True))


@register("similar_incidents", sql=_search_sql(T.SQL_INCIDENT_QUERIES, True, OUT_SQL))
def q_similar_incidents(spark, sf):
    return _out(SM.search(T.memory(spark, sf), T.incident_queries(spark, sf), P, relaxed=True))


@register(
    "runbook_search",
    sql=_search_sql(
        T.sql_memory_queries(), True,
        "SELECT query_id, 'book_' || left(sha256('Runbook|memory|' || source_ref), 12) AS evidence_id, source_ref,"
        " round_even(least(greatest(1 - distance, 0.0), 1.0), 3) AS retrieval_confidence FROM res",
    ),
)
def q_runbook_search(spark, sf):
    r = SM.search(T.memory(spark, sf), T.memory_queries(spark, sf), P, relaxed=True)
    return SM.to_evidence(r, "Runbook").select("query_id", "evidence_id", "source_ref", "retrieval_confidence")


@register(
    "retrieval_confidence",
    sql=_search_sql(T.SQL_INCIDENT_QUERIES, True,
                    "SELECT query_id, id, round_even(least(greatest(1 - distance, 0.0), 1.0), 3) AS confidence FROM res"),
)
def q_retrieval_confidence(spark, sf):
    r = SM.search(T.memory(spark, sf), T.incident_queries(spark, sf), P, relaxed=True)
    return r.select("query_id", "id", SM.retrieval_confidence("distance").alias("confidence"))


_CRLF = "replace(content, chr(13) || chr(10), chr(10))"
SQL_SECTIONS = f"""WITH {T.SQL_MARKDOWN},
ln AS (SELECT file_name, UNNEST(range(len(parts))) AS pos, UNNEST(parts) AS line
  FROM (SELECT file_name, string_split(markdown, chr(10)) AS parts FROM md)),
tg AS (SELECT *, starts_with(line, '## ') AS is_h,
  CAST(sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) OVER (PARTITION BY file_name ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS h FROM ln),
sec AS (SELECT file_name, h, max(CASE WHEN is_h THEN {sql_trim_ws('substr(line, 4)')} END) AS heading,
  list(line ORDER BY pos) FILTER (WHERE NOT is_h) AS body_lines FROM tg WHERE h > 0 GROUP BY ALL
  HAVING count(*) FILTER (WHERE NOT is_h) > 0 AND max(CASE WHEN is_h THEN {sql_trim_ws('substr(line, 4)')} END) <> ''),
tt AS (SELECT file_name, coalesce({sql_trim_ws("substr(list_filter(string_split(markdown, chr(10)), lambda l: starts_with(l, '# '))[1], 3)")},
  file_name) AS doc_title FROM md),
sections AS (SELECT sec.file_name, h AS section_no, doc_title, heading,
  {sql_trim_ws("array_to_string(body_lines, chr(10))")} AS body,
  sec.file_name || '#' || replace(lower(heading), ' ', '-') AS source_ref, doc_title || ' - ' || heading AS title
  FROM sec JOIN tt USING (file_name)),
sc AS (SELECT *, doc_title || chr(10) || heading || chr(10) || chr(10) || body AS content FROM sections)"""


def sections(spark, sf):
    return SM.split_sections(T.runbook_markdown(spark, sf))


@register(
    "split_sections",
    sql=SQL_SECTIONS + "\nSELECT file_name, section_no, doc_title, heading, source_ref, title, sha256(body) AS body_sha FROM sc",
)
def q_split_sections(spark, sf):
    s = sections(spark, sf)
    return s.select("file_name", F.col("section_no").cast("bigint").alias("section_no"), "doc_title", "heading",
                    "source_ref", "title", F.sha2("body", 256).alias("body_sha"))


@register(
    "content_hash",
    sql=SQL_SECTIONS + f"\nSELECT source_ref, sha256({sql_trim_ws(_CRLF)}) AS content_hash FROM sc",
)
def q_content_hash(spark, sf):
    return sections(spark, sf).select("source_ref", SM.content_hash("content").alias("content_hash"))


def _stored(spark, sf):
    """The index as already stored: documents with a labels row were indexed
    before; those of quality 0 have since changed (their stored hash is stale)."""
    s = sections(spark, sf)
    lab = T.read(spark, sf, "labels").select("doc_id", "quality")
    docs = T.runbook_markdown(spark, sf).select("file_name", "doc_id")
    j = s.join(docs, "file_name").join(lab, "doc_id")
    h = F.when(F.col("quality") == 1, SM.content_hash("content")).otherwise(F.sha2(F.lit("stale"), 256))
    return j.select(F.lit("runbook").alias("kind"), "source_ref", h.alias("content_hash"))


@register(
    "reindex_delta",
    sql=SQL_SECTIONS + f""",
docs AS (SELECT source || '-' || CAST(doc_id AS VARCHAR) AS file_name, doc_id FROM documents),
st AS (SELECT 'runbook' AS kind, sc.source_ref, CASE WHEN l.quality = 1
  THEN sha256({sql_trim_ws("replace(sc.content, chr(13) || chr(10), chr(10))")}) ELSE sha256('stale') END AS content_hash
  FROM sc JOIN docs USING (file_name) JOIN labels l USING (doc_id)),
cur AS (SELECT 'runbook' AS kind, source_ref, sha256({sql_trim_ws("replace(content, chr(13) || chr(10), chr(10))")}) AS content_hash FROM sc)
SELECT kind, source_ref, content_hash FROM cur
WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.kind = cur.kind AND st.source_ref = cur.source_ref AND st.content_hash = cur.content_hash)""",
)
def q_reindex_delta(spark, sf):
    return SM.reindex_delta(sections(spark, sf), _stored(spark, sf)).select("kind", "source_ref", "content_hash")


@register(
    "runbook_category",
    sql=SQL_SECTIONS + """,
rc AS (SELECT * FROM (VALUES ('dependency-latency', 'dependency_latency'), ('pod-crash-loop', 'pod_restart_loop'),
  ('out-of-memory', 'out_of_memory'), ('database-unavailable', 'dependency_unavailable'),
  ('readiness-failure', 'readiness_failure')) t(file_name, category))
SELECT doc_id, n.name AS file_name, rc.category, sc.heading FROM sc JOIN md USING (file_name)
JOIN (SELECT doc_id AS d, ['dependency-latency', 'pod-crash-loop', 'out-of-memory', 'database-unavailable', 'readiness-failure', 'scaling'][doc_id % 6 + 1] AS name FROM md) n
  ON n.d = md.doc_id LEFT JOIN rc ON rc.file_name = n.name""",
)
def q_runbook_category(spark, sf):
    """Sections of runbooks under the five known names and one that has no category."""
    names = F.array(*map(F.lit, [*SM.RUNBOOK_CATEGORY, "scaling"]))
    docs = T.runbook_markdown(spark, sf).select("file_name", "doc_id")
    found = sections(spark, sf).join(docs, "file_name").withColumn("file_name", F.get(names, F.col("doc_id") % 6))
    return SM.runbook_category(found).select("doc_id", "file_name", "category", "heading")


@register(
    "memory_counts",
    sql=f"WITH {T.SQL_MEMORY}\nSELECT kind, count(*) AS n FROM mem GROUP BY kind",
)
def q_memory_counts(spark, sf):
    return T.memory(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register(
    "embedding_dim_check",
    sql=f"SELECT vec_id, len(embedding) = {P.embedding_dim} AS dim_ok FROM embeddings",
)
def q_embedding_dim_check(spark, sf):
    return SM.dim_check(T.read(spark, sf, "embeddings"), P.embedding_dim).select("vec_id", "dim_ok")


@register(
    "memory_upsert",
    sql=f"""WITH {T.SQL_MEMORY},
u AS (SELECT id, kind, 'r-' || CAST(vec_id % 100 AS VARCHAR) AS source_ref, incident_id, category, vec_id AS version,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(vec_id) AS written_at
  FROM mem JOIN embeddings ON mem.id = 'mem-' || CAST(embeddings.vec_id AS VARCHAR))
SELECT kind, source_ref, arg_min(id, version) AS id, arg_min(incident_id, version) AS incident_id,
  arg_max(category, version) AS category, max(version) AS version, min(written_at) AS created_at, max(written_at) AS updated_at
FROM u GROUP BY kind, source_ref""",
)
def q_memory_upsert(spark, sf):
    """Every memory row is a write to (kind, 'r-' || vec_id % 100). The first half of them (by version) is stored; the rest
    is upserted into that table: later versions overwrite, id, incident_id and creation time stay those of the first write."""
    e = T.read(spark, sf, "embeddings").select(F.concat(F.lit("mem-"), F.col("vec_id").cast("string")).alias("id"), "vec_id")
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("vec_id"))
    u = T.memory(spark, sf).join(e, "id").select(
        "id", "kind", F.concat(F.lit("r-"), (F.col("vec_id") % 100).cast("string")).alias("source_ref"),
        "incident_id", "category", F.col("vec_id").alias("version"), at.alias("created_at"), at.alias("updated_at"),
    )
    half = e.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY vec_id)").alias("half"))  # one row
    path = f"{ensure_checkpoint_dir(spark)}/vigil/semantic-memory-{uuid.uuid4().hex}"
    for stored_before in (True, False):
        of_half = F.col("version") <= F.col("half")
        ST.upsert_memory(path, u.crossJoin(half).filter(of_half if stored_before else ~of_half).drop("half"))
    return store.read(spark, path, u.schema).drop(store.BUCKET)


@register(
    "retrieval_query_text",
    sql="""WITH sq AS (SELECT o_orderkey, o_orderpriority AS title, o_orderstatus AS category,
  ['svc-' || CAST(o_custkey % 8 AS VARCHAR), 'svc-' || CAST(o_custkey % 5 AS VARCHAR)] AS w FROM orders)
SELECT o_orderkey, title || '. Category ' || category || ' affecting ' || array_to_string(w, ', ') || '.' AS query_text FROM sq""",
)
def q_retrieval_query_text(spark, sf):
    o = T.read(spark, sf, "orders")
    w = F.array(F.concat(F.lit("svc-"), (F.col("o_custkey") % 8).cast("string")),
                F.concat(F.lit("svc-"), (F.col("o_custkey") % 5).cast("string")))
    txt = F.format_string("%s. Category %s affecting %s.", F.col("o_orderpriority"), F.col("o_orderstatus"), F.array_join(w, ", "))
    return o.select("o_orderkey", txt.alias("query_text"))


@register("ann_search")
def q_ann_search(spark, sf):
    """Coded cells, same facets and self-exclusion as the exact search. Cells are trained, so no SQL repeats it: see ``ann_recall``."""
    r = SM.ann_search(T.memory(spark, sf), T.incident_queries(spark, sf), P)
    return r.select("query_id", "id", F.round("distance", R6).alias("distance"), "mode", "rank")


def _recall_queries(spark, sf):
    """Every fourth memory looks for its like: half of them within their workload, never their own incident."""
    m = T.memory(spark, sf).withColumn("n", F.substring("id", 5, 20).cast("long")).filter(F.col("n") % 4 == 0)
    return m.select(F.concat(F.lit("q-"), "id").alias("query_id"), "embedding", "kind", F.when(F.col("n") % 8 == 0, F.col("workload")).alias("workload"),
                    F.lit(None).cast("string").alias("category"), F.col("incident_id").alias("exclude_incident_id"))


RECALL, COMPARED = 0.9, 0.1  # at least, at most


@register(
    "ann_recall",
    sql=_search_sql("""queries AS (SELECT 'q-' || id AS query_id, embedding, kind,
  CASE WHEN CAST(substr(id, 5) AS BIGINT) % 8 = 0 THEN workload END AS workload, CAST(NULL AS VARCHAR) AS category,
  incident_id AS exclude_incident_id FROM mem WHERE CAST(substr(id, 5) AS BIGINT) % 4 = 0)""", True,
                    "SELECT (SELECT count(*) FROM queries) AS queries, count(*) AS matches, true AS recall_reached, true AS few_compared FROM res"),
)
def q_ann_recall(spark, sf):
    """The approximate search of many queries against the exact one: matches that exist, whether ``RECALL`` of them are
    found, and whether at most ``COMPARED`` of all (query, memory) pairs were compared exactly."""
    m, q = T.memory(spark, sf), _recall_queries(spark, sf)
    exact = SM.search(m, q, P, relaxed=True).select("query_id", "id", "mode")
    index, cells = SM.ann_index(m, P)
    left = stored(SM.survivors(index, cells, q), "survivors")
    found = SM.rerank(left, index, q, P).select("query_id", "id", "mode", F.lit(1).alias("hit"))
    hits = exact.join(found, ["query_id", "id", "mode"], "left").agg(F.count(F.lit(1)).alias("matches"), F.count("hit").alias("found"))
    sizes = [d.agg(F.count(F.lit(1)).alias(n)) for d, n in ((q, "queries"), (left, "compared"), (m, "memories"))]
    row = hits
    for one in sizes:
        row = row.crossJoin(one)  # one row each
    return row.select("queries", "matches", (F.col("found") >= RECALL * F.col("matches")).alias("recall_reached"),
                      (F.col("compared") <= COMPARED * F.col("queries") * F.col("memories")).alias("few_compared"))
