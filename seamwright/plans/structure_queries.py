"""Queries on code structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval, structure as s
from .catalog_queries import P
from .retrieval_queries import CHUNK_TEXT, _bm25_sql


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def python_chunks(spark, d):
    """Chunks made from the files against the chunks delivered; asynchronous ones are plain there."""
    made = s.indexed_chunks(_t(spark, d, "repo_files"), _t(spark, d, "projects"))
    return made.select("project_id", "path", F.regexp_replace("chunk_type", "^async_", "").alias("chunk_type"), "qualified_name", "start_line", "end_line").distinct()


def span_parents(spark, d):
    return s.span_parents(_t(spark, d, "code_chunks"))


def span_sequence(spark, d):
    return s.span_sequence(_t(spark, d, "code_chunks"))


def innermost_span(spark, d):
    chunks = _t(spark, d, "code_chunks")
    points = chunks.select(F.col("id").alias("point_id"), "project_id", "path", F.floor((F.col("start_line") + F.col("end_line")) / 2).alias("line"))
    return s.innermost_spans(points, chunks)


def family_cap_topk(spark, d):
    chunks = _t(spark, d, "code_chunks")
    asked = _t(spark, d, "eval_questions").where("item_id % 50 = 0")
    ranked = retrieval.bm25(chunks, "id", retrieval.chunk_text(), asked, "item_id", F.col("question"), ["path", "start_line", "end_line", "id"], 50)
    return s.family_capped(ranked, s.family_roots(s.span_parents(chunks)), "item_id")


def definition_edges(spark, d):
    return s.definition_edges(_t(spark, d, "code_chunks"))


def bounded_walk(spark, d):
    edges = s.definition_edges(_t(spark, d, "code_chunks"))
    files = edges.where("source LIKE 'file:%'").select(F.col("source").alias("node")).distinct()
    return s.bounded_walk(edges, files, 2)


def relation_edges(spark, d):
    return s.relation_edges(_t(spark, d, "repo_files"), _t(spark, d, "projects"))


QUERIES = {f.__name__: f for f in (python_chunks, span_parents, span_sequence, innermost_span, family_cap_topk, definition_edges, bounded_walk, relation_edges)}

PARENTS = """
c AS (SELECT *, coalesce(parent_symbol, '') AS named FROM code_chunks),
hd AS (SELECT a.id, b.id AS other, b.end_line - b.start_line + 1 AS size FROM c a JOIN c b ON a.project_id = b.project_id AND a.repository_revision = b.repository_revision AND a.path = b.path
  AND a.id <> b.id AND b.start_line <= a.start_line AND b.end_line >= a.end_line AND (b.start_line <> a.start_line OR b.end_line <> a.end_line) AND (a.named = '' OR a.named = b.qualified_name)),
nr AS (SELECT id, count(*) FILTER (size = m) AS n, min(other) FILTER (size = m) AS other FROM (SELECT *, min(size) OVER (PARTITION BY id) AS m FROM hd) GROUP BY 1),
pm AS (SELECT c.id, CASE WHEN n = 1 THEN other END AS parent_id, CASE WHEN n = 1 THEN CASE WHEN named <> '' THEN 'explicit_structural_metadata' ELSE 'span_inference' END END AS authority,
  coalesce(n > 1, false) OR (named <> '' AND n IS NULL) AS ambiguous FROM c LEFT JOIN nr USING (id))"""
EDGES = """
r AS (SELECT project_id, path, qualified_name, coalesce(parent_symbol, '') AS up, 'file:' || project_id || ':' || path AS file, 'chunk:' || id AS node FROM code_chunks),
n AS (SELECT project_id, path, qualified_name AS up, min(node) AS one, max(node) AS two FROM r GROUP BY ALL),
ed AS (SELECT CASE WHEN one = two THEN one ELSE file END AS source, node AS target FROM r LEFT JOIN n USING (project_id, path, up))"""

SQL = {
    "python_chunks": "SELECT DISTINCT project_id, path, chunk_type, qualified_name, start_line, end_line FROM code_chunks",
    "span_parents": f"WITH {PARENTS} SELECT * FROM pm",
    "span_sequence": """
WITH p AS (SELECT id, start_line AS s, end_line AS e, lag(id) OVER w AS before, lag(start_line) OVER w AS s1, lag(end_line) OVER w AS e1 FROM code_chunks
  WINDOW w AS (PARTITION BY project_id, repository_revision, path ORDER BY start_line, end_line DESC, lower(qualified_name), id))
SELECT id, before, CASE WHEN before IS NULL THEN NULL WHEN s1 = s AND e1 = e THEN 'exact_span' WHEN s1 <= s AND e1 >= e THEN 'contains' WHEN s <= s1 AND e >= e1 THEN 'within'
  WHEN greatest(s, s1) <= least(e, e1) THEN 'partial_overlap' ELSE 'disjoint' END AS relation FROM p
""",
    "innermost_span": """
SELECT p.id AS point_id, arg_min(c.id, (c.end_line - c.start_line, -c.start_line, c.id)) AS id FROM code_chunks p JOIN code_chunks c ON p.project_id = c.project_id AND p.path = c.path
  AND (p.start_line + p.end_line) // 2 BETWEEN c.start_line AND c.end_line GROUP BY 1
""",
    "family_cap_topk": "WITH RECURSIVE "
    + _bm25_sql("x", "code_chunks", "id", CHUNK_TEXT, "SELECT item_id AS q, question AS qtext FROM eval_questions WHERE item_id % 50 = 0", "c.path, c.start_line, c.end_line, c.id", 50)
    + f", {PARENTS}, up AS (SELECT id, id AS root, 0 AS lv FROM pm UNION ALL SELECT up.id, pm.parent_id, lv + 1 FROM up JOIN pm ON pm.id = up.root WHERE pm.parent_id IS NOT NULL),"
    + """ rt AS (SELECT id, arg_max(root, lv) AS family FROM up GROUP BY 1),
k AS (SELECT q AS item_id, k AS id, family, place, row_number() OVER (PARTITION BY q, family ORDER BY place) AS seat FROM xrk JOIN rt ON rt.id = k)
SELECT item_id, id, family, final AS place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY place) AS final FROM k WHERE seat <= 2) WHERE final <= 8
""",
    "definition_edges": f"WITH {EDGES} SELECT * FROM ed WHERE source <> target",
    "bounded_walk": f"""
WITH {EDGES}, e AS (SELECT DISTINCT * FROM ed WHERE source <> target), f AS (SELECT DISTINCT source AS seed FROM e WHERE source LIKE 'file:%'),
a AS (SELECT seed, seed AS node, 0 AS depth FROM f UNION ALL SELECT seed, target, 1 FROM f JOIN e ON source = seed
  UNION ALL SELECT f.seed, e2.target, 2 FROM f JOIN e e1 ON e1.source = f.seed JOIN e e2 ON e2.source = e1.target)
SELECT seed, node, min(depth) AS depth FROM a GROUP BY 1, 2
""",
}
