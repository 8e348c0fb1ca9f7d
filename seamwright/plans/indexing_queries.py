"""Queries on reading sources, incremental indexing and the combined search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import compared_path
from ..operators import catalog, evaluation, maintenance, structure
from ..operators import indexing as ix
from ..sources import readers, writers
from .catalog_queries import BEST, P
from .learning_queries import GOLD, RANKED, _ranked
from .maintenance_queries import _pairs
from .retrieval_queries import CHUNK_TEXT, WORDS, _bm25_sql, _questions, asked_words, bm25_documents, bm25_topk
from .structure_queries import EDGES, PARENTS


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def tracked_files(spark, d):
    """With the limits of an import: 50 MB and 2,000 files a snapshot, 1 MB a file."""
    return readers.tracked_files(_t(spark, d, "repo_files"), 50_000_000, 2_000, 1_000_000)


def source_lines(spark, d):
    """With the limits of a reading: 200 lines and 32,768 bytes."""
    spans = _t(spark, d, "code_chunks").select(F.col("id").alias("span_id"), "project_id", "path", "start_line", "end_line")
    return readers.source_lines(_t(spark, d, "repo_files"), spans)


def project_report(spark, d):
    files = _t(spark, d, "repo_files")
    return writers.project_report(catalog.project_summaries(files), catalog.modules(files)).select("project_id", F.sha2("report", 256).alias("report_hash"))


def incremental_chunks(spark, d):
    """Chunks of the latest ready snapshots that have a snapshot before them, made from that one's."""
    files, projects = _t(spark, d, "repo_files"), _t(spark, d, "projects")
    pairs = _pairs(spark, d).join(structure.latest_ready(projects).select(F.col("project_id").alias("new_id")), "new_id", "left_semi")
    # paths of all pairs at once: a path is told apart by its pair
    path = compared_path(F.col("path"))
    of = lambda side: files.join(pairs.select(F.col(side).alias("project_id"), F.col("new_id").alias("pair")), "project_id").where("content IS NOT NULL").select(F.concat_ws(":", "pair", path).alias("path"), "content", "id")
    last = lambda df: df.groupBy("path").agg(F.max_by("content", "id").alias("content"), F.max("id").alias("id"))
    old, new = last(of("old_id")), last(of("new_id"))
    entries = lambda df, s: df.select(F.lit(s).alias("snapshot"), "path", F.sha2("content", 256).alias("digest"))
    diff = maintenance.manifest_diff(entries(old, "o").unionByName(entries(new, "n")), spark.createDataFrame([("o", "n")], "old_id string, new_id string"))
    made = ix.incremental_chunks(structure.python_chunks(old), diff, new)
    pair = F.element_at(F.split("path", ":"), 1)
    return made.select(pair.alias("project_id"), F.regexp_replace("path", "^[^:]*:", "").alias("path"), F.regexp_replace("chunk_type", "^async_", "").alias("chunk_type"), "qualified_name", "start_line", "end_line").distinct()


def structure_hashes(spark, d):
    return ix.structure_hashes(_t(spark, d, "repo_files"))


def embed_missing(spark, d):
    return ix.embed_missing(_t(spark, d, "code_chunks"), _t(spark, d, "code_chunk_embeddings"), "mock-embed-small")


def combined_search(spark, d):
    return ix.search(_t(spark, d, "code_chunks"), _questions(spark, d), "item_id", "question")


def evidence_rows(spark, d):
    return ix.evidence_rows(bm25_topk(spark, d), _t(spark, d, "code_chunks"), "item_id")


def best_snippets(spark, d):
    asked = _questions(spark, d).select("item_id", asked_words("question").alias("words"))
    got = ix.best_snippets(bm25_documents(spark, d).where("place <= 6"), _t(spark, d, "documents"), asked, "item_id", "doc_id", "text", 1200)
    return got.select("item_id", "doc_id", "line", "hits")


def one_hop_expand(spark, d):
    return ix.one_hop(bm25_topk(spark, d), _t(spark, d, "code_chunks"), "item_id")


def one_hop_relations(spark, d):
    chunks = _t(spark, d, "code_chunks")
    links = structure.relation_links(chunks, structure.relation_edges(_t(spark, d, "repo_files"), _t(spark, d, "projects")))
    return ix.one_hop_relations(bm25_topk(spark, d), links, "item_id")


def failure_labels(spark, d):
    lexical, _, gold = _ranked(spark, d)
    return ix.failure_labels(lexical, gold, _t(spark, d, "code_chunks"), "hint_id")


def half_cover(spark, d):
    return evaluation.half_cover(_t(spark, d, "code_chunks"), "id")


def stratified_ci(spark, d):
    lexical, _, gold = _ranked(spark, d)
    scored = evaluation.query_metrics(lexical, gold, "hint_id", "id").join(_t(spark, d, "code_chunks").select(F.col("id").alias("hint_id"), "project_id"), "hint_id")
    return evaluation.stratified_bootstrap(scored, "project_id", "hint_id", "mrr_at_8")


def hierarchy_sequence(spark, d):
    """Each chunk against the one before it in its file: parent, child, sibling, or how their spans lie."""
    chunks = _t(spark, d, "code_chunks")
    up = structure.span_parents(chunks).select("id", "parent_id", "ambiguous")
    seq = structure.span_sequence(chunks).where("before IS NOT NULL")
    both = seq.join(up.select("id", F.col("parent_id").alias("p2"), F.col("ambiguous").alias("a2")), "id").join(up.select(F.col("id").alias("before"), F.col("parent_id").alias("p1"), F.col("ambiguous").alias("a1")), "before")
    label = (
        F.when(F.col("a1") | F.col("a2"), "ambiguous").when(F.col("relation") == "exact_span", "exact_span").when(F.col("p2") == F.col("before"), "parent")
        .when(F.col("p1") == F.col("id"), "child").when(F.col("p1") == F.col("p2"), "sibling").otherwise(F.col("relation"))
    )
    return both.select("id", "before", label.alias("relation"))


QUERIES = {
    f.__name__: f
    for f in (
        tracked_files, source_lines, project_report, incremental_chunks, structure_hashes, embed_missing, combined_search, evidence_rows, best_snippets, one_hop_expand, one_hop_relations,
        failure_labels, half_cover, stratified_ci, hierarchy_sequence,
    )
}

XRK = _bm25_sql("x", "code_chunks", "id", CHUNK_TEXT, "SELECT item_id AS q, question AS qtext FROM eval_questions WHERE item_id % 50 = 0", "c.path, c.start_line, c.end_line, c.id", 20)

SQL = {
    "tracked_files": f"""
WITH RECURSIVE b AS (SELECT id, project_id, {P} AS path, strlen(content) AS bytes FROM repo_files WHERE path IS NOT NULL AND content IS NOT NULL AND project_id IS NOT NULL AND strlen(content) <= 1000000 AND NOT contains(substr(content, 1, 2000), chr(0))),
n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY path, id) AS k FROM b),
t AS (SELECT id, project_id, path, bytes, k, bytes AS used, 1 AS files, true AS ok FROM n WHERE k = 1
  UNION ALL SELECT n.id, n.project_id, n.path, n.bytes, n.k, CASE WHEN files < 2000 AND used + n.bytes <= 50000000 THEN used + n.bytes ELSE used END, CASE WHEN files < 2000 AND used + n.bytes <= 50000000 THEN files + 1 ELSE files END,
    files < 2000 AND used + n.bytes <= 50000000 FROM t JOIN n ON n.project_id = t.project_id AND n.k = t.k + 1)
SELECT id, project_id, path, bytes FROM t WHERE ok
""",
    "source_lines": f"""
WITH f AS (SELECT project_id, {P} AS path, arg_min(content, id) AS c FROM repo_files WHERE content IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2),
s AS (SELECT k.id AS span_id, array_to_string(list_slice(string_split(c, chr(10)), greatest(start_line, 1), greatest(start_line, 1) + least(end_line - start_line + 1, 200) - 1), chr(10)) AS t, end_line - start_line + 1 > 200 AS long
  FROM code_chunks k JOIN f USING (project_id, path)),
n AS (SELECT *, len(string_split(t, chr(10))) AS lines, strlen(t) > 32768 AS wide,
  list_max(list_filter(range(least(len(t), 32768) + 1), lambda i: strlen(left(t, i)) <= 32768)) AS fit FROM s WHERE strlen(t) > 32768
  UNION ALL SELECT *, len(string_split(t, chr(10))), false, len(t) FROM s WHERE strlen(t) <= 32768)
SELECT span_id, lines, sha256(left(t, fit)) AS text_hash, long OR wide AS truncated FROM n
""",
    "project_report": f"""
WITH {BEST}, l AS (SELECT project_id, language, count(*) AS n FROM profiles WHERE language NOT IN ('Markdown', 'JSON', 'TOML', 'YAML', 'Text') GROUP BY 1, 2),
m AS (SELECT project_id, language FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, language) AS r FROM l) WHERE r = 1),
a AS (SELECT project_id, module, count(*) AS n FROM best GROUP BY 1, 2), g AS (SELECT project_id, sum(n)::BIGINT AS files, string_agg('- ' || module || ' (' || n || ')', chr(10) ORDER BY module) AS body FROM a GROUP BY 1)
SELECT project_id, sha256('# ' || project_id || chr(10) || 'files: ' || files || chr(10) || 'language: ' || coalesce(m.language, 'Unknown') || chr(10) || chr(10) || body) AS report_hash FROM g LEFT JOIN m USING (project_id)
""",
    "incremental_chunks": """
WITH d AS (SELECT lower(concat_ws('/', owner, repo)) AS r, id, created_at FROM projects WHERE status IS DISTINCT FROM 'failed'),
p AS (SELECT id, lag(id) OVER (PARTITION BY r ORDER BY created_at, id) AS old_id FROM d)
SELECT DISTINCT project_id, path, chunk_type, qualified_name, start_line, end_line FROM code_chunks WHERE project_id IN (SELECT id FROM p WHERE old_id IS NOT NULL)
""",
    "evidence_rows": f"""
WITH {XRK} SELECT q AS item_id, 'E' || place AS evidence_id, k AS id, '[E' || place || '] ' || path || ':' || start_line || '-' || end_line AS token, sha256(substr(content, 1, 2000)) AS excerpt_hash FROM xrk JOIN code_chunks c ON c.id = k
""",
    "best_snippets": "WITH docs AS (SELECT * FROM documents WHERE text IS NOT NULL), "
    + _bm25_sql("x", "docs", "doc_id", "text", "SELECT item_id AS q, question AS qtext FROM eval_questions WHERE item_id % 50 = 0", "k", 6)
    + f""", w AS (SELECT item_id, {WORDS} AS ws FROM eval_questions WHERE item_id % 50 = 0),
l AS (SELECT q, k, string_split(replace(lower(text), chr(13) || chr(10), chr(10)), chr(10)) AS ls, ws FROM xrk JOIN docs ON doc_id = k JOIN w ON item_id = q),
h AS (SELECT q, k, unnest(list_transform(ls, lambda x: len(list_filter(ws, lambda y: contains(x, y))))) AS hits, unnest(range(1, len(ls) + 1)) AS line FROM l)
SELECT q AS item_id, k AS doc_id, arg_min(line, (-hits, line)) AS line, max(hits) AS hits FROM h GROUP BY 1, 2
""",
    "one_hop_expand": f"""
WITH {XRK}, {EDGES}, e AS (SELECT * FROM ed WHERE source <> target), b AS (SELECT source, target FROM e WHERE target LIKE 'chunk:%' UNION ALL SELECT target, source FROM e WHERE source LIKE 'chunk:%'),
s AS (SELECT q, place, 'chunk:' || k AS source FROM xrk WHERE place <= 12),
hop AS (SELECT s.q, s.place, b.target, row_number() OVER (PARTITION BY s.q, s.source ORDER BY b.target) AS seat FROM s JOIN b USING (source)),
t AS (SELECT q, target, round(max(0.7::DOUBLE / (1 + place)), 9) AS priority, count(*) AS paths FROM hop WHERE seat <= 8 AND (q, target) NOT IN (SELECT (q, source) FROM s) GROUP BY 1, 2)
SELECT * FROM (SELECT q AS item_id, target, priority, paths, row_number() OVER (PARTITION BY q ORDER BY priority DESC, target) AS place FROM t) WHERE place <= 24
""",
    "failure_labels": f"""
WITH {RANKED}, {GOLD}, w AS (SELECT hint_id, gd.id AS g, path AS gp FROM gd JOIN code_chunks c ON c.id = gd.id),
h AS (SELECT hint_id, min(place) FILTER (k = g) AS first, bool_or(path = gp) AS near FROM xrk JOIN code_chunks c ON c.id = k JOIN w ON hint_id = q GROUP BY 1)
SELECT DISTINCT w.hint_id, CASE WHEN first = 1 THEN 'found_first' WHEN first IS NOT NULL THEN 'found_later' WHEN near THEN 'path_only' WHEN near IS NOT NULL THEN 'missed' ELSE 'no_results' END AS label FROM w LEFT JOIN h USING (hint_id)
""",
    "half_cover": "SELECT id, CASE WHEN row_number() OVER (ORDER BY id) <= (count(*) OVER () + 1) // 2 THEN 'A' ELSE 'B' END AS part FROM code_chunks",
    "hierarchy_sequence": f"""
WITH {PARENTS}, q AS (SELECT id, start_line AS s, end_line AS e, lag(id) OVER w AS before, lag(start_line) OVER w AS s1, lag(end_line) OVER w AS e1 FROM code_chunks
  WINDOW w AS (PARTITION BY project_id, repository_revision, path ORDER BY start_line, end_line DESC, lower(qualified_name), id))
SELECT q.id, before, CASE WHEN a.ambiguous OR b.ambiguous THEN 'ambiguous' WHEN s1 = s AND e1 = e THEN 'exact_span' WHEN b.parent_id = before THEN 'parent' WHEN a.parent_id = q.id THEN 'child' WHEN a.parent_id = b.parent_id THEN 'sibling'
  WHEN s1 <= s AND e1 >= e THEN 'contains' WHEN s <= s1 AND e >= e1 THEN 'within' WHEN greatest(s, s1) <= least(e, e1) THEN 'partial_overlap' ELSE 'disjoint' END AS relation
FROM q JOIN pm b ON b.id = q.id JOIN pm a ON a.id = before WHERE before IS NOT NULL
""",
}
