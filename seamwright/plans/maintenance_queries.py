"""Queries on keeping an index in step with its sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance as m
from ..operators.snapshots import consecutive_pairs
from .catalog_queries import P


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pairs(spark, d):
    delivered = _t(spark, d, "projects").where("coalesce(status, '') != 'failed'").select(F.lower(F.concat_ws("/", "owner", "repo")).alias("repository"), "id", "created_at")
    return consecutive_pairs(delivered, "repository", "id", "created_at")


def manifest_diff(spark, d):
    return m.manifest_diff(m.snapshot_entries(_t(spark, d, "repo_files")), _pairs(spark, d))


def merge_actions(spark, d):
    """Chunks of each file against the same file's chunks one line further down: every key that moved."""
    chunks = _t(spark, d, "code_chunks")
    old = chunks.select("project_id", "path", "qualified_name", "start_line", "content_hash")
    new = chunks.select("project_id", "path", "qualified_name", (F.col("start_line") + F.when(F.col("chunk_type") == "class", 1).otherwise(0)).alias("start_line"), F.when(F.col("chunk_type") == "method", F.reverse("content_hash")).otherwise(F.col("content_hash")).alias("content_hash"))
    acts = m.merge_actions(old, new, ["project_id", "path", "qualified_name", "start_line"], "content_hash")
    return acts.groupBy("project_id", "action").agg(F.count("*").alias("keys"))


def missing_embeddings(spark, d):
    return m.missing_embeddings(_t(spark, d, "code_chunks"), _t(spark, d, "code_chunk_embeddings"), "mock-embed-small")


def stale_embeddings(spark, d):
    return m.stale_embeddings(_t(spark, d, "code_chunks"), _t(spark, d, "code_chunk_embeddings"))


def embedding_coverage(spark, d):
    return m.embedding_coverage(_t(spark, d, "code_chunks"), _t(spark, d, "code_chunk_embeddings"))


def fresh_embeddings(spark, d):
    identity = F.col("identity_eligible") & (F.col("identity_schema_version") == "v2") & F.col("resolved_revision").isNotNull() & F.col("normalized")
    return m.fresh_embeddings(_t(spark, d, "code_chunks"), _t(spark, d, "code_chunk_embeddings"), identity).select("id", "code_chunk_id", "model_name", "embedding_dimension")


def embedding_inputs(spark, d):
    return m.embedding_inputs(_t(spark, d, "code_chunks"))


def reusable_embeddings(spark, d):
    return m.reusable_embeddings(_t(spark, d, "code_chunks"), _t(spark, d, "code_chunk_embeddings"))


def evidence_checks(spark, d):
    return m.evidence_checks(_t(spark, d, "code_chunks"), _t(spark, d, "repo_files"), _t(spark, d, "projects"))


def citation_markers(spark, d):
    return m.citation_markers(_t(spark, d, "documents"))


def token_estimates(spark, d):
    return m.token_estimates(_t(spark, d, "documents"))


def workspace_listing(spark, d):
    """Customers with their nation and pre-aggregated order counts, the second page of twenty."""
    orders = _t(spark, d, "orders")
    counts = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    rows = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(counts, "c_custkey", "left")
    rows = rows.select("c_custkey", "c_name", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("finished", F.lit(0)).alias("finished"))
    return m.page(rows, [F.desc("orders"), F.desc("finished"), F.col("n_name"), F.col("c_custkey")], 20, 20)


def latest_attempt(spark, d):
    """The last event of each user and type; of equal times the smallest id."""
    return m.latest_by(_t(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value"), ["user_id", "event_type"], [F.desc("ts"), F.col("event_id")])


QUERIES = {
    f.__name__: f
    for f in (
        manifest_diff, merge_actions, missing_embeddings, stale_embeddings, embedding_coverage, fresh_embeddings, embedding_inputs, reusable_embeddings,
        evidence_checks, citation_markers, token_estimates, workspace_listing, latest_attempt,
    )
}

SQL = {
    "manifest_diff": f"""
WITH d AS (SELECT lower(concat_ws('/', owner, repo)) AS r, id, created_at FROM projects WHERE status IS DISTINCT FROM 'failed'),
p AS (SELECT id AS new_id, lag(id) OVER (PARTITION BY r ORDER BY created_at, id) AS old_id FROM d),
f AS (SELECT project_id, {P} AS path, arg_max(sha256(coalesce(content, '')), id) AS dg FROM repo_files WHERE path IS NOT NULL AND project_id IS NOT NULL GROUP BY 1, 2),
n AS (SELECT new_id AS pair, path, dg FROM p JOIN f ON project_id = new_id WHERE old_id IS NOT NULL), o AS (SELECT new_id AS pair, path, dg FROM p JOIN f ON project_id = old_id WHERE old_id IS NOT NULL),
j AS (SELECT coalesce(n.pair, o.pair) AS pair, coalesce(n.path, o.path) AS path, o.dg AS was, n.dg AS now FROM n FULL JOIN o ON n.pair = o.pair AND n.path = o.path),
g AS (SELECT pair, was AS dg, min(path) AS path FROM j WHERE now IS NULL GROUP BY 1, 2 HAVING count(*) = 1), a AS (SELECT pair, now AS dg, min(path) AS path FROM j WHERE was IS NULL GROUP BY 1, 2 HAVING count(*) = 1),
rn AS (SELECT g.pair, a.path, g.path AS old_path FROM g JOIN a USING (pair, dg))
SELECT pair AS new_id, path, CASE WHEN was = now THEN 'unchanged' WHEN was IS NOT NULL AND now IS NOT NULL THEN 'modified' WHEN was IS NULL THEN 'added' ELSE 'deleted' END AS change, NULL::VARCHAR AS old_path
FROM j WHERE NOT (was IS NULL AND (pair, path) IN (SELECT (pair, path) FROM rn)) AND NOT (now IS NULL AND (pair, path) IN (SELECT (pair, old_path) FROM rn))
UNION ALL SELECT pair, path, 'renamed', old_path FROM rn
""",
    "merge_actions": """
WITH o AS (SELECT project_id, path, qualified_name, start_line, content_hash FROM code_chunks),
n AS (SELECT project_id, path, qualified_name, start_line + CASE WHEN chunk_type = 'class' THEN 1 ELSE 0 END AS start_line, CASE WHEN chunk_type = 'method' THEN reverse(content_hash) ELSE content_hash END AS content_hash FROM code_chunks)
SELECT coalesce(o.project_id, n.project_id) AS project_id, CASE WHEN o.path IS NULL THEN 'insert' WHEN n.path IS NULL THEN 'delete' WHEN o.content_hash IS NOT DISTINCT FROM n.content_hash THEN 'keep' ELSE 'update' END AS action, count(*) AS keys
FROM o FULL JOIN n ON o.project_id = n.project_id AND o.path = n.path AND o.qualified_name = n.qualified_name AND o.start_line = n.start_line GROUP BY 1, 2
""",
    "missing_embeddings": "SELECT id FROM code_chunks c WHERE NOT EXISTS (SELECT 1 FROM code_chunk_embeddings e WHERE e.code_chunk_id = c.id AND e.content_hash = c.content_hash AND model_name = 'mock-embed-small')",
    "stale_embeddings": "SELECT id FROM code_chunk_embeddings e WHERE NOT EXISTS (SELECT 1 FROM code_chunks c WHERE e.code_chunk_id = c.id AND e.content_hash = c.content_hash)",
    "embedding_coverage": """
WITH t AS (SELECT project_id, count(*) AS chunks FROM code_chunks GROUP BY 1),
h AS (SELECT project_id, model_name, count(DISTINCT code_chunk_id) AS embedded, count(DISTINCT embedding_dimension) AS dimensions FROM code_chunk_embeddings e JOIN code_chunks c ON e.code_chunk_id = c.id AND e.content_hash = c.content_hash GROUP BY 1, 2)
SELECT project_id, model_name, chunks, embedded, round(embedded / chunks, 6) AS coverage, dimensions FROM h JOIN t USING (project_id)
""",
    "fresh_embeddings": "SELECT e.id, code_chunk_id, model_name, embedding_dimension FROM code_chunk_embeddings e JOIN code_chunks c ON e.code_chunk_id = c.id AND e.content_hash = c.content_hash WHERE identity_eligible AND identity_schema_version = 'v2' AND resolved_revision IS NOT NULL AND normalized",
    "embedding_inputs": "SELECT id, sha256(concat_ws(chr(10), 'format: chunk-text-v1', 'path: ' || path, 'type: ' || chunk_type, 'symbol: ' || qualified_name, 'code:', content)) AS input_hash FROM code_chunks",
    "reusable_embeddings": """
WITH f AS (SELECT model_name, content_hash, min(id) AS source_id FROM code_chunk_embeddings GROUP BY 1, 2)
SELECT c.id, model_name, source_id FROM code_chunks c JOIN f USING (content_hash) WHERE NOT EXISTS (SELECT 1 FROM code_chunk_embeddings e WHERE e.code_chunk_id = c.id AND e.content_hash = c.content_hash AND e.model_name = f.model_name)
""",
    "evidence_checks": f"""
WITH f AS (SELECT project_id, {P} AS path, arg_min(content, id) AS fc FROM repo_files WHERE content IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2),
j AS (SELECT c.*, fc, p.repository_revision AS rev, string_split(fc, chr(10)) AS ls FROM code_chunks c LEFT JOIN f USING (project_id, path) LEFT JOIN projects p ON p.id = c.project_id)
SELECT id, CASE WHEN NOT (path <> '' AND NOT contains(path, '\\') AND NOT starts_with(path, '/') AND len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) = 0) THEN 'unsafe repository path'
  WHEN fc IS NULL THEN 'source file no longer exists' WHEN rev IS NULL OR rev <> repository_revision THEN 'repository revision mismatch' WHEN start_line < 1 OR end_line < start_line THEN 'invalid line range'
  WHEN end_line > CASE WHEN ls[-1] = '' THEN len(ls) - 1 ELSE len(ls) END THEN 'line range exceeds stored source'
  WHEN array_to_string(list_slice(ls, start_line, end_line), chr(10)) || CASE WHEN end_line < len(ls) THEN chr(10) ELSE '' END <> content THEN 'stored source no longer matches code chunk'
  WHEN sha256(content) <> content_hash THEN 'content hash mismatch' END AS reason FROM j
""".replace("'\\\\'", "'\\'"),
    "citation_markers": r"""
WITH m AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '\[E[0-9]+\]')) AS marker FROM documents WHERE text IS NOT NULL)
SELECT doc_id, marker, count(*) AS times, min(instr(text, marker) - 1)::BIGINT AS first_char FROM m GROUP BY 1, 2
""",
    "token_estimates": "SELECT source, count(*) AS documents, sum(greatest(1, (length(text) + 3) // 4))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "workspace_listing": """
WITH k AS (SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY 1)
SELECT c_custkey, c_name, n_name, coalesce(orders, 0) AS orders, coalesce(finished, 0) AS finished FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN k ON o_custkey = c_custkey
ORDER BY orders DESC, finished DESC, n_name, c_custkey LIMIT 20 OFFSET 20
""",
    "latest_attempt": "SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1",
}
