"""Lookups and roll-ups with SQL for comparison."""

from __future__ import annotations

from ..operators import lookups as k
from ..operators import maintenance
from .maintenance_queries import SQL as MAINTENANCE_SQL


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunk_identities(spark, d):
    return k.chunk_identities(_t(spark, d, "code_chunks"))


def latest_deliveries(spark, d):
    return k.latest_deliveries(_t(spark, d, "projects"))


def projects_without_chunks(spark, d):
    return k.projects_without_chunks(_t(spark, d, "projects"), _t(spark, d, "code_chunks"))


def answer_references(spark, d):
    return k.answer_references(_t(spark, d, "documents"))


def acceptance(spark, d):
    chunks = _t(spark, d, "code_chunks")
    return k.acceptance(maintenance.evidence_checks(chunks, _t(spark, d, "repo_files"), _t(spark, d, "projects")), chunks)


def event_diagnostics(spark, d):
    return k.event_diagnostics(_t(spark, d, "learning_events"))


def recovered_runs(spark, d):
    return k.recovered_runs(_t(spark, d, "projects"))


def warning_counts(spark, d):
    return k.warning_counts(_t(spark, d, "repo_files"))


def scoped_chunks(spark, d):
    return k.scoped_chunks(_t(spark, d, "code_chunks"))


QUERIES = {
    f.__name__: f
    for f in (chunk_identities, latest_deliveries, projects_without_chunks, answer_references, acceptance, event_diagnostics, recovered_runs, warning_counts, scoped_chunks)
}

SQL = {
    "chunk_identities": r"""
SELECT id, sha256(concat_ws('|', coalesce(project_id, ''), coalesce(repository_revision, ''), coalesce(path, ''), coalesce(start_line::VARCHAR, ''), coalesce(end_line::VARCHAR, ''), coalesce(content_hash, ''), id::VARCHAR)) AS identity,
  replace(regexp_replace(regexp_replace(path, '\.py$', ''), '(?:^|/)__init__$', ''), '/', '.') AS module, regexp_replace(lower(qualified_name), '[^a-z0-9]', '', 'g') AS name_key,
  path <> '' AND NOT contains(path, '\') AND NOT starts_with(path, '/') AND len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS safe,
  greatest(1, (length(content) + 3) // 4) AS estimate, list_extract(string_split(path, '/'), -1) AS file FROM code_chunks
""",
    "latest_deliveries": """
WITH r AS (SELECT lower(concat_ws('/', owner, repo)) AS repository, id, repository_revision, row_number() OVER w AS n, lead(repository_revision) OVER w AS before, count(*) OVER (PARTITION BY lower(concat_ws('/', owner, repo))) AS deliveries
  FROM projects WINDOW w AS (PARTITION BY lower(concat_ws('/', owner, repo)) ORDER BY created_at DESC NULLS LAST, id DESC))
SELECT repository, id, repository_revision, deliveries, CASE WHEN deliveries = 1 THEN 'first' WHEN before = repository_revision THEN 'unchanged' ELSE 'update_available' END AS state FROM r WHERE n = 1
""",
    "projects_without_chunks": "SELECT id, status FROM projects p WHERE NOT EXISTS (SELECT 1 FROM code_chunks c WHERE c.project_id = p.id)",
    "answer_references": r"""
WITH m AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\[E([0-9]+)\]', 1)) AS m FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(m) AS markers, len(list_filter(m, lambda x: length(x) > 9 OR TRY_CAST(x AS INT) > 5 OR TRY_CAST(x AS INT) < 1)) AS unknown FROM m WHERE len(m) > 0
""",
    "acceptance": f"""
WITH e AS ({MAINTENANCE_SQL["evidence_checks"]}) SELECT project_id, count(*) AS chunks, count(*) FILTER (reason IS NULL) AS passed, round(avg((reason IS NULL)::INT), 6) AS rate, bool_and(reason IS NULL) AS accepted FROM e JOIN code_chunks USING (id) GROUP BY 1
""",
    "event_diagnostics": """
SELECT CASE WHEN grouping(project_id) = 0 THEN 'project' WHEN grouping(event_type) = 0 THEN 'type' ELSE 'all' END AS level, project_id, event_type, count(*) AS events, count(DISTINCT learner_id) AS learners, count(DISTINCT task_id) AS tasks
FROM learning_events GROUP BY GROUPING SETS ((project_id), (event_type), ())
""",
    "recovered_runs": """
SELECT id, CASE WHEN status IS NULL OR status IN ('pending', 'running') THEN 'failed' ELSE status END AS status, CASE WHEN status IS NULL OR status IN ('pending', 'running') THEN 'interrupted' ELSE coalesce(error_message, '') END AS error,
  status IS NULL OR status IN ('pending', 'running', 'failed') AS retryable FROM projects
""",
    "warning_counts": r"""
WITH f AS (SELECT *, coalesce(content, '') AS t FROM repo_files), w AS (SELECT project_id, unnest([CASE WHEN content IS NULL THEN 'no_content' END, CASE WHEN contains(path, '\') OR starts_with(path, './') OR starts_with(path, '/') THEN 'path_spelling' END,
  CASE WHEN contains(t, chr(13) || chr(10)) THEN 'crlf' END, CASE WHEN t <> '' AND NOT ends_with(t, chr(10)) THEN 'no_final_newline' END, CASE WHEN language IS NULL THEN 'no_language' END, CASE WHEN coalesce(size <> strlen(t), true) THEN 'stale_size' END]) AS warning FROM f)
SELECT project_id, warning, count(*) AS files FROM w WHERE warning IS NOT NULL GROUP BY 1, 2
""",
    "scoped_chunks": "SELECT id, place FROM (SELECT id, row_number() OVER (PARTITION BY project_id, repository_revision, path ORDER BY start_line, end_line DESC, qualified_name, chunk_type, id) AS place FROM code_chunks) WHERE place <= 8",
}
