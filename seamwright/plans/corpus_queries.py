"""Queries over snapshots of repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import snapshots


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.repository_changes(spark.read.parquet(f"{d}/repo_files.parquet"), spark.read.parquet(f"{d}/projects.parquet"))


QUERIES = {"p2_found": p2_found}

SQL = {
    "p2_found": r"""
WITH d AS (
  SELECT lower(concat_ws('/', owner, repo)) AS r, id, created_at FROM projects WHERE status IS DISTINCT FROM 'failed'
), p AS (
  SELECT id AS new_id, lag(id) OVER (PARTITION BY r ORDER BY created_at, id) AS old_id FROM d
), f AS (
  SELECT project_id, regexp_replace(replace(path, '\', '/'), '^(\./|/)+', '') AS path, arg_max(sha256(content), id) AS dg
  FROM repo_files GROUP BY 1, 2
), n AS (
  SELECT p.new_id AS pair, f.path, f.dg FROM p JOIN f ON f.project_id = p.new_id WHERE old_id IS NOT NULL
), o AS (
  SELECT p.new_id AS pair, f.path, f.dg FROM p JOIN f ON f.project_id = p.old_id WHERE old_id IS NOT NULL
), j AS (
  SELECT coalesce(n.pair, o.pair) AS project_id, coalesce(n.path, o.path) AS path,
    CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
         WHEN n.dg <> o.dg THEN 'changed' END AS change_type
  FROM n FULL JOIN o ON n.pair = o.pair AND n.path = o.path
)
SELECT project_id, path, change_type FROM j WHERE change_type IS NOT NULL
""",
}
