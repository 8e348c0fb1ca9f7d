"""Queries on files and snapshots, with SQL for comparison."""

from __future__ import annotations

from ..functions.paths import LANGUAGE_BY_SUFFIX
from ..operators import catalog as c


def _q(f, name="repo_files"):
    return lambda spark, d: f(spark.read.parquet(f"{d}/{name}.parquet"))


QUERIES = {
    "candidate_files": _q(c.candidate_files),
    "file_profiles": _q(c.file_profiles),
    "project_summaries": _q(c.project_summaries),
    "project_modules": _q(c.modules),
    "module_dependencies": _q(c.module_dependencies),
    "directory_tree": _q(c.directory_tree),
    "project_frameworks": _q(c.frameworks),
    "start_commands": _q(c.start_commands),
    "script_symbols": _q(c.script_symbols),
    "repository_addresses": _q(c.repository_addresses, "projects"),
    "manifest_hash": _q(c.manifests),
}


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


P = r"regexp_replace(replace(path, '\', '/'), '^(\./|/)+', '')"
NAME = "list_extract(string_split(p, '/'), -1)"
EXT = f"lower(regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1))"
LANGUAGE = "CASE " + " ".join(f"WHEN lower(regexp_extract(path, '\\.([^./\\\\]*)$', 1)) = '{k}' THEN '{v}'" for k, v in LANGUAGE_BY_SUFFIX.items()) + " ELSE 'Text' END"
STRINGS = "coalesce(TRY_CAST({c} AS VARCHAR[]), [])"
IMPORTS = "coalesce(CASE WHEN json_valid(imports_json) THEN from_json(imports_json, '[\"VARCHAR\"]') END, [])"
SYMBOLS = "coalesce(CASE WHEN json_valid(symbols_json) THEN from_json(symbols_json, '[\"VARCHAR\"]') END, [])"

PROFILES = f"""
base AS (SELECT id, project_id, path, {P} AS p, coalesce(content, '') AS t, {IMPORTS} AS imps, {SYMBOLS} AS syms FROM repo_files WHERE path IS NOT NULL),
scored AS (
  SELECT id, project_id, p AS path, {LANGUAGE} AS language, strlen(t) AS bytes, length(t) - length(replace(t, chr(10), '')) AS line_ends,
    round(CASE WHEN lower({NAME}) LIKE 'readme%' THEN 100.0::DOUBLE ELSE 0 END
      + CASE WHEN {NAME} IN {_list(c.DEPENDENCY_NAMES)} THEN 82.0::DOUBLE ELSE 0 END
      + CASE WHEN lower({NAME}) IN {_list(c.ENTRY_NAMES)} THEN 76.0::DOUBLE ELSE 0 END
      + CASE WHEN list_contains(string_split(p, '/'), 'src') OR list_contains(string_split(p, '/'), 'app') THEN 18.0::DOUBLE ELSE 0 END
      - CASE WHEN contains(lower(p), 'test') OR contains(lower(p), 'spec') THEN 8.0::DOUBLE ELSE 0 END
      + CASE WHEN contains(lower({NAME}), 'config') OR starts_with({NAME}, 'vite.config') THEN 32.0::DOUBLE ELSE 0 END
      + CASE WHEN contains(t, '__main__') OR contains(t, 'if __name__') THEN 28.0::DOUBLE ELSE 0 END
      + CASE WHEN contains(t, 'FastAPI(') OR contains(t, 'createRoot(') OR contains(t, 'ReactDOM') THEN 35.0::DOUBLE ELSE 0 END
      + least(len(imps), 12) * 2.2::DOUBLE + least(len(syms), 12) * 1.5::DOUBLE + least(length(t), 8000) / 8000.0::DOUBLE, 6) AS importance
  FROM base
),
profiles AS (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY importance DESC, id) <= 14 AND importance > 12 AS is_core FROM scored
)"""
MODULE = f"""CASE WHEN lower({NAME}) LIKE 'readme%' OR {EXT} = '.md' THEN 'docs' WHEN {NAME} IN ('package.json', 'pyproject.toml', 'requirements.txt') THEN 'project-config'
  WHEN contains(p, '/') THEN list_extract(string_split(p, '/'), 1) ELSE 'root' END"""
BEST = f"""{PROFILES},
parts AS (SELECT *, path AS p FROM profiles), keyed AS (SELECT *, {MODULE} AS module FROM parts),
best AS (SELECT *, row_number() OVER (PARTITION BY project_id, module ORDER BY importance DESC, path, id) AS place FROM keyed)"""

SQL = {
    "candidate_files": f"""
WITH base AS (SELECT id, project_id, {P} AS p, strlen(content) AS bytes FROM repo_files WHERE path IS NOT NULL AND content IS NOT NULL AND project_id IS NOT NULL),
kept AS (SELECT * FROM base WHERE bytes <= {c.MAX_FILE_BYTES}
  AND NOT len(list_filter(string_split(p, '/'), lambda x: lower(x) IN {_list(c.SKIP_PARTS)} OR (starts_with(x, '.') AND x <> '.env'))) > 0
  AND ({EXT} IN {_list(c.TEXT_SUFFIXES)} OR {NAME} IN {_list(c.IMPORTANT_NAMES)}) AND NOT ({EXT} IN ('.md', '.mdx') AND NOT lower({NAME}) LIKE 'readme%')),
scored AS (SELECT id, project_id, p AS path, least(100,
    CASE WHEN {NAME} IN {_list(c.ROOT_NAMES)} OR lower({NAME}) LIKE 'readme%' THEN 0 ELSE 100 END,
    CASE WHEN list_extract(string_split(p, '/'), 1) IN {_list(c.PRIORITY_DIRS)} THEN 12 ELSE 100 END,
    CASE WHEN lower({NAME}) IN {_list(c.FIRST_NAMES)} THEN 4 ELSE 100 END,
    CASE WHEN {EXT} IN ('.py', '.js', '.jsx', '.ts', '.tsx') THEN 20 ELSE 100 END)
    + CASE WHEN contains(lower(p), 'test') OR contains(lower(p), 'spec') THEN 20 ELSE 0 END AS score, len(string_split(p, '/')) AS depth FROM kept)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score, depth, path, id) AS place FROM scored) WHERE place <= {c.MAX_FILES}
""",
    "file_profiles": f"WITH {PROFILES} SELECT id, project_id, path, language, importance, bytes, line_ends, is_core FROM profiles",
    "project_summaries": f"""
WITH {PROFILES}, l AS (SELECT project_id, language, count(*) AS n FROM profiles WHERE language NOT IN ('Markdown', 'JSON', 'TOML', 'YAML', 'Text') GROUP BY 1, 2),
m AS (SELECT project_id, language FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, language) AS r FROM l) WHERE r = 1)
SELECT project_id, count(*) AS files, count(*) FILTER (is_core) AS core_files, sum(bytes)::BIGINT AS bytes, coalesce(any_value(m.language), 'Unknown') AS primary_language
FROM profiles LEFT JOIN m USING (project_id) GROUP BY project_id
""",
    "project_modules": f"""
WITH {BEST} SELECT project_id, module, count(*) AS files, string_agg(path, chr(10) ORDER BY place) FILTER (place <= 8) AS top_files FROM best GROUP BY 1, 2
""",
    "module_dependencies": rf"""
WITH {BEST}, i AS (SELECT id, unnest({IMPORTS}) AS imported FROM repo_files),
e AS (SELECT DISTINCT b.project_id, b.module, list_extract(string_split(list_extract(string_split(regexp_replace(imported, '^[./]+|[./]+$', '', 'g'), '/'), 1), '.'), 1) AS depends_on
  FROM best b JOIN i USING (id) WHERE place <= 8)
SELECT project_id, module, depends_on FROM e WHERE depends_on <> module AND (project_id, depends_on) IN (SELECT (project_id, module) FROM best)
""",
    "directory_tree": f"""
WITH f AS (SELECT DISTINCT project_id, {P} AS p FROM repo_files WHERE path IS NOT NULL),
d AS (SELECT project_id, p, unnest(range(1, len(string_split(p, '/')))) AS depth FROM f)
SELECT project_id, array_to_string(list_slice(string_split(p, '/'), 1, depth), '/') AS path, depth, count(*) AS files FROM d GROUP BY ALL
""",
    "project_frameworks": f"""
WITH f AS (SELECT project_id, {P} AS p, coalesce(content, '') AS t, lower(coalesce(content, '')) AS l FROM repo_files WHERE path IS NOT NULL),
k AS (SELECT project_id, unnest(list_concat(coalesce(json_keys(t, '$.dependencies'), []), coalesce(json_keys(t, '$.devDependencies'), []))) AS key FROM f WHERE p = 'package.json' AND json_valid(t))
"""
    + " UNION ".join(
        [
            *(f"SELECT project_id, '{v}' AS framework FROM f WHERE {NAME} IN ('requirements.txt', 'pyproject.toml') AND contains(l, '{m}')" for m, v in c._DEPENDENCY_MARKERS.items()),
            *(f"SELECT project_id, '{v}' FROM k WHERE key = '{m}'" for m, v in c._PACKAGE_MARKERS.items()),
            "SELECT project_id, 'FastAPI' FROM f WHERE contains(t, 'FastAPI(')",
            "SELECT project_id, 'React' FROM f WHERE contains(t, 'createRoot(') OR contains(t, 'ReactDOM')",
            "SELECT project_id, 'Vite' FROM f WHERE contains(t, 'defineConfig') AND contains(l, 'vite')",
        ]
    ),
    "start_commands": f"""
WITH f AS (SELECT project_id, {P} AS p, id, content FROM repo_files WHERE path IS NOT NULL),
l AS (SELECT project_id, p, id, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) AS x, generate_subscripts(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), 1) AS n FROM f WHERE content IS NOT NULL AND lower({NAME}) LIKE 'readme%'),
c AS (SELECT project_id, (5, p, id, n) AS spot, regexp_replace(x, '^[` >]+|[` >]+$', '', 'g') AS command FROM l),
k AS (SELECT project_id, json_keys(content, '$.scripts') AS names FROM f WHERE p = 'package.json' AND json_valid(content)),
u AS (SELECT project_id, spot, command FROM c WHERE regexp_matches(command, '^(npm|pnpm|yarn|python|uvicorn|streamlit|pytest)\\b')
  UNION ALL SELECT project_id, (i, '', 0, 0), 'npm run ' || name FROM k, (SELECT unnest(range(5)) AS i, unnest(['dev', 'start', 'serve', 'preview', 'test']) AS name) WHERE list_contains(names, name)
  UNION ALL SELECT project_id, (6, '', 0, 0), 'python main.py' FROM f WHERE {NAME} = 'main.py'),
g AS (SELECT project_id, command, min(spot) AS first_at FROM u GROUP BY 1, 2)
SELECT * FROM (SELECT project_id, command, row_number() OVER (PARTITION BY project_id ORDER BY first_at, command) AS place FROM g) WHERE place <= 10
""".replace("\\\\b", "\\b"),
    "script_symbols": rf"""
WITH f AS (SELECT id, content AS t, {LANGUAGE} AS language FROM repo_files WHERE content IS NOT NULL),
s AS (SELECT id,
  list_sort(list_distinct(list_concat(regexp_extract_all(t, 'import\s+(?:[^''"]+\s+from\s+)?[''"]([^''"]+)[''"]', 1), regexp_extract_all(t, 'require\([''"]([^''"]+)[''"]\)', 1)))) AS i,
  list_filter(regexp_extract_all(t, 'export\s+(?:default\s+)?(?:function|class|const|let|var)?\s*([A-Za-z0-9_]*)', 1), lambda x: x <> '') AS e,
  regexp_extract_all(t, '(?:function|class)\s+([A-Za-z0-9_]+)', 1) AS f1, regexp_extract_all(t, 'const\s+([A-Za-z0-9_]+)\s*=\s*(?:\([^)]*\)|[A-Za-z0-9_]+)\s*=>', 1) AS a
  FROM f WHERE language IN ('JavaScript', 'TypeScript'))
SELECT id, array_to_string(i, ',') AS imports, array_to_string(e, ',') AS exports, array_to_string(list_slice(list_concat(f1, a, e), 1, 40), ',') AS symbols FROM s
""",
    "repository_addresses": r"""
WITH u AS (SELECT *, coalesce(repo_url, '') AS u FROM projects)
SELECT id, lower(regexp_extract(u, '^https://([^/@:?#\s]+)(:443)?/([^/?#\s]+)/([^/?#\s]+?)(?:\.git)?/?$', 3)) AS url_owner,
  lower(regexp_extract(u, '^https://([^/@:?#\s]+)(:443)?/([^/?#\s]+)/([^/?#\s]+?)(?:\.git)?/?$', 4)) AS url_repo,
  regexp_matches(u, '^https://([^/@:?#\s]+)(:443)?/([^/?#\s]+)/([^/?#\s]+?)(?:\.git)?/?$') AS is_safe,
  regexp_full_match(coalesce(repository_revision, ''), '[0-9a-f]{40}') AS full_revision,
  'source-sha256:' || sha256(concat_ws(chr(0), coalesce(source_type, ''), coalesce(source_location, ''), coalesce(repository_revision, ''))) AS identity
FROM u
""",
    "manifest_hash": f"""
WITH f AS (SELECT project_id, {P} AS p, arg_max(sha256(coalesce(content, '')), id) AS dg FROM repo_files WHERE path IS NOT NULL AND project_id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT project_id, substr(sha256(p), 1, 2) AS lane, count(*) AS n, sha256(string_agg(p || chr(9) || dg, chr(10) ORDER BY p, dg)) AS h FROM f GROUP BY 1, 2)
SELECT project_id, sum(n)::BIGINT AS files, sha256(string_agg(h, '' ORDER BY lane)) AS manifest_hash FROM l GROUP BY 1
""",
}
