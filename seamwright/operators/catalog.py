"""Source filters, file profiles, core files, modules, trees and summaries of snapshots.

All of it is column expressions, grouped aggregates and windows over ``repo_files``; texts
are only touched by expressions that the scan evaluates in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import compared_path, language_of
from ..functions.text import file_name
from ..session import checkpointed

# What is skipped, read and read first when a repository is taken in.
SKIP_PARTS = (
    ".git .github .idea .mypy_cache .next .pytest_cache .ruff_cache .tox .venv __pycache__ build coverage dist node_modules target vendor".split()
)
TEXT_SUFFIXES = ".cjs .css .env .html .ini .js .json .jsx .md .mdx .py .rs .sh .toml .ts .tsx .txt .vue .yaml .yml".split()
IMPORTANT_NAMES = "Dockerfile Makefile README LICENSE requirements.txt package.json pyproject.toml vite.config.ts vite.config.js".split()
ROOT_NAMES = (
    ".gitignore Dockerfile LICENSE Makefile README.md README.rst README.txt package.json pnpm-lock.yaml poetry.lock pyproject.toml "
    "requirements.txt setup.cfg setup.py tsconfig.json vite.config.js vite.config.ts yarn.lock".split()
)
PRIORITY_DIRS = "app backend frontend lib packages server src tests".split()
FIRST_NAMES = "main.py app.py server.py index.js main.tsx app.tsx".split()
DEPENDENCY_NAMES = "package.json pyproject.toml requirements.txt poetry.lock pnpm-lock.yaml yarn.lock".split()
ENTRY_NAMES = "app.py main.py server.py manage.py index.js index.ts main.js main.ts main.jsx main.tsx app.jsx app.tsx".split()
MAX_FILE_BYTES = 200_000
MAX_FILES = 45


def name_suffix(name: Column) -> Column:
    """Suffix of a file name with its dot, lower case; '' for names like ``.env``."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def skipped_path(path: Column) -> Column:
    """Whether a part of the path is in the skip set, or hidden (but ``.env``)."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.exists(parts, lambda p: F.lower(p).isin(*SKIP_PARTS) | (p.startswith(".") & (p != ".env")))


def interesting_text_file(path: Column, size: Column) -> Column:
    name = file_name(path)
    ext = name_suffix(name)
    readable = ext.isin(*TEXT_SUFFIXES) | name.isin(*IMPORTANT_NAMES)
    prose = ext.isin(".md", ".mdx") & ~F.lower(name).startswith("readme")
    return (size <= MAX_FILE_BYTES) & ~skipped_path(path) & readable & ~prose


def candidate_score(path: Column) -> Column:
    """Reading order: the smaller, the earlier."""
    name, low = file_name(path), F.lower(path)
    first = F.element_at(F.split(path, "/"), 1)
    best = F.least(
        F.lit(100),
        F.when(name.isin(*ROOT_NAMES) | F.lower(name).startswith("readme"), 0).otherwise(100),
        F.when(first.isin(*PRIORITY_DIRS), 12).otherwise(100),
        F.when(F.lower(name).isin(*FIRST_NAMES), 4).otherwise(100),
        F.when(name_suffix(name).isin(".py", ".js", ".jsx", ".ts", ".tsx"), 20).otherwise(100),
    )
    return best + F.when(low.contains("test") | low.contains("spec"), 20).otherwise(0)


def candidate_files(files: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """The first ``most`` files of each snapshot in reading order (a top-k report).

    Null paths, contents and projects are left out.  Ties: path, then id.
    """
    path = compared_path(F.col("path"))
    rows = files.where("path IS NOT NULL AND content IS NOT NULL AND project_id IS NOT NULL").select(
        "id", "project_id", path.alias("path"), F.octet_length("content").alias("bytes")
    )
    rows = rows.where(interesting_text_file(F.col("path"), F.col("bytes"))).select(
        "id", "project_id", "path", candidate_score(F.col("path")).cast("long").alias("score"), F.size(F.split("path", "/")).cast("long").alias("depth")
    )
    order = Window.partitionBy("project_id").orderBy("score", "depth", "path", "id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def json_strings(c: Column) -> Column:
    """A JSON list of strings; empty for null or unsound text."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def importance(path: Column, content: Column, imports: Column, symbols: Column) -> Column:
    """How much a file tells of its repository; unrounded."""
    name, low, parts = file_name(path), F.lower(path), F.split(path, "/")
    add = lambda cond, v: F.when(cond, F.lit(float(v))).otherwise(F.lit(0.0))
    return (
        add(F.lower(name).startswith("readme"), 100)
        + add(name.isin(*DEPENDENCY_NAMES), 82)
        + add(F.lower(name).isin(*ENTRY_NAMES), 76)
        + add(F.array_contains(parts, "src") | F.array_contains(parts, "app"), 18)
        - add(low.contains("test") | low.contains("spec"), 8)
        + add(F.lower(name).contains("config") | name.startswith("vite.config"), 32)
        + add(content.contains("__main__") | content.contains("if __name__"), 28)
        + add(content.contains("FastAPI(") | content.contains("createRoot(") | content.contains("ReactDOM"), 35)
        + F.least(F.size(imports), F.lit(12)) * F.lit(2.2)
        + F.least(F.size(symbols), F.lit(12)) * F.lit(1.5)
        + F.least(F.char_length(content), F.lit(8000)) / F.lit(8000.0)
    )


def file_profiles(files: DataFrame) -> DataFrame:
    """One row per file: compared path, language, importance (6 digits), core flag, bytes, lines.

    Core are the first 14 files of a snapshot by importance over 12; ties by id.  Null
    contents count as empty, null paths are left out.  Texts are read once, into a table of
    figures; of that only the first 14 rows per snapshot are moved to find where core ends,
    so that one huge snapshot is no single task.
    """
    text = F.coalesce("content", F.lit(""))
    path = compared_path(F.col("path"))
    score = F.round(importance(path, text, json_strings(F.col("imports_json")), json_strings(F.col("symbols_json"))), 6)
    rows = files.where("path IS NOT NULL").select(
        "id", "project_id", path.alias("path"), language_of(F.col("path")).alias("language"), score.alias("importance"),
        F.octet_length(text).cast("long").alias("bytes"), (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("line_ends"),
    )
    rows = checkpointed(rows)
    order = Window.partitionBy("project_id").orderBy(F.desc("importance"), "id")
    first = rows.where("importance > 12").select("project_id", "importance", "id").withColumn("at", F.row_number().over(order)).where(F.col("at") <= 14)
    last = first.groupBy("project_id").agg(F.min(F.struct("importance", (-F.col("id")).alias("minus_id"))).alias("last"))
    core = (F.col("importance") > F.col("last.importance")) | ((F.col("importance") == F.col("last.importance")) & (-F.col("id") >= F.col("last.minus_id")))
    joined = rows.join(last.withColumnRenamed("project_id", "_project"), F.col("project_id").eqNullSafe(F.col("_project")), "left")
    return joined.select(*rows.columns, F.coalesce(core, F.lit(False)).alias("is_core"))


def project_summaries(files: DataFrame) -> DataFrame:
    """Per snapshot: files, core files, bytes, primary language (mode of code languages, ties by name)."""
    prose = ("Markdown", "JSON", "TOML", "YAML", "Text")
    by_language = file_profiles(files).groupBy("project_id", "language").agg(
        F.count("*").alias("n"), F.count_if("is_core").alias("core"), F.sum("bytes").alias("bytes")
    )
    counted = F.when(~F.col("language").isin(*prose), F.struct(-F.col("n"), F.col("language")))
    return by_language.groupBy("project_id").agg(
        F.sum("n").alias("files"), F.sum("core").alias("core_files"), F.sum("bytes").alias("bytes"),
        F.coalesce(F.min(counted)["language"], F.lit("Unknown")).alias("primary_language"),
    )


def module_key(path: Column) -> Column:
    name = file_name(path)
    return (
        F.when(F.lower(name).startswith("readme") | (name_suffix(name) == ".md"), "docs")
        .when(name.isin("package.json", "pyproject.toml", "requirements.txt"), "project-config")
        .when(path.contains("/"), F.element_at(F.split(path, "/"), 1))
        .otherwise("root")
    )


def modules(files: DataFrame, top: int = 8) -> DataFrame:
    """(project_id, module, files, top_files): the ``top`` files of a module by importance, path and id."""
    rows = file_profiles(files).withColumn("module", module_key(F.col("path")))
    counts = rows.groupBy("project_id", "module").agg(F.count("*").alias("files"))
    order = Window.partitionBy("project_id", "module").orderBy(F.desc("importance"), "path", "id")
    best = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= top)
    listed = best.groupBy("project_id", "module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]), "\n").alias("top_files"))
    return counts.join(listed, ["project_id", "module"])


def module_dependencies(files: DataFrame, top: int = 8) -> DataFrame:
    """(project_id, module, depends_on): modules whose name one of the top files imports."""
    profile = file_profiles(files).withColumn("module", module_key(F.col("path")))
    order = Window.partitionBy("project_id", "module").orderBy(F.desc("importance"), "path", "id")
    best = profile.withColumn("at", F.row_number().over(order)).where(F.col("at") <= top).select("id", "project_id", "module")
    imports = files.select("id", F.explode(json_strings(F.col("imports_json"))).alias("imported"))
    clean = F.element_at(F.split(F.element_at(F.split(F.regexp_replace("imported", r"^[./]+|[./]+$", ""), "/"), 1), r"\."), 1)
    edges = best.join(imports, "id").select("project_id", "module", clean.alias("depends_on")).where("depends_on != module").distinct()
    names = profile.select("project_id", F.col("module").alias("depends_on")).distinct()
    return edges.join(names, ["project_id", "depends_on"], "left_semi").select("project_id", "module", "depends_on")


def directory_tree(files: DataFrame) -> DataFrame:
    """(project_id, path, depth, files): every directory of a snapshot and the distinct files below it."""
    paths = files.where("path IS NOT NULL").select("project_id", compared_path(F.col("path")).alias("path")).distinct()
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), i.cast("long").alias("depth"))))
    return (
        paths.select("project_id", F.explode(prefixes).alias("d")).groupBy("project_id", "d.path", "d.depth").agg(F.count("*").alias("files"))
    )


# Frameworks by what dependency files name.
_DEPENDENCY_MARKERS = {"fastapi": "FastAPI", "flask": "Flask", "django": "Django", "streamlit": "Streamlit", "pytest": "Pytest"}
_PACKAGE_MARKERS = {"react": "React", "vite": "Vite", "next": "Next.js", "express": "Express", "vue": "Vue", "svelte": "Svelte"}


def frameworks(files: DataFrame) -> DataFrame:
    """(project_id, framework) told by dependency files and by marks in contents."""
    path = compared_path(F.col("path"))
    name, text = file_name(path), F.coalesce("content", F.lit(""))
    low = F.lower(text)
    deps = name.isin("requirements.txt", "pyproject.toml")
    keys = F.concat(
        F.coalesce(F.json_object_keys(F.get_json_object(text, "$.dependencies")), F.array().cast("array<string>")),
        F.coalesce(F.json_object_keys(F.get_json_object(text, "$.devDependencies")), F.array().cast("array<string>")),
    )
    package = F.when(path == "package.json", keys)
    marks = F.array_compact(
        F.array(
            *(F.when(deps & low.contains(m), v) for m, v in _DEPENDENCY_MARKERS.items()),
            *(F.when(F.array_contains(package, m), v) for m, v in _PACKAGE_MARKERS.items()),
            F.when(text.contains("FastAPI("), "FastAPI"),
            F.when(text.contains("createRoot(") | text.contains("ReactDOM"), "React"),
            F.when(text.contains("defineConfig") & low.contains("vite"), "Vite"),
        )
    )
    return files.where("path IS NOT NULL").select("project_id", F.explode(marks).alias("framework")).distinct()


def stored_files(files: DataFrame, keys: DataFrame) -> DataFrame:
    """(project_id, path, content): of each asked path of a snapshot the delivery of the smallest id with a content.

    ``keys``: project_id and path in the compared form, repeated as they may be.  The ids are
    chosen on narrow columns; contents are moved of the chosen files only.
    """
    path = compared_path(F.col("path"))
    named = files.where("content IS NOT NULL AND path IS NOT NULL").select("project_id", path.alias("path"), "id")
    chosen = named.join(keys.select("project_id", "path").distinct(), ["project_id", "path"]).groupBy("project_id", "path").agg(F.min("id").alias("id"))
    whole = files.where("content IS NOT NULL AND path IS NOT NULL").select("id", F.col("project_id").alias("_p"), path.alias("_path"), "content")
    same = (F.col("_p") == F.col("project_id")) & (F.col("_path") == F.col("path"))
    return whole.join(chosen, "id").where(same).select("project_id", "path", "content")


# Scripts of a package that start it, in the order they are named.
NPM_SCRIPTS = ("dev", "start", "serve", "preview", "test")


def start_commands(files: DataFrame, most: int = 10) -> DataFrame:
    """(project_id, command, place): commands that start a project.

    First the scripts of the package at its root, then command lines of its readme files by
    path and line, then ``python main.py`` if there is such a file.  Of a package delivered
    several times any counts; a package that is no JSON names none.
    """
    rows = files.where("path IS NOT NULL").select("project_id", compared_path(F.col("path")).alias("path"), "id", "content")
    at = lambda rank, path, i, line: F.struct(rank.cast("int").alias("rank"), path.alias("path"), i.alias("id"), line.cast("int").alias("line"))
    none = F.lit(0).cast("long"), F.lit(0)
    package = rows.where("path = 'package.json' AND try_parse_json(content) IS NOT NULL")
    keys = F.json_object_keys(F.get_json_object("content", "$.scripts"))
    scripts = package.select("project_id", F.posexplode(F.array(*(F.when(F.array_contains(keys, n), f"npm run {n}") for n in NPM_SCRIPTS))).alias("rank", "command"))
    named = scripts.where("command IS NOT NULL").select("project_id", "command", at(F.col("rank"), F.lit(""), *none).alias("at"))
    readme = rows.where("content IS NOT NULL").where(F.lower(file_name(F.col("path"))).startswith("readme")).select("project_id", "path", "id", F.posexplode(F.split("content", r"\r?\n")).alias("line", "text"))
    command = F.regexp_replace("text", r"^[` >]+|[` >]+$", "")
    told = readme.select("project_id", command.alias("command"), at(F.lit(len(NPM_SCRIPTS)), F.col("path"), F.col("id"), F.col("line")).alias("at")).where(F.col("command").rlike(r"^(npm|pnpm|yarn|python|uvicorn|streamlit|pytest)\b"))
    main = rows.where(file_name(F.col("path")) == "main.py").select("project_id", F.lit("python main.py").alias("command"), at(F.lit(len(NPM_SCRIPTS) + 1), F.lit(""), *none).alias("at"))
    first = named.unionByName(told).unionByName(main).groupBy("project_id", "command").agg(F.min("at").alias("at"))
    order = Window.partitionBy("project_id").orderBy("at", "command")
    return first.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("project_id", "command", "place")


def script_symbols(files: DataFrame) -> DataFrame:
    """Imports, requires, exports, functions, classes and arrow functions of JavaScript and TypeScript texts, by patterns."""
    # the five patterns are fixed values
    text = F.col("content")
    get = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    rows = files.where(language_of(F.col("path")).isin("JavaScript", "TypeScript") & text.isNotNull())
    imports = F.array_sort(F.array_distinct(F.concat(get(r"import\s+(?:[^'\"]+\s+from\s+)?['\"]([^'\"]+)['\"]"), get(r"require\(['\"]([^'\"]+)['\"]\)"))))
    exports = F.filter(get(r"export\s+(?:default\s+)?(?:function|class|const|let|var)?\s*([A-Za-z0-9_]*)"), lambda x: x != "")
    symbols = F.concat(get(r"(?:function|class)\s+([A-Za-z0-9_]+)"), get(r"const\s+([A-Za-z0-9_]+)\s*=\s*(?:\([^)]*\)|[A-Za-z0-9_]+)\s*=>"), exports)
    return rows.select(
        "id", F.array_join(imports, ",").alias("imports"), F.array_join(exports, ",").alias("exports"), F.array_join(F.slice(symbols, 1, 40), ",").alias("symbols")
    )


def repository_addresses(projects: DataFrame) -> DataFrame:
    """Owner and name of the address, whether it is a safe public https address, and the snapshot's identity hash."""
    url = F.coalesce("repo_url", F.lit(""))
    m = r"^https://([^/@:?#\s]+)(:443)?/([^/?#\s]+)/([^/?#\s]+?)(?:\.git)?/?$"
    identity = F.concat(F.lit("source-sha256:"), F.sha2(F.concat_ws("\x00", F.coalesce("source_type", F.lit("")), F.coalesce("source_location", F.lit("")), F.coalesce("repository_revision", F.lit(""))), 256))
    return projects.select(
        "id",
        F.lower(F.regexp_extract(url, m, 3)).alias("url_owner"),
        F.lower(F.regexp_extract(url, m, 4)).alias("url_repo"),
        url.rlike(m).alias("is_safe"),
        F.coalesce("repository_revision", F.lit("")).rlike("^[0-9a-f]{40}$").alias("full_revision"),
        identity.alias("identity"),
    )


def manifests(files: DataFrame) -> DataFrame:
    """(project_id, files, manifest_hash): digest over the path-ordered digests of a snapshot.

    Of a path delivered several times the largest id counts; a null content counts as empty.
    The digest is one of 256 lane digests (lanes by hash of the path), so that no task
    gathers a whole snapshot.
    """
    path = compared_path(F.col("path"))
    one = (
        files.where("path IS NOT NULL AND project_id IS NOT NULL")
        .select("project_id", path.alias("path"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"), "id")
        .groupBy("project_id", "path")
        .agg(F.max_by("digest", "id").alias("digest"))
    )
    lane = F.substring(F.sha2("path", 256), 1, 2)
    lanes = one.groupBy("project_id", lane.alias("lane")).agg(
        F.count("*").alias("n"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: F.concat(x["path"], F.lit("\t"), x["digest"])), "\n"), 256).alias("h"),
    )
    return lanes.groupBy("project_id").agg(
        F.sum("n").alias("files"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lane", "h"))), lambda x: x["h"]), ""), 256).alias("manifest_hash"),
    )
