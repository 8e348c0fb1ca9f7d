"""Lookups, listings and roll-ups over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import compared_path, language_of
from ..functions.text import file_name, module_name, normal_identifier, safe_relative_path


def chunk_identities(chunks: DataFrame) -> DataFrame:
    """(id, identity, module, name_key, safe, estimate): the names a chunk goes by and its estimate in tokens."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    identity = F.concat_ws("|", *map(part, ("project_id", "repository_revision", "path", "start_line", "end_line", "content_hash", "id")))
    return chunks.select(
        "id", F.sha2(identity, 256).alias("identity"), module_name(F.col("path")).alias("module"), normal_identifier(F.col("qualified_name")).alias("name_key"),
        safe_relative_path(F.col("path")).alias("safe"), F.greatest(F.lit(1), F.floor((F.char_length("content") + 3) / 4)).cast("long").alias("estimate"), file_name(F.col("path")).alias("file"),
    )


def latest_deliveries(projects: DataFrame) -> DataFrame:
    """(repository, id, repository_revision, deliveries, state): the last delivery of each repository.

    ``unchanged`` if its revision is that of the one before, ``first`` if there is none, else
    ``update_available``; failed deliveries count like others.
    """
    rows = projects.select(F.lower(F.concat_ws("/", "owner", "repo")).alias("repository"), "id", "repository_revision", "created_at")
    order = Window.partitionBy("repository").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    two = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= 2)
    got = two.groupBy("repository").agg(
        F.max(F.when(F.col("at") == 1, F.col("id"))).alias("id"),
        F.max(F.when(F.col("at") == 1, F.col("repository_revision"))).alias("repository_revision"),
        F.max(F.when(F.col("at") == 2, F.col("repository_revision"))).alias("before"),
        F.count("*").alias("n"),
    )
    count = rows.groupBy("repository").agg(F.count("*").alias("deliveries"))
    state = F.when(F.col("n") == 1, "first").when(F.col("before") == F.col("repository_revision"), "unchanged").otherwise("update_available")
    return got.join(count, "repository").select("repository", "id", "repository_revision", "deliveries", state.alias("state"))


def projects_without_chunks(projects: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids of snapshots that have no chunk: one anti join."""
    return projects.join(chunks.select(F.col("project_id").alias("id")).distinct(), "id", "left_anti").select("id", "status")


def answer_references(documents: DataFrame, known: int = 5) -> DataFrame:
    """(doc_id, markers, unknown): texts with citation markers, and how many of them point past the evidence shown."""
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[E([0-9]+)\]"), F.lit(1)))
    rows = documents.where("text IS NOT NULL").select("doc_id", marks.alias("m")).where(F.size("m") > 0)
    unknown = F.filter("m", lambda x: (F.char_length(x) > 9) | (x.try_cast("int") > known) | (x.try_cast("int") < 1))
    return rows.select("doc_id", F.size("m").cast("long").alias("markers"), F.size(unknown).cast("long").alias("unknown"))


def acceptance(checks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(project_id, chunks, passed, rate, accepted) from evidence checks: a snapshot is accepted if all chunks hold."""
    rows = checks.join(chunks.select("id", "project_id"), "id")
    ok = F.col("reason").isNull()
    return rows.groupBy("project_id").agg(F.count("*").alias("chunks"), F.count_if(ok).alias("passed"), F.round(F.avg(ok.cast("double")), 6).alias("rate"), F.bool_and(ok).alias("accepted"))


def event_diagnostics(events: DataFrame) -> DataFrame:
    """(level, project_id, event_type, events, learners, tasks): counts over all, by project and by type."""
    sets = events.groupingSets([[F.col("project_id")], [F.col("event_type")], []], F.col("project_id"), F.col("event_type")).agg(
        F.count("*").alias("events"), F.countDistinct("learner_id").alias("learners"), F.countDistinct("task_id").alias("tasks"), F.grouping_id().alias("g")
    )
    level = F.when(F.col("g") == 1, "project").when(F.col("g") == 2, "type").otherwise("all")
    return sets.select(level.alias("level"), "project_id", "event_type", "events", "learners", "tasks")


def recovered_runs(projects: DataFrame) -> DataFrame:
    """(id, status, error, retryable): what a restart makes of each snapshot; unfinished ones fail and may be tried again."""
    unfinished = F.coalesce(F.col("status").isin("pending", "running"), F.lit(True))
    return projects.select(
        "id", F.when(unfinished, "failed").otherwise(F.col("status")).alias("status"), F.when(unfinished, "interrupted").otherwise(F.coalesce("error_message", F.lit(""))).alias("error"),
        (unfinished | (F.col("status") == "failed")).alias("retryable"),
    )


def warning_counts(files: DataFrame) -> DataFrame:
    """(project_id, warning, files): dirt in the file lists of each snapshot, a row per kind."""
    text = F.coalesce("content", F.lit(""))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("content").isNull(), "no_content"), F.when(F.col("path").contains("\\") | F.col("path").startswith("./") | F.col("path").startswith("/"), "path_spelling"),
            F.when(text.contains("\r\n"), "crlf"), F.when((text != "") & ~text.endswith("\n"), "no_final_newline"), F.when(F.col("language").isNull(), "no_language"),
            F.when(F.coalesce(F.col("size") != F.octet_length(text), F.lit(True)), "stale_size"),
        )
    )
    return files.select("project_id", F.explode(kinds).alias("warning")).groupBy("project_id", "warning").agg(F.count("*").alias("files"))


def scoped_chunks(chunks: DataFrame, most: int = 8) -> DataFrame:
    """(id, place): the first ``most`` chunks of each file in hierarchy order (start, -end, name, type, id)."""
    order = Window.partitionBy("project_id", "repository_revision", "path").orderBy("start_line", F.desc("end_line"), "qualified_name", "chunk_type", "id")
    return chunks.select("id", F.row_number().over(order).cast("long").alias("place"), "project_id", "repository_revision", "path").where(F.col("place") <= most).select("id", "place")


def project_bundle(files: DataFrame, chunks: DataFrame, most: int = 20) -> DataFrame:
    """(project_id, kind, place, key): the first ``most`` rows of each ordered scan a project is opened with.

    Files by importance and path, modules (the first part of a path) by name, chunks by path,
    start and qualified name.
    """
    path = compared_path(F.col("path"))
    scans = [
        ("file", files.where("path IS NOT NULL").select("project_id", path.alias("k"), F.struct((-F.coalesce("importance", F.lit(0.0))).alias("a"), path.alias("b"), F.col("id").alias("c")).alias("o"))),
        ("module", files.where("path IS NOT NULL").select("project_id", F.element_at(F.split(path, "/"), 1).alias("k")).distinct().select("project_id", "k", F.struct(F.lit(0.0).alias("a"), F.col("k").alias("b"), F.lit(0).cast("long").alias("c")).alias("o"))),
        ("chunk", chunks.select("project_id", F.col("qualified_name").alias("k"), F.struct(F.lit(0.0).alias("a"), F.concat_ws("\t", "path", F.format_string("%09d", "start_line"), "qualified_name").alias("b"), F.col("id").alias("c")).alias("o"))),
    ]
    order = Window.partitionBy("project_id").orderBy("o")
    parts = [df.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("project_id", F.lit(kind).alias("kind"), "place", F.col("k").alias("key")) for kind, df in scans]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def chunk_scan(chunks: DataFrame, path: str | None = None, symbol: str | None = None, chunk_type: str | None = None, language: str | None = None) -> DataFrame:
    """Chunks by optional filters: path, symbol or qualified name, type, language regardless of case; ``place`` orders them by path, start and name."""
    rows = chunks
    if path is not None:
        rows = rows.where(F.col("path") == path)
    if symbol is not None:
        rows = rows.where((F.col("symbol_name") == symbol) | (F.col("qualified_name") == symbol))
    if chunk_type is not None:
        rows = rows.where(F.col("chunk_type") == chunk_type)
    if language is not None:
        rows = rows.where(F.lower("language") == language.lower())
    order = Window.partitionBy("project_id").orderBy("path", "start_line", "qualified_name", "id")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def by_ids(rows: DataFrame, ids: DataFrame, key: str, most: int = 64) -> DataFrame:
    """(key, place, truncated): the rows of the asked ids, by id, at most ``most``; ``truncated`` if there were more."""
    found = rows.join(ids.select(key).distinct(), key, "left_semi").orderBy(key).limit(most + 1)
    at = found.select(key, F.row_number().over(Window.orderBy(key)).cast("long").alias("place"), (F.count("*").over(Window.partitionBy()) > most).alias("truncated"))
    return at.where(F.col("place") <= most)


def project_lookup(projects: DataFrame) -> DataFrame:
    """(source_identity, id, deliveries): the project a source identity stands for: its first delivery."""
    rows = projects.where("source_identity IS NOT NULL")
    return rows.groupBy("source_identity").agg(F.min(F.struct("created_at", "id")).alias("f"), F.count("*").alias("deliveries")).select("source_identity", F.col("f.id").alias("id"), "deliveries")


def workspaces(projects: DataFrame, files: DataFrame, chunks: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """(id, status, language, files, chunks, place): a page of the projects, the last updated first, with what they hold.

    The language is shown of ready projects only.
    """
    n = lambda df, name: df.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias(name))
    rows = projects.join(n(files, "files"), "id", "left").join(n(chunks, "chunks"), "id", "left")
    order = Window.orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.lower("repo"), "id")
    shown = rows.select("updated_at", "created_at", "repo", "id", "status", F.when(F.col("status") == "ready", F.coalesce("primary_language", F.lit("Unknown"))).otherwise("").alias("language"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    page = shown.orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.lower("repo"), "id").offset(max(0, offset)).limit(min(100, max(1, limit)))
    return page.withColumn("place", (F.row_number().over(order) + max(0, offset)).cast("long")).select("id", "status", "language", "files", "chunks", "place")


def in_directory(files: DataFrame, directories: DataFrame) -> DataFrame:
    """(project_id, directory, files): files that are a directory's path or lie below it; ``directories``: project_id, directory.

    Every path meets its own prefixes, so this is an equality.
    """
    parts = F.split(compared_path(F.col("path")), "/")
    rows = files.where("path IS NOT NULL").select("project_id", "id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("directory"))
    return rows.join(directories.select("project_id", "directory").distinct(), ["project_id", "directory"]).groupBy("project_id", "directory").agg(F.count("*").alias("files"))


def unit_norms(vectors: DataFrame, key: str, vector: str, tolerance: float = 1e-3) -> DataFrame:
    """(key, unit): whether a vector is of unit length within the tolerance."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.select(key, (F.abs(norm - 1) <= tolerance * F.greatest(norm, F.lit(1.0))).alias("unit"))


def embedding_identities(embeddings: DataFrame) -> DataFrame:
    """(identity, model_name, dimension, vectors): the effective identity vectors were made under, as a digest of its canonical parts."""
    parts = ("model_name", "resolved_revision", "embedding_dimension", "embedding_dtype", "text_format_version", "embedding_config_hash", "identity_schema_version")
    named = F.to_json(F.struct(*(F.coalesce(F.col(p).cast("string"), F.lit("")).alias(p) for p in sorted(parts))))
    return embeddings.groupBy(F.sha2(named, 256).alias("identity"), "model_name", F.col("embedding_dimension").alias("dimension")).agg(F.count("*").alias("vectors"))


def readme_excerpts(files: DataFrame, most: int = 1200) -> DataFrame:
    """(project_id, path, excerpt_hash): the head of each project's first readme by path."""
    path = compared_path(F.col("path"))
    rows = files.where("path IS NOT NULL AND content IS NOT NULL").where(F.startswith(F.lower(file_name(path)), F.lit("readme")))
    first = rows.groupBy("project_id").agg(F.min(F.struct(path.alias("path"), F.col("id"))).alias("f")).select("f.id", "f.path", "project_id")
    return rows.select("id", "content").join(first, "id").select("project_id", "path", F.sha2(F.substring("content", 1, most), 256).alias("excerpt_hash"))


def file_summaries(files: DataFrame) -> DataFrame:
    """(id, summary): a sentence on a file from its symbols and imports, the first three of each."""
    names = F.from_json("symbols_json", "array<string>")
    imports = F.from_json("imports_json", "array<string>")
    join = lambda a: F.array_join(F.slice(a, 1, 3), ", ")
    text = (
        F.when(F.size(names) > 0, F.concat(F.lit("Defines "), join(names), F.lit("."))).when(F.size(imports) > 0, F.concat(F.lit("Uses "), join(imports), F.lit(".")))
        .otherwise(F.concat(F.lit("A file of "), F.coalesce(language_of(F.col("path")), F.lit("Text")), F.lit(".")))
    )
    return files.select("id", text.alias("summary"))


def priced_usage(usage: DataFrame, by: str, tokens_in: str, tokens_out: str, price_in: float, price_out: float, unit: int = 1_000_000) -> DataFrame:
    """(by, cost, status): what usage costs: known_zero without tokens, unknown if a count is missing, else calculated."""
    missing = F.count_if(F.col(tokens_in).isNull() | F.col(tokens_out).isNull())
    rows = usage.groupBy(by).agg(F.sum(tokens_in).alias("i"), F.sum(tokens_out).alias("o"), missing.alias("m"))
    cost = F.round((F.col("i") * price_in + F.col("o") * price_out) / unit, 9)
    status = F.when(F.col("m") > 0, "unknown").when((F.col("i") == 0) & (F.col("o") == 0), "known_zero").otherwise("calculated")
    return rows.select(by, F.when(F.col("m") == 0, cost).alias("cost"), status.alias("status"))


def dataset_shape(questions: DataFrame, least: int) -> DataFrame:
    """(category, items, answerable, short): questions per category, and whether they are fewer than needed."""
    return questions.groupBy("category").agg(F.count("*").alias("items"), F.count_if("answerable").alias("answerable")).withColumn("short", F.col("items") < least)


def run_differences(one: DataFrame, two: DataFrame, by: str) -> DataFrame:
    """(by, place, first, second): where two runs of the same ranking (by, id, place) differ; no rows if they are equal."""
    a, b = one.select(by, "place", F.col("id").alias("first")), two.select(by, "place", F.col("id").alias("second"))
    return a.join(b, [by, "place"], "full").where(~F.col("first").eqNullSafe(F.col("second"))).select(by, "place", "first", "second")


def containment_matches(ranked: DataFrame, gold: DataFrame, chunks: DataFrame, by: str) -> DataFrame:
    """(by, id, gold_id): results whose span holds a gold span of the same file and revision without being it."""
    facts = chunks.select("id", "project_id", "repository_revision", "path", "start_line", "end_line")
    want = gold.select(by, F.col("id").alias("gold_id")).join(facts.select(F.col("id").alias("gold_id"), "project_id", "repository_revision", "path", F.col("start_line").alias("s"), F.col("end_line").alias("e")), "gold_id")
    got = ranked.select(by, "id").join(facts, "id")
    holds = (F.col("start_line") <= F.col("s")) & (F.col("end_line") >= F.col("e")) & (F.col("id") != F.col("gold_id"))
    return got.join(want, [by, "project_id", "repository_revision", "path"]).where(holds).select(by, "id", "gold_id")


def snapshot_faults(projects: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, fault): the first thing that keeps a snapshot from being activated; null if nothing does.

    snapshot_incomplete (not ready), revision_mixed (a chunk of another revision),
    embeddings_incomplete (a chunk without a vector of its content).
    """
    have = embeddings.select(F.col("code_chunk_id").alias("id"), "content_hash").distinct()
    bare = chunks.join(have, ["id", "content_hash"], "left_anti").groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("bare"))
    mixed = chunks.join(projects.select(F.col("id").alias("project_id"), F.col("repository_revision").alias("now")), "project_id").where(~F.col("now").eqNullSafe(F.col("repository_revision")))
    mixed = mixed.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("mixed"))
    rows = projects.select("id", "status").join(bare, "id", "left").join(mixed, "id", "left")
    fault = F.when(F.coalesce("status", F.lit("")) != "ready", "snapshot_incomplete").when(F.col("mixed") > 0, "revision_mixed").when(F.col("bare") > 0, "embeddings_incomplete")
    return rows.select("id", fault.alias("fault"))


def validated_policies(routes: DataFrame, key: str, pool: str = "pool", least: float = 0.05, most: float = 10.0, most_pool: int = 50, neutral_pool: int = 24) -> DataFrame:
    """(key, dense_weight, lexical_weight, symbol_weight, pool, neutral): routing values, or the neutral ones if any is out of bounds, missing or not finite."""
    names = ("dense_weight", "lexical_weight", "symbol_weight")
    fine = F.coalesce(F.col(pool).between(1, most_pool), F.lit(False))
    for n in names:
        fine = fine & F.coalesce(~F.isnan(n) & F.col(n).between(least, most), F.lit(False))
    weights = [F.when(fine, F.col(n)).otherwise(1.0).alias(n) for n in names]
    return routes.select(key, *weights, F.when(fine, F.col(pool)).otherwise(neutral_pool).cast("long").alias("pool"), (~fine).alias("neutral"))


# Fixed value: keys whose values are never written out.
SECRET_KEYS = r"(?i)(\"[a-z0-9_\-]*(?:password|passwd|secret|token|api_?key|authorization|credential)[a-z0-9_\-]*\"\s*:\s*)\"[^\"\\]*\""


def redacted_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, redacted, text_hash): JSON texts with the string values of secret keys replaced, at any depth, and how many were."""
    found = F.regexp_count(F.col(text), F.lit(SECRET_KEYS))
    clean = F.regexp_replace(F.col(text), SECRET_KEYS, '$1"[redacted]"')
    return rows.where(F.col(text).isNotNull()).select(key, found.cast("long").alias("redacted"), F.sha2(clean, 256).alias("text_hash"))
