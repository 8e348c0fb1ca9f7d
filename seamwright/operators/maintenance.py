"""Keeping an index in step with its sources: manifests, merges, embeddings, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import compared_path
from ..functions.text import safe_relative_path
from .catalog import stored_files


def snapshot_entries(files: DataFrame) -> DataFrame:
    """(snapshot, path, digest): one entry per snapshot and path; the largest id counts, null content is empty."""
    return (
        files.where("path IS NOT NULL AND project_id IS NOT NULL")
        .select(F.col("project_id").alias("snapshot"), compared_path(F.col("path")).alias("path"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("digest"), "id")
        .groupBy("snapshot", "path")
        .agg(F.max_by("digest", "id").alias("digest"))
    )


def manifest_diff(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(new_id, path, change, old_path) between two snapshots: unchanged, modified, added, deleted, renamed.

    A rename is a digest that left exactly one path and came to exactly one.  ``pairs``:
    (old_id, new_id).  Paths meet by an equi-join on (pair, path), renames by one on
    (pair, digest).
    """
    old = entries.join(pairs, entries["snapshot"] == pairs["old_id"]).select(F.col("new_id").alias("pair"), "path", F.col("digest").alias("was"))
    new = entries.join(pairs, entries["snapshot"] == pairs["new_id"]).select(F.col("new_id").alias("pair"), "path", F.col("digest").alias("now"))
    both = old.join(new, ["pair", "path"], "full_outer")
    gone = both.where("now IS NULL").select("pair", F.col("was").alias("digest"), F.col("path").alias("old_path"))
    come = both.where("was IS NULL").select("pair", F.col("now").alias("digest"), "path")
    single = lambda df, c: df.groupBy("pair", "digest").agg(F.min(c).alias(c), F.count("*").alias("n")).where("n = 1").drop("n")
    renamed = single(gone, "old_path").join(single(come, "path"), ["pair", "digest"]).select("pair", "path", "old_path")
    change = F.when(F.col("was") == F.col("now"), "unchanged").when(F.col("was").isNotNull() & F.col("now").isNotNull(), "modified").when(F.col("was").isNull(), "added").otherwise("deleted")
    plain = both.select("pair", "path", change.alias("change"))
    rest = plain.join(renamed.select("pair", "path", F.lit("added").alias("change")), ["pair", "path", "change"], "left_anti").join(
        renamed.select("pair", F.col("old_path").alias("path"), F.lit("deleted").alias("change")), ["pair", "path", "change"], "left_anti"
    )
    return rest.withColumn("old_path", F.lit(None).cast("string")).unionByName(renamed.select("pair", "path", F.lit("renamed").alias("change"), "old_path")).withColumnRenamed("pair", "new_id")


def merge_actions(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, action) that turn ``old`` into ``new``: insert, update, delete or keep."""
    a = old.select(*key, F.col(value).alias("was"), F.lit(True).alias("in_old"))
    b = new.select(*key, F.col(value).alias("now"), F.lit(True).alias("in_new"))
    action = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "delete").when(F.col("was").eqNullSafe(F.col("now")), "keep").otherwise("update")
    return a.join(b, key, "full_outer").select(*key, action.alias("action"))


# ---------------------------------------------------------------------------- embeddings
def fresh_embeddings(chunks: DataFrame, embeddings: DataFrame, identity: Column | None = None) -> DataFrame:
    """Embeddings whose chunk still has the content they were made of (and the given identity)."""
    rows = embeddings if identity is None else embeddings.where(identity)
    on = chunks.select(F.col("id").alias("code_chunk_id"), "content_hash", "project_id")
    return rows.join(on, ["code_chunk_id", "content_hash"])


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Ids of chunks without a fresh embedding of a model: one anti join."""
    have = embeddings.where(F.col("model_name") == model).select(F.col("code_chunk_id").alias("id"), "content_hash")
    return chunks.join(have, ["id", "content_hash"], "left_anti").select("id")


def stale_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Ids of embeddings whose chunk is gone or has other content."""
    now = chunks.select(F.col("id").alias("code_chunk_id"), "content_hash")
    return embeddings.join(now, ["code_chunk_id", "content_hash"], "left_anti").select("id")


def embedding_coverage(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(project_id, model_name, chunks, embedded, coverage, dimensions): share of chunks with a fresh vector."""
    total = chunks.groupBy("project_id").agg(F.count("*").alias("chunks"))
    have = fresh_embeddings(chunks, embeddings).groupBy("project_id", "model_name").agg(
        F.countDistinct("code_chunk_id").alias("embedded"), F.countDistinct("embedding_dimension").alias("dimensions")
    )
    return have.join(total, "project_id").select("project_id", "model_name", "chunks", "embedded", F.round(F.col("embedded") / F.col("chunks"), 6).alias("coverage"), "dimensions")


def embedding_inputs(chunks: DataFrame, version: str = "chunk-text-v1") -> DataFrame:
    """(id, input_hash): digest of the text a chunk is embedded as."""
    text = F.concat_ws("\n", F.lit(f"format: {version}"), F.concat(F.lit("path: "), "path"), F.concat(F.lit("type: "), "chunk_type"), F.concat(F.lit("symbol: "), "qualified_name"), F.lit("code:"), "content")
    return chunks.select("id", F.sha2(text, 256).alias("input_hash"))


def reusable_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, source_id): for each chunk without a vector the smallest embedding of equal content and model."""
    first = embeddings.groupBy("model_name", "content_hash").agg(F.min("id").alias("source_id"))
    have = embeddings.select(F.col("code_chunk_id").alias("id"), "content_hash", "model_name")
    want = chunks.select("id", "content_hash").join(first, "content_hash")
    return want.join(have, ["id", "content_hash", "model_name"], "left_anti").select("id", "model_name", "source_id")


# ---------------------------------------------------------------------------- evidence
def evidence_checks(chunks: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, reason): the first rule a stored chunk breaks as evidence; null if it holds.

    Rules in order: safe path; file there; snapshot there; revision; line range; lines equal
    the stored content; digest.  Of a path delivered twice the smallest file id counts.  Lines
    end at \\n.
    """
    one = stored_files(files, chunks).withColumnRenamed("content", "file_content")
    snap = projects.select(F.col("id").alias("project_id"), F.col("repository_revision").alias("revision_now"))
    rows = chunks.join(one, ["project_id", "path"], "left").join(snap, "project_id", "left")
    lines = F.split("file_content", "\n")
    n = F.when(F.element_at(lines, -1) == "", F.size(lines) - 1).otherwise(F.size(lines))
    piece = F.array_join(F.slice(lines, F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    kept = F.concat(piece, F.when(F.col("end_line") < F.size(lines), F.lit("\n")).otherwise(F.lit("")))
    reason = (
        F.when(~safe_relative_path(F.col("path")), "unsafe repository path")
        .when(F.col("file_content").isNull(), "source file no longer exists")
        .when(F.col("revision_now").isNull() | (F.col("revision_now") != F.col("repository_revision")), "repository revision mismatch")
        .when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "invalid line range")
        .when(F.col("end_line") > n, "line range exceeds stored source")
        .when(kept != F.col("content"), "stored source no longer matches code chunk")
        .when(F.sha2("content", 256) != F.col("content_hash"), "content hash mismatch")
    )
    return rows.select("id", reason.alias("reason"))


def citation_markers(documents: DataFrame) -> DataFrame:
    """(doc_id, marker, times, first_char): markers like [E3] in texts; positions from 0."""
    rows = documents.where("text IS NOT NULL").select("doc_id", "text", F.explode(F.regexp_extract_all("text", F.lit(r"(\[E[0-9]+\])"), F.lit(1))).alias("marker"))
    return rows.groupBy("doc_id", "marker").agg(F.count("*").alias("times"), F.min(F.instr("text", F.col("marker")) - 1).cast("long").alias("first_char"))


def token_estimates(documents: DataFrame) -> DataFrame:
    """(source, documents, tokens): the estimate of a token per four characters, at least one a text."""
    n = F.greatest(F.lit(1), F.floor((F.char_length("text") + 3) / 4)).cast("long")
    return documents.where("text IS NOT NULL").groupBy("source").agg(F.count("*").alias("documents"), F.sum(n).alias("tokens"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of a total order; the limit is taken between 1 and 100."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that is total."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")
