"""Evidence for answers: rows from chunks, the rules a citation must keep, the store of a request, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_relative_path
from .catalog import stored_files

EXCERPT = 2000
STORE_ROWS = 20


def repository_id(projects: DataFrame) -> Column:
    return F.concat_ws("/", F.coalesce("owner", F.lit("")), F.coalesce("repo", F.lit("")))


def chunk_identity() -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("project_id", "repository_revision", "path", "start_line", "end_line", "content_hash", "id")))


def evidence(chunks: DataFrame, projects: DataFrame) -> DataFrame:
    """Chunks as evidence: their facts, the repository's identity and address, an identity of their own and an excerpt."""
    of = projects.select(F.col("id").alias("project_id"), repository_id(projects).alias("repository_id"), F.coalesce("repo_url", F.lit("")).alias("repository_url"))
    return chunks.join(of, "project_id").select(
        F.col("id").alias("chunk_id"), "project_id", "repository_id", "repository_url", "repository_revision", "path", "language", "chunk_type", "symbol_name", "qualified_name",
        "start_line", "end_line", "content_hash", chunk_identity().alias("chunk_identity"), F.substring("content", 1, EXCERPT).alias("excerpt"),
    )


def citation_checks(cited: DataFrame, chunks: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """(key, reason): the first of 18 rules a cited row breaks; null if it holds.

    ``cited``: a ``key`` and the columns of ``evidence``.  Rules in order: identity of the chunk;
    safe path; file, chunk and snapshot there; repository, address, revision, path, language;
    line range; range within the file; file still holds the chunk; digest of the lines; digest
    of the chunk; symbol; qualified symbol; the chunk's lines; its identity; excerpt.  Lines
    end at \\n; of a path delivered twice the smallest id counts.
    """
    c = F.col
    held = chunks.select(
        c("id").alias("chunk_id"), c("project_id"), c("path").alias("c_path"), c("language").alias("c_language"), c("symbol_name").alias("c_symbol"), c("qualified_name").alias("c_name"), c("start_line").alias("c_start"),
        c("end_line").alias("c_end"), c("content").alias("c_content"), c("content_hash").alias("c_hash"), chunk_identity().alias("c_identity"),
    )
    snap = projects.select(c("id").alias("project_id"), repository_id(projects).alias("p_repository"), F.coalesce("repo_url", F.lit("")).alias("p_url"), c("repository_revision").alias("p_revision"))
    one = stored_files(files, cited).withColumnRenamed("content", "file_content")
    rows = cited.join(held, ["project_id", "chunk_id"], "left").join(snap, "project_id", "left").join(one, ["project_id", "path"], "left")
    lines = F.split("file_content", "\n")
    n = F.when(F.element_at(lines, -1) == "", F.size(lines) - 1).otherwise(F.size(lines))
    piece = F.array_join(F.slice(lines, F.greatest(c("start_line"), F.lit(1)), F.greatest(c("end_line") - c("start_line") + 1, F.lit(0))), "\n")
    now = F.concat(piece, F.when(c("end_line") < F.size(lines), "\n").otherwise(""))
    digest = F.sha2(now, 256)
    differ = lambda a, b: ~c(a).eqNullSafe(c(b))
    rules = [
        (F.coalesce("project_id", F.lit("")).eqNullSafe("") | (F.coalesce("chunk_id", F.lit(0)) < 1), "invalid chunk identity"),
        (~F.coalesce(safe_relative_path(c("path")), F.lit(False)), "unsafe repository path"),
        (c("c_identity").isNull() | c("p_repository").isNull() | c("file_content").isNull(), "source file or code chunk no longer exists"),
        (differ("repository_id", "p_repository"), "repository identity mismatch"), (differ("repository_url", "p_url"), "repository URL mismatch"),
        (differ("repository_revision", "p_revision"), "repository revision mismatch"), (differ("path", "c_path"), "repository path mismatch"),
        (~F.lower("language").eqNullSafe(F.lower("c_language")), "language mismatch"), ((c("start_line") < 1) | (c("end_line") < c("start_line")), "invalid line range"),
        (c("end_line") > n, "line range exceeds stored source"), (now != c("c_content"), "stored source no longer matches code chunk"), (c("content_hash") != digest, "content hash mismatch"),
        (differ("content_hash", "c_hash"), "code chunk hash mismatch"), (differ("symbol_name", "c_symbol"), "symbol identity mismatch"), (differ("qualified_name", "c_name"), "qualified symbol identity mismatch"),
        (differ("start_line", "c_start") | differ("end_line", "c_end"), "code chunk line identity mismatch"), (differ("chunk_identity", "c_identity"), "chunk identity mismatch"),
        (~F.startswith(now, c("excerpt")), "excerpt mismatch"),
    ]
    reason = F.coalesce(*(F.when(F.coalesce(broken, F.lit(False)), name) for broken, name in rules))
    return rows.select("key", reason.alias("reason"))


def split_checks(checks: DataFrame) -> DataFrame:
    """(key, valid, warning): which evidence holds, and what is said of the rest."""
    text = F.concat(F.lit("Evidence E"), F.col("key").cast("string"), F.lit(" was rejected: "), "reason", F.lit("."))
    return checks.select("key", F.col("reason").isNull().alias("valid"), text.alias("warning"))


def evidence_store(shown: DataFrame, by: str, most: int = STORE_ROWS) -> DataFrame:
    """(by, chunk_identity, alias, place): what a request keeps of the evidence shown to it (by, chunk_identity, place).

    Of a chunk shown several times the first counts; at most ``most`` are kept and get the
    aliases A1, A2 and so on, in order.
    """
    first = shown.groupBy(by, "chunk_identity").agg(F.min("place").alias("first"))
    order = Window.partitionBy(by).orderBy("first", "chunk_identity")
    kept = first.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)
    return kept.select(by, "chunk_identity", F.concat(F.lit("A"), F.col("place").cast("string")).alias("alias"), "place")


#: a marker that only rendering may set
_MARKER = r"\[E[0-9]+\]"


def rendered_answers(parts: DataFrame, aliases: DataFrame, by: str, most_aliases: int = 8) -> DataFrame:
    """(by, answer, failure): structured answers with their citations written out.

    ``parts``: by, part_no, text, aliases (array); ``aliases``: by, alias, token.  Failures, the
    first that occurs in the order of the parts: citation_alias_missing (none),
    citation_alias_limit_exceeded, citation_alias_unknown, model_supplied_location_forbidden (a
    marker in the text).  An answer that fails has no text.
    """
    each = parts.select(by, "part_no", F.posexplode_outer("aliases").alias("at", "alias")).join(aliases.select(by, "alias", "token"), [by, "alias"], "left")
    told = each.groupBy(by, "part_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ").alias("tokens"), F.count("alias").alias("n"), F.count_if(F.col("alias").isNotNull() & F.col("token").isNull()).alias("unknown")
    )
    failure = (
        F.when(F.col("n") == 0, "citation_alias_missing").when(F.col("n") > most_aliases, "citation_alias_limit_exceeded").when(F.col("unknown") > 0, "citation_alias_unknown")
        .when(F.col("text").rlike(_MARKER), "model_supplied_location_forbidden")
    )
    rows = parts.join(told, [by, "part_no"]).select(by, "part_no", failure.alias("failure"), F.concat("text", F.lit(" "), "tokens").alias("piece"))
    out = rows.groupBy(by).agg(
        F.min(F.when(F.col("failure").isNotNull(), F.struct("part_no", "failure"))).alias("f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "piece"))), lambda x: x["piece"]), "\n\n").alias("answer")
    )
    return out.select(by, F.when(F.col("f").isNull(), F.col("answer")).alias("answer"), F.col("f.failure").alias("failure"))
