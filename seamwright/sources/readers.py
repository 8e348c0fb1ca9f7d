"""Reading repositories: Parquet and JSON tables, checkouts on disk, line ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import compared_path, language_of
from ..operators.catalog import MAX_FILE_BYTES, interesting_text_file, stored_files
from .schemas import conformed, schema


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table of the data model; columns that are not there yet are null."""
    return conformed(spark.read.parquet(f"{directory}/{name}.parquet"), name)


def read_json(spark: SparkSession, path: str, table: str | None = None, ddl: str | None = None) -> DataFrame:
    """JSON lines with a stated schema; rows that do not fit fail the read."""
    return spark.read.schema(ddl or schema(table)).option("mode", "FAILFAST").json(path)


def read_checkout(spark: SparkSession, root: str, project_id: str, revision: str) -> DataFrame:
    """The text files of a checkout below ``root`` as rows of repo_files (ids by path).

    Files that are too large, skipped by path or binary (NUL among the first 2000 bytes) are
    left out; other bytes are decoded as UTF-8 with replacement.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    rows = raw.select(
        compared_path(F.regexp_replace("path", "^.*?" + base.replace(".", r"\."), "")).alias("path"), F.col("length").alias("size"), "content"
    ).where(interesting_text_file(F.col("path"), F.col("size")) & (F.instr(F.decode(F.substring("content", 1, 2000), "ISO-8859-1"), "\x00") == 0))
    return rows.select(
        F.xxhash64(F.lit(project_id), F.col("path")).alias("id"), F.lit(project_id).alias("project_id"), F.lit(revision).alias("repository_revision"), "path",
        language_of(F.col("path")).alias("language"), "size", F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def tracked_files(files: DataFrame, most_bytes: int, most_files: int = 100_000, most_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(id, project_id, path, bytes): files of each snapshot in path order under a byte and a file cap.

    Files over ``most_file_bytes`` are left out.

    A file that would break the byte cap is passed over and later smaller ones are still
    taken, so this is a running decision, not a prefix sum: partitions sorted by
    (project, path, id) are streamed and hold one snapshot's totals at a time.
    """
    rows = files.where("path IS NOT NULL AND content IS NOT NULL AND project_id IS NOT NULL").select(
        "id", "project_id", compared_path(F.col("path")).alias("path"), F.octet_length("content").cast("long").alias("bytes"), F.instr(F.substring("content", 1, 2000), "\x00").alias("nul")
    )
    rows = rows.where((F.col("bytes") <= most_file_bytes) & (F.col("nul") == 0)).drop("nul")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, used, n = None, 0, 0
        for pdf in batches:
            keep = []
            for p, b in zip(pdf["project_id"], pdf["bytes"]):
                if p != project:
                    project, used, n = p, 0, 0
                ok = n < most_files and used + b <= most_bytes
                keep.append(ok)
                if ok:
                    used, n = used + b, n + 1
            yield pdf[keep]

    return rows.repartition("project_id").sortWithinPartitions("project_id", "path", "id").mapInPandas(take, rows.schema)


def source_lines(files: DataFrame, spans: DataFrame, most_lines: int = 200, most_bytes: int = 32_768) -> DataFrame:
    """(span_id, lines, text_hash, truncated): a line range of a stored file, cut to the limits.

    ``spans``: span_id, project_id, path, start_line, end_line.  Lines end at \\n; the byte
    limit never cuts a character in two.  Of a path delivered twice the smallest id counts.
    """
    one = stored_files(files, spans)
    n = F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(most_lines))
    got = F.array_join(F.slice(F.split("content", "\n"), F.greatest("start_line", F.lit(1)), F.greatest(n, F.lit(0))), "\n")
    rows = spans.join(one, ["project_id", "path"]).select("span_id", got.alias("t"), (F.col("end_line") - F.col("start_line") + 1 > most_lines).alias("long"))
    fits = F.octet_length("t") <= most_bytes
    # the bytes of a character that was cut become a replacement mark, which is taken off
    head = F.make_valid_utf8(F.substring(F.encode("t", "UTF-8"), 1, most_bytes).cast("string"))
    cut = F.when(fits, F.col("t")).otherwise(F.regexp_replace(head, "\ufffd$", ""))
    return rows.select("span_id", F.size(F.split("t", "\n")).cast("long").alias("lines"), F.sha2(cut, 256).alias("text_hash"), (F.col("long") | ~fits).alias("truncated"))
