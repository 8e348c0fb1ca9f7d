"""Source files that do not parse.

Each Python, JavaScript, TypeScript, JSON and TOML text is run through the memoised
derivatives of its language's grammar.  An empty derivative names the exact failing
token; a last derivative that is not nullable means that the text is cut off.  Python
texts the derivatives reject are looked at once more by the interpreter's own parser,
which only can acquit them (formatted strings that reuse their own quote, rare letters).
"""

from __future__ import annotations

import ast
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import language_of, suffix
from .lexers import GRAMMAR_OF, check
from .texts import map_texts


def python_tree(text: str) -> ast.Module | None:
    """Syntax tree of a Python text; None if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def verdict_rows(text: str, suffix: str) -> list[tuple]:
    """One row (valid, reason, line_no, column_no, token) for a text of a checked suffix."""
    v = check(text, GRAMMAR_OF[suffix])
    if not v.valid and suffix == "py" and python_tree(text) is not None:
        v = v._replace(valid=True)
    if v.valid:
        return [(True, None, None, None, None)]
    line = text.count("\n", 0, v.offset) + 1
    column = v.offset - (text.rfind("\n", 0, v.offset) + 1) + 1
    return [(False, v.reason, line, column, v.token)]


def parse_verdicts(files: DataFrame) -> DataFrame:
    """One row per file of a checked language: id, valid, reason, line_no, column_no, token.

    Reads ``id, path, content``.  Files of other languages and null contents are left out;
    an empty text is valid but for JSON.  ``reason`` is ``token`` or ``truncated``; lines and
    columns start at 1.  Repeated ids are kept as they are, extra columns are ignored.
    """
    texts = files.select("id", "content", suffix(F.col("path")).alias("suffix")).where(F.col("suffix").isin(*GRAMMAR_OF))
    return map_texts(
        texts, ["id"], "content", "suffix", verdict_rows,
        "id long, valid boolean, reason string, line_no int, column_no int, token string", "parse",
    )


def unparsable(files: DataFrame) -> DataFrame:
    """The rows of ``parse_verdicts`` that are not valid."""
    return parse_verdicts(files).where(~F.col("valid"))


def parse_rates(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files, invalid files and their share per repository and language.

    A repository is owner/repo regardless of case; files of unknown projects count under a
    null repository.  Counts are pre-aggregated per project before the join with projects.
    """
    texts = files.select(
        "project_id", language_of(F.col("path")).alias("language"), "content", suffix(F.col("path")).alias("suffix")
    ).where(F.col("suffix").isin(*GRAMMAR_OF))
    per_project = (
        map_texts(
            texts, ["project_id", "language"], "content", "suffix", verdict_rows,
            "project_id string, language string, valid boolean, reason string, line_no int, column_no int, token string", "parse",
        )
        .groupBy("project_id", "language")
        .agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("bad"))
    )
    repos = projects.select(
        F.col("id").alias("project_id"), F.lower(F.concat_ws("/", "owner", "repo")).alias("repository")
    ).dropDuplicates(["project_id"])
    return (
        per_project.join(repos, "project_id", "left")
        .groupBy("repository", "language")
        .agg(F.sum("n").alias("files"), F.sum("bad").alias("invalid_files"))
        .withColumn("invalid_share", F.round(F.col("invalid_files") / F.col("files"), 6))
    )
