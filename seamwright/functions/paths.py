"""Column functions on file paths: one spelling per path, and the language of a suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by suffix; anything else is Text.
LANGUAGE_BY_SUFFIX = {
    "py": "Python",
    "js": "JavaScript",
    "jsx": "JavaScript",
    "ts": "TypeScript",
    "tsx": "TypeScript",
    "json": "JSON",
    "toml": "TOML",
    "md": "Markdown",
    "yaml": "YAML",
    "yml": "YAML",
    "css": "CSS",
    "html": "HTML",
}


def compared_path(path: Column) -> Column:
    """``path`` with forward slashes and without leading ``./`` or ``/``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./|/)+", "")


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last path part without its dot; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def language_of(path: Column) -> Column:
    """Language name by the path's suffix; null for a null path."""
    out = F.when(path.isNull(), F.lit(None).cast("string"))
    s = suffix(path)
    for ext, name in LANGUAGE_BY_SUFFIX.items():
        out = out.when(s == ext, name)
    return out.otherwise("Text")
