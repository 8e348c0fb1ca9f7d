"""Splitting oversized texts at natural boundaries, by agglomerative merging.

A text begins as atomic segments (lines; pieces of lines that are too long; the edges of
definitions).  Adjacent pairs wait in a heap by the strength of the boundary between them;
the weakest boundaries are merged first, as long as the two segments and the overlap fit
the limit together.  What is left when no pair fits are the pieces; each takes the last
``overlap`` characters before it along.

Boundaries inside a top-level definition are weaker than all boundaries outside, so that
every definition that fits is whole in one piece.
"""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import language_of, suffix
from .symbols import Symbol, symbols_of
from .texts import map_texts

_CUT = re.compile(r"[^\s;,}>。！？.!?]*(?:[;,}>。！？.!?]+\s*|\s+|$)")
_DEF = re.compile(r"(?:export\s+|default\s+|async\s+|abstract\s+)*(?:def|class|function\*?|const|let|var|interface|type)\s+([\w$]+)")
ATOM = 240


def _line_atoms(start: int, line: str, limit: int) -> list[tuple[int, float]]:
    """(offset, strength before it) of the atoms of a line that is longer than ``limit``."""
    out, at, begin = [], 0, 0
    size = max(1, min(ATOM, limit))
    for m in _CUT.finditer(line):
        if m.end() == m.start():
            continue
        if m.end() - begin > size and at > begin:
            out.append((start + begin, 0.5))
            begin = at
        while m.end() - begin > size:  # nothing natural within reach
            out.append((start + begin, 0.1))
            begin += size
        at = m.end()
    if begin < len(line):
        out.append((start + begin, 0.5))
    return out


def _strengths(text: str, language: str, limit: int, tops: list[Symbol], names: frozenset) -> list[tuple[int, float]]:
    """Offsets of the atoms and the strength of the boundary before each."""
    spans = sorted((s.start, s.end) for s in tops)
    edges = {x for span in spans for x in span}
    out: list[tuple[int, float]] = []
    pos, blank, fence, k, prev = 0, 0, False, 0, ""
    for line in text.splitlines(keepends=True) if "\r" not in text and not re.search("[\v\f\x1c-\x1e\x85  ]", text) else re.findall(r"[^\n]*\n|[^\n]+", text):
        bare = line.strip()
        while k < len(spans) and spans[k][1] <= pos:
            k += 1
        inside = k < len(spans) and spans[k][0] < pos < spans[k][1]
        indent = len(line) - len(line.lstrip(" \t"))
        if language == "Markdown":
            if bare.startswith(("```", "~~~")):
                fence = not fence
                strength = 3.0 if fence else 0.8
            elif fence:
                strength = 0.8
            else:
                head = re.match(r"(#{1,6})\s", line)
                strength = 9.0 - len(head[1]) * 0.5 if head else 4.0 if blank else 2.0 if re.match(r"\s*(?:[-*+]|\d+[.)])\s", line) else 1.5
        elif inside:
            strength = 2.5 / (1 + indent / 4) + (0.4 if blank else 0)
        elif not bare:
            strength = 1.0
        elif prev.startswith(("#", "//", "/*", "*", "*/", "@")) and not blank and indent == 0:
            strength = 3.5
        else:
            strength = (5.0 if not blank else 6.0 + min(blank, 3) / 3) / (1 + indent / 2)
            m = _DEF.match(line)
            if (m and indent == 0 and (not names or m[1] in names)) or re.match(r"\[", line) and language == "TOML":
                strength = 7.5
        if not bare and not inside and language != "Markdown":
            strength = 1.0
        if len(line) > limit:
            atoms = _line_atoms(pos, line, limit)
            out.append((pos, strength))
            out.extend(atoms[1:])
        else:
            out.append((pos, strength))
        blank = blank + 1 if not bare else 0
        if bare:
            prev = bare
        pos += len(line)
    have = {at for at, _ in out}
    out = [(at, max(s, 7.0) if at in edges else s) for at, s in out]
    out.extend((at, 7.0) for at in edges if at not in have and at < len(text))
    out.sort()
    return out


def pieces(text: str, max_chars: int, overlap: int, language: str, tops: list[Symbol] = (), names: frozenset = frozenset()) -> list[tuple[int, int]]:
    """(start, end) of the pieces without overlap, in order; together they are the whole text.

    ``text[max(0, start - overlap):end]`` has at most ``max_chars`` characters, and every piece
    but the first begins with the whole overlap.  A text within the limit is one piece.  The
    limit must be at least 1 and more than the overlap; a negative overlap is none.
    """
    if max_chars < 1 or overlap >= max_chars:
        raise ValueError("a limit is at least 1 and more than the overlap")
    n = len(text)
    if n <= max_chars:
        return [(0, n)] if n else []
    overlap = max(0, overlap)
    limit = max_chars - overlap
    atoms = _strengths(text, language, limit, list(tops), names)
    starts = [at for at, _ in atoms]
    m = len(starts)
    ends = [*starts[1:], n]
    left = list(range(-1, m - 1))
    right = [*range(1, m), -1]
    alive = [True] * m
    version = [0] * m
    heap = [(atoms[i][1], ends[i] - starts[i - 1], i, 0, 0) for i in range(1, m)]
    heapq.heapify(heap)
    while heap:
        strength, _, i, va, vb = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = left[i]
        if version[j] != va or version[i] != vb:
            # a side has grown since: look again at its present size
            heapq.heappush(heap, (strength, ends[i] - starts[j], i, version[j], version[i]))
            continue
        if ends[i] - starts[j] > (limit if starts[j] else max_chars):
            continue  # segments only grow
        if starts[j] == 0 and ends[i] - starts[j] > limit and starts[i] >= overlap:
            continue
        ends[j] = ends[i]
        alive[i] = False
        version[j] += 1
        right[j] = right[i]
        if right[i] >= 0:
            left[right[i]] = j
    cores = [(starts[i], ends[i]) for i in range(m) if alive[i]]
    while len(cores) > 1 and cores[0][1] < overlap and cores[1][1] <= max_chars:
        cores[:2] = [(0, cores[1][1])]  # the second piece shares `overlap` characters with the first
    return cores


def _prepared(text: str, arg: str):
    given = json.loads(arg)  # nulls are left out
    suffix, language, max_chars = given["suffix"], given["language"], given["max_chars"]
    overlap, symbols_json = given.get("overlap_chars", 0), given.get("symbols_json")
    symbols = symbols_of(text, suffix)
    tops = [s for s in symbols or () if s.top]
    names: frozenset = frozenset()
    if symbols is None and symbols_json:
        try:
            names = frozenset(x for x in json.loads(symbols_json) if isinstance(x, str))
        except (ValueError, TypeError):
            names = frozenset()
    return pieces(text, max_chars, overlap, language, tops, names), tops, max_chars, max(0, overlap)


def piece_rows(text: str, arg: str) -> list[tuple]:
    cores, _, _, overlap = _prepared(text, arg)
    return [(k, max(0, a - overlap), b, a - max(0, a - overlap), text[max(0, a - overlap) : b]) for k, (a, b) in enumerate(cores)]


def whole_rows(text: str, arg: str) -> list[tuple]:
    """('', 0) and the top-level functions and classes that are whole in a piece."""
    cores, tops, max_chars, overlap = _prepared(text, arg)
    spans = [(max(0, a - overlap), b) for a, b in cores]
    if any(b - a > max_chars for a, b in spans) or (cores and (cores[0][0] != 0 or cores[-1][1] != len(text))):
        return []
    out = [("", 0)]
    for s in tops:
        if s.end - s.start <= max_chars - overlap and any(a <= s.start and s.end <= b for a, b in spans):
            out.append((s.name, s.name_line))
    return out


def _oversized(files: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows longer than their language's limit, with the argument of the split.

    Only those leave the JVM.  ``limits`` may hold one row per language; of several the
    smallest limit counts.  A limit below 1, or not above its overlap, stops the query.
    """
    bad = (F.col("max_chars") < 1) | (F.col("overlap_chars") >= F.col("max_chars"))
    checked = F.when(bad, F.raise_error(F.lit("a limit is at least 1 and more than the overlap")).cast("int")).otherwise(F.col("max_chars"))
    small = limits.groupBy("language").agg(
        F.min("max_chars").alias("max_chars"), F.min_by("overlap_chars", "max_chars").alias("overlap_chars")
    ).withColumn("max_chars", checked)
    rows = files.select("id", "content", "symbols_json", suffix(F.col("path")).alias("suffix"), language_of(F.col("path")).alias("language"))
    return (
        rows.where(F.col("content").isNotNull())
        .join(small, "language")
        .where(F.char_length("content") > F.col("max_chars"))
        .withColumn("arg", F.to_json(F.struct("suffix", "language", "max_chars", "overlap_chars", "symbols_json")))
    )


def split_texts(files: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every oversized file.

    Reads ``id, path, content, symbols_json`` of files and ``language, max_chars,
    overlap_chars`` of limits.  Columns: file_id, piece_no (from 0), start_char, end_char,
    overlap_chars (shared with the piece before), text.  Texts within their limit, null
    contents and languages without a limit give no rows.
    """
    return map_texts(
        _oversized(files, limits), ["id"], "content", "arg", piece_rows,
        "file_id long, piece_no int, start_char long, end_char long, overlap_chars long, text string", "pieces",
    )


def whole_definitions(files: DataFrame, limits: DataFrame) -> DataFrame:
    """(file_id, symbol, name_line): see ``whole_rows``; computed on the pieces themselves."""
    return map_texts(
        _oversized(files, limits), ["id"], "content", "arg", whole_rows, "file_id long, symbol string, name_line long", "wholes"
    )
