"""Column functions on text: the code tokenizer, signatures, hashes and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_HAN_RUN = r"[㐀-䶿一-鿿豈-﫿]+"


def camel_parts(word: Column) -> Column:
    """Parts of a word at lower-upper boundaries and before the last capital of a run."""
    spaced = F.regexp_replace(F.regexp_replace(word, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z])([A-Z][a-z])", "$1 $2")
    return F.split(spaced, " ")


def han_grams(text: Column) -> Column:
    """Each run of Chinese characters, its characters and its pairs of characters."""
    runs = F.regexp_extract_all(text, F.lit(f"({_HAN_RUN})"), F.lit(1))

    def grams(run: Column) -> Column:
        n = F.char_length(run)
        ones = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(run, i, F.lit(1)))
        twos = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))).otherwise(
            F.array().cast("array<string>")
        )
        return F.concat(F.array(run), ones, twos)

    return F.flatten(F.transform(runs, grams))


def code_tokens(text: Column) -> Column:
    """Tokens of code and prose: for each run of word characters the run, its parts at
    underscores and at case boundaries and its Chinese grams, in lower case; each distinct
    token once per run, so that term frequencies count runs.

    Lower case stands in for case folding; the two differ for letters like the sharp s.
    """
    raw = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))

    def variants(word: Column) -> Column:
        parts = F.filter(F.split(word, "_"), lambda p: p != "")
        pieces = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p), camel_parts(p))))
        plain = F.transform(F.concat(F.array(word), pieces), F.lower)
        return F.array_distinct(F.filter(F.concat(plain, F.flatten(F.transform(plain, han_grams))), lambda t: t != ""))

    ascii_only = ~text.rlike(_HAN_RUN)

    def variants_ascii(word: Column) -> Column:
        parts = F.filter(F.split(word, "_"), lambda p: p != "")
        pieces = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p), camel_parts(p))))
        return F.array_distinct(F.filter(F.transform(F.concat(F.array(word), pieces), F.lower), lambda t: t != ""))

    return F.when(ascii_only, F.flatten(F.transform(raw, variants_ascii))).otherwise(F.flatten(F.transform(raw, variants)))


_RAW = re.compile(r"\w+")
_HAN = re.compile(_HAN_RUN)
_LOW_UP, _CAP_RUN = re.compile(r"([a-z0-9])([A-Z])"), re.compile(r"([A-Z])([A-Z][a-z])")
_WORDS: dict[str, tuple[str, ...]] = {}


def word_tokens(word: str) -> tuple[str, ...]:
    """The distinct tokens of one run of word characters."""
    got = _WORDS.get(word)
    if got is None:
        plain = [word]
        for part in word.split("_"):
            if part:
                plain.append(part)
                plain.extend(_CAP_RUN.sub(r"\1 \2", _LOW_UP.sub(r"\1 \2", part)).split(" "))
        out: dict[str, None] = {}
        for t in (p.lower() for p in plain):
            if t:
                out[t] = None
                if not t.isascii():
                    for run in _HAN.findall(t):
                        out.update(dict.fromkeys([run, *run, *(run[i : i + 2] for i in range(len(run) - 1))]))
        got = tuple(out)
        if len(_WORDS) > 500_000:
            _WORDS.clear()
        _WORDS[word] = got
    return got


def code_tokens_of(text: str) -> list[str]:
    """``code_tokens`` in Python, for batches: words repeat, so each is cut up once a worker."""
    return [t for w in _RAW.findall(text) for t in word_tokens(w)]


#: the same tokens for one word ``w`` and one text ``t`` in DuckDB's dialect
TOKENS_SQL = r"""list_filter(flatten(list_transform(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), lambda w:
  list_distinct(list_filter(flatten(list_transform(
    list_concat([lower(w)], flatten(list_transform(list_filter(string_split(w, '_'), lambda p: p <> ''), lambda p:
      list_concat([lower(p)], string_split(lower(regexp_replace(regexp_replace(p, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), ' '))))),
    lambda v: list_concat([v], flatten(list_transform(regexp_extract_all(v, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}]+'), lambda r:
      list_concat([r], list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))))), lambda x: x <> '')))), lambda x: x IS NOT NULL)"""


def tokens_sql(text: str) -> str:
    return TOKENS_SQL.format(t=text)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def signature_text(content: Column, most: int = 20) -> Column:
    """The leading lines of a definition up to the first that ends in a colon, at most ``most``."""
    text = F.regexp_replace(content, r"\r\n?", "\n")
    told = F.regexp_extract(text, rf"^((?:[^\n]*\n){{0,{most - 1}}}?[^\n]*: *)(?:\n|\z)", 1)
    return F.when(told != "", told).otherwise(F.regexp_extract(text, rf"^((?:[^\n]*\n){{0,{most - 1}}}[^\n]*)", 1))


def searchable_text(path: Column, symbol: Column, qualified: Column, content: Column) -> Column:
    """Path, file name, names, signature and content of a chunk, one below the other."""
    blank = F.lit("")
    return F.concat_ws(
        "\n", F.coalesce(path, blank), F.coalesce(file_name(path), blank), F.coalesce(symbol, blank), F.coalesce(qualified, blank),
        signature_text(F.coalesce(content, blank)), F.coalesce(content, blank),
    )


def normal_identifier(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def safe_relative_path(path: Column) -> Column:
    """Whether a path is relative, canonical and without ``.``, ``..`` or back slashes."""
    return (
        (path != "")
        & ~path.contains("\\")
        & ~path.startswith("/")
        & ~F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    )


def module_name(path: Column) -> Column:
    """Dotted module of a Python path: without suffix and a final ``__init__``."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(?:^|/)__init__$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))
