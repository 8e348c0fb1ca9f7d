"""Generated, minified, vendored and bulk-data files.

Layout statistics decide first: maximum and mean line length, the share of white space,
of letters and digits, of numeric literals and of long encoded runs, with thresholds per
language.  They find minified and bundled code, encoded blobs, bulk data and lists of
digests that package managers write, in texts of any length.  Tool output and third-party
copies of ordinary layout have no statistics of their own; only where the layout says
nothing are files told by what a comment says of the file itself and by the directory they
lie in.  ``sign`` names what decided: layout, path or header.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import compared_path, language_of
from .lexers import JS_LEX, PY_LEX
from .texts import map_texts


class Limits(NamedTuple):
    """Thresholds of one language; a file is minified if its lines are long and dense.

    A value beyond what a share can be (2) turns a statistic off.
    """

    mean_line: float = 150  # mean length of a line
    long_line: int = 200  # a line is long from here
    long_share: float = 0.8  # or share of the text in long lines
    space_share: float = 0.12  # white space of minified text stays below
    alnum_share: float = 0.8  # and letters and digits below this, as it is full of operators
    encoded_share: float = 0.2  # share of the text in encoded runs
    encoded_chars: int = 600
    literal_share: float = 0.6  # share of the text in lines of nothing but literals
    literal_chars: int = 1500
    literal_lines: int = 12
    digit_share: float = 0.3  # of letters and digits, numerals


_NO_DATA = {"literal_share": 2, "digit_share": 2}
#: configuration and prose hold values and paragraphs on lines of their own: only much of it is telling
BY_LANGUAGE = {
    "Python": Limits(space_share=0.11, alnum_share=0.82),
    "JavaScript": Limits(),
    "TypeScript": Limits(alnum_share=0.82),
    "CSS": Limits(space_share=0.05, **_NO_DATA),
    "HTML": Limits(space_share=0.04, mean_line=400, long_line=1000, **_NO_DATA),
    "JSON": Limits(space_share=0.02, mean_line=2000, long_line=4000, encoded_share=0.3, encoded_chars=1200, **_NO_DATA),
    "TOML": Limits(space_share=0.02, mean_line=1000, long_line=2000, encoded_share=0.3, encoded_chars=1200, **_NO_DATA),
    "YAML": Limits(space_share=0.02, mean_line=1000, long_line=2000, encoded_share=0.3, encoded_chars=1200, **_NO_DATA),
    "Markdown": Limits(space_share=0.02, mean_line=4000, long_line=8000, encoded_share=0.6, encoded_chars=8000, **_NO_DATA),
    "Text": Limits(space_share=0, encoded_share=0.8, encoded_chars=20_000, **_NO_DATA),
}

# Directories that hold copies of other projects, and files package managers write.
VENDOR_DIRS = frozenset(
    "vendor _vendor third_party thirdparty third-party 3rdparty 3rd_party node_modules bower_components jspm_packages site-packages dist-packages".split()
)
#: these names hold copies if a directory of one package lies within
VENDOR_PARENTS = frozenset("deps extern external externals".split())
LOCK_FILES = frozenset(
    "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock pdm.lock uv.lock cargo.lock composer.lock gemfile.lock bun.lock go.sum mix.lock".split()
)
_VERSIONED = re.compile(r"[A-Za-z][\w.]*-v?\d+\.\d+(?:\.\d+)*")
_TOOL_NAME = re.compile(r"_pb2(?:_grpc)?\.py$|\.pb\.(?:go|js|ts)$|\.g\.(?:ts|js|dart)$|\.generated\.\w+$", re.I)

_LITERAL_LINE = re.compile(
    r"""(?m)^[ \t]*+(?=[^\n]*[\d"'])(?>[-+]?\d[\w.]*+|[bBrRuU]{0,2}"(?!"")(?:[^"\\\n]|\\.)*+"|[bBrRuU]{0,2}'(?!'')(?:[^'\\\n]|\\.)*+'|[][(){},:;]|None\b|null\b|[tT]rue\b|[fF]alse\b|[ \t])++\r?$"""
)
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{80,}|(?:\\x[0-9a-fA-F]{2}|\\[0-7]{3}){10,}[^\n\"']*")
_COMMENT = re.compile(r"^\s*(?:#+!?|//+!?|/\*+!?|\*+/?|<!--|--|;+|[rRuU]?\"\"\"|[rRuU]?''')\s*(.*?)\s*(?:\*/|-->|\"\"\"|''')?\s*$")
#: what a header line says of the file itself; it begins the sentence
_TOOL_HEADER = re.compile(
    r"(?:(?:note|warning|attention|caution|important|notice)\s*[:!]\s*)?(?:"
    r"@(?:partially-)?generated\b|<\s*auto-?generated|@autogenerated\b|"
    r"(?:this (?:file|code|module|source|class|script) (?:is|was|has been|gets) )?(?:\w+ )?(?:auto(?:matically)?[- ]?|machine[- ]?|programmatically )?"
    r"(?:generated|created|produced|emitted|compiled) (?:automatically |code )?(?:by|from|with|using|on|at|via|for you by)\b|"
    r"(?:this (?:file|code|module) (?:is|was|has been) )?(?:auto-?|automatically |machine[- ])(?:generated|created|written|produced)\b|"
    r"this (?:file|code|module) (?:is|was|has been) (?:generated|created by|produced by)\b|"
    r"(?:automatically|auto) (?:generated|created|produced)\b|code generated\b|"
    r"do not (?:edit|modify|change|touch)\b(?! .{0,40}without)|don't (?:edit|modify) this\b|not meant (?:for|to be) (?:hand|manual|edit)|"
    r"output of [\w./-]+\s*[-–—:,]?\s*do not|source: \S+\.(?:proto|graphql|gql|thrift|fbs|avsc|wsdl|xsd)\b|"
    r"(?:注意|警告|提示)?\s*[:：!！]?\s*(?:(?:本|此|该|这个)(?:文件|代码|模块|脚本|源码)\s*(?:由|为|是|系|通过|使用).{0,40}?(?:生成|输出|产生|产物|导出|编译|写出)|"
    r"(?:由|通过|使用).{1,40}?(?:自动)?(?:生成|输出|产生|导出|编译)|(?:代码|文件)?自动(?:生成|产生)|(?:请勿|勿|不要|切勿|禁止)(?:手动|手工|直接|人工)?(?:修改|编辑|改动|更改)|手[工动]?(?:改动|修改|编辑).{0,8}覆盖))",
    re.I,
)
_COPY_HEADER = re.compile(
    r"(?:third[- ]party (?:code|source|file|library)|vendored(?:\s*:|\s+(?:from|copy))|copied (?:unchanged |verbatim |as is |unmodified )?from\b.*(?:\d+\.\d+|licen[cs]e|https?://)|"
    r"upstream (?:fixes|changes) must|(?:this file is )?(?:taken|imported|copied) (?:unchanged|verbatim|unmodified)|"
    r"@?[\w.-]+ v\d+(?:\.\d+)+\s*[|,-].*\b(?:licen[cs]e|licensed|mit|bsd|apache|mpl|isc)\b|@license\b.*|"
    r"copyright (?:\(c\) |©\s*)?(?:\d{4}(?:-\d{4})?,? )?the [\w.-]+ (?:contributors|authors|developers|project)|"
    r"(?:(?:本|此|该)(?:文件|代码|模块|目录)?)?\s*(?:为|是|系)?\s*(?:第三方(?:代码|源码|文件|库)|(?:原样|直接|逐字|未经修改|未改动)?(?:地)?(?:复制|拷贝|搬运|引入|取|摘|抄)自.{0,60}(?:\d+\.\d+|许可|协议|https?://|上游)))",
    re.I,
)
_NEGATED = re.compile(r"\bnot (?:auto(?:matically)?[- ]?)?generated\b|\b(?:kept|written|maintained|edited) by hand\b|rewritten for|idea taken|(?:非|不是|并非)(?:自动)?生成|手(?:工|动)?(?:维护|编写|写成|写的)|人工维护", re.I)


def header_reason(text: str) -> str | None:
    """``generated`` or ``vendored`` if a comment above the first code says so of the file."""
    in_block = ""
    for line in text.split("\n"):
        bare = line.strip().removeprefix("\ufeff")
        if not bare:
            continue
        m = _COMMENT.match(bare)
        if not in_block and not m:
            return None
        said = (m[1] if m else bare).strip(" *#/")
        if said and not _NEGATED.search(said):
            if _TOOL_HEADER.match(said):
                return "generated"
            if _COPY_HEADER.match(said):
                return "vendored"
        if in_block:
            if in_block in bare:
                in_block = ""
        else:
            for begin, end in (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''")):
                at = bare.find(begin)
                if 0 <= at < 3:
                    in_block = "" if end in bare[at + len(begin) :] else end
                    break
    return None


def late_header_reason(text: str, language: str) -> str | None:
    """As ``header_reason``, for whole comments at the margin further down: tools also put
    their line below imports or at the end.  Text inside string literals is no comment."""
    lines = {}
    for k, line in enumerate(text.split("\n")):
        if line[:1] in ("#", "/", "<", "-", ";") or line.startswith(" *"):
            said = _COMMENT.match(line)
            said = said[1].strip(" *#/") if said else ""
            if said and not _NEGATED.search(said):
                if _TOOL_HEADER.match(said):
                    lines[k] = "generated"
                elif _COPY_HEADER.match(said):
                    lines[k] = "vendored"
    if not lines:
        return None
    at = 0
    for lexeme in comment_lexemes(text, language):
        begin, (comment, gap) = at, lexeme
        at += gap
        if comment:
            first = text.count("\n", 0, begin)
            for k in range(first, first + comment.count("\n") + 1):
                if k in lines:
                    return lines[k]
    return None


def comment_lexemes(text: str, language: str):
    """(comment or '', length) of the lexemes of a Python, JavaScript or TypeScript text."""
    if language == "Python":
        for x in PY_LEX.findall(text):
            yield (x if x[0] == "#" else ""), len(x)
    elif language in ("JavaScript", "TypeScript"):
        for ws, x in JS_LEX.findall(text):
            if ws:
                yield "", len(ws)
            if x:
                yield (x if x[:2] in ("//", "/*") else ""), len(x)
    else:
        comment = _COMMENTS.get(language, _COMMENTS["Text"])
        at = 0
        for m in comment.finditer(text):
            if m.start() > at:
                yield "", m.start() - at
            yield m[0], len(m[0])
            at = m.end()


#: comments of languages that have no strings over lines
_COMMENTS = {
    "CSS": re.compile(r"/\*(?:[^*]|\*(?!/))*\*/"),
    "HTML": re.compile(r"<!--(?:[^-]|-(?!->))*-->"),
    "Markdown": re.compile(r"<!--(?:[^-]|-(?!->))*-->"),
    "JSON": re.compile(r"(?!)"),
    "Text": re.compile(r"(?m)^[#;][^\n]*"),
}


def path_reason(path: str) -> str | None:
    """``lock``, ``vendored`` or ``generated`` by the path alone."""
    *dirs, name = path.split("/")
    lower = [d.lower() for d in dirs]
    if name.lower() in LOCK_FILES:
        return "lock"
    if any(d in VENDOR_DIRS for d in lower) or any(_VERSIONED.fullmatch(d) for d in dirs):
        return "vendored"
    if any(d in VENDOR_PARENTS for d in lower[:-1]):
        return "vendored"
    return "generated" if _TOOL_NAME.search(name) else None


class Layout(NamedTuple):
    """Layout statistics of a text; shares are of its characters."""

    max_line: int = 0
    mean_line: float = 0.0  # of the lines that are not empty
    long_share: float = 0.0  # in lines of LONG_LINE characters or more
    space_share: float = 0.0
    alnum_share: float = 0.0
    encoded_share: float = 0.0  # in long encoded runs
    literal_chars: int = 0  # in lines of nothing but literals
    literal_lines: int = 0
    literal_share: float = 0.0
    digit_share: float = 0.0  # of digits among letters and digits


LONG_LINE = 200
_NOT_DIGITS = bytes(x for x in range(256) if not 48 <= x <= 57)
_NOT_ALNUM = bytes(x for x in range(256) if not (48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122 or x >= 192))


def layout(text: str) -> Layout:
    """Layout statistics in a few passes; the costly ones only where one that is cheaper shows a hit is possible."""
    n = len(text)
    if not n:
        return Layout()
    lengths = [x for x in map(len, text.split("\n")) if x] or [0]
    words = text.split()
    raw = text.encode("utf-8", "surrogatepass")
    alnum = len(raw.translate(None, _NOT_ALNUM))
    digits = len(raw.translate(None, _NOT_DIGITS))
    encoded = 0
    if "\\" in text or max(map(len, words), default=0) >= 80:
        encoded = sum(map(len, _ENCODED.findall(text)))
    literal = [len(m) for m in _LITERAL_LINE.findall(text)]
    return Layout(
        max(lengths),
        sum(lengths) / len(lengths),
        sum(x for x in lengths if x >= LONG_LINE) / n,
        (n - sum(map(len, words))) / n,
        alnum / n,
        encoded / n,
        sum(literal),
        len(literal),
        sum(literal) / n,
        digits / max(1, alnum),
    )


def layout_reason(text: str, language: str) -> str | None:
    """``minified``, ``encoded`` or ``data`` by the layout thresholds of the language."""
    limits = BY_LANGUAGE.get(language)
    if limits is None or not text:
        return None
    x = layout(text)
    dense = x.space_share < limits.space_share and x.alnum_share < limits.alnum_share
    if dense and x.max_line >= limits.long_line and (x.mean_line >= limits.mean_line or x.long_share >= limits.long_share):
        return "encoded" if x.encoded_share >= limits.encoded_share else "minified"
    if x.encoded_share >= limits.encoded_share and x.encoded_share * len(text) >= limits.encoded_chars:
        return "encoded"
    if x.literal_chars >= limits.literal_chars and x.literal_lines >= limits.literal_lines:
        if x.literal_share >= limits.literal_share or (x.digit_share >= limits.digit_share and x.literal_share >= limits.literal_share / 2):
            return "data"
    return None


def reason_rows(text: str, arg: str) -> list[tuple]:
    language, _, path = arg.partition("\t")
    reason, sign = layout_reason(text, language), "layout"
    if reason is None:
        reason, sign = path_reason(path), "path"
    if reason is None:
        reason, sign = header_reason(text) or late_header_reason(text, language), "header"
    if reason is None and language == "JSON" and '"lockfileVersion"' in text:
        reason = "lock"
    return [(reason, sign)] if reason else []


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, reason, sign) of the files nobody wrote by hand.

    Reads ``id, path, content``; the size column is stale in deliveries, so sizes are taken
    from the content.  Null contents are no case; an empty text is one only by its path.
    Reasons: lock, vendored, generated, minified, encoded, data; ``sign`` tells what decided:
    layout, path or header.
    """
    texts = files.select(
        "id", "content", F.concat_ws("\t", language_of(F.col("path")), compared_path(F.col("path"))).alias("arg")
    ).where(F.col("path").isNotNull())
    return map_texts(texts, ["id"], "content", "arg", reason_rows, "file_id long, reason string, sign string", "handwritten")
