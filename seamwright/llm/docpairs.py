"""Functions paired with their documentation.

A table of the symbols of all Python, JavaScript and TypeScript files is built first:
module, qualified name, normalised signature (parameter names with normalised types), own
documentation, and the places where a declaration of it can stand.  Declarations are
overload signatures, stubs (``.pyi``, ``.d.ts``), interface members and abstract methods.
They stand in the module of the same name (paths without suffix and without leading source
or stub folders), or, for a method, under a base class or interface that its class names,
found through the file's imports.

Documented declarations are joined to the definitions by module and qualified name; of
overloads the one of the same normalised signature is taken, else of the same parameter
names, else of the same number of parameters, else the first by path and line.  The join
is four equalities over keys that are reduced to one declaration each before it, so that
no key meets a group.  A definition's own documentation goes before a declaration's unless
it is trivial.  Pairs whose documentation is empty or trivial are dropped last.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import language_of, suffix
from ..session import written
from .symbols import symbols_of
from .texts import map_texts

#: stubs lend their declarations only; their suffix has no language of its own
SUFFIXES = ("py", "js", "jsx", "ts", "tsx", "pyi")
# Folders above modules that are no part of their names.
ROOTS = frozenset("src lib stubs typings types @types dist".split())
#: A description has at least so many words, or so many Chinese characters.
MIN_WORDS, MIN_HAN = 4, 6

_SECTION = re.compile(
    r"^[ \t]*(?:[:@\\](?:param|type|return|returns|rtype|raise|raises|arg|argument|keyword|var|ivar|cvar|yield|yields|throws|exception|example|see|deprecated|template|typedef|property|prop|private|public|internal|override|async|function|method|class|this|since|version|author|todo|default|readonly|inheritdoc|memberof|name|export|module|callback|enum|access|static|fires|listens)\b"
    r"|(?:args|arguments|parameters|params|returns?|yields?|raises|throws|keyword arguments|other parameters|attributes|参数|返回|返回值)[ \t]*[:：]?[ \t]*$|>>>|```|~~~)",
    re.I | re.M,
)
_NOTE = re.compile(
    r"^\W*(?:to-?dos?\b|fixmes?\b|tbd\b|tba\b|xxx+\b|wip\b|hack\b|to be (?:written|done|documented|added|described|filled|completed|defined|determined)|"
    r"(?:docs?|documentation|docstring|description|comment)s?\b[^.]{0,20}(?:to come|to follow|pending|missing|needed|goes here|later)|"
    r"(?:please |must |should |need(?:s|ed)? to |someone |i will |we )*(?:write|add|needs?|missing|insert|fill in|complete|provide|update)\b[^.]{0,25}\b(?:docs?|documentation|docstring|description|comment)s?\b|"
    r"(?:not|un)[- ]?(?:yet )?documented|no (?:docs?|documentation|description)\b|placeholder\b|coming soon|describe (?:me|this)\b|"
    r"(?:文档|说明|注释|描述)?(?:待|尚待|有待|未)(?:补充|补|完善|写|编写|完成|办|添加|定)|(?:以后|稍后|之后|回头|需要|请)(?:再)?(?:补|写|添加|完善)|暂无|尚未(?:编写|完成|补)|补文档|占位)",
    re.I,
)
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_WORD = re.compile(r"[^\W\d_㐀-鿿豈-﫿][^\W_㐀-鿿豈-﫿]*(?:['’\-_.][^\W_㐀-鿿豈-﫿]+)*|\d+(?:\.\d+)?")


def plain_doc(doc: str) -> str:
    """Documentation without comment marks and indentation."""
    if doc.startswith("/**"):
        lines = doc[3 : -2 if doc.endswith("*/") else None].split("\n")
        return "\n".join(re.sub(r"^[ \t]*\*?[ \t]?", "", x).rstrip() for x in lines).strip()
    return doc.strip()


def description(doc: str) -> str:
    """The describing part of a documentation: without tags and sections on parameters and results."""
    text = plain_doc(doc)
    text = re.sub(r"^[ \t]*@(?:description|desc|summary|brief|remarks|file|fileoverview)\b", "", text, flags=re.M)
    m = _SECTION.search(text)
    return (text[: m.start()] if m else text).strip()


def is_trivial(doc: str) -> bool:
    """Whether a documentation is empty, bare tags, a note to write it, or too short.

    The bounds are MIN_WORDS words or MIN_HAN Chinese characters; of mixed texts the
    shares of both add up.
    """
    text = description(doc)
    if not text or _NOTE.match(text):
        return True
    han = len(_HAN.findall(text))
    words = len(_WORD.findall(text))
    return words / MIN_WORDS + han / MIN_HAN < 1


def module_of(path: str) -> str:
    """Name of the module in a file: its path without suffix, index file and leading source or stub folders."""
    parts = [x for x in re.sub(r"(?:\.d)?\.[^./]*$", "", path.replace("\\", "/")).split("/") if x not in ("", ".")]
    while len(parts) > 1 and parts[0] in ROOTS:
        parts = parts[1:]
    if len(parts) > 1 and parts[-1] in ("__init__", "index"):
        parts = parts[:-1]
    return "/".join(x.removesuffix("-stubs") for x in parts)


def resolved(where: str, path: str, python: bool) -> str:
    """The module an import in the file ``path`` names; '' is the file's own."""
    if not where:
        return module_of(path)
    here = [x for x in path.replace("\\", "/").split("/") if x not in ("", ".")][:-1]
    if python:
        dots = len(where) - len(where.lstrip("."))
        parts = where[dots:].split(".") if where[dots:] else []
        if dots:
            parts = here[: len(here) - (dots - 1)] + parts
    else:
        parts = here
        for x in where.split("/"):
            if x == "..":
                parts = parts[:-1]
            elif x != ".":
                parts = [*parts, x]
    if not parts:
        return ""
    name = "/".join(parts)
    return module_of(name if not python and re.search(r"\.(?:[cm]?[jt]sx?)$", name) else name + ".x")


def _symbol_rows(with_code: bool):
    def rows(text: str, suffix: str) -> list[tuple]:
        out = []
        for s in symbols_of(text, suffix) or ():
            if s.kind != "class":
                code = text[s.start : s.end] if with_code and s.kind != "signature" else None
                out.append((s.qualified, s.name, s.kind, s.name_line, s.arity, s.typed, s.declares, plain_doc(s.doc), code, bool(s.doc) and not is_trivial(s.doc), s.bases))
        return out

    return rows


def _placed(key: tuple, row: tuple) -> tuple:
    """A row with the places (module, qualified name) where a declaration of it can stand."""
    path = key[2]
    *front, bases = row
    qualified, name = row[0], row[1]
    python = path.lower().endswith((".py", ".pyi"))
    places = [f"{module_of(path)}\t{qualified}"]
    if bases:
        owner = qualified[: -len(name) - 1]
        outer = owner.rpartition(".")[0]
        for where, base in bases:
            if not where and outer:
                places.append(f"{module_of(path)}\t{outer}.{base}.{name}")
            places.append(f"{resolved(where, path, python)}\t{base}.{name}")
    return (*front, list(dict.fromkeys(places)))


def symbol_table(files: DataFrame, with_code: bool = True) -> DataFrame:
    """One row per function, method and signature of every file that parses.

    Reads ``id, project_id, path, content`` of the Python, JavaScript and TypeScript rows and
    of stubs; null contents and files that do not parse give no rows.
    """
    texts = files.select("id", "project_id", "path", "content", suffix(F.col("path")).alias("suffix")).where(
        F.col("suffix").isin(*SUFFIXES)
    )
    return map_texts(
        texts, ["id", "project_id", "path"], "content", "suffix", _symbol_rows(with_code),
        "file_id long, project_id string, path string, qualified_name string, name string, kind string, name_line long,"
        " arity string, typed string, declares boolean, doc string, code string, told boolean, places array<string>",
        f"symbols{with_code}", _placed,
    )


#: how well a declaration fits, best first: by normalised signature, parameter names, their number, name alone
FITS = 4


def _fit_keys(place) -> list:
    size = F.size(F.split("arity", "/")).cast("string")
    return [F.concat_ws("\t", F.lit(str(k)), place, how) for k, how in enumerate((F.col("typed"), F.col("arity"), size, F.lit("")))]


def declared_docs(symbols: DataFrame) -> DataFrame:
    """(row, declared_doc, declared_told): the documentation declared for each definition that has some elsewhere."""
    declared = (
        symbols.where("declares AND doc != ''")
        .select(F.col("project_id").alias("of"), F.explode(F.array(*_fit_keys(F.element_at("places", 1)))).alias("held"), F.struct("path", "name_line", "doc", "told", "row").alias("d"))
        .groupBy("of", "held")
        .agg(F.min("d").alias("d"))
    )
    sought = symbols.where("kind != 'signature'").select("row", "project_id", "typed", "arity", F.posexplode("places").alias("at", "place"))
    keyed = sought.select("row", "project_id", "at", F.posexplode(F.array(*_fit_keys(F.col("place")))).alias("fit", "key"))
    found = keyed.join(declared, F.col("project_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("held")))
    found = found.where("d.row != row").select("row", F.struct("fit", "at", "d").alias("f"))
    best = found.groupBy("row").agg(F.min("f").alias("f"))
    return best.select("row", F.col("f.d.doc").alias("declared_doc"), F.col("f.d.told").alias("declared_told"))


def code_doc_pairs(files: DataFrame, with_code: bool = True) -> DataFrame:
    """Every pair of code and description, see the module's text.

    Columns: file_id, project_id, path, language, qualified_name, name, kind, name_line, arity, doc, code,
    doc_source (``own`` or ``declaration``).  Empty input gives an empty result; repeated
    rows give repeated pairs.  Without ``with_code`` the code is null.
    """
    symbols = written(symbol_table(files, with_code).withColumn("row", F.monotonically_increasing_id()))
    declared = declared_docs(symbols)
    joined = symbols.where("kind != 'signature'").join(declared, "row", "left")
    own = F.col("told") | F.col("declared_doc").isNull() | ~F.col("declared_told")
    pairs = joined.select(
        "file_id", "project_id", "path", "qualified_name", "name", "kind", "name_line", "arity",
        F.when(own, F.col("doc")).otherwise(F.col("declared_doc")).alias("doc"),
        "code",
        F.when(own, "own").otherwise("declaration").alias("doc_source"),
        F.when(own, F.col("told")).otherwise(F.col("declared_told")).alias("told"),
    )
    return pairs.where("told").drop("told").withColumn("language", language_of(F.col("path")))
