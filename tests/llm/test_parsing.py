"""Grammars, documentation pairs, splitting, hand-written sources."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seamwright.llm import docpairs, handwritten, parsecheck, splitting
from seamwright.llm.derive import Grammar
from seamwright.llm.lexers import check
from seamwright.llm.symbols import js_symbols, python_symbols

FILES = "id long, project_id string, path string, content string, symbols_json string, suffix string, arg string, language string"


def files(spark, rows):
    return spark.createDataFrame([(i, "p", path, text, None, "x", "y", "z") for i, (path, text) in enumerate(rows)], FILES)


def test_derivatives():
    g = Grammar("s: 'a' s 'b' | 'c'?", {})
    assert g.run("s", list("aacbb")) == -1 and g.run("s", []) == -1
    assert g.run("s", list("aab")) == 3  # stops too early
    assert g.run("s", list("abb")) == 2  # the third token fails
    small = Grammar("s: 'a' s 'b' | 'c'?", {}, max_languages=3)
    for n in range(30):
        small.tidy()
        assert small.run("s", ["a"] * n + ["b"] * n) == -1


GOOD = {
    "python": ["", "x = 1", "def f(a, /, b=1, *, c, **k) -> int:\n    return a\n", "match x:\n    case [1, *r] if r:\n        pass\n", "f'{a!r:>{w}}'", "async def f():\n\tasync with a as b, c:\n\t\tawait d\n", "x: int\nprint(*a, **b)\n", "if x:\n  pass\nelif y: pass\nelse:\n  z\n", "class A[T](B, k=1):\n    '''d'''\n", "lambda *a, b=1: (yield)\n", "try:\n    a\nexcept* E as e:\n    b\n", "a = b = c, = 1\n", "type X = int\nmatch = 1\n", "with (a as b, c as d,):\n    pass\n", "x = [i async for i in y if z]\n"],
    "js": ["", "a\nb", "return_ = a ? b : c", "let {a, b: [c = 1], ...d} = e", "x = /re[/]/g.test(y) / 2", "`a${`b${c}`}`", "for (const [a] of b) c: for (;;) break c", "class A extends B { static #x = 1; get y() { return 1 } async *z() {} static {} }", "export default {a}; import x, {y as z} from 'q'", "a?.b?.[c]?.(d) ?? e", "async (x) => { await x }", "var f = <div a={1} {...b}>t {c}<br/></div>", "if (a) /x/.test(b)", "do x(); while (y) z()", "({get a() {}, b() {}, [c]: 1, async d() {}})", "new.target; new a.b(c).d"],
    "ts": ["let a: Map<string, Array<number>> = b", "interface A<T extends B = C> extends D { readonly x?: y; (z): w; [k: string]: any }", "type A = {[K in keyof B]?: C} | ((a: D) => E) | `x${F}`", "enum A { B = 1, C }", "function f(a: string): void;\nfunction f(a: any) {}", "abstract class A { constructor(private readonly x: B) {} abstract y(): void }", "let x = <any>y as const satisfies Z", "declare module 'a' { export function f(): void }", "export type {A} from './b'", "f<A>(b!)", "namespace A.B { export const c = 1 }", "let x: A extends infer B ? C : D"],
    "json": ["{}", ' [1, -2.5e3, "a\\u0041", null, {"b": []}]\n', "0"],
    "toml": ["", 'a = 1\n[b.c]\nd = [1, 2,\n 3]\n', '[[x]]\n"k.e" = {a = 1, b = "c"}\nd = 1979-05-27T07:32:00Z\n', "a.b = '''x\ny'''\n"],
}
BAD = {
    "python": ["def f(:\n  pass", "x = (1", "print 'a'", "if x:\npass", "a = “b”", "  x = 1", "def f():\n    a\n  b\n", "<<<<<<< a\n", "x = 01", "f(a=1, b)", "'''abc", "class A:\n", "try:\n    a\n", "a b", "f() = 1", "except A, b:", "f'{a b}'", "return return"],
    "js": ["{ \"a\": 1, \"b\": 2 }", "function f(a {}", "let x = {a: 1 b: 2}", "x = 'a", "if (a > {", "interface A { b: c }", "}", "[1, 2", "let a: string", "class {{ a }} {}", "=======", "`a${b`"],
    "ts": ["let x: = 1", "function f(a: ) {}", "class A(B):", "type = {", "enum { A }"],
    "json": ["", "{'a': 1}", "[1,]", "{\"a\": 1,}", "// c\n{}", "[01]", "NaN", "\"a\nb\"", "[1 2]"],
    "toml": ["a: 1", "a = ", "[a", "a = [1, 2", "a = 1 b = 2", "a = 01", "=======", "a = \"b"],
}


@pytest.mark.parametrize("name", GOOD)
def test_valid_texts(name):
    for t in GOOD[name]:
        assert check(t, name).valid, t


@pytest.mark.parametrize("name", BAD)
def test_invalid_texts(name):
    for t in BAD[name]:
        assert not check(t, name).valid, t


def test_python_verdicts_equal_the_interpreter(tiny):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{tiny}/repo_files.parquet", columns=["path", "content"]).to_pylist()
    for r in t:
        if r["path"] and r["path"].endswith(".py") and r["content"] is not None:
            assert parsecheck.verdict_rows(r["content"], "py")[0][0] == (parsecheck.python_tree(r["content"]) is not None)


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=4), max_leaves=12), st.integers(0, 60))
def test_json_round_trip_and_truncation(value, cut):
    text = json.dumps(value, ensure_ascii=False)
    assert check(text, "json").valid
    short = text[: max(0, len(text) - 1 - cut % max(1, len(text)))]
    try:
        json.loads(short)
        ok = True
    except ValueError:
        ok = False
    assert check(short, "json").valid == ok


def test_place_of_the_failure(spark):
    got = parsecheck.unparsable(files(spark, [("a.py", "x = 1\ny = = 2\n"), ("b.js", "f(1"), ("c.json", '{"a": 1'), ("d.txt", "((("), ("e.py", None), (None, "x")]))
    rows = {r["id"]: (r["reason"], r["line_no"], r["column_no"], r["token"]) for r in got.collect()}
    assert rows == {0: ("token", 2, 5, "="), 1: ("truncated", 1, 4, ""), 2: ("truncated", 1, 8, "")}


def test_parse_edge_cases(spark):
    assert parsecheck.unparsable(files(spark, [])).count() == 0
    long = "x = [" + "1, " * 200_000 + "]\n"
    assert parsecheck.parse_verdicts(files(spark, [("a.py", long), ("a.py", ""), ("a.py", ""), ("b.json", "")])).where("valid").count() == 3
    projects = spark.createDataFrame([("p", "O", "R")], "id string, owner string, repo string")
    r = parsecheck.parse_rates(files(spark, [("a.py", "("), ("b.py", "1")]), projects).collect()
    assert [(x["repository"], x["language"], x["files"], x["invalid_files"], x["invalid_share"]) for x in r] == [("o/r", "Python", 2, 1, 0.5)]


TS = '''
/** Reads all of the given rows. */
export async function load(a: string): Promise<void> { }

/** Not of the next one. */
const x = 1;
function bare() { /** inside of this one here */ const inner = (q) => q; }
class A {
  /** Keeps count of what was seen. */
  @dec() static count<T>(a: T, { b }: any): number { return 1 }
  // not a doc comment at all
  plain() {}
  /** Says what it is about. */
  field = async (x) => { };
  /** Cut off from its method now. */
  /* by this */
  lost() {}
}
'''  # fmt: skip


def test_script_symbols():
    got = {s.qualified: (s.kind, s.name_line, bool(s.doc), s.top) for s in js_symbols(TS, "ts")}
    assert got["load"] == ("function", 3, True, True)
    assert got["bare.inner"][2] is True and got["A.count"] == ("method", 10, True, False)
    assert got["A.field"][2] and not got["A.plain"][2] and not got["A.lost"][2] and got["A"] == ("class", 8, False, True)
    assert js_symbols("function (", "js") is None


def test_python_symbols():
    text = "@dec\ndef f():\n    'one two three four'\n    class K:\n        async def m(self): pass\n\ndef g():\n    pass\n    'late string not a doc'\n"
    got = [(s.qualified, s.kind, s.name_line, s.doc, s.top) for s in python_symbols(text)]
    assert got == [("f", "function", 2, "one two three four", True), ("f.K", "class", 4, "", False), ("f.K.m", "method", 5, "", False), ("g", "function", 7, "", True)]


@pytest.mark.parametrize("doc,trivial", [
    ("Returns one row per key.", False), ("Return it now", True), ("TODO: describe what this function does here", True), ("", True), ("/** */", True),
    ("/**\n * @param {x} a the first of them\n */", True), ("先读取全部文件", False), ("读取文件", True), ("待补充说明文字内容", True), (":param x: the value of it all", True),
    ("/** Sums rows up.\n * @returns all */", True), ("/** Sums the rows up.\n * @returns all */", False), ("...", True), ("write docs for this one", True),
])
def test_trivial_documentation(doc, trivial):
    assert docpairs.is_trivial(doc) is trivial


def test_pairs_join_declarations(spark):
    rows = [
        ("m.d.ts", "/** Adds one number to another. */\nexport declare function add(a: number, b: number): number;\n"),
        ("m.ts", "export function add(x: number, y: number) { return x + y }\n/** Takes one away from it. */\nexport function sub(a) { }\n"),
        ("o.ts", "/** Finds it by its key. */\nfunction find(a: string): void;\nfunction find(a: any) { }\n"),
        ("n.py", 'def f():\n    """Counts the rows of all."""\n'),
        ("bad.py", 'def f(:\n    """Counts the rows of all."""\n'),
    ]
    got = {(r["path"], r["qualified_name"], r["doc_source"], r["name_line"]) for r in docpairs.code_doc_pairs(files(spark, rows)).collect()}
    assert got == {("m.ts", "add", "declaration", 1), ("m.ts", "sub", "own", 3), ("o.ts", "find", "declaration", 3), ("n.py", "f", "own", 1)}
    assert docpairs.code_doc_pairs(files(spark, [])).count() == 0
    assert docpairs.code_doc_pairs(files(spark, [("a.py", None), (None, "x"), ("a.py", "")])).count() == 0


def test_declarations_of_other_files(spark):
    overloads = (
        "from typing import overload\n@overload\ndef cut(x: int) -> int:\n    \"\"\"Cuts a whole number in two.\"\"\"\n@overload\ndef cut(x: 'typing.Optional[str]') -> str:\n    \"\"\"Cuts a text in two halves.\"\"\"\n"
    )
    rows = [
        ("stubs/pkg/m.pyi", overloads),
        ("src/pkg/m.py", "def cut(x: None | str):\n    return x\n"),
        ("pkg/base.py", "import abc\nclass Base(abc.ABC):\n    @abc.abstractmethod\n    def load(self, key):\n        \"\"\"Loads the row of a key.\"\"\"\n"),
        ("pkg/impl.py", "from .base import Base as B\nclass Own(B):\n    def load(self, key):\n        return key\n    def other(self): pass\n"),
        ("web/api.ts", "export interface Store {\n  /** Finds the value of a key. */\n  get(key: string): string;\n}\n"),
        ("web/mem.ts", "import { Store as S } from './api';\nexport class Mem implements S {\n  get(key: string) { return key }\n  put(a) { }\n}\n"),
    ]
    got = {(r["path"], r["qualified_name"], r["doc_source"]): r["doc"] for r in docpairs.code_doc_pairs(files(spark, rows)).collect()}
    assert got == {
        ("src/pkg/m.py", "cut", "declaration"): "Cuts a text in two halves.",
        ("pkg/base.py", "Base.load", "own"): "Loads the row of a key.",
        ("pkg/impl.py", "Own.load", "declaration"): "Loads the row of a key.",
        ("web/mem.ts", "Mem.get", "declaration"): "Finds the value of a key.",
    }


def test_overloads_that_differ_by_type_only(spark):
    text = "declare class A {\n  /** Takes the number apart again. */\n  f(x: number): void;\n  /** Takes the text apart again. */\n  f(x: string | undefined): void;\n}\n"
    rows = [("a.d.ts", text), ("a.ts", "class A {\n  f(x: undefined | string) { }\n}\n"), ("b.ts", "class A {\n  f(x: number) { }\n}\n")]
    assert [(r["path"], r["doc"]) for r in docpairs.code_doc_pairs(files(spark, rows)).collect()] == [("a.ts", "Takes the text apart again.")]


def test_modules_of_paths():
    for path, module in (("./src/a/b.py", "a/b"), ("a\\b\\__init__.py", "a/b"), ("types/x.d.ts", "x"), ("web/index.js", "web"), ("a-stubs/b.pyi", "a/b")):
        assert docpairs.module_of(path) == module
    assert docpairs.resolved("..c.d", "p/q/r.py", True) == "p/c/d" and docpairs.resolved("../c/d.js", "p/q/r.ts", False) == "p/c/d"


LIMITS = "language string, max_chars int, overlap_chars int"


def check_pieces(text, cores, max_chars, overlap):
    assert "".join(text[a:b] for a, b in cores) == text
    for k, (a, b) in enumerate(cores):
        assert b - max(0, a - overlap) <= max_chars
        if k:
            assert a >= overlap  # each shares exactly the overlap


def test_pieces_keep_definitions_whole():
    body = "".join(f"def f{i}(x):\n" + f"    y{i} = [x, {i}]\n" * (i % 9 + 1) + "\n\n" for i in range(60))
    text = "import os\n\n" + body
    tops = [s for s in python_symbols(text) if s.top]
    cores = splitting.pieces(text, 900, 120, "Python", tops)
    check_pieces(text, cores, 900, 120)
    spans = [(max(0, a - 120), b) for a, b in cores]
    for s in tops:
        if s.end - s.start <= 780:
            assert any(a <= s.start and s.end <= b for a, b in spans)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n;{}。，#", max_size=900), st.integers(4, 120), st.integers(0, 80))
def test_pieces_of_any_text(text, limit, overlap):
    o = overlap % limit
    cores = splitting.pieces(text, limit, o, "Text")
    if text:
        assert "".join(text[a:b] for a, b in cores) == text
        if len(text) > limit:
            check_pieces(text, cores, limit, o)
    else:
        assert cores == []


def test_split_texts(spark):
    limits = spark.createDataFrame([("Python", 60, 10), ("Text", 40, 5), ("JSON", None, 3), (None, 5, 1)], LIMITS)
    text = "def a():\n    return 1\n\n\ndef b():\n    return 22222222222222222222\n\n\nx = 3\n"
    df = files(spark, [("a.py", text), ("b.txt", "w" * 200), ("c.md", "y" * 500), ("d.json", "{}" * 100), ("e.py", None), ("f.py", "")])
    rows = splitting.split_texts(df, limits).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["piece_no"]):
        by[r["file_id"]] = by.get(r["file_id"], "") + r["text"][r["overlap_chars"] :]
    assert by == {0: text, 1: "w" * 200} and max(len(r["text"]) for r in rows) <= 60
    assert {(r["file_id"], r["symbol"], r["name_line"]) for r in splitting.whole_definitions(df, limits).collect()} == {(0, "", 0), (0, "a", 1), (0, "b", 5), (1, "", 0)}
    assert splitting.split_texts(df, spark.createDataFrame([], LIMITS)).count() == 0


@pytest.mark.parametrize("max_chars,overlap", [(1, 0), (2, 1), (10, 9), (100, 51), (100, 90), (37, 36), (50, -3)])
def test_overlaps_of_any_size(max_chars, overlap):
    text = "def a():\n    return 1\n\n\n" * 12 + "x" * 180 + "\n一二三。四五六" * 9
    cores = splitting.pieces(text, max_chars, overlap, "Python")
    check_pieces(text, cores, max_chars, max(0, overlap))


def test_limits_that_cannot_be_kept(spark):
    for max_chars, overlap in ((0, 0), (10, 10), (5, 9)):
        with pytest.raises(ValueError):
            splitting.pieces("x" * 20, max_chars, overlap, "Text")
        limits = spark.createDataFrame([("Python", max_chars, overlap)], LIMITS)
        with pytest.raises(Exception, match="more than the overlap"):
            splitting.split_texts(files(spark, [("a.py", "x = 1\n" * 20)]), limits).collect()


HAND = "import os\n\n\ndef f(x):\n    # generated ids are handled by the writer\n    return [x, 1, 2, 3]\n" * 3


@pytest.mark.parametrize("path,text,reason", [
    ("a/package-lock.json", "{}", "lock"), ("x/vendor/lib/a.js", "1", "vendored"), ("src/vendors/a.js", "var a = 1", None), ("lib/foo-1.2.3/a.py", "x=1", "vendored"), ("deps/a.py", "x=1", None), ("deps/b/a.py", "x=1", "vendored"),
    ("a.py", "# Code generated by x. DO NOT EDIT.\nx = 1\n", "generated"), ("a.py", 'BANNER = """\n# Code generated by x. DO NOT EDIT.\n"""\n', None), ("a.py", HAND, None),
    ("a.py", "# Not generated: this table is kept by hand.\nx = 1\n", None), ("a.py", "import a\n\n# @generated by b\n\nx = 1\n", "generated"), ("a.js", "/*! x v1.2.3 | MIT License | (c) the x authors */\nvar a\n", "vendored"),
    ("a.js", "var " + ",".join(f"a{i}=b[{i}]" for i in range(300)) + ";", "minified"), ("a.py", "T = [\n" + "    1234, 5678, 9012, 3456, 7890, 1234,\n" * 80 + "]\n", "data"),
    ("a.py", "T = [\n    1, 2, 3,\n    4, 5, 6,\n]\n", None), ("a.js", "export const d = '" + "aB3+/x9Z" * 120 + "';\n", "encoded"), ("min.js", "function f(a) {\n  return a + 1;\n}\n" * 20, None),
    ("a.md", "x" * 5000, None), ("a.py", "", None),
])
def test_hand_written(path, text, reason):
    from seamwright.functions.paths import LANGUAGE_BY_SUFFIX

    language = LANGUAGE_BY_SUFFIX.get(path.rsplit(".", 1)[-1], "Text")
    got = [r[:1] for r in handwritten.reason_rows(text, f"{language}\t{path}")]
    assert got == ([(reason,)] if reason else [])


def test_hand_written_tables(spark):
    got = handwritten.not_handwritten(files(spark, [("./x\\vendor\\a.py", "1"), ("a.py", None), (None, "x"), ("a.py", "y = 1\n" * 100_000)]))
    assert [(r["file_id"], r["reason"]) for r in got.collect()] == [(0, "vendored")]
    assert handwritten.not_handwritten(files(spark, [])).count() == 0


def test_layout_of_short_texts_and_late_headers():
    """No size below which layout is not looked at, no line after which a header is not read."""
    short = "var a=function(b,c){return b?c(b):0},d=[],e={};" * 5
    assert len(short) < 266 and handwritten.reason_rows(short, "JavaScript\tx.js") == [("minified", "layout")]
    long_head = "".join(f"# note {i}\n" for i in range(40)) + "# Code generated by foo. DO NOT EDIT.\nx = 1\n"
    assert handwritten.reason_rows(long_head, "Python\tx.py") == [("generated", "header")]
    assert handwritten.reason_rows("a {\n}\n/* 此文件由工具自动生成，请勿手动修改 */\n", "CSS\tx.css") == [("generated", "header")]
    assert handwritten.reason_rows("# 手工维护，并非自动生成\nx = 1\n", "Python\tx.py") == []
    lines = "[[package]]\nname = 'x'\n" + "".join(f'hash = "{"ab12" * 20}{i:04d}"\n' for i in range(20))
    assert handwritten.reason_rows(lines, "TOML\tdeps.toml") == [("encoded", "layout")]
