"""Texts to token kinds for the grammars in ``grammars``, and the check of one text.

``check(text, language)`` is the whole test of a file: a token stream is made in one pass
of a regular expression and run through the derivatives of the language's grammar.
Lexemes in doubt (templates with nested templates, expressions starting with ``/`` after
a bracket, elements in .jsx) are read by a second, slower scanner that asks the parser
state what may come next.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .grammars import JS_CONTEXTUAL, JS_RESERVED, PY_KEYWORDS, PY_SOFT, grammar


class Verdict(NamedTuple):
    """valid; else the offset of the failing token (the text's length if it stops too early)."""

    valid: bool
    reason: str = ""
    offset: int = -1
    token: str = ""


OK = Verdict(True)


class _Small(dict):
    """A memo that is emptied when it has grown too large."""

    def put(self, key, value):
        if len(self) > 50_000:
            self.clear()
        self[key] = value
        return value


# ---------------------------------------------------------------------------- JSON
_JSON = re.compile(
    r'[ \t\n\r]+|[{}\[\],:]|"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"|true\b|false\b|null\b|[-+.\w]+|.', re.S
)
_JSON_NUM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")


def json_kinds(text: str) -> tuple[list[str], list[int]]:
    kinds, marks = [], []
    for i, x in enumerate(_JSON.findall(text)):
        c = x[0]
        if c in " \t\n\r":
            continue
        if c in "{}[],:" or x in ("true", "false", "null"):
            kinds.append(x)
        elif c == '"' and len(x) > 1:
            kinds.append("STR")
        else:
            kinds.append("NUM" if _JSON_NUM.fullmatch(x) else "ERR")
        marks.append(i)
    return kinds, marks


# ---------------------------------------------------------------------------- TOML
_ESC = r'\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})'
_TOML_COMMON = (
    r'"""(?:[^"\\]|' + _ESC + r'|\\[ \t]*\r?\n|"(?!""))*"{3,5}|\'\'\'(?:[^\']|\'(?!\'\'))*\'{3,5}'
    r'|"(?:[^"\\\n\x00-\x08\x0b-\x1f]|' + _ESC + r")*\"|'[^'\n]*'|\#[^\n]*|\r?\n|[ \t]+"
)
_TOML_KEY = re.compile(_TOML_COMMON + r"|\[\[|\]\]|[A-Za-z0-9_-]+|.", re.S)
_TOML_VALUE = re.compile(_TOML_COMMON + r"|\d{4}-\d\d-\d\d \d[\d:.]*(?:Z|[-+]\d\d:\d\d)?|[-+\w.:]+|.", re.S)
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?"
_TOML_ATOM = re.compile(
    r"true|false|[-+]?(?:inf|nan)|0x[0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0o[0-7]+(?:_[0-7]+)*|0b[01]+(?:_[01]+)*"
    r"|[-+]?(?:0|[1-9]\d*(?:_\d+)*)(?:\.\d+(?:_\d+)*)?(?:[eE][-+]?\d+(?:_\d+)*)?"
    r"|\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[Tt ]" + _TIME + r"(?:[Zz]|[-+]\d\d:\d\d)?)?|" + _TIME
)


def toml_kinds(text: str) -> tuple[list[str], list[int]]:
    """Kinds and offsets; what a word is depends on whether a key or a value is due."""
    kinds, marks, pos, stack, value, header = [], [], 0, [], False, False
    n = len(text)
    while pos < n:
        x = (_TOML_VALUE if value else _TOML_KEY).match(text, pos)[0]
        at, c = pos, x[0]
        pos += len(x)
        if c in " \t" or c == "#":
            continue
        kind = None
        if x in ("\n", "\r\n"):
            kind = "NL"
            if not stack:
                value = header = False
        elif c in "\"'" and len(x) > 1:
            kind = "STR"
        elif not value and x in ("[", "[["):
            kind, header = x, True
        elif not value and x == "]" and header or x == "]]" and not value:
            kind = x
        elif x == "=":
            kind, value = "=", True
        elif value and c in "[{":
            kind = c
            stack.append(c)
            value = c == "["
        elif c in "]}" and stack:
            kind = c
            stack.pop()
            value = True
        elif c == ",":
            kind = ","
            value = not stack or stack[-1] == "["
        elif x == "." and not value:
            kind = "."
        elif value:
            kind = "ATOM" if _TOML_ATOM.fullmatch(x) else "ERR"
        else:
            kind = "BARE" if re.fullmatch(r"[A-Za-z0-9_-]+", x) else "ERR"
        kinds.append(kind)
        marks.append(at)
    return kinds, marks


# ---------------------------------------------------------------------------- Python
PY_LEX = re.compile(
    r"""(?:[rRbBuUfF]|[bB][rR]|[rR][bBfF]|[fF][rR])?(?:"{3}[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*"{3}|'{3}[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'{3}|"{3}|'{3}"""
    r"""|"[^"\\\r\n]*(?:\\(?:\r\n|.)[^"\\\r\n]*)*"|'[^'\\\r\n]*(?:\\(?:\r\n|.)[^'\\\r\n]*)*')"""
    r"|\#[^\r\n]*|(?:\r\n|\n|\r)[ \t\f]*|[ \t\f]+|\\(?:\r\n|\n|\r)|[^\W\d]\w*"
    r"|0[xX][0-9a-fA-F_]*\w*|(?:\d|\.\d)[\w.]*(?:(?<=[eE])[-+]\d\w*)?"
    r"|\*\*=|//=|>>=|<<=|\.\.\.|[-+*/%@&|^=<>!:]=|->|\*\*|//|<<|>>|.",
    re.S,
)
_PY_NUM = re.compile(
    r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)[eE][-+]?\d(?:_?\d)*[jJ]?"
    r"|\d(?:_?\d)*\.(?:\d(?:_?\d)*)?[jJ]?|\.\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|0(?:_?0)*|[1-9](?:_?\d)*)"
)
_PY_OPS = "( ) [ ] { } , : ; . ... -> := + - * / // % @ ** | & ^ ~ << >> < > <= >= == != = += -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()
_PY_KIND = {x: x for x in _PY_OPS} | {x: x for x in PY_KEYWORDS | PY_SOFT}
_PY_BADESC = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?![0-9a-fA-F]{8})|N(?!\{[^}]+\}))")
_PY_BADHEX = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![0-9a-fA-F]{2})")
_py_words = _Small()


def _py_word(x: str) -> tuple[str, ...]:
    """Kinds of a lexeme that is neither operator, keyword, space nor comment."""
    got = _py_words.get(x)
    if got is not None:
        return got
    c, last = x[0], x[-1]
    if last in "\"'":
        prefix = x[: min(p for p in (x.find('"'), x.find("'")) if p >= 0)].lower()
        body = x[len(prefix) :]
        bad = len(body) == 1 or body in ('"""', "'''") or ("b" in prefix and not x.isascii())
        if "\\" in x and "r" not in prefix:
            bad = bad or (_PY_BADHEX if "b" in prefix else _PY_BADESC).search(x) is not None
        got = ("ERR",) if bad or ("f" in prefix and not _fstring_ok(body, "r" in prefix)) else ("STR",)
    elif c.isdigit() or (c == "." and len(x) > 1):
        m = _PY_NUM.match(x)
        rest = x[m.end() :] if m else "?"
        got = ("NUM",) if not rest else ("NUM", rest) if rest in ("if", "else", "and", "or", "in", "is", "not", "for") else ("ERR",)
    else:
        got = ("id",) if x.isidentifier() else ("ERR",)
    return _py_words.put(x, got) if len(x) < 300 else got


def _fstring_ok(body: str, raw: bool, depth: int = 0) -> bool:
    """Whether the replacement fields of a formatted string parse."""
    q = 3 if body[:3] in ('"""', "'''") and len(body) >= 6 else 1
    return _fields_ok(body[q:-q], raw, False, depth)


def _fields_ok(text: str, raw: bool, spec: bool, depth: int) -> bool:
    pos, n = 0, len(text)
    if depth > 4:
        return True
    while pos < n:
        c = text[pos]
        if c == "{":
            if text.startswith("{{", pos) and not spec:
                pos += 2
                continue
            level, at = 0, pos + 1
            end = colon = -1
            while at < n:
                m = PY_LEX.match(text, at)
                x = m[0]
                if x in ("(", "[", "{"):
                    level += 1
                elif x in (")", "]", "}"):
                    if level == 0:
                        end = at
                        break
                    level -= 1
                elif level == 0 and (x in (":", ":=") or (x == "!" and text[at + 1 : at + 2] in tuple("rsa"))):
                    end = colon = at
                    break
                elif level == 0 and x == "!=" and text[at - 1 : at] == "":
                    break
                at = m.end()
            if end < 0:
                return False
            kinds = python_kinds("(" + text[pos + 1 : end].rstrip().removesuffix("=") + ")")[0][1:-2]
            if not kinds or grammar("python").run("field", kinds) >= 0:
                return False
            pos = end
            if text[pos] == "!":
                pos += 2
                if text[pos : pos + 1] not in (":", "}"):
                    return False
            if text[pos : pos + 1] == ":":
                level, at = 0, pos + 1
                while at < n and not (text[at] == "}" and level == 0):
                    level += {"{": 1, "}": -1}.get(text[at], 0)
                    at += 1
                if at >= n or not _fields_ok(text[pos + 1 : at], raw, True, depth + 1):
                    return False
                pos = at
            pos += 1
        elif c == "}":
            if not text.startswith("}}", pos):
                return False
            pos += 2
        elif c == "\\" and not raw:
            if text.startswith("\\N{", pos):
                pos = text.find("}", pos) + 1 or n
            else:
                pos += 2
        else:
            pos += 1
    return True


def python_kinds(text: str) -> tuple[list[str], list[int]]:
    """Kinds with NEWLINE, INDENT and DEDENT, and for each the index of its lexeme in the
    lexemes of "\\n" + text."""
    kinds: list[str] = []
    marks: list[int] = []
    add, mark = kinds.append, marks.append
    depth, begun, lead = 0, False, "\n"
    indents = [(0, 0)]
    kind_of, i = _PY_KIND.get, -1
    for i, x in enumerate(PY_LEX.findall("\n" + text)):
        k = kind_of(x)
        if k is None:
            c = x[0]
            if c in " \t\f#":
                continue
            if c in "\n\r":
                if depth == 0:
                    if begun:
                        add("NEWLINE")
                        mark(i)
                        begun = False
                    lead = x
                continue
            if c == "\\" and len(x) > 1:
                if not begun and depth == 0:
                    lead = lead + " "
                continue
        if not begun:
            if depth == 0:
                begun = True
                width = alt = 0
                for ch in lead:
                    if ch == " ":
                        width += 1
                        alt += 1
                    elif ch == "\t":
                        width = (width // 8 + 1) * 8
                        alt += 1
                    else:
                        width = alt = 0
                top = indents[-1]
                if (width, alt) != top:
                    if width > top[0] and alt > top[1]:
                        indents.append((width, alt))
                        add("INDENT")
                        mark(i)
                    else:
                        while len(indents) > 1 and indents[-1][0] > width:
                            indents.pop()
                            add("DEDENT")
                            mark(i)
                        if indents[-1] != (width, alt):
                            add("ERR")
                            mark(i)
        if k is None:
            for k in _py_word(x):
                add(k)
                mark(i)
            continue
        if k in "([{":
            depth += 1
        elif k in ")]}" and depth:
            depth -= 1
        add(k)
        mark(i)
    i += 1
    if begun and depth == 0:
        add("NEWLINE")
        mark(i)
    if depth == 0:
        for _ in indents[1:]:
            add("DEDENT")
            mark(i)
    return kinds, marks


# ---------------------------------------------------------------------------- JavaScript and TypeScript
_JS_STR = r'"[^"\\\r\n]*(?:\\(?:\r\n|.)[^"\\\r\n]*)*"|\'[^\'\\\r\n]*(?:\\(?:\r\n|.)[^\'\\\r\n]*)*\''
_JS_TMPL = r"`[^`\\$]*(?:(?:\\.|\$(?!\{)|\$\{[^{}`]*\})[^`\\$]*)*`"
_JS_REGEX = r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
_JS_PUNCT = r"\.\.\.|=>|===|!==|==|!=|\*\*=|\*\*|<<=|>>>=|>>=|<=|>=|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@]"
_JS_NUM = r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?\d[\d_]*)?n?"
#: (white space)(token); a slash directly after an operator or a word that wants an operand begins a regular expression
JS_LEX = re.compile(
    r"(\s*)(//[^\r\n]*|/\*[^*]*(?:\*(?!/)[^*]*)*\*/|(?:[(,=:\[!&|?{};+\-*%<>~^]+|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|yield|await))\s*"
    + _JS_REGEX
    + r"|(?:[^\W\d]|\$)[\w$]*|"
    + _JS_STR
    + "|"
    + _JS_TMPL
    + r"|(?:"
    + _JS_NUM
    + r")(?:[\w$]+)?|#(?:[^\W\d]|\$)[\w$]*|"
    + _JS_PUNCT
    + r"|.|\Z)",
    re.S,
)
_JS_NUM_ONLY = re.compile(_JS_NUM)
_JS_PUNCT_RE = re.compile(_JS_PUNCT)
_JS_REGEX_RE = re.compile(_JS_REGEX)
_JS_WORD_RE = re.compile(r"(?:[^\W\d]|\$)[\w$]*")
_JS_STR_RE = re.compile(_JS_STR, re.S)
_JS_SPACE_RE = re.compile(r"(?:\s+|//[^\r\n]*|/\*[^*]*(?:\*(?!/)[^*]*)*\*/)+", re.S)
JS_KIND = {x: x for x in JS_RESERVED | JS_CONTEXTUAL} | {
    x: x
    for x in "... => === !== == != **= ** <<= >>>= >>= <= >= &&= ||= ??= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @".split()
}
_RESTRICTED = frozenset(["return", "break", "continue"])
_tmpl_ok = _Small()


class _Hard(Exception):
    """The text needs the scanner that asks the parser."""


def _js_word(tok: str, g, lang_name: str):
    """Kind, or tuple of kinds, of a token that is neither word nor punctuation in the table."""
    c = tok[0]
    if c in "\"'":
        return "STR" if len(tok) > 1 else "ERR"
    if c == "`":
        if len(tok) == 1:
            raise _Hard
        if "${" not in tok:
            return "TMPL"
        key = (lang_name, tok)
        ok = _tmpl_ok.get(key)
        if ok is None:
            ok = _tmpl_ok.put(key, all(_js_fragment(x, g, lang_name) for x in re.findall(r"(?<!\\)\$\{([^{}`]*)\}", tok)))
        return "TMPL" if ok else "ERR"
    if c.isdigit() or (c == "." and len(tok) > 1):
        return "NUM" if _JS_NUM_ONLY.fullmatch(tok) else "ERR"
    if c == "#":
        return "PRIVATE" if len(tok) > 1 else "ERR"
    if c == "_" or c == "$" or c.isalpha():
        at = tok.find("/")
        if at < 0:
            return "id"
        return (tok[:at].rstrip(), "REGEX")
    if "/" in tok:
        at = re.search(r"\s*/", tok).start()
        return (*_JS_PUNCT_RE.findall(tok[:at]), "REGEX")
    return "ERR"


def _js_fragment(text: str, g, lang_name: str) -> bool:
    for rule in ("expr",) if lang_name == "js" else ("expr", "type"):  # a template may be a type
        try:
            if _js_fast(text, g, lang_name, rule).valid:
                return True
        except _Hard:
            if _Scanner(text, g, lang_name).whole(rule).valid:
                return True
    return False


def _js_fast(text: str, g, lang_name: str, rule: str) -> Verdict:
    lang, empty, derive = g.start(rule), g.empty, g.derive
    nl, prev, kind_of = False, "", JS_KIND.get
    toks = JS_LEX.findall(text)
    for i, (ws, tok) in enumerate(toks):
        if ws and "\n" in ws:
            nl = True
        k = kind_of(tok)
        if k is None:
            if not tok:
                continue
            if tok[0] == "/" and tok[1:2] in ("/", "*") and len(tok) > 1:
                nl = nl or "\n" in tok
                continue
            k = _js_word(tok, g, lang_name)
        for kind in k if type(k) is tuple else (k,):
            if nl:
                if prev in _RESTRICTED:
                    lang = derive(lang, "ASI")
                if kind == "++" or kind == "--":
                    kind = "NL" + kind
            step = lang.d.get(kind)
            if step is None:
                step = derive(lang, kind)
            if step is empty:
                if nl or kind == "}":
                    step = derive(lang, "ASI")
                    if step is not empty:
                        step = derive(step, kind)
                if step is empty:
                    at = sum(len(a) + len(b) for a, b in toks[:i]) + len(ws)
                    return Verdict(False, "token", at, tok[:40])
            lang, prev, nl = step, kind, False
    if lang.null or derive(lang, "ASI").null:
        return OK
    return Verdict(False, "truncated", len(text), "")


class _Scanner:
    """Reads token by token and asks the state what a slash, backquote or ``<`` begins."""

    def __init__(self, text: str, g, lang_name: str):
        self.text, self.g, self.name = text, g, lang_name
        self.jsx = lang_name in ("js", "tsx")

    def whole(self, rule: str) -> Verdict:
        pos, ok, null = self.prefix(rule, 0)
        if ok and null and pos == len(self.text):
            return OK
        if pos >= len(self.text):
            return Verdict(False, "truncated", len(self.text), "")
        return Verdict(False, "token", pos, self.text[pos : pos + 20].split("\n")[0])

    def _can(self, lang, kind: str, nl: bool) -> bool:
        g = self.g
        if g.derive(lang, kind) is not g.empty:
            return True
        return nl and g.derive(g.derive(lang, "ASI"), kind) is not g.empty

    def prefix(self, rule: str, pos: int):
        """(offset of the first token that does not fit, whether the lexemes were sound, whether a word ended there)"""
        g, text, n = self.g, self.text, len(self.text)
        lang, prev = g.start(rule), ""
        while True:
            nl = False
            m = _JS_SPACE_RE.match(text, pos)
            if m:
                nl = "\n" in m[0]
                pos = m.end()
            if pos >= n:
                return pos, True, lang.null or g.derive(lang, "ASI").null
            c, at = text[pos], pos
            if nl and prev in _RESTRICTED:
                lang = g.derive(lang, "ASI")
            if c in "\"'":
                m = _JS_STR_RE.match(text, pos)
                kind, pos = ("STR", m.end()) if m else ("ERR", pos)
            elif c == "`":
                kind, pos = "TMPL", self.template(pos)
            elif c == "/" and not self._can(lang, "/", nl) and not self._can(lang, "/=", nl):
                m = _JS_REGEX_RE.match(text, pos)
                kind, pos = ("REGEX", m.end()) if m else ("ERR", pos)
            elif c == "<" and self.jsx and self._can(lang, "JSX", nl) and not (self.name == "tsx" and re.match(r"<\s*(?:const\s+)?\w+\s*(?:,|extends\b)", text[pos : pos + 60])):
                kind, pos = "JSX", self.element(pos)
            elif c.isdigit() or (c == "." and text[pos + 1 : pos + 2].isdigit()):
                m = _JS_NUM_ONLY.match(text, pos)
                pos = m.end()
                kind = "ERR" if _JS_WORD_RE.match(text, pos) else "NUM"
            elif c == "#":
                m = _JS_WORD_RE.match(text, pos + 1)
                kind, pos = ("PRIVATE", m.end()) if m else ("ERR", pos)
            else:
                m = _JS_WORD_RE.match(text, pos)
                if m:
                    kind, pos = JS_KIND.get(m[0], "id"), m.end()
                else:
                    m = _JS_PUNCT_RE.match(text, pos)
                    kind, pos = (m[0], m.end()) if m else ("ERR", pos)
            if pos < 0:
                return at, False, False
            if nl and kind in ("++", "--"):
                kind = "NL" + kind
            step = g.derive(lang, kind)
            if step is g.empty and (nl or kind == "}"):
                step = g.derive(lang, "ASI")
                if step is not g.empty:
                    step = g.derive(step, kind)
            if step is g.empty:
                return at, True, lang.null or (rule == "program" and g.derive(lang, "ASI").null)
            lang, prev = step, kind

    def braces(self, pos: int) -> int:
        """End of ``{expr}`` whose brace is at ``pos``; -1 if there is none."""
        m = re.compile(r"\{(?:\s|/\*(?:[^*]|\*(?!/))*\*/)*\}", re.S).match(self.text, pos)
        if m:
            return m.end()
        at = pos + 1
        m = re.compile(r"\s*\.\.\.").match(self.text, at)
        if m:
            at = m.end()
        for rule in ("expr",) if self.name == "js" else ("expr", "type"):
            end, ok, null = self.prefix(rule, at)
            if ok and null and self.text[end : end + 1] == "}":
                return end + 1
        return -1

    def template(self, pos: int) -> int:
        text, n = self.text, len(self.text)
        pos += 1
        while pos < n:
            c = text[pos]
            if c == "`":
                return pos + 1
            if c == "\\":
                pos += 2
            elif c == "$" and text[pos + 1 : pos + 2] == "{":
                pos = self.braces(pos + 1)
                if pos < 0:
                    return -1
            else:
                pos += 1
        return -1

    def element(self, pos: int) -> int:
        """End of the element that begins at ``pos``; -1 if it is not sound."""
        text = self.text
        m = re.compile(r"<\s*([\w$.:-]*)").match(text, pos)
        name, pos = m[1], m.end()
        attr = re.compile(r"\s*(?:([\w$:-]+)\s*(=\s*(\"[^\"]*\"|'[^']*'|(?=[{<])))?|(?=\{))", re.S)
        while True:
            m = re.compile(r"(?:\s|/\*(?:[^*]|\*(?!/))*\*/)*(/?\s*>)").match(text, pos)
            if m:
                pos = m.end()
                if m[1][0] == "/":
                    return pos if name else -1
                break
            m = attr.match(text, pos)
            if not m or (m.end() == pos and text[pos : pos + 1] != "{"):
                return -1
            pos = m.end()
            if text[pos : pos + 1] == "{" and (m[2] or not m[1]):
                pos = self.braces(pos)
            elif text[pos : pos + 1] == "<" and m[2]:
                pos = self.element(pos)
            if pos < 0:
                return -1
        close = re.compile(r"<\s*/\s*([\w$.:-]*)\s*>")
        while True:
            at = re.compile(r"[{<>}]").search(text, pos)
            if not at or at[0] in ">}":
                return -1
            pos = at.start()
            if at[0] == "{":
                pos = self.braces(pos)
            else:
                m = close.match(text, pos)
                if m:
                    return m.end() if m[1] == name else -1
                pos = self.element(pos)
            if pos < 0:
                return -1


def check_js(text: str, lang_name: str) -> Verdict:
    """Scripts and modules of ``js``, ``ts`` or ``tsx``."""
    g = grammar(lang_name)
    if text.startswith("#!"):
        text = "//" + text[2:]
    text = text.removeprefix("\ufeff")
    try:
        first = _js_fast(text, g, lang_name, "program")
        if first.valid or ("/" not in text and "<" not in text):
            return first
    except _Hard:
        first = None
    second = _Scanner(text, g, lang_name).whole("program")
    return second if second.valid or first is None else first


#: suffix of a path to the name of its grammar
GRAMMAR_OF = {"py": "python", "js": "js", "jsx": "js", "ts": "ts", "tsx": "tsx", "json": "json", "toml": "toml"}


def check(text: str, name: str) -> Verdict:
    """Whether ``text`` is a word of the language of grammar ``name``."""
    g = grammar(name)
    g.tidy()
    if name in ("js", "ts", "tsx"):
        return check_js(text, name)
    if name == "json":
        kinds, marks = json_kinds(text)
        bad = g.run("text", kinds)
        lexemes = _JSON.findall(text) if bad >= 0 else []
        shift = 0
    elif name == "toml":
        kinds, marks = toml_kinds(text)
        bad = g.run("text", kinds)
        if 0 <= bad < len(kinds):
            return Verdict(False, "token", marks[bad], text[marks[bad] :].split("\n")[0][:40])
        return OK if bad < 0 else Verdict(False, "truncated", len(text), "")
    else:
        text = text.removeprefix("\ufeff")
        if "\0" in text:
            return Verdict(False, "token", text.index("\0"), "\0")
        kinds, marks = python_kinds(text)
        bad = g.run("file", kinds)
        lexemes = PY_LEX.findall("\n" + text) if bad >= 0 else []
        shift = 1
    if bad < 0:
        return OK
    if bad >= len(kinds) or marks[bad] >= len(lexemes):
        return Verdict(False, "truncated", len(text), "")
    at = sum(map(len, lexemes[: marks[bad]])) - shift
    return Verdict(False, "token", max(at, 0), lexemes[marks[bad]][:40])
