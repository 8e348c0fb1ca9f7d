"""Symbol tables: functions, methods and classes of a Python, JavaScript or TypeScript text.

Python texts are read with the interpreter's parser.  JavaScript and TypeScript texts are
first checked by the derivatives of their grammar; in the token stream of a text that
parses, brackets match, so declarations are found by one walk over the tokens.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from typing import NamedTuple

from .lexers import JS_KIND, JS_LEX, _Scanner, check
from .grammars import grammar
from .parsecheck import python_tree


class Symbol(NamedTuple):
    kind: str  # function, method, class, signature (a declaration without body)
    name: str
    qualified: str
    name_line: int
    start: int  # offsets of the whole declaration, decorators included
    end: int
    doc: str  # its own documentation as written, '' if none
    top: bool  # a statement of the file itself
    arity: str  # '/'-joined parameter names without types and defaults
    typed: str = ""  # the normalised signature: the same with normalised types, `name:type`
    declares: bool = False  # it stands for definitions elsewhere: a signature, or an abstract method
    bases: tuple[tuple[str, str], ...] = ()  # of a method: (module as written or '', name) of the bases of its class


_EOL = re.compile(r"\r\n|\n|\r")
_UNION = re.compile(r"(Optional|Union)\[")


def normal_type(written: str) -> str:
    """A type in one spelling: no blanks, quotes or typing prefixes, unions sorted."""
    t = re.sub(r"[\s\"']+", "", written)
    t = re.sub(r"\b(?:typing|typing_extensions|t|collections\.abc|builtins)\.", "", t)
    m = _UNION.match(t)
    if m and t.endswith("]") and _level(t[m.end() : -1]):
        parts = _split(t[m.end() : -1], ",")
        return "|".join(sorted({normal_type(x) for x in parts} | ({"None"} if m[1] == "Optional" else set())))
    parts = [x for x in _split(t, "|") if x]
    return "|".join(sorted({normal_type(x) for x in parts})) if len(parts) > 1 else (parts[0] if parts else "")


def _level(t: str) -> bool:
    """Whether the brackets of ``t`` match within it."""
    depth = 0
    for c in t:
        depth += (c in "([{<") - (c in ")]}>")
        if depth < 0:
            return False
    return depth == 0


def _split(t: str, sep: str) -> list[str]:
    """``t`` cut at ``sep`` outside brackets; arrows are no brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(t):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and t[k - 1 : k] != "="):
            depth -= 1
        elif c == sep and depth <= 0:
            out.append(t[at:k])
            at = k + 1
    return [*out, t[at:]]


# ---------------------------------------------------------------------------- Python
def python_symbols(text: str, stub: bool = False) -> list[Symbol] | None:
    """Symbols of a Python text in order of appearance; None if it does not parse.

    In a stub every function is a signature.
    """
    tree = python_tree(text)
    if tree is None:
        return None
    starts = [0, *(m.end() for m in _EOL.finditer(text))]
    newlines = None if "\r" not in text else [m.start() for m in re.finditer("\n", text)]
    out: list[Symbol] = []

    def offset(line: int, col: int) -> int:
        at = starts[line - 1]
        stop = starts[line] if line < len(starts) else len(text)
        row = text[at:stop]
        return at + (col if row.isascii() else len(row.encode()[:col].decode("utf-8", "ignore")))

    def line_no(line: int) -> int:
        return line if newlines is None else bisect_right(newlines, starts[line - 1] - 1) + 1

    def of_type(x) -> str:
        return normal_type(text[offset(x.lineno, x.col_offset) : offset(x.end_lineno, x.end_col_offset)])

    # names bound by imports: (module as written, name in it or None)
    bound: dict[str, tuple[str, str | None]] = {}
    todo = list(tree.body) if "class" in text or "overload" in text else []
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.If, ast.Try)):
            todo += [x for x in ast.iter_child_nodes(node) if isinstance(x, ast.stmt)]
            todo += [x for h in getattr(node, "handlers", ()) for x in h.body]
        elif isinstance(node, ast.ImportFrom):
            where = "." * node.level + (node.module or "")
            bound.update({x.asname or x.name: (where, x.name) for x in node.names})
        elif isinstance(node, ast.Import):
            bound.update({x.asname or x.name: (x.name, None) for x in node.names})

    def based(node) -> tuple[str, str] | None:
        """(module, name) of a base class."""
        if isinstance(node, ast.Subscript):
            node = node.value
        if isinstance(node, ast.Name):
            where, name = bound.get(node.id, ("", node.id))
            return (where, name) if name else None
        if isinstance(node, ast.Attribute):
            name, parts = node.attr, []
            node = node.value
            while isinstance(node, ast.Attribute):
                parts.append(node.attr)
                node = node.value
            if isinstance(node, ast.Name):
                written = ".".join((node.id, *reversed(parts)))
                if written in bound and bound[written][1] is None:
                    return bound[written][0], name
                where, inner = bound.get(node.id, ("", None))
                if inner is not None:
                    return f"{where}{'' if where.endswith('.') else '.'}{inner}", name
                if node.id in bound:
                    return ".".join((where, *reversed(parts))), name
        return None

    def decorated(node, name: str) -> bool:
        for d in node.decorator_list:
            last = d.attr if isinstance(d, ast.Attribute) else d.id if isinstance(d, ast.Name) else ""
            if last == name or isinstance(d, ast.Name) and bound.get(last, ("", None))[1] == name:
                return True
        return False

    def bodiless(body: list) -> bool:
        """Nothing but documentation, ``...`` or a NotImplementedError."""
        for x in body:
            e = x.exc if isinstance(x, ast.Raise) else None
            e = e.func if isinstance(e, ast.Call) else e
            if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) or isinstance(e, ast.Name) and e.id == "NotImplementedError"):
                return False
        return True

    stack = [(node, (), None, True) for node in reversed(tree.body)]
    while stack:
        node, names, in_class, top = stack.pop()  # in_class: the bases of the class whose body this is, or None
        inner, cls, inner_top = names, in_class, False
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            arity = typed = ""
            overload = abstract = False
            if not is_class:
                a = node.args
                args = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
                arity = "/".join(x.arg for x in args)
                typed = "/".join(f"{x.arg}:{of_type(x.annotation)}" if x.annotation else x.arg for x in args)
                overload = stub or decorated(node, "overload")
                abstract = in_class is not None and (decorated(node, "abstractmethod") or bodiless(node.body))
            out.append(
                Symbol(
                    "class" if is_class else "signature" if overload else "method" if in_class is not None else "function",
                    node.name,
                    ".".join((*names, node.name)),
                    line_no(node.lineno),
                    starts[first - 1],
                    offset(node.end_lineno, node.end_col_offset),
                    ast.get_docstring(node, clean=True) or "",
                    top,
                    arity,
                    typed,
                    overload or abstract,
                    () if is_class or in_class is None else in_class,
                )
            )
            inner, cls = (*names, node.name), tuple(filter(None, map(based, node.bases))) if is_class else None
        elif isinstance(node, ast.expr):
            continue
        stack.extend((child, inner, cls, False) for child in reversed(list(ast.iter_child_nodes(node))) if isinstance(child, (ast.stmt, ast.excepthandler, ast.match_case)))
    return out


# ---------------------------------------------------------------------------- JavaScript and TypeScript
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_MODIFIERS = frozenset("public private protected readonly override abstract declare static async get set accessor".split())
_OBJECT_AFTER = frozenset("= ( , : [ ? return && || ?? ! => ... default typeof new in of case += yield await".split()) - {"=>"}
_WORD = re.compile(r"(?:[^\W\d]|\$)[\w$]*\Z")


def _lexemes(text: str, lang_name: str):
    """(white space, token) of a text; a template with templates inside is one token."""
    lexemes = JS_LEX.findall(text)
    if not any(tok == "`" for _, tok in lexemes):
        return lexemes
    out, at, scanner = [], 0, _Scanner(text, grammar(lang_name), lang_name)
    while at < len(text):
        ws, tok = JS_LEX.match(text, at).groups()
        at += len(ws)
        if tok == "`":
            end = scanner.template(at)
            tok = text[at:end] if end > 0 else tok
        at += len(tok)
        out.append((ws, tok))
    return out


def _tokens(text: str, lang_name: str) -> tuple[list[str], list[int], dict[int, str]]:
    """Tokens, their offsets, and the last comment directly before a token."""
    toks, offs, notes = [], [], {}
    at, note = 0, None
    for ws, tok in _lexemes(text, lang_name):
        at += len(ws)
        if not tok:
            break
        if tok[0] == "/" and tok[1:2] in ("/", "*") and len(tok) > 1:
            note = tok
        else:
            if note is not None:
                notes[len(toks)] = note
                note = None
            if "/" in tok and len(tok) > 2 and tok[0] not in "\"'`/" and tok not in JS_KIND:
                cut = tok.index("/")  # operators or a word, then a regular expression
                head = tok[:cut].rstrip()
                k = at
                for x in re.findall(r"[\w$]+|=>|[^\w$\s]", head):
                    toks.append(x)
                    offs.append(text.find(x, k))
                    k = offs[-1] + len(x)
                toks.append("/re/")
                offs.append(at + cut)
            else:
                toks.append(tok)
                offs.append(at)
        at += len(tok)
    return toks, offs, notes


def js_symbols(text: str, lang_name: str) -> list[Symbol] | None:
    """Symbols of a JavaScript or TypeScript text in order; None if it does not parse."""
    if not check(text, lang_name).valid:
        return None
    toks, offs, notes = _tokens(text, lang_name)
    n = len(toks)
    pair = [-1] * n
    stack: list[int] = []
    for i, t in enumerate(toks):
        if t in _OPEN:
            stack.append(i)
        elif t in _CLOSE:
            if stack and _OPEN[toks[stack[-1]]] == t:
                j = stack.pop()
                pair[i], pair[j] = j, i
    newlines = [m.start() for m in re.finditer("\n", text)]
    out: list[tuple[int, Symbol]] = []
    bodies: dict[int, tuple[str, tuple[str, ...]]] = {}

    def is_word(i: int) -> bool:
        return i < n and _WORD.match(toks[i]) is not None

    def generic(i: int) -> int:
        """Index after the type parameters that begin at ``i``, else ``i``."""
        if i >= n or toks[i] != "<":
            return i
        level = 0
        while i < n:
            t = toks[i]
            if t == "<":
                level += 1
            elif t == ">":
                level -= 1
                if level == 0:
                    return i + 1
            elif t in _OPEN and pair[i] > 0:
                i = pair[i]
            i += 1
        return n

    def after_type(i: int, stops: tuple[str, ...]) -> int:
        """Index of the first of ``stops`` at this level after a return or variable type."""
        first = True
        while i < n and not (toks[i] in stops and not (toks[i] == "{" and first)):
            if toks[i] in _CLOSE:
                return i
            first = toks[i] in ("|", "&", ":", "=>", "is") or (first and toks[i] in ("keyof", "readonly"))
            if toks[i] == "<":
                i = generic(i)
            elif toks[i] in _OPEN and pair[i] > 0:
                i = pair[i] + 1
            else:
                i += 1
        return i

    def params(i: int) -> tuple[str, str]:
        """Parameter names between the brackets at ``i``, without and with their types."""
        names, types, j, stop, due = [], [], i + 1, pair[i], True
        while j < stop:
            t = toks[j]
            if t == ":" and names and not due and not types[-1]:
                end = j + 1
                while end < stop and toks[end] not in (",", "="):
                    end = generic(end) if toks[end] == "<" else pair[end] + 1 if toks[end] in _OPEN and pair[end] > 0 else end + 1
                types[-1] = normal_type("".join(toks[j + 1 : end]))
                j = end
                continue
            if t in _OPEN and pair[j] > 0:
                if due and t != "(":
                    names.append("_")
                    types.append("")
                    due = False
                j = pair[j]
            elif t == "<":
                j = generic(j) - 1
            elif t == ",":
                due = True
            elif due and is_word(j) and (t not in _MODIFIERS or toks[j + 1] in (",", ":", ")", "=", "?")):
                names.append(t)
                types.append("")
                due = False
            j += 1
        return "/".join(names), "/".join(f"{a}:{b}" if b else a for a, b in zip(names, types))

    def doc_before(i: int) -> str:
        note = notes.get(i, "")
        return note if note.startswith("/**") and len(note) > 4 else ""

    def lead(i: int, words: frozenset | set) -> int:
        """First token of the declaration: modifiers and decorators before ``i`` included."""
        while i > 0:
            p = i - 1
            if toks[p] in words:
                i = p
            elif toks[p] == ")" and pair[p] > 0:
                q = pair[p] - 1
                while q > 1 and toks[q - 1] == "." and is_word(q):
                    q -= 2
                if q > 0 and is_word(q) and toks[q - 1] == "@":
                    i = q - 1
                else:
                    return i
            elif is_word(p):
                q = p
                while q > 1 and toks[q - 1] == ".":
                    q -= 2
                if q > 0 and toks[q - 1] == "@":
                    i = q - 1
                else:
                    return i
            else:
                return i
        return i

    def doc_of(i: int, first: int) -> str:
        for k in range(i, first - 1, -1):  # directly above the name's own words, or above its decorators
            if k in notes:
                return doc_before(k)
        return ""

    def emit(kind, i_name, name, names, first, last, doc_at, top, arity):
        end = offs[last] + len(toks[last]) if last < n else len(text)
        line = bisect_right(newlines, offs[i_name] - 1) + 1
        plain, typed = arity or ("", "")
        of = heirs.get(names, ()) if names else ()
        out.append((first, Symbol(kind, name, ".".join((*names, name)), line, offs[first], end, doc_of(doc_at, first), top, plain, typed, kind == "signature", of)))

    def function_tail(i: int):
        """(arity, body index or -1, last token) of a parameter list at ``i``; None if there is none."""
        i = generic(i)
        if i >= n or toks[i] != "(" or pair[i] < 0:
            return None
        arity, j = params(i), pair[i] + 1
        if j < n and toks[j] == ":":
            j = after_type(j + 1, ("{", ";", "=>", ","))
        return arity, j

    def arrow_end(j: int) -> int:
        """Last token of an arrow body that is an expression beginning at ``j``."""
        while j < n and toks[j] not in (";", ",") and toks[j] not in _CLOSE:
            if toks[j] in _OPEN and pair[j] > 0:
                j = pair[j]
            j += 1
            if j < n and "\n" in text[offs[j - 1] : offs[j]] and (is_word(j) or toks[j] == "@") and toks[j - 1] not in JS_KIND_OPERATORS:
                break
        return j - 1

    def value_function(j: int):
        """(arity, body index or -1, last token, own name index or -1) if a function begins at ``j``."""
        own = -1
        if j < n and toks[j] == "async" and j + 1 < n and (toks[j + 1] in ("(", "<", "function") or is_word(j + 1)):
            j += 1
        if j < n and toks[j] == "function":
            j += 1
            if j < n and toks[j] == "*":
                j += 1
            if is_word(j):
                own = j
                j += 1
            tail = function_tail(j)
            if tail and tail[1] < n and toks[tail[1]] == "{":
                return tail[0], tail[1], pair[tail[1]], own
            return None
        if is_word(j) and j + 1 < n and toks[j + 1] == "=>":
            arity, k = (toks[j], toks[j]), j + 1
        else:
            tail = function_tail(j)
            if not tail:
                return None
            arity, k = tail
        if k >= n or toks[k] != "=>":
            return None
        if k + 1 < n and toks[k + 1] == "{" and pair[k + 1] > 0:
            return arity, k + 1, pair[k + 1], own
        return arity, -1, arrow_end(k + 1), own

    bound: dict[str, tuple[str, str]] | None = None

    def heritage(a: int, b: int) -> tuple[tuple[str, str], ...]:
        """(module as written or '', name) of the classes and interfaces named between a class's name and its body."""
        nonlocal bound
        found, j, on = [], a, False
        while j < b:
            if toks[j] in ("extends", "implements"):
                on = True
            elif toks[j] == ",":
                on = True
            elif toks[j] == "<":
                j = generic(j) - 1
            elif toks[j] in _OPEN and pair[j] > 0:
                j = pair[j]
            elif on and is_word(j):
                parts = [toks[j]]
                while j + 2 < b and toks[j + 1] == "." and is_word(j + 2):
                    parts.append(toks[j + 2])
                    j += 2
                found.append(parts)
                on = False
            j += 1
        if found and bound is None:
            bound = js_imports(text)
        out = []
        for first, *more in found:
            where, name = bound.get(first, ("", first))
            if more:
                name = ".".join(more) if name == "*" else ".".join((name, *more))
            out.append((where, name))
        return tuple(out)

    heirs: dict[tuple[str, ...], tuple[tuple[str, str], ...]] = {}
    contexts: list[tuple[int, str, tuple[str, ...]]] = [(n, "block", ())]
    i = 0
    while i < n:
        while len(contexts) > 1 and i > contexts[-1][0]:
            contexts.pop()
        stop, ctx, names = contexts[-1]
        top = len(contexts) == 1
        t = toks[i]
        prev = toks[i - 1] if i else ""
        if t == "{" and pair[i] > 0:
            if i in bodies:
                kind, inner = bodies[i]
            else:
                kind, inner = ("object" if prev in _OBJECT_AFTER else "block"), names
            contexts.append((pair[i], kind, inner))
            i += 1
            continue
        member = ctx in ("class", "object", "interface") and (
            prev in ("{", ";", "}", ",") or prev in _MODIFIERS or prev == "*" or (ctx != "object" and i and "\n" in text[offs[i - 1] + len(prev) : offs[i]])
        )
        if member and prev == "}" and ctx == "object":
            member = False
        if member:
            words = {*_MODIFIERS, "*"}
            j = i
            if t == "[" and pair[i] > 0:
                i = pair[i] + 1
                continue
            if is_word(j) and not (toks[j] in words and j + 1 < n and (is_word(j + 1) or toks[j + 1] in ("[", "*", "#") or toks[j + 1][:1] in "\"'#")):
                k = j + 1
                if k < n and toks[k] in ("?", "!"):
                    k += 1
                tail = function_tail(k) if k < n and toks[k] in ("(", "<") else None
                first = lead(j, words)
                if tail and tail[1] <= n:
                    arity, b = tail
                    if b < n and toks[b] == "{" and pair[b] > 0:
                        emit("method", j, t, names, first, pair[b], j, False, arity)
                        bodies[b] = ("block", (*names, t))
                        i = k
                        continue
                    if ctx != "object":
                        emit("signature", j, t, names, first, b if b < n and toks[b] == ";" else b - 1, j, False, arity)
                        i = b
                        continue
                elif k < n and toks[k] in (":", "=") and ctx != "interface":
                    v = k
                    if ctx == "class" and toks[k] == ":":
                        v = after_type(k + 1, ("=", ";"))
                    if v < n and (toks[v] == "=" or ctx == "object"):
                        f = value_function(v + 1)
                        if f:
                            arity, b, last, _ = f
                            emit("method", j, t, names, first, last, j, False, arity)
                            if b >= 0:
                                bodies[b] = ("block", (*names, t))
                            i = v + 1
                            if i < n and toks[i] == "async":
                                i += 1
                            if i < n and toks[i] == "function":
                                i += 1
                            continue
        if t == "class" and prev not in (".", "?.") and not (i + 1 < n and toks[i + 1] in (":", "(", ",", "=")):
            named = is_word(i + 1) and toks[i + 1] not in ("extends", "implements")
            b = after_class = i + (2 if named else 1)
            while b < n and toks[b] != "{":
                b = generic(b) if toks[b] == "<" else pair[b] + 1 if toks[b] in _OPEN and pair[b] > 0 else b + 1
            if b < n and pair[b] > 0:
                if named:
                    first = lead(i, {"export", "default", "abstract", "declare"})
                    statement = first == 0 or toks[first - 1] in (";", "}", "{") or "\n" in text[offs[first - 1] : offs[first]]
                    emit("class", i + 1, toks[i + 1], names, first, pair[b], i, top and statement and prev not in _OBJECT_AFTER - {"default"}, None)
                    bodies[b] = ("class", (*names, toks[i + 1]))
                    heirs[(*names, toks[i + 1])] = heritage(i + 2, b)
                else:
                    bodies[b] = ("class", names)
            i = after_class
            continue
        if t == "interface" and is_word(i + 1) and prev != ".":
            b = i + 2
            while b < n and toks[b] != "{" and toks[b] != ";":
                b = generic(b) if toks[b] == "<" else b + 1
            if b < n and toks[b] == "{" and pair[b] > 0:
                bodies[b] = ("interface", (*names, toks[i + 1]))
                i = b
                continue
        if t == "function" and prev not in (".", "?."):
            j = i + 1
            if j < n and toks[j] == "*":
                j += 1
            if is_word(j):
                tail = function_tail(j + 1)
                if tail:
                    arity, b = tail
                    first = lead(i, {"export", "default", "async", "declare"})
                    if b < n and toks[b] == "{" and pair[b] > 0:
                        statement = toks[first - 1] not in _OBJECT_AFTER if first else True
                        emit("function", j, toks[j], names, first, pair[b], i, top and statement, arity)
                        bodies[b] = ("block", (*names, toks[j]))
                    else:
                        emit("signature", j, toks[j], names, first, b if b < n and toks[b] == ";" else b - 1, i, False, arity)
                    i = j + 1
                    continue
        if t in ("const", "let", "var") and is_word(i + 1) and prev != ".":
            j = i + 2
            if j < n and toks[j] == "!":
                j += 1
            if j < n and toks[j] == ":":
                j = after_type(j + 1, ("=", ";", ","))
            if j < n and toks[j] == "=":
                f = value_function(j + 1)
                if f:
                    arity, b, last, own = f
                    first = lead(i, {"export", "declare"})
                    if last + 1 < n and toks[last + 1] == ";":
                        last += 1
                    name = toks[i + 1]
                    emit("function", i + 1, name, names, first, last, i, top, arity)
                    if b >= 0:
                        bodies[b] = ("block", (*names, name))
                    i = j + 1
                    if toks[i] == "async":
                        i += 1
                    if i < n and toks[i] == "function":
                        i += 1
                    continue
        i += 1
    return [s for _, s in sorted(out, key=lambda x: x[0])]


JS_KIND_OPERATORS = frozenset("=> = + - * / % && || ?? ? : , . ?. ( [ { < > & | ^ ! == === != !== <= >= += -=".split())


_IMPORT = re.compile(r"\bimport\s+(?:type\s+)?([\w$\s{},*]+?)\s*from\s*[\"'](\.[^\"'\n]*)[\"']")


def js_imports(text: str) -> dict[str, tuple[str, str]]:
    """Names imported from files beside it: (module as written, name there; ``*`` for the whole)."""
    out: dict[str, tuple[str, str]] = {}
    for what, where in _IMPORT.findall(text):
        head, brace, inner = what.partition("{")
        for part in head.split(","):
            words = part.split()
            if words[:2] == ["*", "as"] and len(words) == 3:
                out[words[2]] = (where, "*")
            elif len(words) == 1:
                out[words[0]] = (where, words[0])  # a default export goes by the name it is bound to
        for part in inner.rstrip("} \n").split(",") if brace else ():
            words = part.removeprefix("type ").split()
            if words:
                out[words[-1]] = (where, words[0])
    return out


def symbols_of(text: str, suffix: str) -> list[Symbol] | None:
    """Symbols by suffix; None for other suffixes and texts that do not parse."""
    if suffix in ("py", "pyi"):
        return python_symbols(text, suffix == "pyi")
    if suffix in ("js", "jsx", "ts", "tsx"):
        return js_symbols(text, {"jsx": "js"}.get(suffix, suffix))
    return None
