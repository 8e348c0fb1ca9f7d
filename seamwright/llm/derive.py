"""Parsing with derivatives over token kinds, with every derivative memoised.

A language is a set of *cells*; a cell ``(e, rest)`` stands for "a word of grammar
expression ``e`` followed by a word of the language ``rest``".  The derivative of a
language by a token kind is again such a set.  Languages are interned, so that equal
continuations are one object, and each object keeps the table of the derivatives taken
from it: after a short warm-up, parsing is one dictionary lookup per token.

* An empty derivative marks the exact failing token.
* A last derivative that is not nullable means that the text stops too early.

Grammars are written in a small EBNF: ``'x'`` a token kind, ``UPPER`` a class of kinds,
``lower`` a rule, ``|  ( )  * + ?`` as usual.  Left recursion is not allowed.
"""

from __future__ import annotations

import re

_EBNF = re.compile(r"\s*(?:'([^']+)'|([A-Z][A-Z0-9_]*)|([a-z][a-z0-9_]*)|([()|*+?]))")


class Language:
    """An interned language: its cells, whether it holds the empty word, its derivatives."""

    __slots__ = ("uid", "cells", "eps", "null", "d")

    def __init__(self, uid, cells, eps, null):
        self.uid, self.cells, self.eps, self.null, self.d = uid, cells, eps, null, {}


class Grammar:
    """Compiled grammar plus the memo tables of its derivatives.

    ``max_languages`` bounds the memory of the memo: beyond it the tables are emptied and
    filled again on demand, which changes no result.
    """

    def __init__(self, text: str, classes: dict[str, frozenset], max_languages: int = 150_000):
        self.classes = classes
        self.max_languages = max_languages
        self.nodes: list[tuple] = []
        self._ids: dict[tuple, int] = {}
        self.rules: dict[str, int] = {}
        bodies = {}
        for line in re.split(r"\n(?=\w+:)", text.strip()):
            name, body = line.split(":", 1)
            bodies[name.strip()] = body
        self._bodies: dict[str, int] = {}
        for name, body in bodies.items():
            self._pos, self._toks = 0, [m.groups() for m in _EBNF.finditer(body)]
            self._bodies[name] = self._alt()
            if self._pos != len(self._toks):
                raise ValueError(f"rule {name}: stray {self._toks[self._pos]}")
        for node in self.nodes:
            if node[0] == "n" and node[1] not in self._bodies:
                raise ValueError(f"unknown rule {node[1]}")
        self._nullable()
        self._residuals: dict[tuple[int, str], tuple] = {}
        self.reset()

    # -- EBNF ------------------------------------------------------------------
    def _node(self, *node) -> int:
        if node not in self._ids:
            self._ids[node] = len(self.nodes)
            self.nodes.append(node)
        return self._ids[node]

    def _alt(self) -> int:
        options = [self._seq()]
        while self._pos < len(self._toks) and self._toks[self._pos][3] == "|":
            self._pos += 1
            options.append(self._seq())
        return options[0] if len(options) == 1 else self._node("a", *options)

    def _seq(self) -> int:
        items = []
        while self._pos < len(self._toks) and self._toks[self._pos][3] not in ("|", ")"):
            lit, cls, rule, op = self._toks[self._pos]
            self._pos += 1
            if lit:
                item = self._node("t", frozenset([lit]))
            elif cls:
                item = self._node("t", self.classes[cls])
            elif rule:
                item = self._node("n", rule)
            else:
                item = self._alt()
                self._pos += 1
            while self._pos < len(self._toks) and self._toks[self._pos][3] in ("*", "+", "?"):
                op = self._toks[self._pos][3]
                self._pos += 1
                if op == "+":
                    item = self._node("s", item, self._node("*", item))
                else:
                    item = self._node(op, item)
            items.append(item)
        if not items:
            return self._node("e")
        out = items[-1]
        for item in reversed(items[:-1]):
            out = self._node("s", item, out)
        return out

    def _nullable(self) -> None:
        null = self.null = [n[0] in "*?e" for n in self.nodes]
        changed = True
        while changed:
            changed = False
            for i, n in enumerate(self.nodes):
                if not null[i] and (
                    (n[0] == "s" and null[n[1]] and null[n[2]])
                    or (n[0] == "a" and any(null[x] for x in n[1:]))
                    or (n[0] == "n" and null[self._bodies[n[1]]])
                ):
                    null[i] = changed = True

    # -- derivatives ------------------------------------------------------------
    def reset(self) -> None:
        """Empties the memo of languages."""
        self._made: dict[tuple, Language] = {}
        self.empty = self._make({}, False)
        self.end = self._make({}, True)
        self._starts: dict[str, Language] = {}

    def tidy(self) -> None:
        """To be called between two texts: bounds the memo."""
        if len(self._made) > self.max_languages:
            self.reset()

    def start(self, rule: str) -> Language:
        if rule not in self._starts:
            self._starts[rule] = self._make({self._bodies[rule]: self.end}, False)
        return self._starts[rule]

    def _make(self, cells: dict[int, Language], eps: bool) -> Language:
        key = (eps, *sorted((e, rest.uid) for e, rest in cells.items()))
        got = self._made.get(key)
        if got is None:
            null = eps or any(self.null[e] and rest.null for e, rest in cells.items())
            got = self._made[key] = Language(len(self._made), tuple(cells.items()), eps, null)
        return got

    def _merge(self, into: dict[int, Language], lang: Language) -> None:
        for e, rest in lang.cells:
            have = into.get(e)
            into[e] = rest if have is None or have is rest else self._union(have, rest)

    def _union(self, a: Language, b: Language) -> Language:
        cells = dict(a.cells)
        self._merge(cells, b)
        return self._make(cells, a.eps or b.eps)

    def _residual(self, e: int, kind: str) -> tuple:
        """What remains of expression ``e`` after ``kind``: tuples of expressions."""
        key = (e, kind)
        got = self._residuals.get(key)
        if got is None:
            self._residuals[key] = ()  # grammars have no left recursion
            n = self.nodes[e]
            if n[0] == "t":
                out = [()] if kind in n[1] else []
            elif n[0] == "s":
                out = [(*r, n[2]) for r in self._residual(n[1], kind)]
                if self.null[n[1]]:
                    out += self._residual(n[2], kind)
            elif n[0] == "a":
                out = [r for x in n[1:] for r in self._residual(x, kind)]
            elif n[0] == "*":
                out = [(*r, e) for r in self._residual(n[1], kind)]
            elif n[0] == "?":
                out = list(self._residual(n[1], kind))
            elif n[0] == "n":
                out = list(self._residual(self._bodies[n[1]], kind))
            else:
                out = []
            got = self._residuals[key] = tuple(dict.fromkeys(out))
        return got

    def derive(self, lang: Language, kind: str) -> Language:
        """The derivative of ``lang`` by ``kind``; ``self.empty`` if no word starts so."""
        got = lang.d.get(kind)
        if got is not None:
            return got
        cells: dict[int, Language] = {}
        eps = False
        for e, rest in lang.cells:
            for residual in self._residual(e, kind):
                at = rest
                for x in reversed(residual):
                    at = self._make({x: at}, False)
                self._merge(cells, at)
                eps = eps or at.eps
            if self.null[e]:
                at = self.derive(rest, kind)
                self._merge(cells, at)
                eps = eps or at.eps
        got = lang.d[kind] = self._make(cells, eps)
        return got

    def run(self, rule: str, kinds) -> int:
        """-1 if the kinds form a word of ``rule``; else the index of the failing token,
        which is ``len(kinds)`` if the text stops too early."""
        lang, empty, derive = self.start(rule), self.empty, self.derive
        for i, kind in enumerate(kinds):
            step = lang.d.get(kind)
            if step is None:
                step = derive(lang, kind)
            if step is empty:
                return i
            lang = step
        return -1 if lang.null else len(kinds)
