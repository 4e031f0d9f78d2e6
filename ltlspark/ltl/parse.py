"""Precedence parser for formulas in ASCII, LaTeX or Unicode notation, and printers.

One scanner reads all notations; the dialects differ in how tightly U, R, W and M
bind: tighter than & and | in `spot`, looser in `latex`. Binary temporal operators
and implications group to the right; & and | make n-ary nodes.
"""

from __future__ import annotations

import re

from .ast import NARY, Tree, is_leaf, walk

# Spellings of the operators.
SPELLINGS = {
    "not": ["!", "~", "¬", "\\neg", "\\lnot"],
    "and": ["&&", "&", "∧", "/\\", "\\land", "\\wedge"],
    "or": ["||", "|", "∨", "\\/", "\\lor", "\\vee"],
    "implies": ["->", "=>", "→", "⇒", "\\rightarrow", "\\to"],
    "iff": ["<->", "<=>", "↔", "⇔", "\\leftrightarrow"],
    "always": ["G", "[]"],
    "eventually": ["F", "<>"],
    "next": ["X"],
    "until": ["U"],
    "release": ["R", "V"],
    "weak_until": ["W"],
    "strong_release": ["M"],
    "open": ["\\left(", "(", "{"],
    "close": ["\\right)", ")", "}"],
}
SPOT = {"not": "!", "next": "X", "always": "G", "eventually": "F", "and": "&", "or": "|", "implies": "->", "iff": "<->", "until": "U", "release": "R", "weak_until": "W", "strong_release": "M"}
LATEX = SPOT | {"not": "\\neg", "and": "\\land", "or": "\\lor", "implies": "\\rightarrow", "iff": "\\leftrightarrow"}

#: Binding strength of binary operators by dialect; larger binds tighter.
STRENGTH = {
    "spot": {"iff": 1, "implies": 2, "or": 3, "and": 4, "until": 5, "release": 5, "weak_until": 5, "strong_release": 5},
    "latex": {"iff": 1, "implies": 2, "until": 3, "release": 3, "weak_until": 3, "strong_release": 3, "or": 4, "and": 5},
}
_UNARY = {"not", "always", "eventually", "next"}
_KIND = {s: k for k, spelt in SPELLINGS.items() for s in spelt}
_SIGNS = "|".join(re.escape(s) + ("(?![A-Za-z])" if s[0] == "\\" and s[-1].isalpha() else "") for s in sorted(_KIND, key=len, reverse=True) if not s.isalpha())
_TOKEN = re.compile(rf"\s*(?:({_SIGNS})|([A-Za-z_][A-Za-z0-9_]*)|([01]))")


class ParseError(ValueError):
    pass


def scan(text: str) -> list[tuple[str, str]]:
    """(kind, spelling) tokens; a word that starts with G, F or X is that operator before the rest of it."""
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at : at + 10]!r} at {at}")
        sign, word, digit = m.groups()
        at = m.end()
        if sign:
            out.append((_KIND[sign], sign))
        elif digit:
            out.append(("atom", "true" if digit == "1" else "false"))
        else:
            while word and word[0] in "GFX" and word not in _KIND and len(word) > 1:
                out.append((_KIND[word[0]], word[0]))
                word = word[1:]
            out.append((_KIND[word], word) if word in _KIND else ("atom", word.lower() if word.lower() in ("true", "false") else word))
    return out


class _Parser:
    def __init__(self, text: str, dialect: str):
        self.tokens, self.at, self.strength = scan(text), 0, STRENGTH[dialect]

    def peek(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ParseError("unexpected end")
        self.at += 1
        return self.tokens[self.at - 1]

    def operand(self) -> Tree:
        before = []
        while self.peek() in _UNARY:
            before.append(self.take()[0])
        kind, word = self.take()
        if kind == "open":
            f = self.binary(0)
            if self.take()[0] != "close":
                raise ParseError("unbalanced parentheses")
        elif kind == "atom":
            f = ("atom", word)
        else:
            raise ParseError(f"unexpected {word!r}")
        for k in reversed(before):
            f = (k, f)
        return f

    def binary(self, least: int) -> Tree:
        """Operand and operators that bind tighter than least."""
        f = self.operand()
        joined = False  # whether f is an & or | of this very level
        while (s := self.strength.get(self.peek(), -1)) > least:
            kind = self.take()[0]
            right = self.binary(s if kind in NARY else s - 1)
            f = (kind, *(f[1:] if joined and f[0] == kind else (f,)), right)
            joined = kind in NARY
        return f


def parse(text: str | None, dialect: str = "spot") -> Tree:
    """The tree of a formula; ParseError if it is not one."""
    if text is None or not text.strip():
        raise ParseError("empty formula")
    p = _Parser(text, dialect)
    f = p.binary(0)
    if p.peek() != "end":
        raise ParseError(f"unexpected {p.tokens[p.at][1]!r}")
    return f


def show(f: Tree, signs: dict[str, str] = SPOT) -> str:
    """Text that parses back to f in either dialect: every binary operand that is binary has parentheses."""
    stack: list[tuple[str, bool]] = []

    def inner(part: tuple[str, bool]) -> str:
        return f"({part[0]})" if part[1] else part[0]

    for n in walk(f):
        if is_leaf(n):
            stack.append((n[1], False))
            continue
        a = len(n) - 1
        args, stack[-a:] = stack[-a:], []
        sign = signs[n[0]]
        if a == 1:
            stack.append((sign + (inner(args[0]) if sign == "!" or args[0][1] else f"({args[0][0]})"), False))
        else:
            stack.append((f" {sign} ".join(inner(x) for x in args), True))
    return stack[0][0]
