"""Rewrites: negation normal form, expansion, flattening, distribution, sorting, simplification, keys."""

from __future__ import annotations

import hashlib

from .ast import FALSE, NARY, TRUE, Tree, children, is_leaf, negation
from .parse import LATEX, show

_DUAL = {"and": "or", "or": "and", "always": "eventually", "eventually": "always", "next": "next", "until": "release", "release": "until"}


def _map(f: Tree, g) -> Tree:
    return f if is_leaf(f) else (f[0], *(g(c) for c in f[1:]))


def expand(f: Tree) -> Tree:
    """Without -> and <->."""
    if f[0] == "implies":
        return ("or", ("not", expand(f[1])), expand(f[2]))
    if f[0] == "iff":
        a, b = expand(f[1]), expand(f[2])
        return ("and", ("or", ("not", a), b), ("or", ("not", b), a))
    return _map(f, expand)


def nnf(f: Tree, positive: bool = True) -> Tree:
    """Negations at atoms only, no -> or <->; W and M are written with R and U."""
    k = f[0]
    if is_leaf(f):
        return f if positive else negation(f)
    if k == "not":
        return nnf(f[1], not positive)
    if k in ("implies", "iff"):
        return nnf(expand(f), positive)
    if k == "weak_until":  # a W b = b R (a | b)
        return nnf(("release", f[2], ("or", f[1], f[2])), positive)
    if k == "strong_release":  # a M b = b U (a & b)
        return nnf(("until", f[2], ("and", f[1], f[2])), positive)
    return (k if positive else _DUAL[k], *(nnf(c, positive) for c in f[1:]))


def flatten(f: Tree) -> Tree:
    """Nested & in & and | in | become one node."""
    f = _map(f, flatten)
    if f[0] in NARY:
        return (f[0], *(x for c in f[1:] for x in (c[1:] if c[0] == f[0] else (c,))))
    return f


def distribute(f: Tree) -> Tree:
    """One step at the topmost |s: the first & below is distributed over."""
    if f[0] == "or":
        for i, c in enumerate(f[1:], 1):
            if c[0] == "and":
                rest = f[1:i] + f[i + 1 :]
                return ("and", *(("or", x, *rest) for x in c[1:]))
    return _map(f, distribute)


def key(f: Tree, commutative: tuple[str, ...] = ("and", "or", "iff")) -> str:
    """Prefix text; operands of commutative operators are sorted."""
    if is_leaf(f):
        return f[1]
    parts = [key(c, commutative) for c in f[1:]]
    return f"{LATEX[f[0]]}({','.join(sorted(parts) if f[0] in commutative else parts)})"


def compat_key(f: Tree) -> str:
    """Prefix text without separators, the operands of every operator sorted (so p U q and q U p are one)."""
    return f[1] if is_leaf(f) else f"{LATEX[f[0]]}({''.join(sorted(compat_key(c) for c in f[1:]))})"


def sort_operands(f: Tree, by=key) -> Tree:
    f = _map(f, lambda c: sort_operands(c, by))
    return (f[0], *sorted(f[1:], key=by)) if f[0] in NARY else f


def shallow_nnf(f: Tree) -> Tree:
    """Pushes a negation through &, |, G, F, X, U and R only; other negated operators and double negations stay."""
    if f[0] == "not" and f[1][0] in _DUAL:
        return (_DUAL[f[1][0]], *(shallow_nnf(("not", c)) for c in children(f[1])))
    return f if is_leaf(f) else _map(f, shallow_nnf)


def compat_canonical(f: Tree) -> Tree:
    return sort_operands(distribute(flatten(expand(shallow_nnf(f)))), compat_key)


def compat_rejects(f: Tree) -> bool:
    """Whether flattening makes an & or | of more than two operands, which a two-place constructor refuses."""
    todo = [flatten(expand(shallow_nnf(f)))]
    while todo:
        n = todo.pop()
        if n[0] in NARY and len(n) > 3:
            return True
        todo += children(n)
    return False


def simplify(f: Tree) -> Tree:
    """Constants, idempotence, absorption of repeated G and F, complements; operands sorted."""
    if is_leaf(f):
        return f
    f = flatten(_map(f, simplify))
    k = f[0]
    if k == "not":
        return negation(f[1])
    if k in ("always", "eventually", "next"):
        if f[1] in (TRUE, FALSE) or (k != "next" and f[1][0] == k):
            return f[1]
        return f
    if k in NARY:
        unit, zero = (TRUE, FALSE) if k == "and" else (FALSE, TRUE)
        parts = sorted({c for c in f[1:] if c != unit}, key=key)
        if zero in parts or any(negation(c) in parts for c in parts):
            return zero
        return (k, *parts) if len(parts) > 1 else parts[0] if parts else unit
    if k == "implies":
        a, b = f[1:]
        if a == FALSE or b == TRUE or a == b:
            return TRUE
        return b if a == TRUE else negation(a) if b == FALSE else f
    if k == "iff":
        a, b = sorted(f[1:], key=key)
        if a == b:
            return TRUE
        for x, y in ((a, b), (b, a)):
            if x == TRUE:
                return y
            if x == FALSE:
                return negation(y)
        return ("iff", a, b)
    a, b = f[1:]
    if a == b:
        return a
    if k == "until" and b in (TRUE, FALSE) or k == "release" and b in (TRUE, FALSE):
        return b
    if k == "until":
        return simplify(("eventually", b)) if a == TRUE else b if a == FALSE else f
    if k == "release":
        return simplify(("always", b)) if a == FALSE else b if a == TRUE else f
    if k == "weak_until":
        return TRUE if TRUE in (a, b) else b if a == FALSE else simplify(("always", a)) if b == FALSE else f
    return FALSE if FALSE in (a, b) else b if a == TRUE else simplify(("eventually", a)) if b == TRUE else f


def canonical(f: Tree) -> Tree:
    """Simplified, flattened and sorted; equal for formulas that differ in operand order or trivial parts only."""
    return simplify(f)


def canonical_text(f: Tree) -> str:
    return show(canonical(f))


def canonical_hash(f: Tree, compat: bool = False) -> str:
    text = compat_key(compat_canonical(f)) if compat else key(sort_operands(flatten(nnf(f))))
    return hashlib.sha256(text.encode()).hexdigest()
