"""Formula trees, and their columnar form.

A tree is a tuple: (kind, child, ...), and an atom or constant is ("atom", name).
Its columnar form is the post-order list of (kind, arity, name), which delimits
itself, is stored as an array of structs, and is folded by an evaluation stack.
"""

from __future__ import annotations

from collections.abc import Iterator

Tree = tuple

UNARY = ("not", "next", "always", "eventually")
TEMPORAL_BINARY = ("until", "release", "weak_until", "strong_release")
BINARY = ("and", "or", "implies", "iff", *TEMPORAL_BINARY)
NARY = ("and", "or")
KINDS = ("atom", *UNARY, *BINARY)
TRUE, FALSE = ("atom", "true"), ("atom", "false")


def atom(name: str) -> Tree:
    return ("atom", name)


def negation(f: Tree) -> Tree:
    """not f, without a double negation or a negated constant."""
    if f == TRUE:
        return FALSE
    if f == FALSE:
        return TRUE
    return f[1] if f[0] == "not" else ("not", f)


def is_leaf(f: Tree) -> bool:
    return f[0] == "atom"


def children(f: Tree) -> tuple:
    return () if is_leaf(f) else f[1:]


def walk(f: Tree) -> Iterator[Tree]:
    """All subtrees in post-order, without recursion."""
    todo = [(f, False)]
    while todo:
        node, opened = todo.pop()
        if opened or is_leaf(node):
            yield node
        else:
            todo.append((node, True))
            todo += [(c, False) for c in reversed(node[1:])]


def to_arena(f: Tree) -> list[dict]:
    return [{"k": n[0], "a": 0, "v": n[1]} if is_leaf(n) else {"k": n[0], "a": len(n) - 1, "v": None} for n in walk(f)]


def from_arena(arena: list) -> Tree:
    """The tree of a post-order list of dicts or rows; ValueError if it isn't one."""
    stack: list[Tree] = []
    for n in arena:
        k, a = n["k"], n["a"]
        if k not in KINDS or a > len(stack) or (k == "atom") != (a == 0):
            raise ValueError(f"not a post-order formula: {k}/{a}")
        if a:
            stack[-a:] = [(k, *stack[-a:])]
        else:
            stack.append(("atom", n["v"]))
    if len(stack) != 1:
        raise ValueError("not one formula")
    return stack[0]


def to_dict(f: Tree) -> dict:
    """Nested type, value and children."""
    return {"type": f[0], "value": f[1] if is_leaf(f) else None, "children": [to_dict(c) for c in children(f)]}


def from_dict(d: dict) -> Tree:
    if d["type"] not in KINDS or (d["type"] == "atom") == bool(d["children"]):
        raise ValueError(f"not a formula: {d['type']!r}")
    return ("atom", d["value"]) if d["type"] == "atom" else (d["type"], *map(from_dict, d["children"]))


def atoms(f: Tree) -> list[str]:
    return sorted({n[1] for n in walk(f) if is_leaf(n) and n not in (TRUE, FALSE)})


def size(f: Tree) -> int:
    return sum(1 for _ in walk(f))


def operators(f: Tree) -> int:
    return sum(not is_leaf(n) for n in walk(f))


def depth(f: Tree) -> int:
    """Edges of the longest path to a leaf."""
    stack: list[int] = []
    for n in walk(f):
        if is_leaf(n):
            stack.append(0)
        else:
            a = len(n) - 1
            stack[-a:] = [1 + max(stack[-a:])]
    return stack[0]
