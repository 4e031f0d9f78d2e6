"""Random formulas that depend on a seed and a number alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from .ast import BINARY, UNARY, Tree

# Atoms, operators in order, and the chance of a leaf below the root.
ATOMS = ["p", "q", "r", "s", "t", "u", "v", "w"]
OPERATORS = ["and", "or", "not", "implies", "iff", "always", "eventually", "next", "until", "release", "weak_until"]
LEAF = 0.3


def _numbers(seed: str) -> Iterator[float]:
    k = 0
    while True:
        block = hashlib.md5(f"{seed}:{k}".encode()).digest()
        for i in range(0, 16, 4):
            yield int.from_bytes(block[i : i + 4], "big") / 2**32
        k += 1


def formula(seed: int | str, number: int, max_depth: int = 8) -> Tree:
    """A leaf at max_depth, or with chance LEAF below the root; else a uniform choice of operator."""
    draw = _numbers(f"{seed}:{number}")

    def grow(depth: int) -> Tree:
        if depth >= max_depth or (depth > 0 and next(draw) < LEAF):
            return ("atom", ATOMS[int(next(draw) * len(ATOMS))])
        kind = OPERATORS[int(next(draw) * len(OPERATORS))]
        return (kind, *(grow(depth + 1) for _ in range(1 if kind in UNARY else 2)))

    assert set(OPERATORS) <= {*UNARY, *BINARY}
    return grow(0)


def space_size(depth: int) -> int:
    """How many formulas the generator's author expects at a depth."""
    return 8 if depth <= 1 else (depth * 11 * 8) ** (depth - 1)
