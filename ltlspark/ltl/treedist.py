"""Tree edit distance (Zhang and Shasha, 1989) on post-order trees."""

from __future__ import annotations

from .ast import Tree, is_leaf, walk


def _layout(f: Tree) -> tuple[list[str], list[int], list[int]]:
    """Labels in post-order, the leftmost leaf of each node, and the key roots."""
    labels, leftmost, stack = [], [], []
    for n in walk(f):
        a = 0 if is_leaf(n) else len(n) - 1
        first = stack[-a] if a else len(labels)
        if a:
            del stack[-a:]
        stack.append(first)
        labels.append(n[1] if is_leaf(n) else n[0])
        leftmost.append(first)
    roots = sorted({left: i for i, left in enumerate(leftmost)}.values())
    return labels, leftmost, roots


def distance(f: Tree, g: Tree) -> int:
    """Least number of insertions, deletions and changes of label."""
    (a, la, ra), (b, lb, rb) = _layout(f), _layout(g)
    tree = [[0] * len(b) for _ in a]
    for i in ra:
        for j in rb:
            m, n, x, y = i - la[i] + 2, j - lb[j] + 2, la[i] - 1, lb[j] - 1
            d = [[0] * n for _ in range(m)]
            for p in range(1, m):
                d[p][0] = p
            d[0] = list(range(n))
            for p in range(1, m):
                for q in range(1, n):
                    whole = la[i] == la[p + x] and lb[j] == lb[q + y]
                    step = d[p - 1][q - 1] + (a[p + x] != b[q + y]) if whole else d[la[p + x] - 1 - x][lb[q + y] - 1 - y] + tree[p + x][q + y]
                    d[p][q] = min(d[p - 1][q] + 1, d[p][q - 1] + 1, step)
                    if whole:
                        tree[p + x][q + y] = d[p][q]
    return tree[-1][-1]


def normalised(f: Tree, g: Tree) -> float:
    return distance(f, g) / max(sum(1 for _ in walk(f)), sum(1 for _ in walk(g)))
