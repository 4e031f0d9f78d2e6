"""Connected components of an edge table: forests in every task, then rounds of hooking and jumping (Shiloach and Vishkin, 1982).

A task contracts its edges, in packed arrays of at most CHUNK edges at a time, to
stars around each tree's smallest node; edges lead from the larger node to the
smaller. A round takes each node's smallest neighbour as its parent, moves every edge
on to the parent of its smaller end, links a node's other neighbours with its parent,
and contracts again. It ends when no node has two parents or both a parent and
children. The same steps run at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialise

#: Edges that a task contracts at once; with the forest so far they take some 100 bytes each.
CHUNK = 1 << 19


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest node of each node's tree, for n nodes and edges (x, y)."""
    up = np.arange(n)
    while len(x):
        x, y = up[x], up[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (over := up[up] != up).any():
            up[over] = up[up[over]]
    return up


def _stars(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(node, smallest node of its tree) for every other node of a forest of the edges."""
    both = pa.concat_arrays([a, b])
    if pa.types.is_integer(both.type):
        names, code = np.unique(both.to_numpy(), return_inverse=True)
        names = pa.array(names, both.type)
    else:
        coded = both.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        names, code = coded.dictionary.take(order), rank[coded.indices.to_numpy()]
    up = roots(len(names), code[: len(a)], code[len(a) :])
    child = np.flatnonzero(up != np.arange(len(up)))
    return names.take(pa.array(child)), names.take(pa.array(up[child]))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(_stars(*(c.combine_chunks() for c in whole.columns)), whole.schema, strict=True)], names=["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= CHUNK:
            held = [stars()]
            size = held[0].num_rows
            if 2 * size > CHUNK:  # the forest itself is large: send it on and begin anew
                yield held[0]
                held, size = [], 0
    if held:
        yield stars()


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_contract, edges.schema)


def _round(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Every node of an edge moves on to its neighbour's parent, and a node's other neighbours go to its own parent.

    parents(a, m) is a written table, so a join in which one node has most edges can be split at run time.
    """
    moved = edges.join(parents.toDF("b", "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    met = edges.join(parents, "a").filter(F.col("b") != F.col("m")).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return moved.union(met)


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one parent or children alone; stars has the larger node of an edge in a."""
    seen = stars.select("a", F.col("b").alias("lo"), F.col("b").alias("hi"), F.lit(False).alias("up")).union(stars.select("b", F.lit(None), F.lit(None), F.lit(True)))
    each = seen.groupBy("a").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("up").alias("up"))
    return each.filter("lo is not null and (up or lo != hi)").limit(1).count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the component's smallest node.

    Nodes are whole numbers, strings or other orderable values without nulls; edges
    with a null end and loops are left out, repeated edges count once, and no edge
    gives no row. Each round is written to the shared folder and the one before it
    deleted; nothing but a flag reaches the driver. Neighbourhoods of any size are
    aggregated before they are shuffled, and joins carry a node's parent alone.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a") != F.col("b"))
    now = materialise(_contracted(now), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        parents = materialise(now.groupBy("a").agg(F.min("b").alias("m")), "parents")
        before, now = now, materialise(_contracted(_round(now, parents)), "edges")
        discard(before, parents)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
