"""Operator 5: exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4, 16, ... equal segments. With each segment's mean and root
sum of squared deviations, |q - x|^2 is at least the sum over segments of
n (mean_q - mean_x)^2 + (dev_q - dev_x)^2; as |q - x|^2 = |q|^2 + |x|^2 - 2 q.x, an
inner product is at most the sum of n mean_q mean_x + dev_q dev_x. A level is one
matrix product of the statistics. Coarse to fine, a candidate goes on to the next
level only where its bound reaches the query's k-th best exact score so far, and
the survivors' scores are exact integers.

Distinct queries are written once, in blocks of about BLOCK vectors by a hash of id
and vector, so that a hot id is dealt out. Blocks are run one after another: the
driver holds one block, broadcasts it (BLOCK x dimension integers) with a floor for
each query, its k-th best score among a first bounded set of rows, and destroys the
broadcast once the block's result is written. Every partition returns at most k rows
a query that reach the floor.

Components become floor(scale * x), x as double. Vectors that are null, empty or
hold a null or non-finite component take no part, nor do rows with a null id; vectors
of different lengths do not meet. Scores are exact while they fit in 63 bits. Ties go
to the smaller id. A row is never its own candidate, nor is another row of its id.
Repeated rows are rows: each copy of a candidate takes a place of its own, and a
query id that has several rows gets the k best pairs of all its rows. An empty table
gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import arrow_rows, discard, materialise

#: Queries of one block, and rows that the floors are taken from.
BLOCK, FIRST = 16_384, 2_048
#: Candidates and queries of one tile.
TILE = 512


def vectors(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer vectors) of a list column, by length of the vector; only whole, finite vectors."""
    column = column.cast(pa.list_(pa.float64()))
    size = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()])
    flat = column.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        x = np.floor(scale * flat[first[rows][:, None] + np.arange(n)].astype(float))
        ok = np.isfinite(x).all(axis=1)
        if ok.any():
            yield rows[ok], x[ok]


class Side:
    """Vectors of one length with their segment statistics by level."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, times: np.ndarray | None = None):
        self.ids, self.x, self.times, n = ids, x, times, x.shape[1]
        self.levels = []
        parts = 1
        while parts < n:
            cuts = np.linspace(0, n, parts + 1).astype(int)
            size = np.diff(cuts)
            mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
            dev = np.sqrt(np.maximum(np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, cuts[:-1], axis=1), 0))
            self.levels.append(np.concatenate([mean * np.sqrt(size), dev], axis=1))
            parts *= 4

    def part(self, at: slice) -> Side:
        own = object.__new__(Side)
        own.ids, own.x, own.levels = self.ids[at], self.x[at], [s[at] for s in self.levels]
        return own


def exact(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows a of q with the rows b of x."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] >= 2**53:
        return np.array([sum(int(u) * int(v) for u, v in zip(q[i], x[j], strict=True)) for i, j in zip(a, b, strict=True)], np.int64)
    if len(a) * 4 > len(q) * len(x):
        return (q @ x.T)[a, b].astype(np.int64)
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 1 << 14):
        part = slice(at, at + (1 << 14))
        out[part] = np.einsum("ij,ij->i", q[a[part]], x[b[part]])
    return out


def survivors(q: Side, c: Side, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose bounds at every level reach the query's floor."""
    a = b = None
    for mine, other in zip(q.levels, c.levels, strict=True):
        if a is None:
            bound = mine @ other.T
            slack = 1e-9 * (np.abs(bound).max(initial=0) + 1)
            a, b = np.nonzero(bound + slack >= floor[:, None])
        else:
            bound = np.einsum("ij,ij->i", mine[a], other[b]) if len(a) * 16 < len(q.ids) * len(c.ids) else (mine @ other.T)[a, b]
            keep = bound + 1e-9 * (np.abs(bound).max(initial=0) + 1) >= floor[a]
            a, b = a[keep], b[keep]
    if a is None:
        a, b = (x.ravel() for x in np.indices((len(q.ids), len(c.ids))))
    return a, b


class Best:
    """The k best (score, id) of each query so far; copies of a row take a place each."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.q, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, -math.inf) if floor is None else floor.copy()

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids, score = np.concatenate([self.q, q]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.q, self.id, self.score = q[top], ids[top], score[top]
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])

    def search(self, q: Side, c: Side) -> None:
        for i in range(0, len(q.ids), TILE):
            own = q.part(slice(i, i + TILE))
            for j in range(0, len(c.ids), TILE):
                other = c.part(slice(j, j + TILE))
                a, b = survivors(own, other, self.floor[i : i + TILE])
                apart = own.ids[a] != other.ids[b]
                a, b = a[apart], b[apart]
                score = exact(own.x, other.x, a, b)
                keep = score >= self.floor[i + a]
                self.add(i + a[keep], other.ids[b[keep]], score[keep])


def top_k(rows: DataFrame, is_query, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query (a condition on id) holds, its k best other rows.

    Runs a job for each block of queries; the result is read from what they wrote.
    """
    spark = rows.sparkSession
    arrow_rows(spark, 4096)
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
    queries = source.filter(is_query(F.col("id"))).groupBy("id", "v").agg(F.count("*").alias("n"))
    asked = materialise(queries.withColumn("h", F.xxhash64("id", "v")), "queries")
    blocks = max(1, math.ceil(asked.count() / (0.8 * BLOCK)))
    first = _sides(source.limit(FIRST).toArrow(), scale)
    found = None
    for block in range(blocks):
        sides = _sides(asked.filter(F.pmod("h", F.lit(blocks)) == block).select("id", "v", "n").toArrow(), scale)
        floors = {}
        for n, side in sides.items():
            best = Best(len(side.ids), k)
            if n in first:
                best.search(side, first[n])
            floors[n] = best.floor
        sent = spark.sparkContext.broadcast([(s.ids, s.x, s.times, floors[n]) for n, s in sides.items()])
        hits = source.mapInArrow(_search(sent, k, scale), "query_id long, times long, vec_id long, score long")
        # of a query row that stands for several, each pair counts as often
        pairs = hits.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
        found = materialise(_ranked(pairs, k), "found", onto=found)
        sent.destroy()
    discard(asked)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best pairs of each query id; each partition sends on at most k of one."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("query_id", "vec_id", "score").withColumn("rank", rank).filter(F.col("rank") <= k)


def _sides(found: pa.Table, scale: int) -> dict[int, Side]:
    """Vectors of each length, with how many rows each stands for (a third column, or one)."""
    ids = found.column(0).to_numpy()
    times = found.column(2).to_numpy() if found.num_columns > 2 else np.ones(len(ids), np.int64)
    held: dict[int, list] = {}
    for chunk, at in zip(found.column(1).chunks, np.cumsum([0, *map(len, found.column(1).chunks)]), strict=False):
        for own, x in vectors(chunk, scale):
            held.setdefault(x.shape[1], []).append((ids[at + own], x, times[at + own]))
    return {n: Side(*(np.concatenate([p[k] for p in parts]) for k in range(3))) for n, parts in held.items()}


def _search(sent, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {x.shape[1]: (Side(ids, x, times), floor) for ids, x, times, floor in sent.value}
        best = {n: Best(len(side.ids), k, floor) for n, (side, floor) in sides.items()}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, x in vectors(batch.column(1), scale):
                if (n := x.shape[1]) in sides:
                    best[n].search(sides[n][0], Side(ids[rows], x))
        for n, b in best.items():
            if len(b.q):
                side = sides[n][0]
                yield pa.RecordBatch.from_arrays([pa.array(side.ids[b.q]), pa.array(side.times[b.q]), pa.array(b.id), pa.array(b.score)], names=["query_id", "times", "vec_id", "score"])

    return run
