"""Operator 6: near-duplicate documents by b-bit MinHash.

A document's set is its distinct n-word shingles, as 64-bit hashes. K minima are
taken over the whole set; R of them make one band, and of every minimum the low
B bits are packed into the signature. The steps:

1. Equal sets collapse into one node by an aggregate that combines before its
   shuffle, however many copies there are. A node is a row number that is written
   once, with bands and signature beside it; sets are made from the texts again for
   the nodes that need them.
2. In every band bucket each node is paired with the bucket's smallest and largest
   node only (`stars`). Pairs whose similarity, estimated from equal low bits and
   corrected for chance collisions, lies more than six standard errors below the
   threshold are left; the others are confirmed on full sets.
3. Buckets in which several components are left among the other nodes are `open`:
   their nodes are compared pair by pair, but for pairs within one component. A
   bucket is split by size of set (sets that differ by more than the threshold allows
   never meet) and dealt out as cells, pairs of chunks bounded in sets and in
   bytes, so no task sees a whole bucket and none is capped. A first pass sees
   signatures alone and names the nodes that have a likely partner; the sets of
   those go to the same cells and are compared, until their components have met.
4. Links of both rounds give the components.

Links, not pairs, are counted: a pair within a component is never compared again.
With K=128 and R=4 a pair at 0.8 shares no bucket with a chance of 5e-8, and at six
standard errors fewer than one pair in 1e8 is left.

Null texts, empty texts and texts without a word have an empty set and link with
nothing. Repeated rows each get their row. Rows of one id with different texts are
documents of their own, which the id reaches together with what either is linked
with only if their sets are linked. Rows with a null id are kept, never linked, with
a null component. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import arrow_rows, discard, materialise
from .text import lower, mix, release, row_shingles, slices, word_hashes, word_spans

K, R, B = 128, 4, 4
BANDS = K // R
#: Sets of a bucket, and bytes of them, that one chunk has; two chunks meet in a cell.
CHUNK, CHUNK_BYTES = 1024, 16 << 20
#: Bytes of sets that a task sends on at once.
SENT_BYTES = 16 << 20

_rng = np.random.default_rng(0x5EED)
_ODD = _rng.integers(0, 1 << 63, K, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; A-Z count as a-z."""
    for i, j, data, off in slices(column):
        starts, ends, woff = word_spans(data, off)
        h, row = row_shingles(word_hashes(lower(data), starts, ends), woff, n)
        order = np.argsort(row, kind="stable") if len(h) and (np.diff(row) < 0).any() else slice(None)
        h, at = h[order], np.searchsorted(row[order], np.arange(j - i + 1))
        for k in range(j - i):
            yield np.unique(h[at[k] : at[k + 1]])


def minima(own: np.ndarray) -> np.ndarray:
    """K minima of 32 bits over a set of hashes that is not empty."""
    low = np.full(K, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 512):
        np.minimum(low, np.multiply.outer(own[at : at + 512], _ODD).min(axis=0), out=low)
    return low >> np.uint64(32)


def bands(low: np.ndarray) -> np.ndarray:
    h = _BAND.copy()
    for part in low.reshape(BANDS, R).T:
        h = mix((h ^ part) * _FOLD)
    return h.view(np.int64)


def packed(low: np.ndarray) -> bytes:
    """The low B = 4 bits of each minimum, two to a byte."""
    bits = (low & np.uint64(15)).astype(np.uint8)
    return (bits[::2] | bits[1::2] << 4).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (rows of K/2 bytes), corrected for collisions by chance."""
    x = a ^ b
    same = ((x & 15) == 0).sum(-1, dtype=np.int32) + ((x >> 4) == 0).sum(-1, dtype=np.int32)
    chance = 2.0**-B
    return (same / K - chance) / (1 - chance)


def floor_of(threshold: float) -> float:
    """Six standard errors of the estimate below the threshold."""
    chance = 2.0**-B
    hit = threshold * (1 - chance) + chance
    return threshold - 6 * (hit * (1 - hit) / K) ** 0.5 / (1 - chance)


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, f1, f2, keys, sig = [], [], [], [], []
            for own in shingle_sets(batch.column("text"), n):
                size.append(len(own))
                f1.append(int(mix(own).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix(own ^ _FOLD).sum(dtype=np.uint64).view(np.int64)))
                low = minima(own) if len(own) else None
                keys.append(None if low is None else bands(low))
                sig.append(None if low is None else packed(low))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["doc_id", "h", "size", "f1", "f2", "bands", "sig"])

    return run


def _sets(n: int):
    """(node, its set as packed 64-bit hashes) of rows (node, text), in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, at = [], 0, 0
            for own in shingle_sets(batch.column("text"), n):
                out.append(own.tobytes())
                held += own.nbytes
                if held > SENT_BYTES or at + len(out) == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(out)), pa.array(out, pa.binary())], names=["node", "shingles"])
                    out, held, at = [], 0, at + len(out)
        release()

    return run


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), K // 2)


def _likely(least: float):
    """Pairs (a, b) whose signatures allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = estimate(_signature_rows(batch.column(2)), _signature_rows(batch.column(3))) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared) > 0


def _linked(percent: int):
    """Pairs (a, b, set of a, set of b) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Classes:
    """Union and find over component ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.top(x)] = self.top(y)


#: What names a cell: bucket, class of size, and the two chunks that meet.
CELL = ["key", "s", "i", "j"]


def _likely_pairs(own: pa.Table, percent: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a cell of pairs that may be linked and are in different components.

    Each pair has one side in chunk i and one in chunk j, and at least one side in the cell's class of size.
    """
    i, j, chunk, mine, comp, size = (own[c].to_numpy() for c in ("i", "j", "chunk", "own", "comp", "size"))
    sig = _signature_rows(own["sig"])
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    inside = i[0] == j[0]
    found = []
    for at in range(0, len(left), 64):
        a = left[at : at + 64, None]
        ok = (mine[a] | mine[right]) & (comp[a] != comp[right]) & (100 * np.minimum(size[a], size[right]) >= percent * np.maximum(size[a], size[right]))
        if inside:
            ok &= a < right
        x, y = np.nonzero(ok)
        x, y = a[x, 0], right[y]
        for k in range(0, len(x), 1 << 15):
            part = slice(k, k + (1 << 15))
            good = estimate(sig[x[part]], sig[y[part]]) >= least
            found.append((x[part][good], y[part][good]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))


def _in_cells(body: Callable[[pa.Table], pa.RecordBatch | None]):
    """body over each cell of rows that come sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held and (found := body(pa.Table.from_batches(held))) is not None and found.num_rows:
                yield found
            held.clear()

        for batch in batches:
            group = np.stack([batch.column(c).to_numpy() for c in CELL])
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x < y:
                    if (now := tuple(group[:, x])) != last:
                        yield from flush()
                        last = now
                    held.append(batch.slice(x, y - x))
        yield from flush()
        release()

    return run


def _partnered(percent: int, least: float):
    """The rows of a cell that have a likely partner there."""

    def body(own: pa.Table) -> pa.RecordBatch | None:
        x, y = _likely_pairs(own, percent, least)
        if not len(x):
            return None
        return own.take(pa.array(np.unique(np.concatenate([x, y])))).combine_chunks().to_batches()[0]

    return _in_cells(body)


def _met(percent: int, least: float):
    """Links within a cell, likeliest first; a pair whose components have met is not compared."""

    def body(own: pa.Table) -> pa.RecordBatch | None:
        x, y = _likely_pairs(own, percent, least)
        sig, sets = _signature_rows(own["sig"]), own["shingles"].to_pylist()
        node, comp, classes, found = own["node"].to_numpy(), own["comp"].to_numpy(), _Classes(), []
        order = np.concatenate([np.zeros(0, np.int64), np.argsort(-estimate(sig[x], sig[y]), kind="stable")])
        for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
            if classes.top(int(comp[a])) != classes.top(int(comp[b])) and _alike(np.frombuffer(sets[a], np.uint64), np.frombuffer(sets[b], np.uint64), percent):
                classes.join(int(comp[a]), int(comp[b]))
                found.append((int(node[a]), int(node[b])))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"]) if found else None

    return _in_cells(body)


def _sized(placed: DataFrame, percent: int) -> DataFrame:
    """Rows (key, s, own, node, comp, size) of placed(key, node, comp, size): a set goes to its own class of size and to the one above.

    Sets that can be linked are of the same class or of neighbouring ones.
    """
    kind = F.floor(F.log("size") / F.log(F.lit(1.0001 * 100 / percent))).cast("int")
    both = placed.withColumn("c", kind).withColumn("up", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.select("key", (F.col("c") + F.col("up")).alias("s"), (F.col("up") == 0).alias("own"), "node", "comp", "size")


def _open(sized: DataFrame) -> DataFrame:
    """(key, s, n): what has several components left, and into how many chunks it is cut."""
    pieces = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") * 8 / CHUNK_BYTES)).cast("int")
    return sized.groupBy("key", "s").agg(pieces.alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("own").alias("any")).filter("x != y and any").select("key", "s", "n")


def _cells(sized: DataFrame, open_: DataFrame, signatures: DataFrame) -> DataFrame:
    """The rows of what is open, with their signatures, each in every cell that its chunk is in."""
    signed = sized.join(open_, ["key", "s"]).join(signatures, "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = signed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return dealt.select("key", "s", F.least("chunk", "other").cast("int").alias("i"), F.greatest("chunk", "other").cast("int").alias("j"), "chunk", "own", "node", "comp", "size", "sig")


def _sorted_by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is its own component's smallest).

    Documents are linked whose sets have 100 * intersection >= percent * union.
    """
    arrow_rows(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    least = floor_of(percent / 100)

    signed = source.mapInArrow(_signatures(shingle), "doc_id long, h long, size long, f1 long, f2 long, bands array<long>, sig binary")
    every = materialise(signed.withColumn("rid", F.monotonically_increasing_id()), "signatures")
    some = every.filter((F.col("size") > 0) & F.col("doc_id").isNotNull())
    first = some.groupBy("f1", "f2").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least_id"))
    nodes = every.select("rid", "h", F.col("doc_id").alias("id"), "size", "bands", "sig").join(first, "rid").withColumnRenamed("rid", "node")
    nodes = materialise(nodes, "nodes")
    signatures = nodes.select("node", "sig")

    def sets_of(some_nodes: DataFrame) -> DataFrame:
        """The sets of nodes, from their texts; repeated rows are combined before the texts are shuffled."""
        texts = source.filter("doc_id is not null and text is not null").groupBy("doc_id", "h").agg(F.first("text").alias("text"))
        named = nodes.select("node", F.col("id").alias("doc_id"), "h").join(some_nodes, "node", "left_semi")
        return materialise(texts.join(named, ["doc_id", "h"]).select("node", "text").mapInArrow(_sets(shingle), "node long, shingles binary"), "sets")

    # buckets are written before their members are joined, here and in cells: a hot one can then be split at run time
    member = nodes.select("node", F.explode("bands").alias("key"))
    bucket = materialise(member.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi"), "buckets")
    hits = materialise(member.join(bucket, "key"), "hits")
    discard(bucket)

    def of(frame: DataFrame, side: str) -> DataFrame:
        return frame.toDF(side, f"of_{side}")

    # a set that is in many pairs, a hub's, is joined last: it goes to where its pairs are
    stars = hits.select(F.explode(F.array("lo", "hi")).alias("a"), F.col("node").alias("b")).filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = stars.join(of(signatures, "b"), "b").join(of(signatures, "a"), "a").select("a", "b", "of_a", "of_b").mapInArrow(_likely(least), "a long, b long")
    near = materialise(near, "likely")
    sets = sets_of(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
    both = near.join(of(sets, "b"), "b").join(of(sets, "a"), "a").select("a", "b", "of_a", "of_b")
    links = materialise(both.mapInArrow(_linked(percent), "a long, b long"), "links")
    discard(near, sets)

    comps = materialise(connected_components(links), "components")
    rest = hits.filter("node != lo and node != hi").select("key", "node")
    placed = rest.join(nodes.select("node", "size").join(comps, "node", "left"), "node").select("key", "node", F.coalesce("component", "node").alias("comp"), "size")
    sized = _sized(placed, percent)
    open_ = materialise(_open(sized), "open")
    cells = _sorted_by_cell(_cells(sized, open_, signatures))
    rows = "key long, s int, i int, j int, chunk int, own boolean, node long, comp long, size long, sig binary"
    columns = [c.split()[0] for c in rows.split(", ")]
    partnered = materialise(cells.select(*columns).mapInArrow(_partnered(percent, least), rows), "partnered")
    sets = sets_of(partnered.select("node").distinct())
    whole = _sorted_by_cell(partnered.join(sets, "node"))
    more = materialise(whole.select(*columns, "shingles").mapInArrow(_met(percent, least), "a long, b long"), "links")
    discard(hits, comps, open_, partnered, sets)

    found = materialise(connected_components(links.union(more)), "components")
    discard(links, more)
    ids = nodes.select("node", "f1", "f2", "least_id")
    lowest = materialise(found.join(ids, "node").groupBy("component").agg(F.min("least_id").alias("lowest")), "lowest")
    named = ids.join(found.join(lowest, "component").select("node", "lowest"), "node", "left").select("f1", "f2", F.coalesce("lowest", "least_id").alias("component"))
    component = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return (
        every.select("doc_id", "size", "f1", "f2")
        .join(named, ["f1", "f2"], "left")
        .select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
