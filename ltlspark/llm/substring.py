"""Operator 2: repeated passages by difference-cover anchors.

A window is W consecutive words of one document. Hashes are taken only of shorter
runs that start at cover positions: word positions whose remainder modulo a period v
lies in a perfect difference set. Of any two equal windows, some offset below v
puts both on cover positions, so they share an anchor of W - v + 1 words there.

1. Every document's anchors are hashed; an anchor hash that occurs twice is a seed.
2. Each seed is extended to the windows that contain it, and these are confirmed by
   a 96-bit hash of all W words: a window that occurs twice is a repeat.
3. Words covered by repeats are removed, judged on the input.

Hashes meet in buckets that are packed arrays, not rows; there are as many as give
each PART_BYTES / 2 of text, by the table's size. A hash that occurs twice within a map
task's buffer is answered there and sent on once, so a passage that fills a third of
all rows adds one entry for each buffer to its bucket. Documents are shuffled once, by
a row number of the scan; the three passes read that exchange. The row number names a
row between passes, so the input must be deterministic (a table, or what a stage has
written): a lost task is run again and must give its rows the same numbers.

Null and empty texts have no words; texts of fewer than W words have no window and
lose nothing; a text of any length is read whole, in one row. Repeated rows are
documents of their own, each other's copies, and so are rows that share an id or have
none. An empty table gives no row. Extra columns, whatever their names, are kept by
`strip_repeats` and ignored by `kept_words`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import arrow_rows, shuffle_partitions
from .rows import column, packed, unpacked
from .text import gram_hashes, gram_starts, mix, release, slices, word_hashes, word_spans

#: Perfect difference sets by period.
COVERS = {3: [0, 1], 7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [3, 6, 7, 12, 14], 31: [1, 5, 11, 24, 25, 27]}
#: The shortest anchor that is still rare in ordinary text.
ANCHOR = 12
#: Entries that a map task holds before it sends them.
BUFFER = 250_000
#: Bytes of text for a partition of the passes, at most; the session's shuffle partitions are the least number of them.
PART_BYTES = 128 << 20

_ENTRY = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("rid", pa.binary()), ("pos", pa.binary()), ("h1", pa.binary()), ("h2", pa.binary())])
ENTRY = "bucket int, kind tinyint, rid binary, pos binary, h1 binary, h2 binary"


def period(window: int) -> int:
    fits = [v for v in COVERS if window - v + 1 >= min(ANCHOR, window // 2)]
    return max(fits, default=3)


def cover_positions(starts: np.ndarray, first: np.ndarray, v: int) -> np.ndarray:
    """Which of these word positions (of rows that start at first) are on the cover."""
    on = np.zeros(v, bool)
    on[COVERS[v]] = True
    return on[(starts - first) % v]


class _Out:
    """Entries of a map task, sent on in packed form by bucket."""

    def __init__(self, n_buckets: int):
        self.n, self.held, self.size = n_buckets, [], 0

    def add(self, rid: np.ndarray, pos: np.ndarray, h1: np.ndarray, h2: np.ndarray | None) -> bool:
        if len(rid):
            self.held.append((rid, pos, h1, h2))
            self.size += len(rid)
        return self.size >= BUFFER

    def flush(self) -> pa.RecordBatch | None:
        if not self.held:
            return None
        rid, pos, h1 = (np.concatenate([x[k] for x in self.held]) for k in range(3))
        h2 = None if self.held[0][3] is None else np.concatenate([x[3] for x in self.held])
        self.held, self.size = [], 0
        order = np.lexsort((h1,)) if h2 is None else np.lexsort((h2, h1))
        a = h1[order]
        same = a[1:] == a[:-1] if h2 is None else (a[1:] == a[:-1]) & (h2[order][1:] == h2[order][:-1])
        again = np.concatenate([[False], same])
        known = again.copy()
        known[:-1] |= again[1:]  # occurs twice here: answered here
        out = []
        # kind 0: one of its kind here; 1: stands for several here; 2: an answer
        for kind, at in ((0, order[~known]), (1, order[known & ~again]), (2, order[known])):
            if not len(at):
                continue
            bucket = ((h1[at] >> np.uint64(40)) % np.uint64(self.n) if kind < 2 else rid[at].view(np.uint64) % np.uint64(self.n)).astype(np.int32)
            by = np.lexsort((pos[at], rid[at], bucket)) if kind < 2 else np.argsort(bucket, kind="stable")
            at, bucket = at[by], bucket[by]
            for x, y in _cuts(bucket):
                part = at[x:y]
                out.append((int(bucket[x]), kind, rid[part].tobytes() if kind != 1 else None, pos[part].tobytes() if kind != 1 else None, h1[part].tobytes() if kind < 2 else None, h2[part].tobytes() if kind < 2 and h2 is not None else None))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _ENTRY, strict=True)], schema=_ENTRY)


def _flat(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), dtype)


def _cuts(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """Ends of the runs of equal keys."""
    if not len(sorted_keys):
        return []
    cut = [0, *(np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1).tolist(), len(sorted_keys)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def _answers(n_parts: int):
    def run(key: tuple, entries: pa.Table) -> pa.Table:
        """(rid, pos) of all entries of a bucket whose hash occurs twice, packed by the part that their row belongs to."""
        kind = entries["kind"].to_numpy()
        one, many, told = (entries.filter(pa.array(kind == k)) for k in range(3))
        h = np.concatenate([_flat(one["h1"], np.uint64), _flat(many["h1"], np.uint64)])
        n = len(_flat(one["pos"], np.int32))
        hit = np.zeros(n, bool)
        if len(h):
            g = np.concatenate([_flat(one["h2"], np.uint32), _flat(many["h2"], np.uint32)])
            order = np.lexsort((g, h)) if len(g) else np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            if len(g):
                same &= g[order][1:] == g[order][:-1]
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            hit = twice[:n]
        rid = np.concatenate([_flat(one["rid"], np.int64)[hit], _flat(told["rid"], np.int64)])
        pos = np.concatenate([_flat(one["pos"], np.int32)[hit], _flat(told["pos"], np.int32)])
        part = (mix(rid.view(np.uint64)) % np.uint64(n_parts)).astype(np.int32)
        order = np.lexsort((rid, part))
        rid, pos, part = rid[order], pos[order], part[order]
        cuts = _cuts(part)
        release()
        return pa.table({"part": pa.array([int(part[x]) for x, _ in cuts], pa.int32()), "rids": pa.array([rid[x:y].tobytes() for x, y in cuts], pa.binary()), "pos": pa.array([pos[x:y].tobytes() for x, y in cuts], pa.binary())})

    return run


def _by_row(key: tuple, answers: pa.Table) -> pa.Table:
    """One row for each rid, with its packed positions."""
    rid, pos = _flat(answers["rids"], np.int64), _flat(answers["pos"], np.int32)
    order = np.argsort(rid, kind="stable")
    rid, pos = rid[order], pos[order]
    cuts = _cuts(rid)
    return pa.table({"rid": pa.array([int(rid[x]) for x, _ in cuts], pa.int64()), "pos": pa.array([pos[x:y].tobytes() for x, y in cuts], pa.binary())})


def _marked(column: pa.Array, woff: np.ndarray) -> np.ndarray:
    """A flag for each word of a slice: its row's packed positions name it."""
    flag = np.zeros(int(woff[-1]), bool)
    for k, packed in enumerate(column.to_pylist()):
        if packed:
            flag[woff[k] + np.frombuffer(packed, np.int32)] = True
    return flag


def _covered(start: np.ndarray, length: int) -> np.ndarray:
    """Positions within length from a flagged one, itself included."""
    step = np.zeros(len(start) + length + 1, np.int32)
    np.add.at(step, np.flatnonzero(start), 1)
    np.add.at(step, np.flatnonzero(start) + length, -1)
    return np.cumsum(step)[: len(start)] > 0


def _map(body: Callable, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(n_buckets)
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for i, j, data, off in slices(batch.column("text")):
                starts, ends, woff = word_spans(data, off)
                if out.add(*body(batch.slice(i, j - i), rid[i:j], word_hashes(data, starts, ends), woff)) and (sent := out.flush()):
                    yield sent
        if sent := out.flush():
            yield sent
        release()

    return run


def _repeats(source: DataFrame, window: int) -> DataFrame:
    """source(row, text) with rid and repeats: packed int32 word positions at which a repeated window starts."""
    spark = source.sparkSession
    arrow_rows(spark)
    v = period(window)
    anchor = window - v + 1
    size = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n_parts = max(shuffle_partitions(spark), -(-size // PART_BYTES))
    n_buckets = 2 * n_parts

    def anchors(batch, rid, words, woff):
        at, row = gram_starts(woff, anchor)
        on = cover_positions(at, woff[:-1][row], v)
        at, row = at[on], row[on]
        return rid[row], (at - woff[:-1][row]).astype(np.int32), gram_hashes(words, at, anchor), None

    def windows(batch, rid, words, woff):
        seed = _marked(batch.column("seeds"), woff)
        at, row = gram_starts(woff, window)
        near = _covered(seed[::-1], v)[::-1]  # a seed lies at this word or up to v - 1 after it
        keep = near[at]
        at, row = at[keep], row[keep]
        return rid[row], (at - woff[:-1][row]).astype(np.int32), gram_hashes(words, at, window), gram_hashes(words, at, window, 77).astype(np.uint32)

    texts = source.withColumn("rid", F.monotonically_increasing_id()).repartition(n_parts, "rid")

    def answered(entries: DataFrame, name: str) -> DataFrame:
        found = entries.repartition(n_parts, "bucket").groupBy("bucket").applyInArrow(_answers(n_parts), "part int, rids binary, pos binary")
        by_row = found.repartition(n_parts, "part").groupBy("part").applyInArrow(_by_row, "rid long, pos binary")
        return by_row.withColumnRenamed("pos", name).repartition(n_parts, "rid").hint("shuffle_hash")

    # all passes take the same columns, else the exchange of the texts would not be reused
    seeds = answered(texts.mapInArrow(_map(anchors, n_buckets), ENTRY), "seeds")
    seeded = texts.join(seeds, "rid")
    found = answered(seeded.mapInArrow(_map(windows, n_buckets), ENTRY), "repeats")
    return texts.join(found, "rid", "left")


def _removed(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row: its bytes, word starts and ends, and which words repeats cover."""
    for i, j, data, off in slices(batch.column("text")):
        starts, ends, woff = word_spans(data, off)
        start = _marked(batch.column("repeats").slice(i, j - i), woff)
        gone = _covered(start, window)
        for k in range(j - i):
            own = slice(woff[k], woff[k + 1])
            yield data[off[k] : off[k + 1]], starts[own] - off[k], ends[own] - off[k], gone[own]


def kept_words(docs: DataFrame, *, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lost, sha = [], [], []
            for data, starts, ends, gone in _removed(batch, window):
                n.append(len(gone))
                lost.append(int(gone.sum()))
                raw = data.tobytes()
                words = raw.split() if not lost[-1] else [raw[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)]
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
        release()

    source = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    marked = _repeats(source, window).select("row", "text", "repeats")
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(docs: DataFrame, *, window: int = 35, text_col: str = "text") -> DataFrame:
    """docs, all columns, with repeated passages cut out of the text: each removed word goes with the space after it.

    n_words and n_removed follow (columns of those names are replaced). Texts
    without repeats stay as they are, byte for byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n, lost = [], [], []
            for data, starts, ends, gone in _removed(batch, window):
                n.append(len(gone))
                lost.append(int(gone.sum()))
                if lost[-1]:
                    follow = np.append(starts[1:], len(data))
                    step = np.zeros(len(data) + 1, np.int32)
                    np.add.at(step, starts[gone], 1)
                    np.add.at(step, follow[gone], -1)
                    data = data[np.cumsum(step)[:-1] == 0]
                out.append(data.tobytes())
            texts = pc.if_else(batch.column("text").is_null(), pa.scalar(None, pa.string()), pa.array(out, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts, pa.array(n, pa.int64()), pa.array(lost, pa.int64())], names=["row", "text", "n_words", "n_removed"])
        release()

    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    rest = [c for c in kept if c != text_col]
    source = docs.select(packed(rest), column(text_col).cast("string").alias("text"))
    schema = T.StructType([source.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    cut = _repeats(source, window).select("row", "text", "repeats").mapInArrow(run, schema)
    back = unpacked(rest) | {text_col: F.col("text").alias(text_col)}
    return cut.select(*[back[c] for c in kept], "n_words", "n_removed")
