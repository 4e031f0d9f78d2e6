"""Operator 3: document fingerprints by improved consistent weighted sampling (Ioffe, 2010).

Terms are pairs of adjacent words, the word itself for a text of one; a term's
weight is how often it occurs. For each of K samples a term draws r, c ~ Gamma(2, 1)
and beta ~ U(0, 1) from its hash alone; with t = floor(ln w / r + beta) the sample
is the (term, t) with the smallest ln a = ln c - r (t - beta + 1). Two texts agree
in a sample with a chance of their generalised Jaccard similarity.

The draws come from tables of 2^16 values, indexed by 16 bits of the term's hash
times the sample's odd number, so nothing is drawn anew for a term, and a weight's
ln a is a table too. A fingerprint is K 16-bit hashes of the samples in hex: equal
texts have equal ones, and `likeness` is the share of equal samples.

Null and empty texts, and those without a word, have a fingerprint of zeros, which
no other text has; two of them are alike (1). Texts of any length are read whole.
Repeated rows get equal fingerprints. An empty table gives no row. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_rows, shuffle_partitions
from .text import buffers, gram_hashes, mix, slices, word_hashes, word_spans

K = 128
SIZE = 1 << 16
_ODD = mix(np.arange(1, K + 1, dtype=np.uint64)) | np.uint64(1)
_TOP = np.uint64(48)


def _uniform(stream: int) -> np.ndarray:
    return ((mix(np.arange(SIZE, dtype=np.uint64) + np.uint64(stream << 32)) >> np.uint64(11)).astype(float) + 0.5) / 2**53


@lru_cache(1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta."""
    u = [_uniform(k) for k in range(1, 6)]
    return -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]


@lru_cache(256)
def _levels(weight: int) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t for a weight, by draw."""
    r, c, beta = _draws()
    t = np.floor(np.log(weight) / r + beta)
    return (c - r * (t - beta + 1)).astype(np.float32), t.astype(np.int64).astype(np.uint64)


def signature(terms: np.ndarray) -> np.ndarray:
    """K 16-bit samples of a text's term hashes, repeats included."""
    if not len(terms):
        return np.zeros(K, np.uint16)
    own, weight = np.unique(terms, return_counts=True)
    best, who, level = np.full(K, np.inf, np.float32), np.zeros(K, np.uint64), np.zeros(K, np.uint64)
    for w in np.unique(weight).tolist():
        group = own[weight == w]
        low, ts = _levels(w)
        for at in range(0, len(group), 512):
            part = group[at : at + 512]
            draw = (np.multiply.outer(_ODD, part) >> _TOP).astype(np.int32)
            value = low[draw]
            k = value.argmin(axis=1)
            found = value[np.arange(K), k]
            better = found < best
            best[better], who[better] = found[better], part[k[better]]
            level[better] = ts[draw[better, k[better]]]
    return (mix(who + mix(level + np.uint64(1))) >> _TOP).astype(np.uint16) | np.uint16(1)


def terms_of(words: np.ndarray) -> np.ndarray:
    """Hashes of a text's terms from its word hashes."""
    n = min(2, len(words))
    return gram_hashes(words, np.arange(len(words) - n + 1), n) if n else words


def _words(data: np.ndarray) -> np.ndarray:
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return word_hashes(data, starts, ends)


def hexed(sig: np.ndarray) -> str:
    return sig.astype("<u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row, without a shuffle."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, j, data, off in slices(batch.column(1)):
                starts, ends, woff = word_spans(data, off)
                words = word_hashes(data, starts, ends)
                out += [hexed(signature(terms_of(words[woff[k] : woff[k + 1]]))) for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


#: Stands for every hash where an id is not cut by them.
_ANY = -(1 << 63)


class _Text:
    """A text on its way through the neighbours' pass."""

    __slots__ = ("chars", "data", "doc", "sig")

    def __init__(self, doc: int | None, data: np.ndarray):
        self.doc, self.data = doc, data
        self.chars = np.flatnonzero((data & 0xC0) != 0x80)  # where each code point starts
        self.sig = signature(terms_of(_words(data)))

    def prefix(self, n: int) -> np.ndarray:
        return self.data[: self.chars[n]] if n < len(self.chars) else self.data


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edited form and the next document.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document, by ascending id; the first follows
    the last. Rows are dealt once, by ranges of the id, and of the text's hash within an
    id that many rows share, whose lower ends are values of the table; the rows at a
    lower end go to the range before it as well, and the first row to the last range.
    Ties in the id are ordered by the text's hash, then by the text; null ids come
    first, and a text that is alone follows itself. Rows equal in id and text share a range.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    n = shuffle_partitions(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 11))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    stats = source.agg(F.min(key).alias("lo"), F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], F.lit(max(10_000, 20 * n))).alias("cuts")).first()
    first = stats["lo"] if stats["lo"] is not None else 0
    quantiles = _in_table(source.select(key.alias("k")), list(stats["cuts"] or ())) if n > 1 else []
    ends = [(c, _ANY) for c in sorted({c for c in quantiles if c > first})]
    # an id that several quantiles fall on is cut by quantiles of its texts' hashes
    shared = [c for c, times in Counter(quantiles).items() if times > 1]
    least = {}
    if shared:
        inside = source.filter(key.isin(shared)).groupBy(key.alias("k")).agg(F.min("h").alias("least"), F.percentile_approx("h", [i / 64 for i in range(1, 64)], F.lit(10_000)).alias("hs"))
        for r in inside.collect():
            least[r["k"]] = r["least"]
            step = max(1, 64 // (quantiles.count(r["k"]) + 1))
            ends += [(r["k"], x) for x in sorted(set(r["hs"][step - 1 :: step])) if x > r["least"]]
    ends.sort()
    cuts, hashes = (np.array([e[i] for e in ends], np.int64) for i in range(2))
    last = len(ends)
    lowest = [(first, _ANY), *ends]
    at = np.array([least.get(c, _ANY) if x == _ANY else x for c, x in lowest], np.int64)
    any_hash = np.array([x == _ANY and c not in least for c, x in lowest])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = batch.column(0).fill_null(-(1 << 63)).to_numpy(), batch.column(2).to_numpy()
            to = np.searchsorted(cuts, k, "right")
            for c in least:
                own = k == c
                x, y = np.searchsorted(cuts, c, "left"), np.searchsorted(cuts, c, "right")
                to[own] = x + np.searchsorted(hashes[x:y], h[own], "right")
            low = (np.append(np.int64(first), cuts)[to] == k) & (any_hash[to] | (at[to] == h))
            rows = np.concatenate([np.arange(len(k)), np.flatnonzero(low)])
            bucket = np.concatenate([to, np.where(to[low] > 0, to[low] - 1, last)])
            order = np.concatenate([np.zeros(len(k), bool), np.ones(low.sum(), bool)])
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(bucket, pa.int32()), pa.array(order)], names=["doc_id", "text", "h", "bucket", "after"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: _Text | None = None
        before_bucket, done = -1, False
        for batch in batches:
            data, off = buffers(batch.column("text"))
            out = []
            for k, (doc, bucket, after) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist(), batch.column("after").to_pylist(), strict=True)):
                if bucket != before_bucket:
                    before, before_bucket, done = None, bucket, False
                if done:
                    continue
                now = _Text(doc, data[off[k] : off[k + 1]])
                if before is not None:
                    out.append(_compared(before, now))
                before, done = now, after
            if before is not None:
                before.data = before.data.copy()  # does not hold on to the batch
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    dealt = source.mapInArrow(deal, "doc_id long, text string, h long, bucket int, after boolean")
    spread = dealt.repartitionById(last + 1, F.col("bucket")) if hasattr(dealt, "repartitionById") else dealt.repartition(last + 1, "bucket")
    return spread.sortWithinPartitions("bucket", "after", F.asc_nulls_first("doc_id"), "h", "text").mapInArrow(run, SCHEMA)


def _in_table(keys: DataFrame, quantiles: list[int]) -> list[int]:
    """Quantiles went through doubles: large ones are replaced by the next value that the table has."""
    if all(abs(c) <= 1 << 53 for c in quantiles if c != _ANY):
        return quantiles
    at = np.array(sorted(set(quantiles)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.sort(batch.column(0).to_numpy())
            place = np.searchsorted(k, at)
            found = np.flatnonzero(place < len(k))
            yield pa.RecordBatch.from_arrays([pa.array(at[found]), pa.array(k[place[found]])], names=["c", "k"])

    named = {r["c"]: r["k"] for r in keys.mapInArrow(run, "c long, k long").groupBy("c").agg(F.min("k").alias("k")).collect()}
    return [named[c] for c in quantiles if c in named]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]


def _compared(text: _Text, after: _Text) -> tuple:
    n = len(text.chars)
    half = n // 2
    edited = np.concatenate([text.prefix(n - half), after.prefix(half)]) if half else text.data
    sig = signature(terms_of(_words(edited)))
    return text.doc, n, hashlib.sha256(edited.tobytes()).hexdigest(), hexed(text.sig), hexed(sig), likeness(text.sig, sig), likeness(text.sig, after.sig)
