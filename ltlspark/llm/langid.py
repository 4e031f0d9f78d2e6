"""Operator 1: language by a string kernel.

The kernel of two texts is the number of character n-grams (n = 1 to 4, blended)
that occur in both, over the root of the product of their numbers of distinct
n-grams: presence, not frequency. Letters are lowered and every run of other
characters is one space. N-grams are hashed into DIM columns.

Nystroem: the kernel against a few landmark texts, whitened by the landmarks' own
kernel matrix, gives each text its features; ridge regression of each language
against the rest is solved on them. Landmarks, whitening and weights are linear in
a text's presence row, so their product is formed once, and a batch of texts is
scored by one matrix product; a column of ones counts its n-grams on the way.

The classifier learns from a bounded sample: at most ROWS_PER_LANG rows of each
language and MAX_ROWS in all, but one of each language at least, the smallest by a
hash of id and text. Rows are cut to that number within each task before they meet,
and come to the driver as presence bits of DIM / 8 bytes, however long the texts;
equal rows count once. Everything else covers all rows, and whole texts. The model
has DIM floats for each language, so the number of languages must fit the driver.

A text that is null or has no letter is `und` with score 0 and null margin and lead. Ties go
to the language that sorts first. With no labelled row every text is `und`. Repeated
rows get the same answer each; an empty table gives no row. learn ignores extra
columns; identify keeps them, but replaces those named lang_pred, score, margin and lead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import arrow_rows
from .text import slices

DIM = 1 << 16
ORDERS = 4
ROWS_PER_LANG = 400
MAX_ROWS = 4096
LANDMARKS = 256
RIDGE = 1e-2
#: Logits for one unit of the regression's output, for the softmax that makes a score.
SHARPNESS = 12.0
#: Rows and characters that are turned into presence rows at once.
ROWS, CHARS = 64, 1 << 18

_K = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - 16)


def _letters() -> np.ndarray:
    """Code point to lowered letter; what is no letter to space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            table[c] = ord(y) if len(y := x.lower()) == 1 else c
    return table


_TABLE: np.ndarray | None = None


def _normal(text: np.ndarray) -> tuple[np.ndarray, bool]:
    """UTF-8 bytes to lowered letters and single spaces, with one space at either end; whether there is a letter."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _letters()
    c = _TABLE[np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
    blank = c == 32
    c = c[~(blank & np.concatenate([[False], blank[:-1]]))]
    return c, len(c) > 1


def _mark(out: np.ndarray, c: np.ndarray) -> None:
    """Set the columns of all n-grams of c, in pieces of bounded size."""
    for at in range(0, len(c), CHARS):
        part = c[at : at + CHARS + ORDERS - 1].astype(np.uint64)
        h = np.zeros(len(part), np.uint64)
        for n in range(1, ORDERS + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(n)
            x = (h ^ (h >> np.uint64(29))) * _K
            out[(x >> _SHIFT).astype(np.int64)] = 1


def presence(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, presence rows, has letters) of a string column, ROWS rows at once. The rows are reused."""
    space = np.zeros((ROWS, DIM), np.float32)
    for i, j, data, off in slices(column):
        for a in range(0, j - i, ROWS):
            b = min(a + ROWS, j - i)
            x = space[: b - a]
            x[:] = 0
            lettered = np.zeros(b - a, bool)
            for k in range(a, b):
                c, lettered[k - a] = _normal(data[off[k] : off[k + 1]])
                if lettered[k - a]:
                    _mark(x[k - a], c)
            yield i + a, i + b, x, lettered


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = []
        for _, _, x, lettered in presence(batch.column(2)):
            bits += [np.packbits(row > 0).tobytes() if ok else None for row, ok in zip(x, lettered, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["h", "lang", "bits"])


class Model:
    """langs, and weights of DIM rows and a column for each language."""

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights
        self.wide = np.concatenate([weights, np.ones((DIM, 1), np.float32)], axis=1)

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its softmax share, its regression's output and the output's lead over the next, for presence rows.

        The output is near 1 for a text like those of the language, and both are near 0 for one like none that was
        learnt, however many languages there are. A single language leads by its output.
        """
        raw = x @ self.wide
        f = raw[:, :-1] / np.sqrt(np.maximum(raw[:, -1:], 1))
        best = f.argmax(axis=1)
        top = f[np.arange(len(f)), best]
        second = np.partition(f, -2, axis=1)[:, -2] if f.shape[1] > 1 else np.zeros(len(f))
        return best, (1 / np.exp(SHARPNESS * (f - top[:, None])).sum(axis=1)).astype(float), top.astype(float), (top - second).astype(float)


def fit(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model of (language, presence bits)."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([], np.zeros((DIM, 0), np.float32))
    y = np.array([langs.index(lang) for lang, _ in rows])
    bits = np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), DIM // 8)
    turn = np.argsort([np.flatnonzero(np.flatnonzero(y == y[i]) == i)[0] for i in range(len(y))], kind="stable")  # languages in turn
    chosen = turn[:landmarks]
    marks = np.unpackbits(bits[chosen], axis=1).astype(np.float32)
    marks /= np.sqrt(marks.sum(axis=1, keepdims=True))
    kernel = np.empty((len(rows), len(chosen)))
    for at in range(0, len(rows), 128):
        x = np.unpackbits(bits[at : at + 128], axis=1).astype(np.float32)
        kernel[at : at + 128] = (x @ marks.T) / np.sqrt(x.sum(axis=1, keepdims=True))
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ whiten
    weight = 1 / np.bincount(y, minlength=len(langs))[y]  # languages count alike
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    gram = features.T @ (weight[:, None] * features)
    beta = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), features.T @ (weight[:, None] * target))
    return Model(langs, (marks.T @ (whiten @ beta)).astype(np.float32))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG, max_rows: int = MAX_ROWS) -> Model:
    """A model from the labelled rows of docs, on a sample bounded by rows_per_lang and max_rows."""
    arrow_rows(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    h = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit(1)), F.lit(1 << 62))
    named = rows.select(h.alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((DIM, 0), np.float32))
    most = max(1, min(rows_per_lang, max_rows // len(counts)))
    rate = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.5 * most / n + 32 / n))])
    few = named.filter(F.col("h") < rate[F.col("lang")] * float(1 << 62)).groupBy("lang", "h").agg(F.min("text").alias("text")).select("h", "lang", "text")
    marked = few.mapInArrow(_bits, "h long, lang string, bits binary").filter("bits is not null")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "bits")) <= most
    found = marked.withColumn("first", first).filter("first").drop("first").toArrow().to_pylist()
    return fit([(r["lang"], r["bits"]) for r in sorted(found, key=lambda r: (r["h"], r["lang"], r["bits"]))])


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, margin and lead; columns of those names are replaced. text_col is the only input of a prediction."""
    spark = docs.sparkSession
    arrow_rows(spark)
    sent = spark.sparkContext.broadcast((model.langs, model.weights))  # DIM x languages floats
    docs = docs.drop("lang_pred", "score", "margin", "lead")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            lang, score, margin, lead = [], [], [], []
            for _, _, x, lettered in presence(batch.column(at)):
                if own.langs:
                    best, p, top, over = own.score(x)
                else:
                    best, p, top, over, lettered = np.zeros(len(x), int), *np.zeros((3, len(x))), np.zeros(len(x), bool)
                lang += [own.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                score += np.where(lettered, p, 0.0).tolist()
                margin += [t if ok else None for t, ok in zip(top.tolist(), lettered.tolist(), strict=True)]
                lead += [t if ok else None for t, ok in zip(over.tolist(), lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(lead, pa.float64())], names=[*batch.schema.names, "lang_pred", "score", "margin", "lead"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("score", "margin", "lead")]]))
