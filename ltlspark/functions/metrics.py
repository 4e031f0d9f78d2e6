"""Evaluation metrics over a table of predictions and references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import arrow_rows, shuffle_partitions
from .text import FAILED, collapse, strip


def valid_pairs(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Rows whose prediction is there and no failure's mark."""
    return df.filter(F.col(prediction).isNotNull() & (F.col(prediction) != FAILED))


def exact_match(p: Column, r: Column) -> Column:
    return (strip(p) == strip(r)).cast("double")


def normalized_exact_match(p: Column, r: Column) -> Column:
    return (collapse(p) == collapse(r)).cast("double")


def tokens(c: Column) -> Column:
    s = collapse(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def _grams(words: list[str], n: int) -> Iterator[tuple[str, ...]]:
    return zip(*(words[k:] for k in range(n)))  # noqa: B905


_COUNTS = "key string, n int, g string, cp bigint, cr bigint, total bigint, hit bigint"


def _counted(order: int, long: int):
    """Arrow batches of (key, p, r, matched) to sums of rows without a key, and n-gram counts of rows with one.

    A sum has no text: n, total and hit; n = 0 has the words of both sides.
    """
    schema = pa.schema([("key", pa.string()), ("n", pa.int32()), ("g", pa.string()), *[(c, pa.int64()) for c in ("cp", "cr", "total", "hit")]])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def spread(key: str, words: list[str], n: int, mine: bool) -> Iterator[tuple]:
        for lo in range(0, len(words) - n + 1, long):
            for g, c in Counter(_grams(words[lo : lo + long + n - 1], n)).items():
                yield key, n, " ".join(g), c if mine else 0, 0 if mine else c, 0, 0

    def counted(batch: pa.RecordBatch, sums: list[list[int]]) -> Iterator[tuple]:
        for key, p, r, matched in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = (x.split(" ") if x else [] for x in (p, r))
            sums[0][0] += len(a)
            sums[0][1] += len(b)
            for n in range(1, order + 1):
                if key is not None:
                    yield from spread(key, a, n, True)
                    yield from spread(key, b, n, False)
                    continue
                sums[n][0] += max(len(a) - n + 1, 0)
                if matched:
                    mine, other = Counter(_grams(a, n)), Counter(_grams(b, n))
                    sums[n][1] += sum(min(c, other[g]) for g, c in mine.items() if g in other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0, 0] for _ in range(order + 1)]
        for batch in batches:
            rows = counted(batch, sums)
            while part := list(islice(rows, 10_000)):
                yield made(part)
        yield made([(None, n, None, 0, 0, *two) for n, two in enumerate(sums)])

    return run


def bleu(df: DataFrame, id_cols: str | list[str], prediction: str, reference: str, order: int = 4, long: int = 20_000) -> DataFrame:
    """Corpus BLEU of one reference each: clipped n-gram precisions and brevity penalty, 0 where an order has no match.

    Rows of one id are one item. Where an id has one row, and its texts have no more than `long` words, n-grams are counted
    within the row and only sums leave the task; all others are rows and meet by (id, n-gram), so a long text is no long task.
    """
    ids = [id_cols] if isinstance(id_cols, str) else id_cols
    arrow_rows(df.sparkSession)
    some = reduce(and_, [F.col(c).isNotNull() for c in ids])
    words = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1
    texts = df.select(*ids, collapse(F.col(prediction)).alias("p"), collapse(F.col(reference)).alias("r"))
    texts = texts.withColumn("rows", F.count("*").over(Window.partitionBy(*ids)))
    apart = some & ((F.col("rows") > 1) | (F.greatest(words(F.col("p")), words(F.col("r"))) > long))
    sent = texts.select(F.when(apart, F.to_json(F.struct(*ids))).alias("key"), "p", "r", some.alias("matched"))
    met = sent.mapInArrow(_counted(order, long), _COUNTS).groupBy("key", "n", "g").agg(*[F.sum(c).alias(c) for c in ("cp", "cr", "total", "hit")])
    by = met.groupBy("n").agg(F.sum(F.col("cp") + F.col("total")).alias("total"), F.sum(F.least("cp", "cr") + F.col("hit")).alias("hit"))
    found = (F.col("n") > 0) & (F.col("hit") > 0)
    size = lambda c: F.coalesce(F.sum(F.when(F.col("n") == 0, F.col(c))), F.lit(0))
    one = by.agg(size("total").alias("cp"), size("hit").alias("cr"), F.count_if(found).alias("k"), F.sum(F.when(found, F.ln(F.col("hit") / F.col("total")))).alias("logs"))
    short = F.when(F.col("cp") > F.col("cr"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("cr").cast("double"), F.col("cp"))))
    return one.select("cp", "cr", F.when(F.col("k") == order, short * F.exp(F.col("logs") / order)).otherwise(0.0).alias("bleu"))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of the shorter text (Hyyro, 2004)."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & masks.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of lower-case words; null if a text is null."""
    return F.pandas_udf(_rouge_l, "double")(prediction, reference)


def meteor(prediction: Column, reference: Column) -> Column:
    """METEOR of exact and stem matches, in order, without a thesaurus: an approximation."""
    return F.pandas_udf(_meteor, "double")(prediction, reference)


def _rouge_l(p: pd.Series, r: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(p, r, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        a, b = x.lower().split(), y.lower().split()
        n = _lcs(a, b)
        out.append(2 * n / (len(a) + len(b)) if n else 0.0)
    return pd.Series(out, dtype="float64")


def _stem(w: str) -> str:
    for end in ("ing", "ed", "es", "s", "ly"):
        if w.endswith(end) and len(w) > len(end) + 2:
            return w[: -len(end)]
    return w


def _meteor(p: pd.Series, r: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(p, r, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        a, b = x.lower().split(), y.lower().split()
        places: dict[str, list[int]] = {}
        for i in range(len(b) - 1, -1, -1):
            places.setdefault(_stem(b[i]), []).append(i)
        match = [places[s].pop() if places.get(s := _stem(w)) else -1 for w in a]
        hit = [m for m in match if m >= 0]
        if not hit:
            out.append(0.0)
            continue
        chunks = 1 + sum(n != m + 1 for m, n in zip(hit[:-1], hit[1:], strict=True))
        pr, rc = len(hit) / len(a), len(hit) / len(b)
        out.append(10 * pr * rc / (rc + 9 * pr) * (1 - 0.5 * (chunks / len(hit)) ** 3))
    return pd.Series(out, dtype="float64")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; null where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def without_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def metric_table(df: DataFrame, target: str) -> DataFrame:
    """One row of the means that the kind of target (nl, ltl or itl) has; those that it has not are null.

    Formulas repeat and cost much each, so every pair of theirs is scored once and counts as often as it occurs.
    """
    from .udfs import ltl_equivalent, ltl_parse, tree_edit_distance

    p, r = F.col("prediction"), F.col("reference")
    rows = valid_pairs(df).select("prediction", "reference")
    out = {"exact_match": exact_match(p, r), "normalized_exact_match": normalized_exact_match(p, r)}
    if target == "nl":
        out |= {"rouge_l": rouge_l(p, r), "meteor": meteor(p, r)}
    if target == "ltl":
        out |= {"semantic_equivalence": ltl_equivalent(p, r).cast("double"), "tree_edit_distance": tree_edit_distance(p, r), "syntactic_correctness": ltl_parse(p)["valid"].cast("double")}
        rows = rows.groupBy("prediction", "reference").agg(F.count("*").alias("n")).repartition(shuffle_partitions(df.sparkSession))  # said outright: few bytes, but much work each
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    scored = rows.select("n", *[v.alias(k) for k, v in out.items()])
    names = ["exact_match", "normalized_exact_match", "rouge_l", "meteor", "semantic_equivalence", "tree_edit_distance", "syntactic_correctness"]
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum(F.when(F.col(c).isNotNull(), F.col("n"))))
    return scored.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[without_nan(mean(n) if n in out else F.lit(None).cast("double")).alias(n) for n in names])
