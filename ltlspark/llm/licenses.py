"""Operator 10: licence scans by TF-IDF cosine to templates, and inheritance by directory.

A file's units are its lines and its whole text. A unit is a sparse vector over
words of letters and digits (A-Z lowered), term frequency times the inverse
document frequency over all files; words that no template has enter its norm at
the weight of a word that no file has. The header of a file is its line that is
most like a template, from HEADER on; a file is a licence file where its whole text
is like a template from WHOLE on, or where it has a header and is named as one.

Files without a header take the licence of the licence file in the nearest
directory above them: every distinct directory is joined with its ancestors by
path, and the deepest that has a licence file counts (the first by path, if several).

Files without either have no licence. Null, empty and blank texts have no header, and
texts of any length are read whole; null paths inherit nothing and give nothing. Ties
between templates go to the first by name, those between licence files to the first by
path. Repeated rows are files of their own. An empty table gives no row. Other columns
of files are kept, whatever their names, but for those named license, score, origin
and license_path, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import arrow_rows, materialise
from .rows import column, packed, unpacked
from .text import lower, slices, word_hashes, word_spans

# Headers of well-known licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
HEADER, WHOLE = 0.75, 0.6
NAMES = r"(?i)^(licen[cs]e|copying)(\..*)?$"

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _hashed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, woff = word_spans(data, off, _BETWEEN)
    return word_hashes(lower(data), starts, ends), starts, woff


class Vocabulary:
    """The templates' words as sorted hashes."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words = [_hashed(raw := np.frombuffer(templates[n].encode(), np.uint8), np.array([0, len(raw)]))[0] for n in self.names]
        self.hashes = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]))
        self.tf = np.array([np.bincount(np.searchsorted(self.hashes, w), minlength=len(self.hashes)) for w in words], float).reshape(len(words), len(self.hashes))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def document_frequencies(files: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """Number of files, and in how many each word of the templates occurs, over all of files(text)."""
    size = len(vocabulary.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(size, np.int64)
        for batch in batches:
            n += batch.num_rows
            for _, _, data, off in slices(batch.column(0)):
                h, _, woff = _hashed(data, off)
                v = vocabulary.find(h)
                row = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
                df += np.bincount(np.unique(row[v >= 0] * size + v[v >= 0]) % size if size else [], minlength=size).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(size)], pa.int32()), pa.array([n, *df.tolist()], pa.int64())], names=["v", "n"])

    got = {r["v"]: r["s"] for r in files.mapInArrow(run, "v int, n long").groupBy("v").agg(F.sum("n").alias("s")).collect()}
    return got.get(-1, 0), np.array([got.get(k, 0) for k in range(size)], float)


def _best(unit: np.ndarray, v: np.ndarray, idf: np.ndarray, rare: float, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units with a word of the templates, best cosine of each, which template); unit is sorted."""
    known = v >= 0
    units = np.unique(unit[known])
    size = len(idf)
    code, tf = np.unique(np.searchsorted(units, unit[known]) * size + v[known], return_counts=True)
    at, word = code // size, code % size
    w = tf * idf[word]
    alien = np.searchsorted(units, unit[~known])
    inside = alien < len(units)
    alien = alien[inside][units[alien[inside]] == unit[~known][inside]]
    norm = np.sqrt(np.bincount(at, w * w, len(units)) + rare * rare * np.bincount(alien, minlength=len(units)))
    cos = np.stack([np.bincount(at, w * row[word], len(units)) for row in weights]) / norm
    best = cos.argmax(axis=0)
    return units, cos[best, np.arange(len(units))], best


def matches(files: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """files (all columns; the text last, named text) with __line_score, __line_template, __whole_score and __whole_template."""
    arrow_rows(files.sparkSession)
    vocabulary = Vocabulary(templates)
    n, df = document_frequencies(files.select("text"), vocabulary)
    idf, rare = np.log((1 + n) / (1 + df)) + 1, float(np.log(1 + n) + 1)
    weights = vocabulary.tf * idf
    weights /= np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-300)
    names = vocabulary.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, j, data, off in slices(batch.column("text")):
                score, which = np.zeros((2, j - i)), np.full((2, j - i), -1)
                h, starts, woff = _hashed(data, off)
                v = vocabulary.find(h)
                row = np.repeat(np.arange(j - i), np.diff(woff))
                if (v >= 0).any():
                    line = np.searchsorted(np.sort(np.concatenate([np.flatnonzero(data == 10), off[1:-1]])), starts, "right")
                    for k, unit in enumerate((line, row)):
                        units, cos, best = _best(unit, v, idf, rare, weights)
                        own = row[np.searchsorted(unit, units)]
                        order = np.lexsort((best, -cos, own))
                        first = order[np.unique(own[order], return_index=True)[1]]
                        score[k, own[first]], which[k, own[first]] = cos[first], best[first]
                for k in range(2):
                    out[2 * k] += score[k].tolist()
                    out[2 * k + 1] += [names[x] if x >= 0 else None for x in which[k].tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, t) for x, t in zip(out, (pa.float64(), pa.string()) * 2, strict=True))], names=[*batch.schema.names[:-1], "__line_score", "__line_template", "__whole_score", "__whole_template"])

    more = [T.StructField(n, t) for n, t in (("__line_score", T.DoubleType()), ("__line_template", T.StringType()), ("__whole_score", T.DoubleType()), ("__whole_template", T.StringType()))]
    return files.mapInArrow(run, T.StructType([f for f in files.schema.fields if f.name != "text"] + more))


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, *, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """files, without the text, with license, score, origin (header, file, inherited or none) and license_path.

    score is the cosine of the file's own best unit; license_path is the licence file that an inherited licence is of.
    """
    kept, source = _source(files, path_col, text_col)
    path = F.col("path")
    found = materialise(matches(source, templates), "licences")
    header = F.col("__line_score") >= HEADER
    whole = F.col("__whole_score") >= WHOLE
    is_file = whole | (header & F.substring_index(path, "/", -1).rlike(NAMES))
    own = F.when(whole & (F.col("__whole_score") >= F.col("__line_score")), F.col("__whole_template")).when(header, F.col("__line_template")).when(whole, F.col("__whole_template"))
    return inherit(found, kept, own, is_file, F.greatest("__line_score", "__whole_score"))


def _source(files: DataFrame, path_col: str, text_col: str) -> tuple[list[str], DataFrame]:
    """The names that are kept, and (row, path, text) of files."""
    kept = [c for c in files.columns if c not in (text_col, "license", "score", "origin", "license_path")]
    return kept, files.select(packed(kept), column(path_col).cast("string").alias("path"), column(text_col).cast("string").alias("text"))


def inherit(found: DataFrame, kept: list[str], own: Column, is_file: Column, score: Column) -> DataFrame:
    """kept columns of found(row, path, ...) with license, score, origin and license_path; own, is_file and score are said of found's rows.

    A directory's nearest licence file is written before files are joined with it, so that a hot directory can be split.
    """
    path = F.col("path")
    slash = F.length(path) - F.instr(F.reverse(path), "/")
    found = found.withColumn("__directory", F.when(F.instr(path, "/") > 0, F.substring(path, F.lit(1), slash)).when(path.isNotNull(), ""))
    found = found.withColumns({"__own": own, "__is_file": F.coalesce(is_file, F.lit(False))})

    given = found.filter(F.col("__is_file") & F.col("__directory").isNotNull()).groupBy("__directory").agg(F.min(F.struct(path.alias("p"), F.col("__own").alias("l"))).alias("__given")).withColumnRenamed("__directory", "__above")
    parts = F.split("__directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("__directory") == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    ancestors = found.select("__directory").filter("__directory is not null").distinct().select("__directory", F.explode(above).alias("__above"))
    nearest = ancestors.join(given, "__above").groupBy("__directory").agg(F.max_by("__given", F.length("__above")).alias("__given"))
    out = found.join(materialise(nearest, "nearest"), "__directory", "left")
    return out.select(
        *unpacked(kept).values(),
        F.coalesce("__own", "__given.l").alias("license"),
        score.alias("score"),
        F.when(F.col("__own").isNotNull(), F.when(F.col("__is_file"), "file").otherwise("header")).when(F.col("__given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("__own").isNull(), F.col("__given.p")).alias("license_path"),
    )
