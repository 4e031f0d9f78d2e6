"""Operator 10 with full licence texts: headers as windows of words, licence files by their whole text.

A header template of n words is compared with the next n words (or as many as are
left) from every word of a file, so line breaks, comment signs and text around a
header do not count. Titles and SPDX lines must agree in every word; sentences and
notices from HEADER on. A file is a licence file where its whole text is like a text
or sentence from WHOLE on (it then has that licence, whatever licences its text
mentions), or where it has a header and is named as one. Directories, nulls and ties
are as in licenses; score is that of the unit that gave the file its own licence, and
null without one.

Weights are inverse document frequencies of all words over all files. The HEAD most
frequent words and the templates' are sent to the executors; the rest count there at
the least weight they can have, which only raises a cosine, and where a unit with
such words may reach its threshold their counts are joined, so no count is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import arrow_rows, materialise
from .licenses import HEADER, NAMES, TEMPLATES, WHOLE, Vocabulary, _hashed, _source, inherit
from .lm import head_from
from .text import slices

# Texts and headers of well-known licences.
TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
NOTICES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
} | {
    name: f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    for name, what, kind, version in (("GPL-2.0", "program", "General", "2"), ("GPL-3.0", "program", "General", "3"), ("LGPL-2.1", "library", "Lesser General", "2.1"), ("LGPL-3.0", "library", "Lesser General", "3"))
}
TITLES = {
    "Apache-2.0": ["Apache License Version 2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "GPL-2.0": ["GNU General Public License version 2", "GPLv2 license"],
    "GPL-3.0": ["GNU General Public License version 3", "GPLv3 license"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
}
#: What a title must reach: all its words and no other.
SAME = 1 - 1e-9
#: Texts of at most so many words are headers too.
LONGEST_HEADER = 300
#: Windows whose words are counted at once.
CHUNK = 4096
#: Most frequent words that are sent to the executors, and words that a task counts before it gives them on.
HEAD, HELD = 500_000, 1 << 20


def templates() -> list[tuple[str, str, float, bool]]:
    """(name, text, what a window must reach or infinity, whether whole files are compared with it), by name."""
    out = [(n, t, HEADER, True) for n, t in [*TEMPLATES.items(), *NOTICES.items()]]
    out += [(n, t, HEADER if len(t.split()) <= LONGEST_HEADER else np.inf, True) for n, t in TEXTS.items()]
    out += [(n, t, SAME, False) for n, titles in TITLES.items() for t in [*titles, f"SPDX-License-Identifier: {n}"]]
    return sorted(out, key=lambda x: x[0])


def word_counts(files: DataFrame) -> DataFrame:
    """(h, n): in how many of files(text) each word occurs; h null has the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(h, n):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        rows, held, n = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            rows += batch.num_rows
            for _, _, data, off in slices(batch.column(0)):
                h, _, woff = _hashed(data, off)
                kinds, code = np.unique(h, return_inverse=True)
                row = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
                new = np.bincount(np.unique(row * max(len(kinds), 1) + code) % max(len(kinds), 1), minlength=len(kinds))
                held, at = np.unique(np.concatenate([held, kinds]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, new]), len(held)).astype(np.int64)
                if len(held) > HELD:
                    yield given(held, n)
                    held, n = held[:0], n[:0]
        yield given(held, n)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows])], names=["h", "n"])

    return files.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Scanner:
    """Templates with the weights of words; words that are not among hashes weigh low at least."""

    def __init__(self, found: list[tuple[str, str, float, bool]], vocabulary: Vocabulary, hashes: np.ndarray, idf: np.ndarray, low: float):
        self.names = [n for n, *_ in found]
        self.least = np.array([x for _, _, x, _ in found])
        self.whole = np.flatnonzero([w for *_, w in found])
        self.vocabulary, self.hashes, self.idf, self.low = vocabulary, hashes, idf, low
        self.words = vocabulary.tf.sum(axis=1).astype(int)
        self.unit = vocabulary.tf * idf[np.searchsorted(hashes, vocabulary.hashes)]
        self.unit /= np.maximum(np.linalg.norm(self.unit, axis=1, keepdims=True), 1e-300)

    def best(self, data: np.ndarray, off: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[list[dict]]]:
        """(best cosine or 0, its template or -1) of each text, of its windows and of the whole; and units that other words decide."""
        n = len(off) - 1
        h, _, woff = _hashed(data, off)
        row = np.repeat(np.arange(n), np.diff(woff))
        kinds, code = np.unique(h, return_inverse=True)
        v = self.vocabulary.find(kinds)
        at = np.minimum(np.searchsorted(self.hashes, kinds), len(self.hashes) - 1)
        tail = self.hashes[at] != kinds
        idf = np.where(tail, self.low, self.idf[at])
        out, undecided = [], [[] for _ in range(n)]
        for whole, (own, which, cos, dot, words) in enumerate((self._windows(row, woff, code, v, idf, tail), self._wholes(row, code, v, idf, tail))):
            score, template = np.zeros(n), np.full(n, -1)
            sure = np.array([w is None for w in words], bool)
            o, w, c = own[sure], which[sure], cos[sure]
            order = np.lexsort((w, -np.round(c, 12), o))
            first = order[np.unique(o[order], return_index=True)[1]]
            score[o[first]], template[o[first]] = c[first], w[first]
            out.append((score, template))
            for k in np.flatnonzero(~sure):
                if cos[k] >= score[own[k]] - 1e-9:
                    code_of, tf, norm = words[k]
                    undecided[own[k]].append({"whole": bool(whole), "name": self.names[which[k]], "least": WHOLE if whole else float(self.least[which[k]]), "dot": float(dot[k]), "norm": norm, "tail": [{"h": int(x), "tf": int(y)} for x, y in zip(kinds[code_of].view(np.int64), tf, strict=True)]})
        return out, undecided

    def _windows(self, row, woff, code, v, idf, tail):
        """(text, template, cosine, dot product, words outside the head) of the windows that may reach their template's threshold."""
        mass = np.append(0, np.cumsum((idf * idf)[code]))
        end = woff[1:][row]
        start = np.arange(len(code))
        found = _Found()
        by: dict[int, tuple] = {}
        for t in np.flatnonzero(self.least <= 1):
            size = int(self.words[t])
            if size not in by:
                stop = np.minimum(start + size, end)
                by[size] = stop, np.sqrt(np.maximum(mass[stop] - mass[:-1], 0))
            stop, norm = by[size]
            weight = np.where(v >= 0, idf * self.unit[t][v], 0)[code]
            dot = np.append(0, np.cumsum(weight))
            # The norm without repetitions is at most the true one, so nothing is lost here.
            at = np.flatnonzero((dot[stop] - dot[:-1] >= self.least[t] * norm - 1e-6 * (1 + norm)) & (weight > 0))
            for k in range(0, len(at), CHUNK):
                here = at[k : k + CHUNK]
                size_of = stop[here] - here
                unit = np.repeat(np.arange(len(here)), size_of)
                place = np.arange(size_of.sum()) - np.repeat(np.cumsum(size_of) - size_of, size_of) + here[unit]
                found.add(t, self.least[t], row[here], unit, code[place], np.bincount(unit, weight[place], len(here)), idf, tail)
        return found.all()

    def _wholes(self, row, code, v, idf, tail):
        """The same of whole texts that may reach WHOLE."""
        n = int(row[-1]) + 1 if len(row) else 0
        size = max(len(idf), 1)
        pair, tf = np.unique(row * size + code, return_counts=True)
        own, word = pair // size, pair % size
        w = tf * idf[word]
        norm = np.sqrt(np.bincount(own, w * w, n))
        known = v[word] >= 0
        own, w, word = own[known], w[known], v[word[known]]
        first = np.searchsorted(row, np.arange(n + 1))
        found = _Found()
        for t in self.whole:
            dot = np.bincount(own, w * self.unit[t][word], n)
            at = np.flatnonzero(dot >= WHOLE * norm * (1 - 1e-9)) if n else np.zeros(0, int)
            for text in at[norm[at] > 0]:
                words = code[first[text] : first[text + 1]]
                found.add(t, WHOLE, np.array([text]), np.zeros(len(words), int), words, dot[[text]], idf, tail)
        return found.all()


class _Found:
    """Units that may be like a template."""

    def __init__(self):
        self.parts, self.words = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))], []

    def add(self, t, least, own, unit, code, dot, idf, tail) -> None:
        pair, tf = np.unique(unit * len(idf) + code, return_counts=True)
        unit, code = pair // len(idf), pair % len(idf)
        mass, out = (tf * idf[code]) ** 2, tail[code]
        cos = dot / np.sqrt(np.bincount(unit, mass, len(own)))
        inside = np.bincount(unit[~out], mass[~out], len(own))
        keep = np.flatnonzero(cos >= least - (1e-12 if least < SAME else 0))
        self.parts.append((own[keep], np.full(len(keep), t), cos[keep], dot[keep]))
        edge = np.searchsorted(unit, np.arange(len(own) + 1))
        for k in keep:
            part = slice(edge[k], edge[k + 1])
            self.words.append((code[part][out[part]], tf[part][out[part]], float(inside[k])) if out[part].any() else None)

    def all(self):
        return *(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.words


def matches(files: DataFrame) -> tuple[DataFrame, DataFrame, int, bool]:
    """Units, counts of words, number of files, and whether all words are in the head.

    Units are files (all columns; the text last, named text) with __line_score, __line_template, __whole_score,
    __whole_template and __undecided.
    """
    spark = files.sparkSession
    arrow_rows(spark)
    found = templates()
    vocabulary = Vocabulary({k: t for k, (_, t, *_) in enumerate(found)})
    counts = materialise(word_counts(files.select("text")), "words")
    n = (counts.filter("h is null").first() or {"n": 0})["n"]
    counts = counts.filter("h is not null")
    least, complete = head_from(counts, "n", HEAD)
    below = least - 1
    named = spark.createDataFrame([(int(x),) for x in vocabulary.hashes.view(np.int64)], "h long")
    got = [counts.filter(F.col("n") > below).toArrow(), counts.join(F.broadcast(named), "h", "left_semi").toArrow()]
    h = np.concatenate([*(t["h"].to_numpy().view(np.uint64) for t in got), vocabulary.hashes])
    hashes, first = np.unique(h, return_index=True)
    df = np.concatenate([*(t["n"].to_numpy() for t in got), np.zeros(len(vocabulary.hashes))])[first]
    sent = spark.sparkContext.broadcast(Scanner(found, vocabulary, hashes, np.log((1 + n) / (1 + df)) + 1, float(np.log((1 + n) / (1 + below)) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for _, _, data, off in slices(batch.column("text")):
                sure, undecided = scanner.best(data, off)
                for k, (score, which) in enumerate(sure):
                    out[2 * k] += score.tolist()
                    out[2 * k + 1] += [scanner.names[x] if x >= 0 else None for x in which.tolist()]
                out[4] += undecided
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, t) for x, t in zip(out, (pa.float64(), pa.string(), pa.float64(), pa.string(), _UNDECIDED), strict=True))], names=[*batch.schema.names[:-1], *(f.name for f in more)])

    more = [T.StructField(f"__{unit}_{what}", t) for unit in ("line", "whole") for what, t in (("score", T.DoubleType()), ("template", T.StringType()))]
    more.append(T.StructField("__undecided", T.ArrayType(T._parse_datatype_string("struct<whole: boolean, name: string, least: double, dot: double, norm: double, tail: array<struct<h: bigint, tf: bigint>>>"))))
    return files.mapInArrow(run, T.StructType([f for f in files.schema.fields if f.name != "text"] + more)), counts, n, complete


_UNDECIDED = pa.list_(pa.struct([("whole", pa.bool_()), ("name", pa.string()), ("least", pa.float64()), ("dot", pa.float64()), ("norm", pa.float64()), ("tail", pa.list_(pa.struct([("h", pa.int64()), ("tf", pa.int64())])))]))


def decided(found: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """found, with the counts of the words outside the head joined to the units that hang on them."""
    units = found.select("__rid", F.posexplode("__undecided").alias("__pos", "u"))
    tails = units.select("__rid", "__pos", F.explode("u.tail").alias("t")).select("__rid", "__pos", F.col("t.h").alias("h"), F.col("t.tf").alias("tf"))
    idf = F.log(F.lit(1.0 + n) / (1 + F.col("n"))) + 1
    mass = tails.join(counts, "h").groupBy("__rid", "__pos").agg(F.sum((F.col("tf") * idf) ** 2).alias("mass"))
    cos = units.join(mass, ["__rid", "__pos"]).select("__rid", "u.whole", "u.name", "u.least", (F.col("u.dot") / F.sqrt(F.col("u.norm") + F.col("mass"))).alias("cos")).filter("cos >= least")
    order = F.struct((-F.round("cos", 12)).alias("c"), F.col("name"), F.col("cos").alias("score"))
    best = cos.groupBy("__rid").agg(F.min(F.when(~F.col("whole"), order)).alias("__new_line"), F.min(F.when(F.col("whole"), order)).alias("__new_whole"))
    out = found.join(best, "__rid", "left")
    for unit in ("line", "whole"):
        old = F.when(F.col(f"__{unit}_template").isNotNull(), F.struct((-F.round(f"__{unit}_score", 12)).alias("c"), F.col(f"__{unit}_template").alias("name"), F.col(f"__{unit}_score").alias("score")))
        both = F.array_min(F.array_compact(F.array(old, f"__new_{unit}")))
        out = out.withColumn("__both", both).withColumns({f"__{unit}_score": F.col("__both.score"), f"__{unit}_template": F.col("__both.name")})
    return out


def scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """files, without the text, with license, score, origin (header, file, inherited or none) and license_path."""
    kept, source = _source(files, path_col, text_col)
    units, counts, n, complete = matches(source)
    found = materialise(units.withColumn("__rid", F.monotonically_increasing_id()), "licences")
    if not complete:
        found = decided(found, counts, n)
    own = F.coalesce("__whole_template", "__line_template")
    score = F.when(F.col("__whole_template").isNotNull(), F.col("__whole_score")).when(F.col("__line_template").isNotNull(), F.col("__line_score"))
    named = F.substring_index(F.col("path"), "/", -1).rlike(NAMES)
    is_file = F.col("__whole_template").isNotNull() | (F.col("__line_template").isNotNull() & named)
    return inherit(found, kept, own, is_file, score)
