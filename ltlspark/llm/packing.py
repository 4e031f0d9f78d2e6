"""Operator 8: bounded-space online packing of documents into token sequences.

Each scan partition keeps a fixed number of open windows. A document's tail (what
is left after whole windows are cut off it) goes to the window that it fills best;
where none has room, the fullest window is filled up with the front of it and
emitted, and the rest goes on. At its end a partition pours its open windows
together, so at most one is left over; leftovers meet in groups of a fixed number
of partitions, and what a group has over is cut into lengths that are powers of
two, which need no padding. So nothing is padded, whatever the input.

Sequence ids depend on the scan's partitions alone: the input must be deterministic
(a table), as a lost task is run again. The packed pieces are written once to the
shared folder; the small second step reads them from there.

Null and empty texts are one piece with the end id. Null ids stay null; repeated
rows are packed each. Special tokens written out in a text get their own ids, as
the tokenizer has it. Texts of any length are read whole; ties in the best fit go to
the window that was opened first. An empty table gives no row. Extra columns are
ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_rows, materialise
from .text import Memo, packed_ids, release, runs, with_missing, word_dictionary

#: Distinct words and parts of words whose ids a worker keeps; beyond that the older half goes.
WORDS_KEPT = 800_000
#: Partitions whose leftovers meet in one task: 4 bytes x max_len each at most.
GROUP = 512

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left", pa.int64())])


class WordTokens:
    """Ids of whole texts by a tokenizer that never merges over white space: each distinct word is encoded once.

    Words of plain Latin letters and signs are parted by the tokenizer's own pattern,
    so that "word," costs nothing once "word" and "," are known; their parts go to the
    tokenizer many to a text, and the end-of-word mark of a part's last token tells
    them apart. Other words go to it one by one.
    """

    def __init__(self, path: str, end_of_word: str = "</w>"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.memo = Memo(WORDS_KEPT)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        self.parts = regex.compile(next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split")).findall
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for w, i in names.items() if w.endswith(end_of_word)]] = True

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(parts), 2048):
            own = parts[at : at + 2048]
            ids = np.array(self.bare.encode_batch_fast(["\n".join(own)], add_special_tokens=False)[0].ids, "<i4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) != len(own):
                raise ValueError("a part of a word is more than one to the tokenizer")
            raw = ids.tobytes()
            out += [raw[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are not known, which they are from then on."""
        parts: dict[str, bytes | None] = {"": b""}
        split, odd = [], []
        for w in words:
            low = w.lower()
            if not w.isascii() and (max(w) >= "\u0130" or max(low) >= "\u0180"):
                odd.append(w)
            elif low.isalpha():
                parts[low] = None
                if low != w:
                    split.append((w, (low,)))
            elif "<" in w and any(x in w for x in self.special):
                odd.append(w)
            elif w:
                split.append((w, own := self.parts(low)))
                for x in own:
                    parts[x] = None
        found = self.memo.known_bytes(pa.array(list(parts), pa.large_string()))
        parts = dict(zip(parts, found, strict=True)) | {"": b""}
        new = [x for x, ids in parts.items() if ids is None]
        parts |= zip(new, self._encode_parts(new), strict=True)
        whole = {w: b"".join([parts[x] for x in own]) for w, own in split}
        for at in range(0, len(odd), 4096):
            own = odd[at : at + 4096]
            whole |= {w: np.array(x.ids, "<i4").tobytes() for w, x in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True)}
        parts |= whole
        fresh = [*new, *whole]
        self.memo.keep(pa.array(fresh, pa.large_string()), *packed_ids([parts[x] for x in fresh]))
        return parts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and each row's first (offsets)."""
        codes, words, woff = word_dictionary(texts)
        known = self.memo.known(words)
        if len(missing := np.flatnonzero(known[2] < 0)):
            names = words.take(pa.array(missing)).to_pylist()
            learnt = self._learn(names)
            known = with_missing(known, missing, *packed_ids([learnt[w] for w in names]))
        ids, first, size = known
        ids, starts = runs(ids, first[codes], size[codes])
        return ids, starts[woff]


@lru_cache(1)
def word_tokens(path: str) -> WordTokens:
    """One for a worker process: what it has learnt serves its later tasks."""
    return WordTokens(path)


class Window:
    __slots__ = ("pieces", "used")

    def __init__(self):
        self.pieces: list[tuple] = []
        self.used = 0

    def put(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.used += len(piece[2])


def _cut(piece: tuple, at: int) -> tuple[tuple, tuple]:
    doc, start, ids, n = piece
    return (doc, start, ids[:at], n), (doc, start + at, ids[at:], n)


class Packer:
    """Best fit over a fixed number of open windows; emits whole windows by sink(window)."""

    def __init__(self, max_len: int, n_open: int, sink):
        self.max_len, self.n_open, self.sink, self.open = max_len, n_open, sink, []

    def add(self, piece: tuple) -> None:
        while len(piece[2]) >= self.max_len:
            head, piece = _cut(piece, self.max_len)
            whole = Window()
            whole.put(head)
            self.sink(whole)
        while len(piece[2]):
            need = len(piece[2])
            fit = max((w for w in self.open if w.used + need <= self.max_len), key=lambda w: w.used, default=None)
            if fit is None and len(self.open) < self.n_open:
                self.open.append(fit := Window())
            if fit is None:
                fit = max(self.open, key=lambda w: w.used)
                head, piece = _cut(piece, self.max_len - fit.used)
                fit.put(head)
            else:
                fit.put(piece)
                piece = _cut(piece, need)[1]
            if fit.used == self.max_len:
                self.open.remove(fit)
                self.sink(fit)

    def pour(self) -> Window:
        """Pour the open windows together; what is left over is less than one."""
        rest = sorted(self.open, key=lambda w: -w.used)
        into, self.open = Window(), []
        for w in rest:
            for piece in w.pieces:
                while into.used + len(piece[2]) >= self.max_len:
                    head, piece = _cut(piece, self.max_len - into.used)
                    into.put(head)
                    self.sink(into)
                    into = Window()
                if len(piece[2]):
                    into.put(piece)
        return into


def _rows(window: Window, sequence: int | None, left: int | None) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, n in window.pieces:
        yield doc, start, len(ids), ids.tobytes(), n, sequence, offset, left
        offset += len(ids)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, max_len: int = 4096, n_open: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: SCHEMA; ids are little-endian unsigned 32-bit.

    The rows of a sequence_id, in order of offset, make up one sequence of max_len
    ids, or of a power of two below it for the last few of each group of partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pid, out, n = word_tokens(tokenizer_path), TaskContext.get().partitionId(), [], 0

        def sink(window: Window) -> None:
            nonlocal n
            out.extend(_rows(window, (pid << 32) + n, None))
            n += 1

        packer = Packer(max_len, n_open, sink)
        for batch in batches:
            step = 2048
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, off = tokens.encode(part.column(1))
                for k, doc in enumerate(part.column(0).to_pylist()):
                    own = np.append(ids[off[k] : off[k + 1]], np.int32(end_id))
                    packer.add((doc, 0, own, len(own)))
                if out:
                    yield _batch(out)
                    out.clear()
        if (rest := packer.pour()).used:
            out.extend(_rows(rest, None, pid))
        if out:
            yield _batch(out)
        release()

    def merge(key: tuple, leftovers: pa.Table) -> pa.Table:
        group, out, n = key[0].as_py(), [], 0

        def sink(window: Window) -> None:
            nonlocal n
            out.extend(_rows(window, (1 << 62) + (group << 32) + n, None))
            n += 1

        packer = Packer(max_len, 1, sink)
        packer.open = [Window()]
        for r in leftovers.sort_by([("left", "ascending"), ("offset", "ascending")]).to_pylist():
            packer.open[0].put((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<i4"), r["doc_tokens"]))
        rest = packer.pour()
        while rest.used:
            size, part, over = 1 << (rest.used.bit_length() - 1), Window(), Window()
            for piece in rest.pieces:
                head, tail = _cut(piece, size - part.used)
                if len(head[2]):
                    part.put(head)
                if len(tail[2]):
                    over.put(tail)
            sink(part)
            rest = over
        return pa.Table.from_batches([_batch(out)]).drop_columns("left")

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    arrow_rows(docs.sparkSession)
    pieces = materialise(source.mapInArrow(run, SCHEMA + ", left long"), "packed")
    whole = pieces.filter(F.col("left").isNull()).drop("left")
    over = pieces.filter(F.col("left").isNotNull()).withColumn("g", F.floor(F.col("left") / GROUP)).groupBy("g").applyInArrow(merge, SCHEMA)
    return whole.unionByName(over)
