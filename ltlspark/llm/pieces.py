"""Operator 7: encoding and decoding with a SentencePiece vocabulary, streaming.

One Viterbi pass reads characters as they come. An automaton names the pieces that
end at each character; every position of the window holds the last piece of the best
path that ends there. After each chunk the back pointers of the positions that a
later piece may still start from (as many as the longest piece has characters) are
followed until they meet on one boundary; what lies before it is committed, and only
the rest is retained. Two kinds of model, as the vocabulary's file says:

- unigram: the best path has the largest sum of piece scores;
- BPE: the best path is the one that merging gives. A piece may follow another
  exactly if merging the two pieces' characters alone gives back the two; so each
  position has one last piece, the longest that fits what stands before it. (A sum
  of BPE scores, which are ranks, would give other ids.)

White space becomes the mark U+2581, a text that is not empty gets one in front,
characters without a piece become their UTF-8 bytes' pieces, and no other
normalisation is done; models that ask for one are refused. Texts are cut where no
piece has the two characters around the cut together (as a rule, before white space
and around signs); of a batch, the distinct segments that a worker's memory does not
know go through the pass one after another.

Null and empty texts have no ids, and texts of any length are read whole. Repeated
rows are encoded each, with equal ids; null ids stay null. An empty table gives no
row. Extra columns are ignored. Decoding joins pieces, turns marks into spaces
and byte pieces into bytes (invalid UTF-8 into U+FFFD), and drops the first mark;
null ids have a null text.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_rows
from .text import Memo, buffers, release, runs, with_missing

MARK = "▁"
#: Distinct segments whose ids a worker keeps, and pairs of pieces.
SEGMENTS_KEPT, PAIRS_KEPT = 600_000, 300_000
#: Characters that the window takes in before it commits.
CHUNK = 1 << 14
#: Parts the segments of a batch: half of a surrogate pair, which no text has.
PART = "\ud800"


class Pieces:
    """A vocabulary: pieces with ids and scores, byte pieces, and the kind of its model."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], *, bpe: bool, unk: int = 0):
        self.scores, self.byte_ids, self.bpe, self.unk = scores, byte_ids, bpe, unk
        self.longest = max(map(len, scores), default=1)
        # what each id stands for; the last entry is for ids that stand for nothing
        self._raw = ["\ufffd".encode()] * (2 + max([i for i, _ in scores.values()] + byte_ids + [unk]))
        for p, (i, _) in scores.items():
            self._raw[i] = p.replace(MARK, " ").encode()
        if any(byte_ids):
            for b, i in enumerate(byte_ids):
                self._raw[i] = bytes([b])
        self._named = {i + 1: p for p, (i, _) in scores.items()}
        self._lengths = {i: len(p) for i, p in self._named.items()}
        self._many, self._pairs, self._automaton = len(self._raw) + 1, {}, None
        self._size = np.array([len(x) for x in self._raw])
        self.memo = Memo(SEGMENTS_KEPT)
        self._worth = {i + 1: s for i, s in scores.values()}
        self._unknown = min((s for _, s in scores.values()), default=0.0) - 10.0
        # no piece has these two ASCII characters (a space is the mark) together: a text may be cut between them
        self._cut = np.zeros((256, 256), bool)
        self._cut[:128, :128] = True
        for p in scores:
            for x, y in zip(p[:-1].replace(MARK, " "), p[1:].replace(MARK, " "), strict=True):
                if x < "\x80" and y < "\x80":
                    self._cut[ord(x), ord(y)] = False

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "aÅﬁ  b "
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("the model normalises its input")
        scores, byte_ids = {}, [0] * 256
        for i in range(model.vocab_size()):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                scores[model.id_to_piece(i)] = (i, model.get_score(i))
        return cls(scores, byte_ids, bpe=model_type(path) == 2, unk=model.unk_id())

    def merge(self, text: str) -> list[str]:
        """Plain BPE merging, for short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                hit = self.scores.get(parts[k] + parts[k + 1])
                if hit is not None and (best is None or hit[1] > best):
                    best, at = hit[1], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stream(self, chunks: Iterable[str], retained: list[int] | None = None) -> Iterator[int]:
        """Ids of a text that comes in chunks of any size; retained, if given, collects the window's sizes after each commit.

        A PART has the id -1, and what follows it is a text of its own.
        """
        for ids in self._commits(chunks, retained):
            yield from ids

    def _commits(self, chunks: Iterable[str], retained: list[int] | None = None) -> Iterator[list[int]]:
        """Lists of ids, as they are committed."""
        # last: the number of the last piece of the best path to each boundary of the window, 0 for a character without one
        window, last, score = "", [0], [0.0]
        extend = self._extend_bpe if self.bpe else self._extend_unigram
        for chunk in chunks:
            for at in range(0, len(chunk), CHUNK):
                part = chunk[at : at + CHUNK]
                # a piece that ends in the new part starts within the window; what it may have there is read again
                start = max(0, len(window) - self.longest + 1)
                text = window[start:] + part
                extend(self._ending().iter(text), start, len(part), last, score)
                window += part
                if common := self._meeting(last, len(window)):
                    yield self._path(window, last, common)
                    window, last = window[common:], last[common:]
                    score = [s - score[common] for s in score[common:]]
                if retained is not None:
                    retained.append(len(window))
        yield self._path(window, last, len(window))

    def _extend_bpe(self, walk: Iterator, start: int, n: int, last: list[int], score: list[float]) -> None:
        done = len(last)
        last += [0] * n
        known, many = self._pairs.get, self._many
        start += 1
        for end, (size, piece) in walk:
            j = end + start
            if not last[j] and j >= done:
                prior = last[j - size]
                if prior and not ((ok := known(prior * many + piece)) or (ok is None and self._pair(prior, piece))):
                    continue
                last[j] = piece

    def _extend_unigram(self, walk: Iterator, start: int, n: int, last: list[int], score: list[float]) -> None:
        done, unknown, worth = len(last), self._unknown, self._worth
        for end, (size, piece) in walk:
            if (j := end + 1 + start) >= done:
                while len(last) <= j:
                    last.append(0)
                    score.append(score[-1] + unknown)
                if (value := score[j - size] + worth[piece]) > score[j]:
                    last[j], score[j] = piece, value
        while len(last) < done + n:
            last.append(0)
            score.append(score[-1] + unknown)

    def _meeting(self, last: list[int], end: int) -> int:
        """The boundary at which the paths back from all open positions first meet."""
        sizes = self._lengths.get
        paths = set(range(max(0, end - self.longest + 1), end + 1))
        while len(paths) > 1:
            j = max(paths)
            paths.remove(j)
            paths.add(j - sizes(last[j], 1))
        return paths.pop()

    def _path(self, window: str, last: list[int], end: int) -> list[int]:
        """Ids of the best path to a boundary."""
        ids, sizes, j = [], self._lengths, end
        while j > 0:
            if piece := last[j]:
                ids.append(piece - 1)
                j -= sizes[piece]
            else:
                j -= 1
                if window[j] == PART:
                    ids.append(-1)
                else:
                    ids += list(self._ids(window[j]))[::-1]
        ids.reverse()
        return ids

    def _pair(self, prior: int, piece: int) -> bool:
        """Whether a piece may stand after another in a BPE encoding."""
        if len(self._pairs) > PAIRS_KEPT:
            self._pairs.clear()
        a, b = self._named[prior], self._named[piece]
        got = self._pairs[prior * self._many + piece] = self.merge(a + b) == [a, b]
        return got

    def _ending(self):
        """Names the pieces that end at each character, longest first; of BPE pieces, those that merging makes."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for p, (i, _) in self.scores.items():
                if not self.bpe or self.merge(p) == [p]:
                    self._automaton.add_word(p, (len(p), i + 1))
            self._automaton.make_automaton()
        return self._automaton

    def _ids(self, piece: str) -> Iterator[int]:
        hit = self.scores.get(piece)
        if hit is not None:
            yield hit[0]
        elif any(self.byte_ids):
            for b in piece.encode("utf-8", "surrogatepass"):
                yield self.byte_ids[b]
        else:
            yield self.unk

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a string column, and each row's first (offsets)."""
        data, off = buffers(column)
        full = off[1:] > off[:-1]
        data = np.insert(data, off[:-1][full], 0x20)  # the mark in front
        off = off + np.concatenate([[0], np.cumsum(full)])
        start = np.zeros(len(data) + 1, bool)
        start[1:-1] = self._cut[data[:-1], data[1:]]
        start[off] = True
        cuts = np.flatnonzero(start)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = raw.dictionary_encode()
        segments, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        known = self.memo.known(segments)
        if len(missing := np.flatnonzero(known[2] < 0)):
            new = segments.take(pa.array(missing))
            ids, size = self._segments([x.decode().replace(" ", MARK) for x in new.to_pylist()])
            known = with_missing(known, missing, ids, size)
            short = np.flatnonzero(pc.binary_length(new).to_numpy() <= 256)
            ends = np.cumsum(size)
            self.memo.keep(new.take(pa.array(short)), runs(ids, (ends - size)[short], size[short])[0], size[short])
        ids, first, size = known
        ids, starts = runs(ids, first[codes], size[codes])
        return ids, starts[np.searchsorted(cuts, off)]

    def _segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments end to end, and how many each has: one pass over all of them."""
        found = array("i")
        for ids in self._commits([PART.join(segments), PART]):
            found.extend(ids)
        ids = np.frombuffer(found, np.int32).astype("<i4")
        part = np.flatnonzero(ids < 0)
        return ids[ids >= 0], np.diff(part, prepend=-1) - 1

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()))[0]

    def decode_rows(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """Texts of rows of ids, which lie end to end from off."""
        top = len(self._raw) - 1
        raw = b"".join(map(self._raw.__getitem__, np.where((ids >= 0) & (ids < top), ids, top).tolist()))
        size = np.append(0, np.cumsum(self._size[np.where((ids >= 0) & (ids < top), ids, top)]))[off].tolist()
        texts = (raw[x:y].decode("utf-8", "replace") for x, y in zip(size[:-1], size[1:], strict=True))
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.fromiter(ids, np.int64)
        return self.decode_rows(ids, np.array([0, len(ids)]))[0]


def model_type(path: str) -> int:
    """trainer_spec.model_type of a model file, 1 unigram (also where it isn't set), 2 BPE, 3 word, 4 character."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model.trainer_spec.model_type


@lru_cache(1)
def loaded(path: str) -> Pieces:
    return Pieces.load(path)


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    arrow_rows(docs.sparkSession, 1024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_path)
        for batch in batches:
            ids, off = pieces.encode_column(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and text of every row of ids; null ids have a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_path)
        for batch in batches:
            rows = batch.column(1)
            size = pc.list_value_length(rows).fill_null(0).to_numpy()
            texts = pieces.decode_rows(rows.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size)))
            texts = pc.if_else(rows.is_null(), pa.scalar(None, pa.string()), pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=["doc_id", "ids", "text"])
        release()

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")
