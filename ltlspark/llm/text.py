"""Words of Arrow string columns as numpy arrays.

Words are the runs of bytes other than space and 0x09-0x0D. Text never becomes
Python strings: the UTF-8 buffer of a column is looked at in place, in slices of
bounded size, so memory follows the slice (or the longest single text), not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S = {i: np.uint64(i) for i in (27, 30, 31)}


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    h = (h ^ (h >> _S[30])) * _K2
    h = (h ^ (h >> _S[27])) * _K3
    return h ^ (h >> _S[31])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of rows of at most limit bytes, or of one row."""
    data, off = buffers(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)


def word_spans(data: np.ndarray, off: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's first word (offsets, one more than rows).

    between flags the bytes that part words.
    """
    inside = ~between[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = off[1:] > off[:-1]
    first, last = off[:-1][full], off[1:][full] - 1
    start[first], end[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes a step."""
    size = ends - starts
    h = mix(size.astype(np.uint64) + _K1 + np.uint64(seed))
    if not len(starts):
        return h
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, at, left = slice(None), starts, size
    while True:
        part = eight[at] & _MASK[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ part) * _K1 + _K2)
        more = left > 8
        if not more.any():
            return h
        live = np.flatnonzero(more) if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8


def gram_hashes(words: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the n words from each position in at."""
    base = _K1 + np.uint64(2 * seed)
    h = np.full(len(at), seed + n, np.uint64)
    for j in range(n):
        h = h * base + words[at + j]
    return mix(h)


def gram_starts(woff: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which n words of one row start, and the row of each."""
    count = np.maximum(np.diff(woff) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + woff[row], row


def row_shingles(words: np.ndarray, woff: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every n-word shingle; a row with fewer words has its whole sequence as one, without words none."""
    at, row = gram_starts(woff, n)
    h = gram_hashes(words, at, n, seed)
    size = np.diff(woff)
    if len(short := np.flatnonzero((size > 0) & (size < n))):
        extra = np.empty(len(short), np.uint64)
        for k in range(1, n):
            of = size[short] == k
            extra[of] = gram_hashes(words, woff[:-1][short[of]], k, seed)
        h, row = np.concatenate([h, extra]), np.concatenate([row, short])
    return h, row


def word_dictionary(column: pa.Array, lowered: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all words of a string column, the distinct words, and each row's first word (offsets)."""
    data, off = buffers(column)
    raw = data.tobytes()
    if lowered:
        raw = raw.translate(_LOWER)
    n = len(off) - 1
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off), pa.py_buffer(raw)])
    parts = pc.ascii_split_whitespace(texts.view(pa.large_string()))
    flat, loff = parts.values, parts.offsets.to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        loff = np.concatenate([[0], np.cumsum(keep)])[loff]
        codes = codes[keep]
    return codes, coded.dictionary, loff.astype(np.int64)


def release() -> None:
    """Give memory that is free in this worker back to the machine: a worker outlives its task and waits with what it has."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def runs(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ids[first : first + size] end to end, and where each starts (one more than runs)."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return ids[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])], ends


class Memo:
    """Ids of distinct words, by 128-bit hashes, in generations of sorted arrays: a million words take some 50 MB.

    What a batch adds is merged with what is at most twice its size, so a word is moved
    a logarithmic number of times, and a lookup costs by the batch, not by the memo. At half
    the limit what is older goes.
    """

    def __init__(self, limit: int):
        self.limit, self.older, self.newer = limit, [], []

    def __len__(self) -> int:
        return sum(len(g[0]) for g in self.older + self.newer)

    @staticmethod
    def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = buffers(words)
        return word_hashes(data, off[:-1], off[1:]), word_hashes(data, off[:-1], off[1:], 1)

    def known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and each word's first among them and its number of them; the number is -1 for a word that is not known."""
        first, size, held, n = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64), [np.zeros(0, "<i4")], 0
        h, g = self._hashes(words)
        order = np.argsort(h)
        for low, high, at, many, ids in self.newer[::-1] + self.older[::-1]:
            k = np.minimum(np.searchsorted(low, h[order]), len(low) - 1)
            hit = (low[k] == h[order]) & (high[k] == g[order])
            own, k = order[hit], k[hit]
            found, ends = runs(ids, at[k], many[k])
            first[own], size[own] = n + ends[:-1], many[k]
            held.append(found)
            n += len(found)
            order = order[~hit]
        return np.concatenate(held), first, size

    def known_bytes(self, words: pa.Array) -> list[bytes | None]:
        ids, first, size = self.known(words)
        raw = ids.tobytes()
        return [raw[x : x + n] if n >= 0 else None for x, n in zip((4 * first).tolist(), (4 * size).tolist(), strict=True)]

    def keep(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        """New words with their ids, which lie end to end."""
        if not len(words):
            return
        low, high = self._hashes(words)
        now = self._sorted(low, high, np.cumsum(size) - size, size, ids)
        while self.newer and len(self.newer[-1][0]) <= 2 * len(now[0]):
            before = self.newer.pop()
            at = np.concatenate([before[2], now[2] + len(before[4])])
            now = self._sorted(*(np.concatenate([x, y]) for x, y in zip(before[:2], now[:2], strict=True)), at, *(np.concatenate([x, y]) for x, y in zip(before[3:], now[3:], strict=True)))
        self.newer.append(now)
        if sum(len(x[0]) for x in self.newer) > self.limit // 2:
            self.older, self.newer = self.newer, []

    @staticmethod
    def _sorted(low, high, at, size, ids) -> tuple:
        order = np.argsort(low)
        return low[order], high[order], at[order], size[order], ids


def packed_ids(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids end to end, and how many each part has."""
    return np.frombuffer(b"".join(parts), "<i4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


def with_missing(known: tuple, missing: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What Memo.known gave, with the ids of the words that were missing."""
    held, first, many = known
    first[missing], many[missing] = len(held) + np.cumsum(size) - size, size
    return np.concatenate([held, ids]), first, many
