"""Operator 4: scores of a log-bilinear neural language model, and of a smoothed unigram.

Tokens are words, A-Z lowered, and one end for each text (the empty string here).
Counts of all distinct tokens of all training texts are kept as a table; what is
sent to the executors is its head, the most frequent tokens up to HEAD of at most
HEAD_BYTES bytes each. Rarer tokens meet their counts in a join, by token, so no
count is cut off however many there are.

The model predicts units: the WORDS most frequent tokens, and CLASSES of the rest
by their last two bytes; a token of a class gets its smoothed share of the class.
A unit's context is the two before it. Its score is a dot product of its own vector
and a predicted one, the sum of the context's vectors weighted by place, plus a
bias (a log-bilinear model; Mnih and Hinton, 2007). The training texts, as units,
are dealt into shards of about SHARD tokens by a hash of the row, and the shards into
ROUNDS. Each shard of a round runs noise-contrastive estimation in numpy over all its
tokens, from the average of the round before, the noise of a minibatch shared so that
it is one matrix product; a round's parameters, and Adagrad's memory of their
gradients, are averaged by tokens. Shards, their
order and their random numbers follow from the rows alone, so the model does not
depend on how the table is partitioned (but for the last digits of the averages' sums).
Scores use the full softmax: the log normaliser of each context is a batched matrix
product over all units, made once for a context.

Null and empty texts are one end token. With no training text every count is 0.
Repeated rows are scored each and learnt from each; rows equal in all columns are of
one shard. An empty table gives no row. Extra columns are ignored by the scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_rows, discard, materialise, shuffle_partitions
from .text import buffers, release, slices, word_dictionary

WORDS, CLASSES, DIM = 2048, 256, 16
UNITS = WORDS + CLASSES
#: Context unit before a text's first token.
BEGIN = UNITS
HEAD, HEAD_BYTES = 500_000, 64
SMOOTH = 0.1
#: Tokens of a minibatch, noise samples of one, and the step of Adagrad.
BATCH, NOISE, RATE = 1024, 48, 0.1
#: Tokens of a shard, about; rounds of averaging; and tokens of a shard that are shuffled at once.
SHARD, ROUNDS, MIXED = 1 << 21, 4, 1 << 18
_BLOCK = 4096


def classes_of(words: pa.Array) -> np.ndarray:
    """Class of each word by its last two bytes."""
    data, off = buffers(words)
    data = np.concatenate([np.zeros(2, np.uint8), data]).astype(np.int64)
    size = np.diff(off)
    end = off[1:] + 2
    one = np.where(size > 0, data[end - 1], 0)
    two = np.where(size > 1, data[end - 2], 0)
    return ((one * 257 + two) * 2654435761 >> 13) % CLASSES


def tokens(column: pa.Array, head: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, their place in the head (-1: none) and unit, all tokens as codes (-1: an end), each row's first."""
    codes, words, woff = word_dictionary(column, lowered=True)
    place = pc.index_in(words, value_set=head).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    unit = np.where((place >= 0) & (place < WORDS), place, WORDS + classes_of(words))
    codes = np.insert(codes.astype(np.int64), woff[1:], -1)
    return words, place, unit, codes, woff + np.arange(len(woff))


def contexts(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two units before each."""
    one, two = np.roll(units, 1), np.roll(units, 2)
    begin = first[:-1]
    one[begin], two[begin] = BEGIN, BEGIN
    later = begin + 1
    two[later[later < first[1:]]] = BEGIN
    return one, two


class Net:
    """Parameters: context vectors, unit vectors, biases and the weights of the two places."""

    shapes = ((UNITS + 1, DIM), (UNITS, DIM), (UNITS,), (2, DIM))

    def __init__(self, flat: np.ndarray):
        self.flat, at, parts = flat, 0, []
        for shape in self.shapes:
            n = int(np.prod(shape))
            parts.append(flat[at : at + n].reshape(shape))
            at += n
        self.ctx, self.out, self.bias, self.place = parts

    @classmethod
    def start(cls, share: np.ndarray) -> Net:
        """Small vectors, and biases at the units' log shares."""
        rng = np.random.default_rng(7)
        size = sum(int(np.prod(s)) for s in cls.shapes)
        net = cls((0.2 * rng.standard_normal(size)).astype(np.float32))
        net.bias[:] = np.log(np.maximum(share, 1e-9))
        net.place[0], net.place[1] = 1.0, 0.5
        return net

    def learn(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray, noise: np.ndarray, memory: np.ndarray, rng) -> None:
        """One minibatch of noise-contrastive estimation; noise holds the noise's log shares."""
        drawn = np.searchsorted(np.cumsum(np.exp(noise)), rng.random(NOISE)).clip(0, UNITS - 1)
        c1, c2 = self.ctx[one], self.ctx[two]
        guess = c1 * self.place[0] + c2 * self.place[1]
        own = self.out[unit]
        ratio = np.log(NOISE) + noise
        hit = 1 / (1 + np.exp((guess * own).sum(1) + self.bias[unit] - ratio[unit]))  # 1 - P(data)
        miss = 1 / (1 + np.exp(-(guess @ self.out[drawn].T + self.bias[drawn] - ratio[drawn])))  # P(data) of noise
        n = np.float32(1 / len(unit))
        d_guess = (hit[:, None] * own - miss @ self.out[drawn]) * n
        grad = Net(np.zeros_like(self.flat))
        _scatter(grad.out, unit, hit[:, None] * guess * n)
        np.add.at(grad.out, drawn, -(miss.T @ guess) * n)
        grad.bias += np.bincount(unit, hit * n, UNITS).astype(np.float32)
        np.add.at(grad.bias, drawn, -miss.sum(0) * n)
        _scatter(grad.ctx, one, d_guess * self.place[0])
        _scatter(grad.ctx, two, d_guess * self.place[1])
        grad.place[0], grad.place[1] = (d_guess * c1).sum(0), (d_guess * c2).sum(0)
        memory += grad.flat**2
        self.flat += np.float32(RATE) * grad.flat / (np.sqrt(memory) + np.float32(1e-6))

    def normaliser(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log of the sum over all units of the exponential scores, for contexts."""
        out = np.empty(len(one), np.float32)
        for at in range(0, len(one), 2048):
            part = slice(at, at + 2048)
            s = (self.ctx[one[part]] * self.place[0] + self.ctx[two[part]] * self.place[1]) @ self.out.T + self.bias
            top = s.max(axis=1)
            out[part] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return out


def _scatter(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    for k in range(values.shape[1]):
        to[:, k] += np.bincount(rows, values[:, k], len(to)).astype(np.float32)


#: The log normalisers of one model's contexts, as far as this worker has met them.
_NORMALISERS: dict[str, np.ndarray] = {}


class Scorer:
    """A trained model with the head of the counts, as sent to the executors."""

    def __init__(self, head: pa.Array, counts: np.ndarray, total: int, distinct: int, class_n: np.ndarray, class_v: np.ndarray, flat: np.ndarray):
        self.head, self.counts, self.total, self.distinct, self.flat, self.uid = head, counts, total, distinct, flat, uuid.uuid4().hex
        self.class_log = np.log10(class_n + SMOOTH * (class_v + 1))
        self.base_log = np.log10(total + SMOOTH * (distinct + 1))

    def token_scores(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 P(unit | context), normalised over all units."""
        if self.uid not in _NORMALISERS:
            _NORMALISERS.clear()
            _NORMALISERS[self.uid] = np.full((UNITS + 1) ** 2, np.nan, np.float32)
        net, norm = Net(self.flat), _NORMALISERS[self.uid]
        code = one * (UNITS + 1) + two
        if len(new := np.flatnonzero(np.isnan(norm[code]))):
            new = np.unique(code[new])
            norm[new] = net.normaliser(new // (UNITS + 1), new % (UNITS + 1))
        first, second, out = net.ctx * net.place[0], net.ctx * net.place[1], np.empty(len(unit))
        for at in range(0, len(unit), 1 << 16):
            part = slice(at, at + (1 << 16))
            out[part] = np.einsum("ij,ij->i", first[one[part]] + second[two[part]], net.out[unit[part]]) + net.bias[unit[part]]
        return (out - norm[code]) / np.log(10)


def head_from(counts: DataFrame, column: str, room: int) -> tuple[int, bool]:
    """The least count so that no more than room rows have it or more, and whether those are all rows.

    Counts are binned, eight bins to a doubling, so the driver gets some 500 rows at most; of a bin
    that does not fit as a whole nothing is taken.
    """
    bins = counts.groupBy(F.floor(8 * F.log2(column)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).collect()
    least = max((b["most"] for b in bins), default=0) + 1
    for b in sorted(bins, key=lambda b: -b["bin"]):
        if b["n"] > room:
            return least, False
        room, least = room - b["n"], b["least"]
    return least, True


def token_counts(docs: DataFrame) -> DataFrame:
    """token (the empty string is the end) and its count c over all rows of docs(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, words, _ = word_dictionary(batch.column(0), lowered=True)
            n = np.bincount(codes, minlength=len(words))
            keep = n > 0
            names = pa.concat_arrays([words.filter(pa.array(keep)), pa.array([""], pa.large_string())]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.append(n[keep], batch.num_rows), pa.int64())], names=["token", "n"])

    return docs.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


def _class_sums(head: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        for batch in batches:
            words = batch.column(0).cast(pa.large_string())
            rare = pc.is_null(pc.index_in(words, value_set=head)).to_numpy(zero_copy_only=False)
            own = classes_of(words)[rare]
            n += np.bincount(own, batch.column(1).to_numpy()[rare], CLASSES)
            v += np.bincount(own, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(v)], names=["k", "n", "v"])

    return run


def _units(head: pa.Array):
    """Rows (h, text) as (h, packed units)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, *_ in slices(batch.column("text")):
                _, _, unit, codes, first = tokens(batch.column("text").slice(i, j - i), head)
                units = (np.where(codes < 0, 0, unit[codes]) if len(unit) else np.zeros(len(codes))).astype("<u2")
                raw, ends = units.tobytes(), (2 * first).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(i, j - i), pa.array([raw[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["h", "units"])
        release()

    return run


def _trained(state: np.ndarray, share: np.ndarray):
    """A shard's state (parameters, then Adagrad's memory) after one pass over its tokens, as blocks weighted by its tokens."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        flat, memory = np.split(state.copy(), 2)
        net, noise, rng, n = Net(flat), np.log(np.maximum(share, 1e-9)), np.random.default_rng([11, shard]), 0
        texts = rows.sort_by([("h", "ascending"), ("units", "ascending")])["units"].to_pylist()
        sizes = np.cumsum([0, *(len(t) // 2 for t in texts)])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + MIXED, "right")) - 1)
            units = np.frombuffer(b"".join(texts[at:to]), "<u2").astype(np.int64)
            one, two = contexts(units, sizes[at : to + 1] - sizes[at])
            order = rng.permutation(len(units))
            for x in range(0, len(order), BATCH):
                k = order[x : x + BATCH]
                net.learn(units[k], one[k], two[k], noise, memory, rng)
            n += len(units)
            at = to
        after = np.concatenate([net.flat, memory]).astype(float) * n
        blocks = [after[x : x + _BLOCK] for x in range(0, len(after), _BLOCK)]
        release()
        return pa.table({"block": pa.array(range(len(blocks)), pa.int32()), "part": pa.array([shard % 64] * len(blocks), pa.int32()), "n": [float(n)] * len(blocks), "v": pa.array([b.tobytes() for b in blocks], pa.binary())})

    return run


def _summed(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v) for v in rows["v"].to_pylist()], axis=0)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "n": [float(np.sum(rows["n"].to_numpy()))], "v": pa.array([total.tobytes()], pa.binary())})


def learn(docs: DataFrame, *, text_col: str = "text") -> tuple[Scorer, DataFrame]:
    """A scorer that has learnt from all rows of docs, and the table of all counts (token, c)."""
    spark = docs.sparkSession
    arrow_rows(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = materialise(token_counts(texts), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = counts.filter((F.octet_length("token") <= HEAD_BYTES) & (F.col("token") != ""))
    most = known.filter(F.col("c") >= head_from(known, "c", HEAD - 1)[0])
    got = most.toArrow().combine_chunks().sort_by([("c", "descending"), ("token", "ascending")])
    ends = counts.filter("token = ''").first()
    head = pa.concat_arrays([pa.array([""], pa.large_string()), *[c.cast(pa.large_string()) for c in got["token"].chunks]])
    n = np.append(ends["c"] if ends else 0, got["c"].to_numpy())
    rare = counts.select("token", "c").mapInArrow(_class_sums(head[:WORDS]), "k long, n double, v double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rare:
        class_n[r["k"]], class_v[r["k"]] = r["n"], r["v"]
    share = np.append(np.pad(n[:WORDS].astype(float), (0, max(0, WORDS - len(n)))), class_n) + SMOOTH
    share /= share.sum()
    shards = max(ROUNDS, -(-int(total) // SHARD))
    named = docs.select(F.xxhash64(*docs.columns).alias("h"), F.col(text_col).cast("string").alias("text"))
    units = materialise(named.mapInArrow(_units(head[:WORDS]), "h long, units binary").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))), "units")
    flat = Net.start(share).flat
    state, schema = np.concatenate([flat, np.full_like(flat, 1e-6)]), "block int, part int, n double, v binary"
    tasks = min(-(-2 * shards // ROUNDS), 4 * shuffle_partitions(spark))  # said outright: few bytes, but much work each
    for k in range(ROUNDS):
        trained = units.filter(F.col("shard") % ROUNDS == k).repartition(tasks, "shard").groupBy("shard").applyInArrow(_trained(state, share), schema)
        blocks = trained.groupBy("block", "part").applyInArrow(_summed, schema).groupBy("block").applyInArrow(_summed, schema)
        parts = {r["block"]: np.frombuffer(r["v"]) / r["n"] for r in blocks.collect()}
        if parts:
            state = np.concatenate([parts[b] for b in sorted(parts)]).astype(np.float32)
    flat = np.split(state, 2)[0]
    discard(units)
    return Scorer(head, n, int(total), int(distinct), class_n, class_v, flat), counts


def score(docs: DataFrame, scorer: Scorer, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    arrow_rows(spark, 1024)
    sent = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Scorer = sent.value
        log_count = np.log10(own.counts + SMOOTH)
        for batch in batches:
            words, place, unit, codes, first = tokens(batch.column(1), own.head)
            rare = unit >= WORDS
            there = place >= 0
            # of each distinct word: what base and model have of it apart from the count of a word outside the head
            log_c = np.where(there, log_count[place], 0.0)
            base, extra = log_c - own.base_log, np.where(rare, log_c - own.class_log[np.maximum(unit - WORDS, 0)], 0.0)
            known = there & (own.counts[place] > 0)
            end = codes < 0
            at = np.where(end, len(words), codes)
            units = np.append(unit, 0)[at]
            one, two = contexts(units, first)
            s = own.token_scores(units, one, two) + np.append(extra, 0.0)[at]
            b = np.append(base, log_count[0] - own.base_log)[at]
            k = np.append(known, own.counts[0] > 0)[at]
            sums = [np.add.reduceat(x, first[:-1]) if len(x) else x for x in (b, s, k.astype(np.int64))]
            tail = np.flatnonzero(~np.append(there, True)[at])
            row = np.searchsorted(first, tail, "right") - 1
            pair, times = np.unique(row * (len(words) + 1) + codes[tail], return_counts=True)
            off = np.searchsorted(pair // (len(words) + 1), np.arange(batch.num_rows + 1))
            names = words.take(pa.array(pair % (len(words) + 1))).cast(pa.string())
            lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), x) for x in (names, pa.array(times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), *lists], names=["doc_id", "n_tokens", "known", "base", "s", "tail", "times"])
        release()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = source.mapInArrow(run, "doc_id long, n_tokens long, known long, base double, s double, tail array<string>, times array<long>")
    scored = materialise(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")
    rare = scored.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("rid", F.col("t.tail").alias("token"), F.col("t.times").alias("n"))
    met = rare.join(counts, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = met.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + SMOOTH)).alias("log_c"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"))
    return scored.join(more, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(scorer.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log_c", F.lit(0.0))).alias("base_score"),
        (F.col("s") + F.coalesce("log_c", F.lit(0.0))).alias("score"),
    )
