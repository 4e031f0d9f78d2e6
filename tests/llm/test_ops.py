"""The ten operators against brute force, and on odd input."""

import hashlib
import math
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from compare import MIDDLE, SMALL, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ltlspark.llm import fingerprint, headers, langid, licenses, lm, minhash, packing, pieces, queries, substring, topk, urls
from ltlspark.llm import text as kernels

TO_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def documents(folder):
    return pd.read_parquet(f"{folder}/documents.parquet").sort_values("doc_id")


def words(text, low=False):
    return ((text or "").translate(TO_LOWER) if low else text or "").encode().split()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- kernels

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB é中\t\n\x0b😀.x", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_as_python_splits_them(many):
    column = pa.array(many, pa.string())
    data, off = kernels.buffers(column)
    starts, ends, woff = kernels.word_spans(data, off)
    raw = data.tobytes()
    got = [[raw[s:e] for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(woff[:-1], woff[1:])]
    assert got == [words(t) for t in many]
    codes, names, first = kernels.word_dictionary(column, lowered=True)
    names = names.to_pylist()
    assert [[names[c].encode() for c in codes[a:b]] for a, b in zip(first[:-1], first[1:])] == [words(t, True) for t in many]
    h = kernels.word_hashes(data, starts, ends)
    by = defaultdict(set)
    for w, x in zip([w for t in got for w in t], h.tolist()):
        by[w].add(x)
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)


# --- 1 language


def test_language_held_out(spark):
    df = queries.op1_language(spark, MIDDLE).toPandas().merge(documents(MIDDLE)[["doc_id", "lang", "text"]], on="doc_id")
    assert len(df) == len(documents(MIDDLE))
    assert (df.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in df.doc_id]).all()
    assert (df.lang_pred == df.lang)[df.held_out].mean() > 0.97
    assert df.score.between(0, 1).all()


def test_language_on_odd_rows(spark, odd, none):
    got = [r for r in langid.identify(odd, langid.learn(odd)).collect()]
    assert len(got) == 12
    for r in got:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not lettered) and (r["score"] == 0) == (not lettered)
    assert langid.identify(none, langid.learn(none)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.learn(none)).collect()} == {"und"}


def test_nystroem_and_ridge_by_hand():
    """The model's outputs against kernel, whitening and regression written out, one language and one text at a time."""
    rng = np.random.default_rng(3)
    said = [("".join(rng.choice(list("abcde ") if k % 3 else list("xyzab "), 60)), ("l1", "l2", "l2")[k % 3]) for k in range(30)]
    rows = []
    for t, lang in said:
        (_, _, x, _), = langid.presence(pa.array([t]))
        rows.append((lang, np.packbits(x[0] > 0).tobytes()))
    model = langid.fit(rows, landmarks=8)
    grams = []
    for t, _ in said:
        s = " " + " ".join(t.split()) + " "
        grams.append({s[i : i + n] for n in range(1, 5) for i in range(len(s) - n + 1)})
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    own = {lang: [k for k, (_, x) in enumerate(said) if x == lang] for lang in ("l1", "l2")}
    marks = [own[lang][k] for k in range(4) for lang in ("l1", "l2")]
    values, vectors = np.linalg.eigh(np.array([[kernel(grams[a], grams[b]) for b in marks] for a in marks]))
    features = np.array([[kernel(g, grams[b]) for b in marks] for g in grams]) @ (vectors / np.sqrt(values))
    for j, lang in enumerate(("l1", "l2")):
        weight = np.array([1 / len(own[x]) for _, x in said])
        y = np.array([1.0 if x == lang else -1.0 for _, x in said])
        gram = features.T @ np.diag(weight) @ features
        beta = np.linalg.solve(gram + 1e-2 * np.trace(gram) / 8 * np.eye(8), features.T @ (weight * y))
        raw = np.array([np.unpackbits(np.frombuffer(b, np.uint8)).astype(float) @ model.weights[:, j] for _, b in rows])
        size = np.array([np.unpackbits(np.frombuffer(b, np.uint8)).sum() for _, b in rows])
        assert np.allclose(raw / np.sqrt(size), features @ beta, atol=5e-2)  # a few n-grams share a column


def test_the_sample_is_bounded_and_keeps_every_language(spark):
    rows = [(7, "the same row again and again", "en")] * 3000 + [(k, f"text {k} with words", f"l{k % 40}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    assert langid.learn(df, max_rows=20).langs == sorted({"en", *(f"l{k}" for k in range(40))})


def test_language_kernel_is_a_presence_kernel():
    x = next(langid.presence(pa.array(["ab ab", "ab"])))[2].copy()
    assert (x[0] >= x[1]).all() and set(np.unique(x)) == {0.0, 1.0}


# --- 2 substring


def removed(docs, window):
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield gone


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_substring_brute_force(spark, folder):
    docs = documents(folder)
    got = queries.op2_substring(spark, folder).toPandas().set_index("doc_id")
    split = [words(t) for t in docs.text]
    for k, w, gone in zip(docs.doc_id, split, removed(split, 35)):
        r = got.loc[k]
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("window", [3, 8, 20, 35, 60])
def test_substring_windows_of_any_length(spark, window):
    rng = np.random.default_rng(window)
    base = [f"w{k}" for k in range(400)]
    many = []
    for _ in range(12):
        a = rng.integers(0, 300)
        many.append(" ".join([*(f"u{x}" for x in rng.integers(0, 10**9, rng.integers(0, 30))), *base[a : a + rng.integers(0, 90)]]))
    df = spark.createDataFrame(list(enumerate(many)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring.kept_words(df, window=window).collect()}
    assert got == {k: sum(g) for k, g in enumerate(removed([words(t) for t in many], window))}


def test_difference_covers():
    for v, d in substring.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_substring_on_odd_rows(spark, odd, none):
    got = substring.kept_words(odd, window=5).collect()
    assert len(got) == 12 and {r["n_removed"] for r in got if r["doc_id"] in (2, 3, 4, 5, 6, 7)} == {0}
    assert [r["n_removed"] for r in got if r["doc_id"] == 1] == [14, 14]
    stripped = substring.strip_repeats(odd, window=5)
    assert set(stripped.columns) == set(odd.columns)
    texts = defaultdict(list)
    for r in stripped.collect():
        texts[r["doc_id"]].append(r["text"])
    assert texts[1] == ["", ""] and texts[2] == [None] and texts[4] == [" \t\n "] and texts[6][0].startswith("Größe")
    assert substring.strip_repeats(none).count() == 0 and substring.kept_words(none).count() == 0


def test_substring_columns_of_any_name(spark):
    rows = [(k, "a b c d e f g h" if k < 2 else f"own {k}", f"t{k}", k, "r", "x", "y") for k in range(4)]
    df = spark.createDataFrame(rows, "`doc.id` int, body string, text string, rid int, row string, repeats string, __rid string")
    got = substring.strip_repeats(df, window=5, text_col="body")
    assert got.columns == [*df.columns, "n_words", "n_removed"]
    assert sorted(tuple(r) for r in got.collect()) == [(k, "" if k < 2 else f"own {k}", f"t{k}", k, "r", "x", "y", 8 if k < 2 else 2, 8 if k < 2 else 0) for k in range(4)]
    only = substring.strip_repeats(df.select("body"), window=5, text_col="body")
    assert sorted(r["body"] for r in only.collect()) == ["", "", "own 2", "own 3"]


# --- 3 fingerprints


def test_fingerprints_of_edited_texts(spark):
    docs = documents(SMALL)
    got = queries.op3_fingerprint(spark, SMALL).toPandas().set_index("doc_id")
    many = docs.text.tolist()
    assert len(got) == len(many)
    error = []
    for k, (i, t) in enumerate(zip(docs.doc_id, many)):
        after = many[(k + 1) % len(many)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got.loc[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)
        error.append(r.near_edited - jaccard(t, edited))
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.07
    by_text = defaultdict(set)
    for t, f in zip(many, got.loc[docs.doc_id].fingerprint):
        by_text[t].add(f)
    assert all(len(v) == 1 for v in by_text.values())


def jaccard(a, b):
    def terms(t):
        w = words(t)
        return Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w)

    x, y = terms(a), terms(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


@pytest.mark.parametrize(("hot", "more"), [(1, 0), (5, 0), (9, 0), (2**60 + 3, 2**60)])
def test_an_id_of_many_rows_is_cut_by_its_texts(spark, hot, more):
    import xxhash

    many = [(k + more, f"text of {k} and {k * k}") for k in range(1, 10)] + [(hot, f"one of many {j} {j * j}") for j in range(400)] + [(None, f"no id {j}") for j in range(300)]
    df = spark.createDataFrame(many, "doc_id bigint, text string").repartition(5)
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprint.edited_fingerprints(df).collect())
    rows = sorted(many, key=lambda r: (-1 if r[0] is None else r[0], xxhash.xxh64_intdigest(r[1].encode(), seed=42) >> 11, r[1]))
    want = Counter()
    for (k, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        half = len(t) // 2
        want[k, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert got == want


def test_consistent_sampling_follows_weights():
    rng = np.random.default_rng(1)
    terms = rng.integers(0, 2**63, 60, np.uint64)
    for shift in (0, 3):
        x, y = np.repeat(terms, rng.integers(1, 9, 60)), np.repeat(np.roll(terms, shift), rng.integers(1, 9, 60))
        a, b = Counter(x.tolist()), Counter(y.tolist())
        want = sum((a & b).values()) / sum((a | b).values())
        assert abs(fingerprint.likeness(fingerprint.signature(x), fingerprint.signature(y)) - want) < 5 * (0.25 / fingerprint.K) ** 0.5


def test_fingerprints_on_odd_rows(spark, odd, none):
    got = fingerprint.edited_fingerprints(odd).collect()
    assert len(got) == 12
    assert all(r["fingerprint"] == "0" * 4 * fingerprint.K for r in got if r["doc_id"] in (2, 3, 4))
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 1}) == 1
    assert fingerprint.edited_fingerprints(none).count() == 0
    alone = fingerprint.edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1
    assert fingerprint.fingerprints(odd).count() == 12


# --- 4 language model


def test_language_model_counts(spark):
    docs = documents(MIDDLE)
    got = queries.op4_lm_score(spark, MIDDLE).toPandas().set_index("doc_id")
    split = {k: [*words(t, True), None] for k, t in zip(docs.doc_id, docs.text)}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in split}
    c = Counter(w for k, ws in split.items() if not held[k] for w in ws)
    total, distinct = sum(c.values()), len(c)
    for k, ws in split.items():
        r = got.loc[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(c[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), rel_tol=1e-9, abs_tol=1e-6)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_language_model_is_normalised(spark):
    docs = spark.createDataFrame([(k, "a b c a b" if k % 2 else "x y z") for k in range(40)], "doc_id bigint, text string")
    scorer, _ = lm.learn(docs.select("text"))
    units = np.arange(lm.UNITS)
    for context in ((lm.BEGIN, lm.BEGIN), (1, 2), (lm.WORDS + 3, 0)):
        p = 10 ** scorer.token_scores(units, np.full(lm.UNITS, context[0]), np.full(lm.UNITS, context[1]))
        assert abs(p.sum() - 1) < 1e-3
    assert scorer.distinct == 7 and scorer.total == sum(scorer.counts)


def test_scores_of_whole_documents_by_hand(spark, monkeypatch):
    """Every document's score from the parameters, a full softmax for each token and the counts."""
    monkeypatch.setattr(lm, "HEAD", 40)
    docs = documents(SMALL).head(60)
    df = spark.createDataFrame([(int(k), t) for k, t in zip(docs.doc_id, docs.text)], "doc_id bigint, text string")
    scorer, counts = lm.learn(df.filter("doc_id % 3 > 0"))
    c = {r["token"]: r["c"] for r in counts.collect()}
    net = lm.Net(scorer.flat.astype(np.float64))
    unit_of = {w: k for k, w in enumerate(scorer.head.to_pylist()[: lm.WORDS])}
    vocabulary = sorted(c)
    by_class = lm.WORDS + lm.classes_of(pa.array(vocabulary, pa.large_string()))
    n, v = np.zeros(lm.UNITS), np.zeros(lm.UNITS)
    for w, k in zip(vocabulary, by_class):
        if w not in unit_of:
            n[k] += c[w]
            v[k] += 1
    got = by_id(lm.score(df, scorer, counts))
    for k, t in zip(docs.doc_id, docs.text):
        ws = [x.decode() for x in words(t, True)] + [""]
        units = [unit_of.get(w, lm.WORDS + int(lm.classes_of(pa.array([w], pa.large_string()))[0])) for w in ws]
        want, before = 0.0, [lm.BEGIN, lm.BEGIN]
        for w, u in zip(ws, units):
            guess = net.ctx[before[-1]] * net.place[0] + net.ctx[before[-2]] * net.place[1]
            s = net.out @ guess + net.bias
            want += (s[u] - s.max() - np.log(np.exp(s - s.max()).sum())) / np.log(10)
            if w not in unit_of:
                want += math.log10((c.get(w, 0) + 0.1) / (n[u] + 0.1 * (v[u] + 1)))
            before.append(u)
        assert math.isclose(got[k]["score"], want, rel_tol=1e-4, abs_tol=1e-3)


def test_the_model_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 2000)
    docs = documents(SMALL).head(80)
    df = spark.createDataFrame([(int(k), t) for k, t in zip(docs.doc_id, docs.text)], "doc_id bigint, text string")
    one, other = (lm.learn(x)[0].flat for x in (df.coalesce(1), df.repartition(7)))
    assert np.allclose(one, other, rtol=1e-4, atol=1e-6) and not np.allclose(one, lm.Net.start(np.full(lm.UNITS, 1 / lm.UNITS)).flat)


def test_rare_tokens_meet_their_counts_in_a_join(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 7 + 1))) for k in range(30)], "doc_id bigint, text string")
    whole = {r["doc_id"]: r["base_score"] for r in lm.score(docs, *lm.learn(docs)).collect()}
    monkeypatch.setattr(lm, "HEAD", 3)
    small = {r["doc_id"]: r["base_score"] for r in lm.score(docs, *lm.learn(docs)).collect()}
    assert whole.keys() == small.keys() and all(math.isclose(whole[k], small[k], rel_tol=1e-9) for k in whole)


def test_language_model_on_odd_rows(odd, none):
    got = lm.score(odd, *lm.learn(odd)).collect()
    assert len(got) == 12 and all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (2, 3, 4))
    assert all(math.isfinite(r["score"]) and r["n_known"] == r["n_tokens"] for r in got)
    nothing = lm.score(odd, *lm.learn(none)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in nothing)
    assert lm.score(none, *lm.learn(odd)).count() == 0


# --- 5 top-k


def test_top_k_brute_force(spark):
    df = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    x = np.floor(256 * np.array(df.embedding.tolist(), float)).astype(int)
    ids = df.vec_id.to_numpy()
    got = queries.op5_topk(spark, SMALL).toPandas()
    for q in ids[ids % 50 == 0]:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        want = sorted((-a, b) for a, b in zip(s, ids) if b != q)[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(zip(-mine.score, mine.vec_id)) == want and mine["rank"].tolist() == [1, 2, 3, 4, 5]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 60), st.integers(1, 33), st.integers(0, 2**31))
def test_bounds_lose_nothing(n, m, dim, seed):
    rng = np.random.default_rng(seed)
    q, c = (np.floor(rng.normal(size=(k, dim)) * 20) for k in (n, m))
    best = topk.Best(n, 3)
    best.search(topk.Side(np.arange(n) - 10**6, q), topk.Side(np.arange(m), c))
    for i in range(n):
        want = sorted((-int(s), j) for j, s in enumerate(c @ q[i]))[:3]
        assert [(-s, j) for s, j in zip(best.score[best.q == i], best.id[best.q == i])] == want


def test_top_k_on_odd_rows(spark, monkeypatch):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, None]), (3, None), (4, [float("nan"), 1.0]), (5, []), (6, [1.0, 2.0, 3.0]), (50, [2.0, 1.0]), (7, [float("inf"), 0.0]), (8, [1e12, 1e12]), (None, [1.0, 1.0]), (1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    is_query = lambda i: i % 50 == 0
    got = topk.top_k(df, is_query, k=5).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(0, 1), (0, 50), (0, 8), (50, 0), (50, 1), (50, 8)}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 50] == [8, 0, 1, 1]
    assert topk.top_k(df.limit(0), is_query).count() == 0
    monkeypatch.setattr(topk, "BLOCK", 1)
    assert sorted(map(tuple, topk.top_k(df, is_query, k=5).collect())) == sorted(map(tuple, got))


@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_rows_are_rows(spark, monkeypatch, parts):
    import duckdb

    rng = np.random.default_rng(8)
    vectors = [[round(float(x), 3) for x in rng.normal(size=9)] for _ in range(40)]
    copies = {0: 1, 1: 6, 2: 12, 50: 3, 51: 7, 100: 2}
    frame = [(k, v) for k, v in enumerate(vectors) for _ in range(copies.get(k, 1))]
    frame += [(50, vectors[3]), (50, vectors[4]), (100, vectors[5]), (100, vectors[5])] + [(k, vectors[k % 40]) for k in (51, 52, 53)] * 7
    embeddings = pd.DataFrame(frame, columns=["vec_id", "embedding"])
    want = duckdb.sql(queries.OP5_SQL).fetchall()
    df = spark.createDataFrame(frame, "vec_id bigint, embedding array<float>").repartition(parts)
    for block in (16_384, 2):
        monkeypatch.setattr(topk, "BLOCK", block)
        got = topk.top_k(df, lambda i: i % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    six = [(0, [1.0, 1.0]), *[(1, [9.0, 9.0])] * 6, *[(k, [float(k), 1.0]) for k in range(2, 9)]]
    got = topk.top_k(spark.createDataFrame(six, "vec_id bigint, embedding array<double>").repartition(parts), lambda i: i == 0, scale=1).collect()
    assert sorted(map(tuple, got)) == [(0, r, 1, 18) for r in range(1, 6)]


def test_top_k_on_the_odd_table_and_long_vectors(spark, odd, none):
    vectors = F.when(F.col("doc_id") != 3, F.array(F.lit(1.0), F.col("doc_id").cast("double")))
    df = odd.withColumn("embedding", vectors).withColumn("query_id", F.lit(1)).withColumn("id", F.lit("x"))
    got = topk.top_k(df, lambda i: i == 5, id_col="doc_id", scale=1).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 10, 51), (2, 9, 46), (3, 8, 41), (4, 7, 36), (5, 6, 31)]
    assert topk.top_k(none.withColumn("embedding", vectors), lambda i: i == 5, id_col="doc_id").count() == 0
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(6, 5000)) * 50)
    got = topk.top_k(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>"), lambda i: i == 0, scale=1).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(n + 1, k, -s) for n, (s, k) in enumerate(sorted((-int(x[0] @ x[k]), k) for k in range(1, 6)))]


# --- 6 near-duplicates


def components(texts, n, percent):
    """Smallest linked key by brute force over shared shingles."""
    sets = {}
    for k, t in texts.items():
        w = words(t, True)
        sets[k] = {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()
    has, up = defaultdict(list), {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k in sorted(sets):
        near = Counter(y for s in sets[k] for y in has[s])
        for y, shared in near.items():
            if 100 * shared >= percent * (len(sets[k]) + len(sets[y]) - shared) and top(k) != top(y):
                up[max(top(k), top(y))] = min(top(k), top(y))
        for s in sets[k]:
            has[s].append(k)
    return {k: (len(s), top(k)) for k, s in sets.items()}


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_near_duplicates_brute_force(spark, folder):
    docs = documents(folder)
    got = queries.op6_minhash(spark, folder).toPandas().set_index("doc_id")
    want = components(dict(zip(docs.doc_id, docs.text)), 4, 80)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.iterrows()} == want
    assert (got.kept == (got.index == got.component_id)).all()


def test_a_large_family_with_borderline_members(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 16)
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(200)]
    many = {}
    for k in range(150):
        w = list(base)
        for at in rng.choice(200, rng.integers(0, 16), replace=False):
            w[at] = f"e{k}_{at}"
        many[k] = " ".join(w)
    df = spark.createDataFrame(list(many.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, shingle=4).collect()}
    assert got == components(many, 4, 80)


def test_a_chained_family_of_ten_thousand(spark):
    """Each text is linked with its neighbours in the chain alone, the rest of the family is borderline or unlike."""
    rng = np.random.default_rng(9)
    chains, length, size = 20, 500, 96
    rows, want = [], {}
    for c in range(chains):
        w = [f"c{c}w{k}" for k in range(size)]
        for k in range(length):
            doc = int(c * length + k)
            at = (8 * k) % size
            w[at : at + 8] = [f"c{c}k{k}x{x}" for x in range(8)]  # at most 11 of 93 shingles differ
            rows.append((doc, " ".join(w)))
            want[doc] = c * length
    sets = [{tuple(t.split()[i : i + 4]) for i in range(size - 3)} for _, t in rows]
    linked = {a for a in range(1, len(rows)) if 100 * len(sets[a] & sets[a - 1]) >= 75 * len(sets[a] | sets[a - 1])}
    assert linked == {a for a in range(len(rows)) if a % length}
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, shingle=4, percent=75).collect()}
    assert got == want


def test_one_id_with_two_texts_is_two_documents(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "xyz")
    rows = [(5, a), (5, b), (6, a), (7, b), (8, c), (5, a)]
    got = sorted(tuple(r)[::2] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == [(5, 5), (5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]


def test_signature_estimates():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 900, np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100, np.uint64)])
    s = [np.frombuffer(minhash.packed(minhash.minima(np.unique(x))), np.uint8) for x in (a, b)]
    assert abs(minhash.estimate(s[0], s[1]) - 0.8) < 0.2 and minhash.estimate(s[0], s[0]) == 1


def test_near_duplicates_on_odd_rows(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == 12 and all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in got if r["doc_id"] in (2, 3, 4))
    assert [r["component_id"] for r in got if r["doc_id"] == 1] == [1, 1]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert minhash.near_duplicates(none).count() == 0


# --- 7 pieces

BPE = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.load(queries.tokenizer_path(BPE))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(BPE))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeioutnsrh  \n\tT▁é中😀ñ|$%.,#-1x<s></", max_size=80))
def test_pieces_are_the_library_s(vocabulary, library, t):
    ids = vocabulary.encode(t).tolist()
    assert ids == library.encode(t)
    assert vocabulary.decode(ids) == library.decode(ids) == t.replace("▁", " ")
    assert [i for i in vocabulary.stream(["▁" + t[: len(t) // 2].replace(" ", "▁"), t[len(t) // 2 :].replace(" ", "▁")])] == ids or not t


@pytest.mark.parametrize("chunk", [1, 7, 1 << 14])
def test_window_is_bounded(vocabulary, library, monkeypatch, chunk):
    monkeypatch.setattr(pieces, "CHUNK", chunk)
    t = "internationalization" * 300 + "=" * 1000 + "中😀" * 50
    retained = []
    ids = list(vocabulary.stream(["▁" + t], retained))
    assert ids == library.encode(t) and max(retained) <= 3 * vocabulary.longest


@pytest.mark.parametrize("chunk", [5, 1 << 14])
def test_one_pass_over_segments(vocabulary, library, monkeypatch, chunk):
    monkeypatch.setattr(pieces, "CHUNK", chunk)
    docs = documents(SMALL).text.dropna()
    segments = sorted({("▁" + w) for t in docs[:60] for w in t.split()} | {"▁", "▁▁a", "中中", "\0", "a\0b", "é" * 80})
    ids, size = vocabulary._segments(segments)
    got = [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
    assert got == [list(vocabulary.stream([x])) for x in segments]
    assert all(a == library.encode(s[1:]) for a, s in zip(got, segments) if s.startswith("▁") and not s.startswith("▁▁") and len(s) > 1)


def test_memo_keeps_what_it_is_told():
    memo = kernels.Memo(400)
    want = {}
    for k in range(60):
        new = [f"w{k}_{i}" * (1 + i % 3) for i in range(k % 13)]
        ids = [np.arange(i % 4, dtype="<i4") + 1000 * k + i for i in range(len(new))]
        want |= zip(new, map(bytes, map(np.ndarray.tobytes, ids)))
        memo.keep(pa.array(new, pa.large_string()), *kernels.packed_ids([x.tobytes() for x in ids]))
        asked = [*new, "other", ""]
        assert memo.known_bytes(pa.array(asked, pa.large_string())) == [*(want[x] for x in new), None, None]
    assert 100 <= len(memo) <= 400
    held = [x for x, y in zip(want, memo.known_bytes(pa.array(list(want), pa.large_string()))) if y is not None]
    assert len(held) == len(memo) and held == list(want)[-len(held):]


def test_unigram_viterbi_against_all_segmentations():
    scores = {p: (k, -float(v)) for k, (p, v) in enumerate([("a", 3), ("b", 3), ("ab", 4), ("ba", 4.5), ("aba", 5.5), ("▁", 2), ("▁a", 3.5)])}
    model = pieces.Pieces(scores, [0] * 256, bpe=False)

    def best(t):
        found = {0: (0.0, ())}
        for j in range(1, len(t) + 1):
            found[j] = max((found[i][0] + scores[t[i:j]][1], found[i][1] + (scores[t[i:j]][0],)) for i in range(j) if t[i:j] in scores)
        return found[len(t)]

    cost = {i: v for i, v in scores.values()}
    for k in range(200):
        t = "▁" + "".join("ab"[k >> i & 1] for i in range(8)) * 3
        assert math.isclose(sum(cost[i] for i in model.stream([t])), best(t)[0])
        assert list(model.stream([*t])) == list(model.stream([t])) == list(model.stream([t + pieces.PART + t]))[len(list(model.stream([t]))) + 1 :]


def test_pieces_query(spark, library):
    docs = documents(SMALL)
    got = queries.op7_pieces(spark, SMALL).toPandas().set_index("doc_id")
    for k, t in zip(docs.doc_id, docs.text):
        ids = library.encode(t)
        assert (got.loc[k].n_ids, got.loc[k].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got.loc[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_pieces_on_odd_rows(odd, none):
    path = queries.tokenizer_path(BPE)
    encoded = pieces.encode(odd, path)
    got = pieces.decode(encoded, path).collect()
    want = Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    assert Counter((r["doc_id"], r["text"]) for r in got) == want
    assert pieces.encode(none, path).count() == 0
    assert pieces.decode(encoded.withColumn("ids", F.lit(None).cast("array<int>")), path).first()["text"] is None


# --- 8 packing


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def check_packing(got, want, max_len):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == want.keys()
    for k, parts in by_doc.items():
        parts.sort(key=lambda r: (r["start"]))
        assert [i for r in parts for i in np.frombuffer(r["ids"], "<u4").tolist()] == want[k]
        assert all(r["doc_tokens"] == len(want[k]) and r["length"] * 4 == len(r["ids"]) > 0 for r in parts)
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [sum(x["length"] for x in parts[:k]) for k in range(len(parts))]
        n = sum(r["length"] for r in parts)
        assert n <= max_len
        padding += 0 if n & (n - 1) == 0 else max_len - n
    assert padding == 0


@pytest.mark.parametrize("max_len", [64, 4096])
def test_packing(spark, word_bpe, max_len):
    docs = documents(SMALL)
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {k: [*word_bpe.encode(t, add_special_tokens=False).ids, 2] for k, t in zip(docs.doc_id, docs.text)}
    check_packing(packing.pack(df.repartition(5, "doc_id") if max_len == 64 else df, queries.tokenizer_path(), max_len=max_len, n_open=4).collect(), want, max_len)


def test_packing_query_digests(spark):
    df = queries.op8_packing(spark, SMALL)
    assert dict(df.dtypes) == {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    assert df.filter("ids_crc32 < 0 or ids_crc32 > 4294967295").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aéIİıſK'sßΣςñÑ½²ªº_-.,1٣中😀ﬁ \t\nRELLd<|endoftext>", max_size=30)), min_size=1, max_size=4))
def test_word_ids_are_the_library_s(many):
    tokens = packing.word_tokens(queries.tokenizer_path())
    ids, off = tokens.encode(pa.array(many, pa.string()))
    for k, t in enumerate(many):
        assert ids[off[k] : off[k + 1]].tolist() == tokens.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_packing_on_odd_rows(odd, none, word_bpe):
    source = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r["doc_id"]: [*word_bpe.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in source.collect()}
    check_packing(packing.pack(source, queries.tokenizer_path()).collect(), want, 4096)
    assert {r["doc_id"] for r in packing.pack(odd, queries.tokenizer_path()).collect()} == {*range(1, 11), None}
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


# --- 9 URLs


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, duck, name):
    mine, theirs = queries.queries()[name](spark, MIDDLE).toPandas(), duck(MIDDLE).sql(queries.oracle_sql()[name]).df()
    assert rows(mine) == rows(theirs)


def verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if c in string.ascii_uppercase else c for c in rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))])
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


@pytest.mark.parametrize("broadcast", [True, False])
def test_url_rules(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST_RULES", 100 if broadcast else 0)
    rules = [*queries.URL_RULES, ("com", "/a/very", "block"), ("x.y", "", "block"), ("dup.org", "/", "allow"), ("dup.org", "/", "block")]
    many = ["http://A.Com/", "http://com", "http://a.com", "https://www.example.com/en/x?y#z", "http://example.com/en/", "http://notexample.com/en/", "http://EXAMPLE.com/EN/", "//a.com/", None, "", "x://", "http://a.x.y#frag", "http://user@com:80/", "http://.com/", "http://a.com/a/very/long", "http://dup.org/", "http://net/fr/", "http://a..net/es/q", "ftp://é.com/ü", "http://com?://net/es/"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate([*many, "http://A.Com/"])], "page_id bigint, url string").withColumn("rule", F.lit("x")).withColumn("host", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    known = [r for r in rules if r != ("dup.org", "/", "allow")]
    assert got == {k: verdict(u, known) for k, u in enumerate([*many, "http://A.Com/"])}


def test_urls_on_the_odd_table(spark, odd, none):
    rules = spark.createDataFrame([("example.com", "/en/", "block"), ("com", "/", "allow"), ("com", "/" + "x" * 3000, "block")], "host string, path string, verdict string")
    said = F.when(F.col("doc_id") == 2, None).when(F.col("doc_id") == 3, "").when(F.col("doc_id") == 5, F.concat(F.lit("HTTP://WWW.Example.COM/en/"), F.repeat(F.lit("y/"), 50_000))).when(F.col("doc_id") == 6, F.concat(F.lit("x://a.com/"), F.repeat(F.lit("x"), 4000))).otherwise("a://b.example.com/de/?q#f")
    df = odd.withColumn("url", said).withColumns({c: F.lit(1) for c in ("of", "best", "of_", "h", "p", "e", "prefix", "full", "shapes", "labels", "size", "digest", "v", "a.b")})
    out = urls.judge(df, rules)
    got = {r["doc_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got[2] == got[3] == ("", "", None, "allow") and got[1] == ("b.example.com", "/de/", "com/", "allow")
    assert got[5][0] == "www.example.com" and len(got[5][1]) == 100_004 and got[5][2:] == ("example.com/en/", "block")
    assert got[6][2] == "com/" + "x" * 3000 and got[6][3] == "block"
    assert out.count() == 12 and set(out.columns) == set(df.columns)
    assert urls.judge(none.withColumn("url", F.lit("a://b")), rules).count() == 0


def test_url_rules_of_nothing(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    assert urls.judge(pages, none).first()["verdict"] == "allow"
    assert urls.judge(pages.limit(0), none).count() == 0


# --- 10 licences


def licence_units(texts):
    """Cosine of each line and text with each template, as published formulas say."""
    import re

    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate(TO_LOWER))
    names = sorted(licenses.TEMPLATES)
    known = {w for n in names for w in split(licenses.TEMPLATES[n])}
    df = Counter(w for t in texts for w in set(split(t)) & known)
    weight = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1
    rare = math.log(1 + len(texts)) + 1

    def cosines(t):
        tf = Counter(split(t))
        inside = {w: n * weight(w) for w, n in tf.items() if w in known}
        norm = math.sqrt(sum(x * x for x in inside.values()) + rare**2 * sum(n for w, n in tf.items() if w not in known))
        out = []
        for n in names:
            other = {w: k * weight(w) for w, k in Counter(split(licenses.TEMPLATES[n])).items()}
            dot = sum(x * other.get(w, 0) for w, x in inside.items())
            out.append((dot / norm / math.sqrt(sum(x * x for x in other.values())) if norm else 0.0, n))
        return max(out, key=lambda x: (x[0], [-ord(c) for c in x[1]]))

    for t in texts:
        yield max((cosines(x) for x in (t or "").split("\n")), key=lambda x: x[0]), cosines(t)


def test_licences_brute_force(spark):
    docs = documents(SMALL)
    got = queries.op10_license(spark, SMALL).toPandas().set_index("doc_id").loc[docs.doc_id]
    found = list(licence_units(docs.text.tolist()))
    assert np.allclose(got.score, [max(a[0], b[0]) for a, b in found], atol=1e-8)
    own = [b[1] if b[0] >= licenses.WHOLE and b[0] >= a[0] else a[1] if a[0] >= licenses.HEADER else b[1] if b[0] >= licenses.WHOLE else None for a, b in found]
    path = [f"{s}/{lang}/{k}" for s, lang, k in zip(docs.source, docs.lang, docs.doc_id)]
    files = {p: o for p, o, (_, b) in zip(path, own, found) if b[0] >= licenses.WHOLE}
    for p, o, r in zip(path, own, got.itertuples()):
        folder, given = p.rpartition("/")[0], None
        while given is None:
            given = min((f for f in files if f.rpartition("/")[0] == folder), default=None)
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        assert (r.license or None) == (o or (files[given] if given else None))
        assert r.origin == ("file" if o and p in files else "header" if o else "inherited" if given else "none")


def test_licences_by_nearest_directory(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [("LICENSE", f"{mit}\n" + "some words of prose that follow " * 9), ("a/b/COPYING.txt", gpl), ("a/b/c/d.py", "print"), ("a/x.py", None), ("z.py", ""), ("a/b/own.py", f"# x = 1\n{mit}\n" + "some code that does its work in many lines " * 5), (None, "code"), ("a/b/c/d.py", "print")]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("own", F.lit("x")).withColumn("license", F.lit(0))
    got = [(r["path"], r["license"], r["origin"], r["license_path"]) for r in licenses.scan(df).collect()]
    assert Counter(got) == Counter([("LICENSE", "MIT", "file", None), ("a/b/COPYING.txt", "GPL-3.0", "file", None), ("a/b/c/d.py", "GPL-3.0", "inherited", "a/b/COPYING.txt"), ("a/x.py", "MIT", "inherited", "LICENSE"), ("z.py", "MIT", "inherited", "LICENSE"), ("a/b/own.py", "MIT", "header", None), (None, None, "none", None), ("a/b/c/d.py", "GPL-3.0", "inherited", "a/b/COPYING.txt")])
    assert licenses.scan(df.limit(0)).count() == 0


PROSE = "some words of prose that follow in a file of no licence " * 30


def licence_of(spark, scan, texts):
    """license and origin of each text as the file k/LICENSE.txt."""
    df = spark.createDataFrame([(f"{k}/LICENSE.txt", t) for k, t in enumerate(texts)] + [(f"p{k}/x.py", PROSE) for k in range(50)], "path string, text string")
    got = {r["path"]: (r["license"], r["origin"]) for r in scan(df).collect()}
    return [got[f"{k}/LICENSE.txt"] for k in range(len(texts))] + sorted({got[f"p{k}/x.py"] for k in range(50)})


@pytest.mark.parametrize("operator", [licenses, headers])
def test_licences_on_the_odd_table(spark, odd, none, operator):
    path = F.when(F.col("doc_id") == 2, None).when(F.col("doc_id") == 9, "a/LICENSE").otherwise(F.concat(F.lit("a/b/"), F.col("doc_id").cast("string")))
    text = F.when(F.col("doc_id") == 9, "Released under the MIT License.").when(F.col("doc_id") == 5, F.concat("text", F.lit("\nThis work is licensed under the GNU General Public License, version 3.\n"), "text")).otherwise(F.col("text"))
    df = odd.withColumn("path", path).withColumn("text", text).withColumns({c: F.lit("x") for c in ("row", "__own", "__directory", "__rid", "__line_score", "license", "a.b")})
    out = operator.scan(df)
    assert set(out.columns) == {*df.columns, "license", "origin", "license_path"} - {"text"} and out.count() == 12
    got = {r["doc_id"]: (r["license"], r["origin"]) for r in out.collect()}
    assert got[9] == ("MIT", "file") and got[5] == ("GPL-3.0", "header") and got[2] == (None, "none") and got[None] == (None, "none")
    assert all(got[k] == ("MIT", "inherited") for k in (1, 3, 4, 6, 7, 8, 10))
    assert operator.scan(none.withColumn("path", F.lit("a"))).count() == 0


def test_full_texts_and_wrapped_headers(spark):
    full = sorted(headers.TEXTS)
    wrapped = [
        ("BSD-3-Clause", "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met."),
        ("MIT", "// SPDX-License-Identifier: MIT"),
        ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007"),
        ("MIT", "MIT License"),
        ("MIT", "Copyright Foo. Released under the MIT License."),
        ("Apache-2.0", "\n".join(f" * {w}" for w in headers.NOTICES["Apache-2.0"].split())),
    ]
    texts = [headers.TEXTS[n] for n in full] + [f"{PROSE}\n{t}\n{PROSE}" for _, t in wrapped]
    want = [(n, "file") for n in full + [n for n, _ in wrapped]] + [(None, "none")]
    assert licence_of(spark, headers.scan, texts) == want
    assert licence_of(spark, headers.scan, ["SPDX-License-Identifier: ISC", None, "", "The MIT press has a license."]) == [(None, "none")] * 5


@pytest.mark.parametrize("head", [0, 12, 500_000])
def test_weights_are_of_all_words(spark, monkeypatch, head):
    import re

    monkeypatch.setattr(headers, "HEAD", head)
    common = "alpha beta gamma delta epsilon zeta eta theta"
    own = [f"{common} {headers.TEXTS['MIT']}", f"{common} Released under the MIT License {common} once{head}", f"the released software under zeta MIT License", None]
    texts = own + [f"{common} word{k}" for k in range(300)]
    df = spark.createDataFrame([(k, f"{k}/x.py", t) for k, t in enumerate(texts)], "k int, path string, text string")
    got = {r["k"]: r for r in headers.scan(df).collect()}
    split = lambda t: re.findall("[0-9a-z]+", (t or "").lower())
    seen = Counter(w for t in texts for w in set(split(t)))
    idf = lambda w: math.log((1 + len(texts)) / (1 + seen[w])) + 1
    vector = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
    size = lambda a: math.sqrt(sum(x * x for x in a.values()))

    def cosine(a, b):
        return sum(x * b.get(w, 0) for w, x in a.items()) / (size(a) * size(b)) if a else 0.0

    for k, t in enumerate(texts[:8]):
        ws, whole, line = split(t), [], []
        for name, said, least, is_whole in headers.templates():
            b = split(said)
            whole += [(cosine(vector(ws), vector(b)), name)] if is_whole else []
            line += [(c, name) for i in range(len(ws)) if (c := cosine(vector(ws[i : i + len(b)]), vector(b))) >= least]
        top = max(whole, default=(0, ""))
        want = top if top[0] >= headers.WHOLE else max(line, default=(None, None), key=lambda x: round(x[0], 12))
        assert got[k]["license"] == want[1] and (want[0] is None) == (got[k]["score"] is None)
        assert want[0] is None or abs(got[k]["score"] - want[0]) < 1e-9
