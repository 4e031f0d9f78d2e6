"""Operators beyond what SQL compares: layout, edge cases, sources, streams."""

import sqlite3

import pytest
from compare import SMALL
from pyspark.sql import functions as F

from ltlspark import runtime
from ltlspark.functions import folds, metrics, text, udfs
from ltlspark.ltl import decide, generate, itl, rewrite
from ltlspark.ltl.ast import depth, operators, to_arena
from ltlspark.ltl.parse import parse
from ltlspark.operators import aggregates, components, sampling, store
from ltlspark.operators.components import connected_components
from ltlspark.plans import stages
from ltlspark.schema import AST, DOMAINS, FORMULAS, ITL
from ltlspark.sources import tables
from ltlspark.streaming import incremental


def collected(df):
    return sorted(map(tuple, df.collect()))


def test_folds_agree_with_python(spark):
    made = [generate.formula(3, k, 5) for k in range(150)]
    df = spark.createDataFrame([(k, [(n["k"], n["a"], n["v"]) for n in to_arena(f)]) for k, f in enumerate(made)], f"i int, ast {AST}")
    got = df.select("i", folds.itl_render("ast"), folds.ltl_key("ast"), folds.ltl_key("ast", compat=True), folds.tree_depth("ast"), folds.operator_count("ast"), folds.nnf_text("ast"), folds.ltl_render("ast"), folds.ltl_render("ast", latex=True)).collect()
    for i, said, key, compat, d, n, nnf, spot, latex in got:
        f = made[i]
        assert (said, key, compat, d, n) == (itl.render(f), rewrite.key(f), rewrite.compat_key(f), depth(f), operators(f))
        assert rewrite.flatten(parse(spot)) == rewrite.flatten(f) == rewrite.flatten(parse(latex, "latex"))
        assert decide.equivalent(parse(nnf), f) in (True, None)


def test_folds_on_broken_arrays(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [("atom", 0, "p"), ("atom", 0, "q")]), (4, [("and", 2, None)])], f"i int, ast {AST}")
    assert [r[1] for r in df.select("i", folds.itl_render("ast")).orderBy("i").collect()] == [None, None, None, ""]


def test_no_python_in_folds(spark):
    df = spark.createDataFrame([(1, [("atom", 0, "p")])], f"i int, ast {AST}").select(folds.itl_render("ast"), folds.classify("ast"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").filter("n_chars >= 500").select("doc_id")
    assert "GreaterThanOrEqual(n_chars,500)" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 7])
def test_samples_do_not_depend_on_layout(spark, parts):
    base = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    other = base.repartition(parts)
    for f in (lambda d: sampling.fraction_sample(d, "doc_id"), lambda d: sampling.stratified_split(d, "doc_id", "lang"), lambda d: sampling.fixed_sample(d, "doc_id", 17)):
        assert collected(f(base)) == collected(f(other))


def test_ranks_are_exact_with_null_groups(spark):
    df = spark.createDataFrame([(k, None if k % 3 else "a") for k in range(50)], "id int, g string")
    got = sampling.ranked(df, "id", 1, ["g"]).groupBy("g").agg(F.sort_array(F.collect_list("rank")), F.max("size")).collect()
    assert all(r[1] == list(range(1, r[2] + 1)) for r in got) and len(got) == 2
    assert sampling.ranked(df.limit(0), "id", 1).count() == 0


def test_generated_rows_do_not_depend_on_layout(spark):
    a, b = (stages.generated(spark, 60, partitions=p).select("id", "formula", "canonical_hash") for p in (1, 5))
    assert collected(a) == collected(b)


def test_unique_and_useful_formulas(spark):
    df = stages.unique_formulas(spark, 30, max_depth=3, useful=True)
    rows = df.collect()
    assert len(rows) == 30 and len({r["canonical_hash"] for r in rows}) == 30
    assert all(decide.tautology(parse(r["formula"])) is not True for r in rows)


def test_store(spark):
    new = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b"), (4, "c")], "id int, k string")
    old = spark.createDataFrame([(0, "c")], "id int, k string")
    assert collected(store.insert_ignore(old, new, "k", "id")) == [(1, "a"), (3, "b")]
    table = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert collected(store.update_by_key(table, spark.createDataFrame([(2, None)], "id int, v string"), "id", ["v"])) == [(1, "x"), (2, None)]
    assert store.add_missing_columns(table, {"v": "int", "w": "int"}).columns == ["id", "v", "w"]
    assert [r["n"] for r in store.with_ids(table, ["v"], 10, "n").orderBy("v").collect()] == [11, 12]


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40) if k % 10 != 9] + [(100, 7), (7, 100), (5, 5), (None, 3), (200, 201)]
    got = dict(connected_components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert got == {**{k: k // 10 * 10 for k in range(40)}, 100: 0, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_aggregates_of_nothing(spark):
    empty = spark.createDataFrame([], "is_correct boolean, score int, verification_time double, verified boolean")
    one = aggregates.judge_statistics(empty).first()
    assert one["total_verified"] == 0 and one["correct_percentage"] is None and one["median_score"] is None
    assert aggregates.verification_summary(empty).first()["correct_pct"] is None
    assert [r["n"] for r in aggregates.dense_histogram(empty, "score", 0, 2).orderBy("bin").collect()] == [0, 0, 0]


def test_stages_from_formula_to_verdict(spark):
    f = spark.createDataFrame([(1, "G {p \\rightarrow F {q}}"), (2, "p \\land"), (3, "\\neg {q} W p")], "id int, formula string")
    done = stages.converted(f)
    assert collected(done.select("id", "status")) == [(1, "valid"), (2, "error"), (3, "valid")]
    said = stages.rendered(done)
    assert collected(said.select("formula_id", "itl_text")) == [(1, "Always, if p, then Eventually, q"), (3, "not q weakly until p")]
    judged = stages.verified(said.join(done.select(F.col("id").alias("formula_id"), F.col("spot_formulas").alias("formula")), "formula_id"))
    assert {r["formula_id"]: r["is_correct"] for r in judged.collect()} == {1: True, 3: False}


def test_over_distinct_keeps_rows_and_nulls(spark):
    df = spark.createDataFrame([("p",), ("p",), (None,), ("p &",)], "f string")
    got = udfs.over_distinct(df, ["f"], ok=udfs.ltl_parse(F.col("f"))["valid"])
    assert sorted(map(str, (r["ok"] for r in got.collect()))) == ["False", "False", "True", "True"]


def test_text_functions(spark):
    one = spark.range(1)
    say = lambda c: one.select(c).first()[0]
    assert say(text.tag(F.lit("a<t> x\n</t>"), "t")) == "x" and say(text.tag(F.lit("a"), "t")) is None
    assert say(text.response(F.lit("<domain>x</domain><activity></activity><translation>t</translation>"))) is None
    assert say(text.basic_conversion(F.lit("G {p"))) is None
    assert say(text.word_count(F.lit(" \n "))) == 0 and say(text.word_count(F.lit("a  b\tc"))) == 3
    assert say(text.balanced(F.lit(")("))) is False
    assert say(text.duration(F.lit(3725.5))) == "1h 2m 5s"
    assert say(text.safe_name(F.lit("a/b"))) == "a__b"
    assert say(text.judge_parse(F.lit('{"is_correct": true, "score": 77}')))["score"] is None


def test_paired_sums_of_hot_and_null_keys(spark):
    few = [(1, 1, 2.0), (1, 1, 3.0), (1, 2, None), (None, 1, 1.0), (2, 1, None), (2, 1, 4.0)]
    hot = spark.range(100_000).selectExpr("9L as a", "9 as b", "cast(id % 7 as double) as v")
    df = spark.createDataFrame(few, "a bigint, b int, v double").union(hot)
    total = sum(k % 7 for k in range(100_000))
    want = [(1, 1, 20.0), (1, 2, None), (2, 1, 8.0), (9, 9, 2.0 * 100_000 * total)]
    assert collected(aggregates.paired_sums(df, df, ["a", "b"], "v", "q")) == want
    assert collected(aggregates.paired_sums(df.filter("v = 2"), df.filter("v = 3"), ["a", "b"], "v", "q"))[0] == (1, 1, 5.0)


def test_partitions_follow_the_table(spark):
    assert runtime.partitions_of(spark.range(1001), 100) == 11 and runtime.partitions_of(spark.range(0), 100) == 4
    df = spark.range(2_500_001).selectExpr("id as a", "id as v")
    assert ", 6), REPARTITION_BY_NUM" in aggregates.paired_sums(df, df, ["a"], "v", "q")._jdf.queryExecution().executedPlan().toString()


def test_metric_table_weighs_pairs_that_repeat(spark):
    schema, once = "prediction string, reference string", [("G(p)", "!F(!p)"), ("F(p)", "G(p)"), ("p &", "p"), ("p", None), ("[Generation failed]", "p"), (None, "p")]
    rows = spark.createDataFrame(once * 10 + once[:1] * 40, schema)
    got = metrics.metric_table(rows.repartition(3), "ltl")
    r = got.first()
    # 50 pairs of one meaning, 10 of two, 10 whose prediction is no formula, 10 without reference
    assert (r["n"], r["exact_match"], r["syntactic_correctness"]) == (80, 0.0, 7 / 8)
    assert r["semantic_equivalence"] == pytest.approx(50 / 60) and r["tree_edit_distance"] == pytest.approx((50 * 3 / 4 + 10 / 2) / 60)
    nodes = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [[k for k, line in enumerate(nodes) if what in line] for what in ("ArrowEvalPython", "Aggregate [prediction")]
    assert at[0] and at[1] and max(at[0]) < min(at[1])  # formulas are counted before they are scored
    assert metrics.metric_table(rows.limit(0), "ltl").first()[:2] == (0, None)
    assert metrics.metric_table(rows, "nl").first()["n"] == 80


def test_reply_is_read_once_not_for_each_domain(spark):
    full = "<domain> {} </domain>\n<activity>a</activity><translation>\nt t </translation><domain>late</domain>"
    replies = [full.format("robotics"), full.format("nothing known"), full.format("Web Services/APIs and Robotics"), full.format("  "), full.replace("activity", "other").format("Robotics"), "", None]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, reply string").withColumn("r", text.response(F.col("reply")))
    assert [r and tuple(r) for _, _, r in df.orderBy("k").collect()] == [("Robotics", "a", "t t"), (DOMAINS[0], "a", "t t"), ("Robotics", "a", "t t"), None, None, None, None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    each = plan[plan.index("filter([") : plan.index(", 1, None", plan.index("filter(["))]
    assert "Contains(" in each and "regexp_extract" not in each and "trim(" not in each


def test_bleu_counts_within_rows_and_across(spark):
    import math
    import random
    from collections import Counter

    rnd = random.Random(5)
    said = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    rows = [(k, said(rnd.randrange(0, 30)), said(rnd.randrange(1, 30))) for k in range(40)] + [(40, said(300), said(200)), (41, "A  b\tc d e", None), (42, None, "a b"), (43, "", "a")]
    rows += [(k % 5, said(9), said(8)) for k in range(20)] + [(None, said(9), said(9))] * 2  # ids of many rows are one item; without one there is no match
    p, r = Counter(), Counter()
    for k, a, b in rows:
        for side, t in ((p, a), (r, b)):
            w = (t or "").lower().split()
            for n in range(1, 5):
                for g in range(len(w) - n + 1):
                    side[k, n, tuple(w[g : g + n])] += 1
    total, hit = ([sum(f(x) for x in p if x[1] == n) for n in range(1, 5)] for f in (p.get, lambda x: min(p[x], r[x]) if x[0] is not None else 0))
    cp, cr = (sum(c for (_, n, _), c in side.items() if n == 1) for side in (p, r))
    want = min(1, math.exp(1 - cr / cp)) * math.exp(sum(math.log(h / t) for h, t in zip(hit, total, strict=True)) / 4)
    df = spark.createDataFrame(rows, "id int, p string, r string").withColumn("of", F.col("id") % 2)
    for long in (1, 7, 50, 20_000):
        for ids in ("id", ["of", "id"]):
            got = metrics.bleu(df, ids, "p", "r", long=long).first()
            assert (got["cp"], got["cr"]) == (cp, cr) and got["bleu"] == pytest.approx(want, rel=1e-12)
    assert tuple(metrics.bleu(df.limit(0), "id", "p", "r").first()) == (0, 0, 0.0)


def test_bleu_of_short_texts_makes_few_rows(spark):
    df = spark.range(3000, numPartitions=3).selectExpr("id", "repeat(concat('w', id, ' x y '), 40) as p", "repeat(concat('w', id, ' x z '), 40) as r")
    made = df.selectExpr("string(null) as key", "p", "r", "true as matched").mapInArrow(metrics._counted(4, 20_000), metrics._COUNTS)
    assert made.count() == 3 * 5


def test_csv_json_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a, "quoted"\nline'), (2, None)], "id bigint, t string")
    tables.write_csv(df, f"{tmp_path}/c")
    assert collected(tables.read_csv(spark, f"{tmp_path}/c", "id bigint, t string")) == collected(df)
    tables.snapshot(df, f"{tmp_path}/s")
    tables.snapshot(df.limit(0), f"{tmp_path}/s")
    tables.append(df, f"{tmp_path}/s")
    assert tables.read_parquet(spark, f"{tmp_path}/s").count() == 4
    tables.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    assert tables.read_sql(spark, "select max(id) as m from {t}", t=df).first()["m"] == 2
    assert tables.processed_keys(spark, "none", "id bigint").count() == 0
    tables.note_processed(df.select("id"), "some")
    assert tables.processed_keys(spark, "some", "id bigint").count() == 2


def test_csv_keeps_every_text(spark, tmp_path):
    odd = ["", " a ", "\tb\n", "\r\n", "\r", "\x00", '\x00"', '"\x00,', '"', '""', "\\", '\\"', "\\N", "\\\\N", "\\N\n", "\ufeffx", "\x0c", "#", "null", None]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate((a, b) for a in odd for b in odd)], "id int, t string, u string")
    tables.write_csv(df, f"{tmp_path}/c")
    assert {r[0]: tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/c", "id int, t string, u string").collect()} == {r[0]: tuple(r) for r in df.collect()}
    tables.write_csv(df.select("t"), f"{tmp_path}/one")
    assert sorted(map(repr, tables.read_csv(spark, f"{tmp_path}/one", "t string").collect())) == sorted(map(repr, df.select("t").collect()))
    (tmp_path / "other.csv").write_text('id,t\n1,\n2,""\n3," x, ""y"""\n')
    assert collected(tables.read_csv(spark, f"{tmp_path}/other.csv", "id int, t string")) == [(1, None), (2, ""), (3, ' x, "y"')]
    (tmp_path / "ends.csv").write_bytes(b'id,t\r\n1,"a, b"\r\n2,c\r\n')
    assert collected(tables.read_csv(spark, f"{tmp_path}/ends.csv", "id int, t string", line_end=None)) == [(1, "a, b"), (2, "c")]


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/corpus.db"
    with sqlite3.connect(path) as db:
        db.execute("create table itl_representations (id integer primary key, formula_id integer, itl_text text, canonical_form boolean, generation_method text, verified boolean, is_correct boolean, verification_errors text)")
        db.executemany("insert into itl_representations values (?, ?, ?, 1, 'canonical_mapping', 0, null, null)", [(k, k, f"t{k}") for k in range(1, 24)])
        db.execute("create table formulas (id integer primary key, formula text)")
    df = tables.read_sqlite(spark, path, "itl_representations", ITL)
    assert df.count() == 23 and df.rdd.getNumPartitions() == 4
    row = df.orderBy("id").first()
    assert row["canonical_form"] is True and row["is_correct"] is None
    assert tables.read_sqlite(spark, path, "formulas", "id bigint, formula string").count() == 0
    assert "canonical_hash" in FORMULAS


def test_incremental_stage_adds_each_key_once(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    batch = lambda ids: spark.createDataFrame([(i, "G(p)") for i in ids], "id int, formula string").write.mode("append").parquet(source)
    run = lambda k: incremental.run_incremental(spark, source, "id int, formula string", out, "id", lambda d: d.withColumn("n", F.length("formula")), checkpoint=f"{tmp_path}/c{k}").awaitTermination(60)
    batch([1, 2])
    run(0)
    batch([2, 3])
    run(0)
    run(1)  # a new checkpoint reads all again
    assert collected(spark.read.parquet(out).select("id")) == [(1,), (2,), (3,)]


def test_sql_names(spark):
    from ltlspark.functions.register import register

    register(spark)
    row = spark.sql("select ltl_canonical('q & p') a, ltl_valid('p &') b, ltl_valid('p') c, ltl_equivalent('G(p)', '!F(!p)') d, ltl_tree_edit_distance('p', 'q') e, ltl_to_itl('G(p)') f, itl_to_ltl('Always, p') g, rouge_l('a b', 'a c') h, ltl_equivalent('p', null) i").first()
    assert tuple(row) == ("p & q", False, True, True, 1.0, "Always, p", "G(p)", 0.5, None)
    got = spark.sql("select f.x, t.kind, t.said from (select 'G p' as x union all select '@') f, lateral ltl_tokens(f.x) t order by t.position").collect()
    assert [tuple(r) for r in got] == [("G p", "always", "G"), ("G p", "atom", "p")]


def test_discard_deletes_what_was_written(spark):
    from ltlspark.runtime import discard, materialise

    df = materialise(spark.range(3), "t")
    path = df.inputFiles()[0].removeprefix("file://")
    other = materialise(spark.range(2), "t")
    discard(df, spark.range(1))
    assert not __import__("os").path.exists(path) and other.count() == 2


@pytest.mark.parametrize("parts", [1, 24])
def test_components_of_random_graphs(spark, parts):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    got = dict(connected_components(spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in edges], "a string, b string").repartition(parts)).collect())
    assert got == {f"n{x:03}": f"n{top(x):03}" for x in list(up)}


def test_components_of_a_long_path_and_a_hub(spark):
    path = spark.range(2000).selectExpr("id as a", "id + 1 as b").repartition(20, "a")
    hub = spark.range(1, 3000).selectExpr("10000 + id as a", "10000L as b").repartition(20)
    got = connected_components(path.union(hub)).groupBy("component").count().collect()
    assert sorted(map(tuple, got)) == [(0, 2001), (10000, 3000)]


def test_a_task_contracts_in_bounded_chunks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(components, "CHUNK", 8)
    batches = [pa.RecordBatch.from_arrays([pa.array([k, k]), pa.array([k + 1, 0])], names=["a", "b"]) for k in range(1, 40)]
    got = pa.Table.from_batches(list(components._contract(iter(batches))))
    assert got.num_rows >= 40 and set(got["b"].to_pylist()) >= {0} and all(x > y for x, y in zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
    assert list(components._contract(iter([]))) == []


def test_json_and_roles(spark):
    from ltlspark.ltl.ast import from_dict, to_dict

    made = [parse(x) for x in ("G(p -> F(q))", "p U (q & r)", "F(G(p))", "p", "G(p -> q)")]
    assert [from_dict(to_dict(f)) for f in made] == made
    df = spark.createDataFrame([(k, [(n["k"], n["a"], n["v"]) for n in to_arena(f)]) for k, f in enumerate(made)], f"i int, ast {AST}").cache()
    back = df.withColumn("j", folds.to_json("ast")).cache()
    back.count()
    assert back.select(F.count_if(udfs.ast_from_json(F.col("j")) == F.col("ast"))).first()[0] == 5
    assert spark.range(1).select(udfs.ast_from_json(F.lit("{"))).first()[0] is None
    roles = ["condition", "left", "right", "antecedent", "consequent", "other"]
    got = [tuple(r) for r in df.orderBy("i").select(*[folds.proposition("ast", r) for r in roles]).collect()]
    no = "the condition"
    assert got == [("(p implies eventually(q))", no, no, "p", "q", no), (no, "p", "(q and r)", no, no, no), ("always(p)", no, no, no, no, no), (no,) * 6, ("(p implies q)", no, no, "p", "q", no)]


def test_updates_that_repeat_a_key(spark):
    table = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "id int, v string")
    new = spark.createDataFrame([(2, "a"), (2, "b"), (2, None), (9, "c")], "id int, v string")
    assert collected(store.update_by_key(table, new, "id", ["v"])) == [(1, "x"), (2, "b"), (2, "b")]


def test_running_average_of_hot_groups_nulls_and_ties(spark):
    rows = [("hot", k, float(k % 7)) for k in range(500)] + [("other", 3, 1.0), ("other", 1, None), (None, 5, 2.0), ("hot", None, 4.0)]
    df = spark.createDataFrame(rows, "g string, t int, v double").repartition(5)
    got = {(r["g"], r["t"]): r["running"] for r in store.running_average(df, "t", "v", "g").collect()}
    assert len(got) == len(rows) and got["hot", None] == 4.0 and got[None, 5] == 2.0 and got["other", 1] is None and got["other", 3] == 1.0
    assert abs(got["hot", 499] - (sum(k % 7 for k in range(500)) + 4) / 501) < 1e-12 and abs(got["hot", 9] - (sum(k % 7 for k in range(10)) + 4) / 11) < 1e-12
    assert store.running_average(df.limit(0), "t", "v", "g").count() == 0


def test_samples_are_dealt_into_ranges(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "k")
    want = collected(sampling.fraction_sample(df, "k", 10))
    monkeypatch.setattr(sampling, "BUCKET", 7)
    assert collected(sampling.fraction_sample(df, "k", 10)) == want and len(want) == 300


def test_published_latex_of_many_operands(spark):
    rows = [(k, [(n["k"], n["a"], n["v"]) for n in to_arena(parse(x))]) for k, x in enumerate(["p & q & (r | s)", "!(p | q)"])]
    df = spark.createDataFrame(rows, f"i int, ast {AST}")
    assert [r[0] for r in df.orderBy("i").select(folds.ltl_published("ast")).collect()] == ["p \\land q \\land \\left(r \\lor s\\right)", "\\neg {p \\lor q}"]


def test_grid_and_progress(spark):
    from ltlspark.plans.experiments import grid

    assert grid(spark, ["a", "b"], ["x"]).count() == 2


def test_verdicts_of_many_replies(spark):
    replies = [
        ('```json\n{"is_correct": true, "score": 11, "issues": ["a"], "reasoning": "r"}\n```', (True, None, ["a"], "json")),
        ('{"is_correct": false}', (False, None, [], "json")),
        ('text before {"score": 4, "issues": null} after', (False, 4, [], "json")),
        ('{"broken": ', (False, 3, [text.DEFAULT_ISSUE], "text")),
        ('IS_CORRECT: TRUE score: 7 issues: []', (True, 7, [], "text")),
        ('is_correct: false issues: [one, two]', (False, 3, ["one", "two"], "text")),
        ("it accurately captures the formula", (True, 8, [], "text")),
        ("an incorrect translation, not equivalent", (False, 3, [text.DEFAULT_ISSUE], "text")),
        ("", (False, 3, [text.DEFAULT_ISSUE], "text")),
        ("score: 99999999999999", (False, None, [text.DEFAULT_ISSUE], "text")),
    ]
    df = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(replies)] + [(99, None)], "k int, r string")
    got = {x["k"]: x["j"] for x in df.select("k", text.judge_parse(F.col("r")).alias("j")).collect()}
    assert got.pop(99) is None
    for k, (_, want) in enumerate(replies):
        assert (got[k]["is_correct"], got[k]["score"], got[k]["issues"], got[k]["source"]) == want, replies[k]


def test_english_as_trees(spark):
    df = spark.createDataFrame([("Always, p",), ("nothing in particular",), (None,)], "s string")
    got = [(r["s"], r["p"]["valid"], r["p"]["ast"] is not None) for r in df.select("s", udfs.itl_parse(F.col("s")).alias("p")).collect()]
    assert got == [("Always, p", True, True), ("nothing in particular", False, False), (None, False, False)]


def test_domain_counts_over_a_stream(spark, tmp_path):
    rows = [("2025-05-09 10:05:00", "Robotics"), ("2025-05-09 10:55:00", "Robotics"), ("2025-05-09 11:05:00", "Aerospace")]
    spark.createDataFrame(rows, "t string, domain string").select(F.to_timestamp("t").alias("t"), "domain").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t timestamp, domain string").parquet(f"{tmp_path}/in")
    q = incremental.domain_counts(stream, "t", "domain").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert collected(spark.table("counts").select(F.hour("window.start"), "domain", "n")) == [(10, "Robotics", 2), (11, "Aerospace", 1)]


def test_schemas_are_those_of_written_tables(spark, tmp_path):
    from ltlspark.schema import TABLES

    for name, schema in TABLES.items():
        made = spark.createDataFrame([], schema)
        made.write.parquet(f"{tmp_path}/{name}")
        back = tables.read_parquet(spark, f"{tmp_path}/{name}", schema)
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in made.schema] and back.count() == 0
