"""All queries of the engine by name, and their DuckDB SQL.

Each is an operator of the library over whole test tables (stand-ins for the corpus'
tables are in standins.py). `golden` results are tables of values joined by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import goldens
from .functions import folds, metrics, text, udfs
from .ltl.ast import atoms, depth, operators, to_arena
from .ltl.generate import space_size
from .ltl.parse import parse
from .operators import aggregates, corpus, sampling, store
from .plans import experiments, stages
from .runtime import scratch, table
from .schema import AST, DOMAINS, GOLDEN
from .sources import tables
from .standins import CONTEXT, DOMAIN_RUNS, GOLD, frame, quoted, values, with_tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    """Register a function under its name, with SQL over the test tables and the named stand-ins."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = with_tables(sql, *names) if names else sql
        return f

    return keep


def _golden(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def _orders_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, each with a golden formula, its tree and its English."""
    rows = [(k, ltl, itl, said) for k, (ltl, itl, said) in enumerate(GOLDEN)]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 31).cast("int").alias("k"))
    df = orders.join(_golden(spark, "k int, ltl string, itl string, said string", rows), "k")
    return udfs.over_distinct(df, ["ltl"], parsed=udfs.ltl_parse(F.col("ltl"))).withColumn("ast", F.col("parsed.ast"))


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, each with a golden formula's stored tree: no Python in what follows."""
    rows = [(k, ltl, [(n["k"], n["a"], n["v"]) for n in to_arena(parse(ltl))]) for k, (ltl, _, _) in enumerate(GOLDEN)]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 31).cast("int").alias("k"))
    return orders.join(_golden(spark, f"k int, ltl string, ast {AST}", rows), "k")


def _dealt(spark: SparkSession, sf_dir: str, schema: str, rows: list[tuple]) -> DataFrame:
    """Orders, each with one of the rows, in turn."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % len(rows)).cast("int").alias("k"))
    return orders.join(_golden(spark, f"k int, {schema}", [(k, *r) for k, r in enumerate(rows)]), "k")


def _dealt_trees(spark: SparkSession, sf_dir: str, formulas: list[str]) -> DataFrame:
    """Orders, each with a formula and its stored tree."""
    return _dealt(spark, sf_dir, f"ltl string, ast {AST}", [(f, [(n["k"], n["a"], n["v"]) for n in to_arena(parse(f))]) for f in formulas])


def _dealt_sql(columns: str, rows: list[tuple], select: str) -> str:
    return f"select {select} from orders join {values([(k, *r) for k, r in enumerate(rows)])} as g(k, {columns}) on g.k = o_orderkey % {len(rows)}"


def _gold_sql(columns: str, rows: list[tuple], select: str) -> str:
    return f"select {select} from orders join {values(rows)} as g(k, {columns}) on g.k = o_orderkey % 31"


def _r(c, n: int = 6) -> Column:
    return F.round(c, n)


# --- scans, joins and the corpus' own queries


@query("select depth, count(*) as n, (select count(*) from formulas) as total from formulas group by depth", "formulas")
def depth_distribution(spark, d):
    return corpus.depth_distribution(frame(spark, d, "formulas"))


@query(
    """select f.id, i.id as itl_id, coalesce(nullif(spot_formulas, ''), formula) as formula, itl_text, depth from formulas f join itl i on f.id = i.formula_id
    where depth >= 2 and i.canonical_form and not exists (select 1 from translations t where t.formula_id = f.id and t.itl_id = i.id)""",
    "formulas", "itl", "translations",
)
def untranslated(spark, d):
    return corpus.untranslated(frame(spark, d, "formulas"), frame(spark, d, "itl"), frame(spark, d, "translations"), 2)


@query(
    """select f.id, i.id as itl_id, coalesce(nullif(spot_formulas, ''), formula) as formula, itl_text, depth from formulas f join itl i on f.id = i.formula_id
    where depth >= 1 and i.canonical_form and not exists (select 1 from translations t where t.formula_id = f.id and t.itl_id = i.id) order by f.id, i.id limit 64 offset 64""",
    "formulas", "itl", "translations",
)
def untranslated_page(spark, d):
    return corpus.untranslated(frame(spark, d, "formulas"), frame(spark, d, "itl"), frame(spark, d, "translations"), 1, 64, 64)


@query(
    """select t.formula_id, t.itl_id, t.id as translation_id, t.domain, t.activity, t.translation, i.itl_text, i.canonical_form as itl_canonical, f.formula, f.canonical_form as ltl_canonical, f.depth
    from formulas f join itl i on f.id = i.formula_id join translations t on t.formula_id = i.formula_id and t.itl_id = i.id""",
    "formulas", "itl", "translations",
)
def triplet_join(spark, d):
    return corpus.triplets(frame(spark, d, "formulas"), frame(spark, d, "itl"), frame(spark, d, "translations"))


@query(
    """select f.id, f.formula, i.itl_text, t.domain, t.translation from formulas f left join itl i on f.id = i.formula_id and i.canonical_form
    left join translations t on t.formula_id = f.id and t.itl_id = i.id where i.itl_text is not null and t.translation is not null""",
    "formulas", "itl", "translations",
)
def complete_triplets(spark, d):
    return corpus.complete_triplets(frame(spark, d, "formulas"), frame(spark, d, "itl"), frame(spark, d, "translations"))


_UNVERIFIED = "select i.id as itl_id, i.formula_id, f.formula, f.spot_formulas, f.canonical_form, i.itl_text from itl i join formulas f on f.id = i.formula_id where not i.verified"


@query(_UNVERIFIED, "formulas", "itl")
def unverified_itl(spark, d):
    return corpus.unverified(frame(spark, d, "formulas"), frame(spark, d, "itl"))


@query(_UNVERIFIED + " order by i.id limit 64 offset 128", "formulas", "itl")
def unverified_page(spark, d):
    return corpus.unverified(frame(spark, d, "formulas"), frame(spark, d, "itl"), 64, 128)


@query("select id, spot_formulas, canonical_form from formulas where spot_formulas is null or canonical_form is null", "formulas")
def formulas_to_convert(spark, d):
    return corpus.to_convert(frame(spark, d, "formulas")).select("id", "spot_formulas", "canonical_form")


@query("select count(*) as n from formulas where spot_formulas is null or canonical_form is null", "formulas")
def formulas_to_convert_count(spark, d):
    return corpus.to_convert(frame(spark, d, "formulas")).agg(F.count("*").alias("n"))


@query(
    """select count(*) as total, count(*) filter (verified) as verified, count(*) filter (verified and is_correct) as correct, count(*) filter (verified and not is_correct) as incorrect,
    round(100.0 * count(*) filter (verified and is_correct) / nullif(count(*) filter (verified), 0)::double, 6) as correct_pct, round(100.0 * count(*) filter (verified and not is_correct) / nullif(count(*) filter (verified), 0)::double, 6) as incorrect_pct from itl""",
    "itl",
)
def verification_summary(spark, d):
    return aggregates.verification_summary(frame(spark, d, "itl")).withColumns({c: _r(c) for c in ("correct_pct", "incorrect_pct")})


@query(f"select d.name as domain, count(t.id) as n from {values([(x,) for x in [*DOMAINS, 'Unused']])} as d(name) left join translations t on t.domain = d.name group by 1", "translations")
def domain_stats_zero_fill(spark, d):
    dimension = spark.createDataFrame([(x,) for x in [*DOMAINS, "Unused"]], "domain string")
    return aggregates.zero_filled_counts(frame(spark, d, "translations"), "domain", dimension)


@query("select id, not exists (select 1 from translations t where t.formula_id = f.id) as pending from formulas f", "formulas", "translations")
def pending_translations(spark, d):
    return corpus.pending(frame(spark, d, "formulas"), frame(spark, d, "translations"))


@query("select 'formulas' as table_name, count(*) as n from formulas union all select 'itl', count(*) from itl union all select 'translations', count(*) from translations", "formulas", "itl", "translations")
def corpus_row_counts(spark, d):
    return corpus.row_counts(**{n: frame(spark, d, n) for n in ("formulas", "itl", "translations")})


@query("select doc_id, source from documents order by doc_id limit 50 offset 20")
def paged_scan(spark, d):
    return store.page(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 20, 50)


@query("select doc_id, n_chars from documents where n_chars >= 500 and not exists (select 1 from labels l where l.doc_id = documents.doc_id)")
def unlabelled_antijoin(spark, d):
    docs = table(spark, d, "documents").filter("n_chars >= 500").select("doc_id", "n_chars")
    return store.existing_keys(docs, table(spark, d, "labels"), "doc_id", present=False)


@query("select doc_id, n_chars from documents where exists (select 1 from labels l where l.doc_id = documents.doc_id)")
def labelled_semijoin(spark, d):
    return store.existing_keys(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels"), "doc_id")


@query("select p.l_orderkey, p.l_linenumber, sum(p.l_quantity + s.l_quantity) as q from lineitem p join lineitem s on p.l_orderkey = s.l_orderkey and p.l_linenumber = s.l_linenumber group by 1, 2")
def composite_key_join(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return aggregates.paired_sums(l, l, ["l_orderkey", "l_linenumber"], "l_quantity", "q")


# --- filters and projections


@query("select e.event_type, count(*) as n from events e where event_type not in ('view', 'click') and value >= 10 group by 1")
def filtered_events(spark, d):
    return table(spark, d, "events").filter(~F.col("event_type").isin("view", "click") & (F.col("value") >= 10)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("select c_custkey, coalesce(nullif(case when c_custkey % 3 = 0 then '' when c_custkey % 5 = 0 then null else c_mktsegment end, ''), c_name) as label from customer")
def first_filled(spark, d):
    c = table(spark, d, "customer")
    maybe = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", text.first_filled(maybe, F.col("c_name")).alias("label"))


@query("select status, count(*) as n from (select case when n_chars % 3 = 0 then 'valid' when n_chars % 2 = 0 then 'basic' else 'error' end as status from documents) group by 1")
def conversion_status(spark, d):
    docs = table(spark, d, "documents").withColumns({"a": F.col("n_chars") % 3 == 0, "b": F.col("n_chars") % 2 == 0})
    return corpus.conversion_status(docs, "a", "b").groupBy("status").agg(F.count("*").alias("n"))


@query("select starts_with(c_name, 'Customer#00000') as low, count(*) as n from customer where c_name is not null group by 1")
def prefix_filter(spark, d):
    return table(spark, d, "customer").filter(F.col("c_name").isNotNull()).groupBy(F.startswith("c_name", F.lit("Customer#00000")).alias("low")).agg(F.count("*").alias("n"))


@query("select count(*) as n, count(*) filter (prediction = reference) as same from predictions where prediction is not null and prediction <> '[Generation failed]'", "predictions")
def sentinel_filter(spark, d):
    return metrics.valid_pairs(frame(spark, d, "predictions")).agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("reference")).alias("same"))


# --- sinks


@query("select h, min(doc_id) as doc_id from (select doc_id, sha256(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) as h from documents) group by 1")
def dedup_store(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.regexp_replace(F.lower("text"), r"[ \t\n\r\f\x0B]+", " "), 256).alias("h"))
    return store.insert_ignore(None, docs, "h", "doc_id")


@query("select doc_id, h from (select min(doc_id) as doc_id, source || ':' || (doc_id % 7)::varchar as h from documents group by 2) where h not in (select source || ':' || (doc_id % 7)::varchar from documents where doc_id < 40)")
def insert_into_store(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(":"), (F.col("doc_id") % 7).cast("string")).alias("h"))
    return store.insert_ignore(docs.filter("doc_id < 40"), docs, "h", "doc_id")


@query("select d.doc_id, case when l.doc_id is null then d.n_chars else l.quality end::bigint as n_chars from documents d left join labels l on l.doc_id = d.doc_id")
def update_by_key(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    new = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars"))
    return store.update_by_key(docs, new, "doc_id", ["n_chars"])


@query("select doc_id, 100 + row_number() over (order by source, doc_id) as id from documents")
def generated_ids(spark, d):
    return store.with_ids(table(spark, d, "documents").select("source", "doc_id"), ["source", "doc_id"], 100).select("doc_id", "id")


@query("select o_orderkey, (select max(c_custkey) from customer) + row_number() over (order by o_custkey, o_orderkey) as id from orders")
def next_ids(spark, d):
    existing = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return store.with_next_ids(existing, table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], time_col="at").select("o_orderkey", "id")


@query("select doc_id, text, source, n_chars from documents")
def csv_round_trip(spark, d):
    """Texts with commas, quotes and line ends, written as CSV and read back."""
    path = scratch(spark, "csv")
    tables.write_csv(table(spark, d, "documents").select("doc_id", "text", "source", "n_chars"), path)
    return tables.read_csv(spark, path, "doc_id bigint, text string, source string, n_chars bigint")


@query("select conv_id, turn, role, text from conversations")
def json_round_trip(spark, d):
    path = scratch(spark, "json")
    tables.write_json(table(spark, d, "conversations"), path)
    return spark.read.schema("conv_id bigint, turn bigint, role string, text string").json(path)


@query("select doc_id, n_chars from documents where doc_id % 2 = 0 union all select doc_id, n_chars from documents where doc_id % 3 = 0")
def snapshot_and_append(spark, d):
    """A snapshot that a second one does not replace, and an addition to it."""
    docs, path = table(spark, d, "documents").select("doc_id", "n_chars"), scratch(spark, "snapshot")
    tables.snapshot(docs.filter("doc_id % 2 = 0"), path)
    tables.snapshot(docs, path)
    tables.append(docs.filter("doc_id % 3 = 0"), path)
    return tables.read_parquet(spark, path, "doc_id bigint, n_chars bigint")


@query("select source, count(*) as n, round(avg(n_chars), 6) as mean from documents where n_chars > 100 group by 1")
def sql_scan(spark, d):
    return tables.read_sql(spark, "select source, count(*) as n, round(avg(n_chars), 6) as mean from {docs} where n_chars > 100 group by 1", docs=table(spark, d, "documents"))


@query(
    """select 'summary' as section, 'total' as key, count(*)::varchar as value from results union all select 'summary', 'correct', count(*) filter (is_correct)::varchar from results
    union all select 'scores', b::varchar, count(score)::varchar from range(11) r(b) left join results on score = b group by b""",
    "results",
)
def report_file(spark, d):
    """The statistics report through its CSV file."""
    path = scratch(spark, "report")
    tables.write_report(statistics_report(spark, d), path)
    return tables.read_csv(spark, path, "section string, key string, value string")


@query("select n_nationkey, n_name, null::varchar as canonical_form from nation")
def added_columns(spark, d):
    return store.add_missing_columns(table(spark, d, "nation").select("n_nationkey", "n_name"), {"canonical_form": "string", "n_name": "string"})


@query("""select '{"n":' || count(*)::varchar || ',"top":' || max(score)::varchar || '}' as statistics_json from results""", "results")
def statistics_json(spark, d):
    return tables.statistics_json(frame(spark, d, "results").agg(F.count("*").alias("n"), F.max("score").alias("top"))).select("statistics_json")


@query(
    """select 'summary' as section, 'total' as key, count(*)::varchar as value from results union all select 'summary', 'correct', count(*) filter (is_correct)::varchar from results
    union all select 'scores', b::varchar, count(score)::varchar from range(11) r(b) left join results on score = b group by b""",
    "results",
)
def statistics_report(spark, d):
    results = frame(spark, d, "results")
    one = results.agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"))
    return aggregates.statistics_report(one, aggregates.dense_histogram(results, "score", 0, 10))


# --- aggregates


@query(
    """select count(*) as total_verified, count(*) filter (is_correct) as correct, count(*) filter (not is_correct) as incorrect, count(*) filter (score > 10) as invalid_scores,
    round(avg(score) filter (score <= 10), 6) as average_score, median(score) filter (score <= 10)::double as median_score, round(avg(verification_time), 6) as average_time, min(verification_time) as min_time, max(verification_time) as max_time,
    round(100.0 * count(*) filter (is_correct) / count(*)::double, 6) as correct_percentage, round(100.0 * count(*) filter (not is_correct) / count(*)::double, 6) as incorrect_percentage from results""",
    "results",
)
def judge_statistics(spark, d):
    return aggregates.judge_statistics(frame(spark, d, "results")).withColumns({c: _r(c) for c in ("average_score", "average_time", "correct_percentage", "incorrect_percentage")})


@query("select b::int as bin, count(score) as n, round(100.0 * count(score) / (select count(*) from results)::double, 6) as percentage from range(11) r(b) left join results on score = b group by b", "results")
def score_histogram(spark, d):
    return aggregates.dense_histogram(frame(spark, d, "results"), "score", 0, 10).withColumn("percentage", _r("percentage"))


@query("select lang, count(*) as n from documents group by 1 order by n desc, lang")
def value_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


_WORDS = r"case when btrim(t) = '' then 0 else len(string_split(btrim(t), ' ')) end"


@query(f"""select count(w) as n, round(avg(w), 6) as mean, round(stddev_samp(w), 6) as std, min(w) as min, round(quantile_cont(w, 0.25), 6) as p25, round(quantile_cont(w, 0.5), 6) as p50, round(quantile_cont(w, 0.75), 6) as p75, max(w) as max
    from (select ({_WORDS})::double as w from (select trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) as t from documents))""".replace("btrim", "trim"))
def word_count_describe(spark, d):
    words = table(spark, d, "documents").select(text.word_count(F.col("text")).alias("w"))
    return aggregates.describe(words, "w").withColumns({c: _r(c) for c in ("mean", "std", "p25", "p50", "p75")})


@query("with e as (select min(n_chars)::double as lo, max(n_chars)::double as hi from documents) select least(floor((n_chars - lo) * 30 / (hi - lo)) + 1, 30)::int as bin, count(*) as n from documents, e group by 1")
def fixed_bins(spark, d):
    return aggregates.fixed_bins(table(spark, d, "documents"), "n_chars", 30)


@query("""select count(*) as total, count(*) filter (generation_method = 'canonical_mapping') as success, count(*) filter (generation_method <> 'canonical_mapping') as failed, count(*) filter (generation_method is null) as skipped,
    round(100.0 * count(*) filter (generation_method = 'canonical_mapping') / count(*)::double, 6) as success_rate from itl""", "itl")
def status_counters(spark, d):
    return aggregates.status_counters(frame(spark, d, "itl"), "generation_method", "canonical_mapping").withColumn("success_rate", _r("success_rate"))


@query("""with x as (select unnest(['depth_' || (l_linenumber)::varchar, 'operators_' || (l_suppkey // 5 * 5)::varchar || '-' || (l_suppkey // 5 * 5 + 4)::varchar, 'propositions_' || (l_partkey % 9)::varchar]) as bin, l_quantity as v from lineitem)
    select bin, count(*) as n, round(avg(v), 6) as mean from x group by 1 having count(*) >= 5""")
def complexity_bins(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return aggregates.complexity_bins(l, F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey") % 9, F.col("l_quantity")).withColumn("mean", _r("mean"))


@query("""select l_suppkey, count(*) filter (l_returnflag = 'R') as n_with, count(*) filter (l_returnflag <> 'R') as n_without, round(avg(l_discount) filter (l_returnflag = 'R'), 6) as "with", round(avg(l_discount) filter (l_returnflag <> 'R'), 6) as "without",
    round(avg(l_discount) filter (l_returnflag = 'R') - avg(l_discount) filter (l_returnflag <> 'R'), 6) as difference from lineitem group by 1 having n_with >= 10 and n_without >= 10""")
def context_impact(spark, d):
    out = aggregates.paired_by_group(table(spark, d, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R", F.col("l_discount"))
    return out.withColumns({c: _r(c) for c in ("with", "without", "difference")})


@query("select count(distinct formula) as formulas, count(distinct canonical_hash) as hashes from formulas", "formulas")
def count_distinct(spark, d):
    return frame(spark, d, "formulas").agg(F.countDistinct("formula").alias("formulas"), F.countDistinct("canonical_hash").alias("hashes"))


@query("select user_id, event_id, round(avg(value) over (partition by user_id order by event_id rows between unbounded preceding and current row), 9) as running from events")
def running_average(spark, d):
    return store.running_average(table(spark, d, "events").select("user_id", "event_id", "value"), "event_id", "value", "user_id").select("user_id", "event_id", _r("running", 9).alias("running"))


# --- samples and splits

_H = "('0x' || substr(md5({}::varchar || ':' || {}::varchar), 1, 8))::bigint"


@query(f"select doc_id from (select doc_id, row_number() over (order by {_H.format(42, 'doc_id')}, doc_id) as k, count(*) over () as n from documents) where k * 100 <= n * 18")
def fraction_sample(spark, d):
    return sampling.fraction_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 18)


@query(
    f"""select translation_id from (select *, row_number() over (order by {_H.format(42, 'translation_id')}, translation_id) as k, count(*) over () as n from
    (select t.id as translation_id from translations t join itl i on t.formula_id = i.formula_id and t.itl_id = i.id join formulas f on f.id = t.formula_id where t.id not in (select translation_id from results))) where k * 100 <= n * 18""",
    "formulas", "itl", "translations", "results",
)
def judge_candidates(spark, d):
    return corpus.judge_candidates(*(frame(spark, d, n) for n in ("formulas", "itl", "translations", "results"))).select("translation_id")


@query(f"select doc_id, source from documents order by {_H.format(42, 'doc_id')}, doc_id limit 100")
def fixed_sample(spark, d):
    return sampling.fixed_sample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100)


_SPLIT = f"""select doc_id, lang, case when k <= n // 10 then 'test' when k <= 2 * (n // 10) then 'val' else 'train' end as split
    from (select doc_id, lang, row_number() over (partition by lang order by {_H.format(42, 'doc_id')}, doc_id) as k, count(*) over (partition by lang) as n from documents)"""


def _split(spark, d):
    return sampling.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query(_SPLIT)
def stratified_split(spark, d):
    return _split(spark, d)


@query(f"with s as ({_SPLIT}) select lang as held_out, (select count(*) from s where split = 'train') - count(*) filter (split = 'train') as train_rows, count(*) filter (split = 'test') as test_rows from s group by 1")
def leave_one_out(spark, d):
    return sampling.leave_one_out(_split(spark, d), "lang")


@query(f"with s as ({_SPLIT}) select doc_id from s where split = 'train' and lang <> 'en'")
def leave_one_out_rows(spark, d):
    return sampling.leave_one_out_rows(_split(spark, d), "lang", "en").select("doc_id")


@query(
    f"""with s as ({_SPLIT}), fit as (select lang from (select lang, count(*) filter (split = 'train') as tr, count(*) filter (split = 'test') as te from s group by 1 order by lang limit 3) where tr >= 50 and te > 0),
    r as (select doc_id, lang, row_number() over (partition by lang order by {_H.format("'42:shot'", 'doc_id')}, doc_id) as rank from s where split = 'train' and lang in (select lang from fit))
    select k::int as k, lang, doc_id from r, (values (1), (5), (10), (25), (50)) v(k) where rank <= k"""
)
def few_shot(spark, d):
    return sampling.few_shot(_split(spark, d), "doc_id", "lang")


_COUNTS = "(select lang, count(*) as n from documents group by 1)"
_PROB = f"(select lang, n, power(1.0 / (n + 1), 1 / 0.3) / sum(power(1.0 / (n + 1), 1 / 0.3)) over () as probability from {_COUNTS})"


@query(f"select lang, n, round(probability, 9) as probability from {_PROB}")
def balanced_probabilities(spark, d):
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return sampling.balanced_probabilities(counts, "lang", "n").withColumn("probability", _r("probability", 9))


@query(f"""with s as (select lang, sum(probability) over (order by lang) as upto, lag(lang) over (order by lang) as before, coalesce(sum(probability) over (order by lang rows between unbounded preceding and 1 preceding), 0) as since from {_PROB})
    select o_orderkey, lang as domain from (select o_orderkey, {_H.format(42, 'o_orderkey')} / 4294967296.0::double as u from orders) o join s on u < upto and u >= since""")
def assign_balanced(spark, d):
    counts = table(spark, d, "documents").groupBy(F.col("lang").alias("domain")).agg(F.count("*").alias("n"))
    return sampling.assign_balanced(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", sampling.balanced_probabilities(counts, "domain", "n"), "domain").select("o_orderkey", "domain")


# --- text


@query("select page_id, case when regexp_matches(html, '(?s)<title>(.*?)</title>') then trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ' \t\n\r\f\v') end as title from pages")
def tag_extract(spark, d):
    return table(spark, d, "pages").select("page_id", text.tag(F.col("html"), "title").alias("title"))


@query(
    """select conv_id, turn, case when turn % 4 <> 3 and trim(text, ' \t\n\r\f\v') <> '' then 'Robotics' end as domain, case when turn % 4 <> 3 and trim(text, ' \t\n\r\f\v') <> '' then trim(text, ' \t\n\r\f\v') end as translation
    from conversations"""
)
def tagged_response(spark, d):
    reply = F.concat(F.lit("<domain>robotics systems and Robotics</domain>\n<activity> a </activity><translation>"), F.col("text"), F.lit("</translation>"))
    full = F.when(F.col("turn") % 4 == 3, F.lit("<domain>x</domain>")).otherwise(reply)
    return table(spark, d, "conversations").withColumn("r", text.response(full)).select("conv_id", "turn", "r.domain", "r.translation")


def _domain_sql(c: str) -> str:
    return "case " + " ".join(f"when contains({quoted(x.lower())}, lower(trim({c}))) or contains(lower(trim({c})), {quoted(x.lower())}) then {quoted(x)}" for x in DOMAINS) + f" else {quoted(DOMAINS[0])} end"


_SEGMENTS = "case p_size % 5 when 0 then ' robotics ' when 1 then 'Finance' when 2 then 'web services' when 3 then 'the Aerospace and Medical Devices' else p_type end"


@query(f"select p_partkey, {_domain_sql(_SEGMENTS)} as domain from part")
def domain_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalise_domain(F.expr(_SEGMENTS)).alias("domain"))


# Replies of a model, and what they come to.
_REPLIES = [
    ('```json {"is_correct": true, "score": 9, "issues": [], "reasoning": "ok"} ```', True, 9, "", "json"),
    ('is_correct: false, "score": 2, issues: ["F vs X", "late"]', False, 2, "F vs X|late", "text"),
    ("This is a correct translation.", True, 8, "", "text"),
    ("This misrepresents the formula.", False, 3, text.DEFAULT_ISSUE, "text"),
    ("It is an accurate and correct translation but not equivalent", False, 3, text.DEFAULT_ISSUE, "text"),
    ('{"score": 7}', False, 7, "", "json"),
    ('{not json, score: 99, is_correct": true}', True, None, "", "text"),
]


@query(f"select o_orderkey, is_correct, score::int as score, issues, source from orders join {values([(k, *r[1:]) for k, r in enumerate(_REPLIES)])} as g(k, is_correct, score, issues, source) on g.k = o_orderkey % 7")
def judge_parse(spark, d):
    replies = _golden(spark, "k int, reply string", [(k, r[0]) for k, r in enumerate(_REPLIES)])
    df = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7).cast("int").alias("k")).join(replies, "k").withColumn("j", text.judge_parse(F.col("reply")))
    return df.select("o_orderkey", "j.is_correct", "j.score", F.array_join("j.issues", "|").alias("issues"), "j.source")


_TURNS = "select a.text as p, b.text as r, a.conv_id, a.turn from conversations a join conversations b on a.conv_id = b.conv_id and a.turn + 1 = b.turn"


def _turns(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return c.withColumnRenamed("text", "p").join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r")), ["conv_id", "turn"])


@query(f"select count(*) as n, avg((trim(p, ' \t\n\r\f\v') = trim(r, ' \t\n\r\f\v'))::double) as exact, avg((lower(regexp_replace(trim(p, ' \t\n\r\f\v'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) = lower(regexp_replace(trim(upper(p), ' \t\n\r\f\v'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))::double) as normalized from ({_TURNS})")
def exact_match(spark, d):
    return _turns(spark, d).agg(F.count("*").alias("n"), F.avg(metrics.exact_match(F.col("p"), F.col("r"))).alias("exact"), F.avg(metrics.normalized_exact_match(F.col("p"), F.upper("p"))).alias("normalized"))


@query("select a.p_partkey, levenshtein(a.p_name, b.p_name)::int as distance from part a join part b on a.p_partkey + 1 = b.p_partkey")
def levenshtein_pairs(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").alias("distance"))


@query("select doc_id, case when length(text) > 40 then substr(text, 1, 40) || '...' else text end as preview from documents")
def preview(spark, d):
    return table(spark, d, "documents").select("doc_id", text.preview(F.col("text"), 40).alias("preview"))


@query("select l_orderkey, l_linenumber, (l_extendedprice::bigint // 3600)::varchar || 'h ' || (l_extendedprice::bigint % 3600 // 60)::varchar || 'm ' || (l_extendedprice::bigint % 60)::varchar || 's' as took from (select l_orderkey, l_linenumber, floor(l_extendedprice) as l_extendedprice from lineitem)")
def durations(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.duration(F.col("l_extendedprice")).alias("took"))


@query("select vec_id, list_transform(embedding, lambda x: case when floor(x * 10) = -1 then 0 else floor(x * 10)::int end)::varchar as ids from embeddings")
def mask_tokens(spark, d):
    ids = F.transform("embedding", lambda x: F.floor(x * 10).cast("int"))
    masked = text.mask_tokens(ids, 0, -1)
    return table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(masked, ", "), F.lit("]")).alias("ids"))


@query(f"select o_orderkey, atom from orders join {values([(k, a) for k, (_, a) in enumerate(goldens.ATOMS)])} as g(k, atom) on g.k = o_orderkey % {len(goldens.ATOMS)}")
def clean_atoms(spark, d):
    return _dealt(spark, d, "said string", [(t,) for t, _ in goldens.ATOMS]).select("o_orderkey", text.clean_atom(F.col("said")).alias("atom"))


@query("""with s as (select page_id, list_reduce(list_transform(string_split(regexp_replace(html, '[^()]', '', 'g'), ''), lambda x: case x when '(' then 1 when ')' then -1 else 0 end), lambda a, x: case when a < 0 then a else a + x end, 0) as level from pages) select page_id, level = 0 as balanced from s""")
def balanced_parentheses(spark, d):
    return table(spark, d, "pages").select("page_id", text.balanced(F.col("html")).alias("balanced"))


_LATEX = ["G {p \\rightarrow F {q}}", "\\left(p \\land q\\right) U r", "\\neg {\\neg {p}} \\leftrightarrow p", "G {p \\land q}", "{p", "p  \\lor   q"]
_BASIC = ["G p -> F q", "(p & q) U r", "! ! p <-> p", "G p & q", None, "p | q"]


@query(f"select o_orderkey, basic from orders join {values(list(enumerate(_BASIC)))} as g(k, basic) on g.k = o_orderkey % {len(_LATEX)}")
def basic_conversion(spark, d):
    g = _golden(spark, "k int, latex string", list(enumerate(_LATEX)))
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % len(_LATEX)).cast("int").alias("k")).join(g, "k").select("o_orderkey", text.basic_conversion(F.col("latex")).alias("basic"))


@query("select p_partkey, regexp_replace('G|(' || p_name || ') U | (q', '([GFXURWM])[ ]*\\|[ ]*\\(', '\\1(', 'g') as repaired from part")
def repaired_operators(spark, d):
    return table(spark, d, "part").select("p_partkey", text.repair_operators(F.concat(F.lit("G|("), "p_name", F.lit(") U | (q"))).alias("repaired"))


@query("select paren_depth, count(*) as n from (select (length(html) - length(replace(html, '(', '')))::int as paren_depth from pages) group by 1")
def paren_depth_hist(spark, d):
    return table(spark, d, "pages").groupBy(folds.paren_depth(F.col("html")).alias("paren_depth")).agg(F.count("*").alias("n"))


def _variation_sql() -> str:
    each = " union all ".join(f"select o_orderkey, replace(itl, {quoted(a)}, {quoted(b)}) as v from g where contains(itl, {quoted(a)})" for a, b in text.SIMPLE + text.ADDITIONAL)
    return f"with g as ({_gold_sql('itl', [(k, i) for k, (_, i, _) in enumerate(GOLDEN)], 'o_orderkey, itl')}) select distinct o_orderkey, v from ({each})"


@query(_variation_sql())
def paraphrase_explode(spark, d):
    g = _golden(spark, "k int, itl string", [(k, i) for k, (_, i, _) in enumerate(GOLDEN)])
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 31).cast("int").alias("k")).join(g, "k").select("o_orderkey", F.explode(text.variations(F.col("itl"), additional=True)).alias("v"))


def _rephrased_sql() -> str:
    out = f"with s0 as ({_gold_sql('itl', [(k, i) for k, (_, i, _) in enumerate(GOLDEN)], 'o_orderkey, itl, itl as t')})"
    for n, (phrase, others) in enumerate(text.REPHRASE.items()):
        pick = f"([{', '.join(map(quoted, others))}])[('0x' || substr(md5(itl || {quoted(phrase)}), 1, 8))::bigint % {len(others)} + 1]"
        out += f", s{n + 1} as (select o_orderkey, itl, case when strpos(t, {quoted(phrase)}) > 0 then substr(t, 1, strpos(t, {quoted(phrase)}) - 1) || {pick} || substr(t, strpos(t, {quoted(phrase)}) + {len(phrase)}) else t end as t from s{n})"
    return out + f" select o_orderkey, t as rephrased from s{len(text.REPHRASE)}"


@query(_rephrased_sql())
def rephrase(spark, d):
    g = _golden(spark, "k int, itl string", [(k, i) for k, (_, i, _) in enumerate(GOLDEN)])
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 31).cast("int").alias("k")).join(g, "k").select("o_orderkey", text.rephrase(F.col("itl")).alias("rephrased"))


def _task_sql(context: bool) -> str:
    made = []
    for name, (lead, has, mark, source, target) in stages.TASKS.items():
        middle = "'domain: ' || domain || ' activity: ' || activity || ' ' || " if has and (context or not name.endswith("_to_nl")) else ""
        made.append(f"select translation_id, '{name}' as task, '{lead}' || {middle}'{mark}' || {source} as source_text, {target} as target from x")
    return ", x as (select t.id as translation_id, t.domain, t.activity, t.translation, i.itl_text, f.formula from formulas f join itl i on f.id = i.formula_id join translations t on t.formula_id = i.formula_id and t.itl_id = i.id) " + " union all ".join(made)


_SQL_TASKS = ("formulas", "itl", "translations")


@query()
def task_rows(spark, d):
    t = corpus.triplets(frame(spark, d, "formulas"), frame(spark, d, "itl"), frame(spark, d, "translations"))
    return stages.task_rows(t).select("translation_id", "task", "source_text", "target")


@query()
def task_rows_without_context(spark, d):
    t = corpus.triplets(frame(spark, d, "formulas"), frame(spark, d, "itl"), frame(spark, d, "translations"))
    return stages.task_rows(t, context=False).select("translation_id", "task", "source_text", "target")


for _name, _context in (("task_rows", True), ("task_rows_without_context", False)):
    _SQL[_name] = with_tables("", *_SQL_TASKS).rstrip() + _task_sql(_context)


_GRAMS = """tok as (select conv_id * 4294967296 + turn as id, string_split(trim(lower(regexp_replace(p, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), ' ') as p, string_split(trim(lower(regexp_replace(r, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), ' ') as r from ({turns})),
    n as (select unnest([1, 2, 3, 4]) as n),
    gp as (select id, n, unnest(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i:i + n - 1], ' '))) as g from tok, n where len(p) >= n),
    gr as (select id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) as g from tok, n where len(r) >= n),
    cp as (select id, n, g, count(*) as c from gp group by all), cr as (select id, n, g, count(*) as c from gr group by all),
    by_n as (select n, sum(cp.c) as total, sum(least(cp.c, coalesce(cr.c, 0))) as hit from cp left join cr using (id, n, g) group by n)"""


@query(
    f"with {_GRAMS.format(turns=_TURNS)} select (select sum(len(p)) from tok)::bigint as cp, (select sum(len(r)) from tok)::bigint as cr, round(case when (select count(*) from by_n where hit > 0) = 4 then (case when (select sum(len(p)) from tok) > (select sum(len(r)) from tok) then 1.0 else exp(1 - (select sum(len(r)) from tok)::double / (select sum(len(p)) from tok)) end) * exp((select avg(ln(hit / total)) from by_n)) else 0.0 end, 9) as bleu"
)
def bleu_corpus(spark, d):
    return metrics.bleu(_turns(spark, d), ["conv_id", "turn"], "p", "r").withColumn("bleu", _r("bleu", 9))


@query()
def rouge_l(spark, d):
    return _turns(spark, d).select("conv_id", "turn", _r(metrics.rouge_l(F.col("p"), F.col("r")), 9).alias("rouge_l"))


# Two texts, words of their longest common subsequence, words of each.
_COMMON = [("the cat sat", "the cat sat", 3, 3, 3), ("The  cat", "the CAT sat down", 2, 2, 4), ("a b c d", "d c b a", 1, 4, 4), ("p holds until q", "until q p holds", 2, 4, 4), ("x", "y", 0, 1, 1), ("", "a", 0, 0, 1), ("a a a b", "a b a", 2, 4, 3), (None, "a", None, 1, 1)]


@query(_dealt_sql("p, r, n, a, b", _COMMON, "o_orderkey, round(2 * n / (a + b)::double, 9) as rouge_l"))
def rouge_l_golden(spark, d):
    return _dealt(spark, d, "p string, r string", [x[:2] for x in _COMMON]).select("o_orderkey", _r(metrics.rouge_l(F.col("p"), F.col("r")), 9).alias("rouge_l"))


@query()
def meteor(spark, d):
    return _turns(spark, d).select("conv_id", "turn", _r(metrics.meteor(F.col("p"), F.col("r")), 9).alias("meteor"))


@query("select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on a.vec_id + 1 = b.vec_id")
def embedding_cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", _r(metrics.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query(f"select o_orderkey, space from orders join {values([(k, space_size(k)) for k in range(4)])} as g(k, space) on g.k = o_orderkey % 4".replace("space from", "space::bigint as space from"))
def formula_space(spark, d):
    k = F.col("o_orderkey") % 4
    return table(spark, d, "orders").select("o_orderkey", F.when(k <= 1, 8).otherwise(F.power(k * 88, k - 1)).cast("long").alias("space"))


# --- formulas


@query(_gold_sql("itl", [(k, i) for k, (_, i, _) in enumerate(GOLDEN)], "o_orderkey, itl"))
def itl_render_golden(spark, d):
    return _orders_with(spark, d).select("o_orderkey", folds.itl_render("ast").alias("itl"))


_PARSED = [parse(ltl) for ltl, _, _ in GOLDEN]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas read, rendered in English and counted by text and depth."""
    df = _orders_with(spark, sf_dir).select(folds.itl_render("ast").alias("itl"), folds.tree_depth("ast").alias("depth"))
    return df.groupBy("itl", "depth").agg(F.count("*").alias("n"))


@query(_gold_sql("itl, depth", [(k, i, depth(f)) for k, ((_, i, _), f) in enumerate(zip(GOLDEN, _PARSED, strict=True))], "itl, depth, count(*) as n") + " group by 1, 2")
def itl_by_depth(spark, d):
    return flagship(spark, d)


@query(_dealt_sql("ltl, canonical_key, compat_key", goldens.KEYS, "o_orderkey, canonical_key, compat_key, sha256(compat_key) as compat_hash"))
def ltl_keys(spark, d):
    keys = _dealt_trees(spark, d, [f for f, *_ in goldens.KEYS]).select("o_orderkey", folds.ltl_key("ast").alias("canonical_key"), folds.ltl_key("ast", compat=True).alias("compat_key"))
    return keys.withColumn("compat_hash", F.sha2("compat_key", 256))


@query(_dealt_sql("ltl, normal, compat_normal", goldens.NORMAL, "o_orderkey, sha256(normal) as canonical_hash, sha256(compat_normal) as compat_hash"))
def ltl_canonical_hash(spark, d):
    df = _dealt_trees(spark, d, [f for f, *_ in goldens.NORMAL])
    return udfs.over_distinct(df, ["ast"], canonical_hash=udfs.ltl_canonical_hash(F.col("ast")), compat_hash=udfs.ltl_canonical_hash(F.col("ast"), True)).select("o_orderkey", "canonical_hash", "compat_hash")


_STEPS = ["nnf", "expand", "flatten", "distribute", "sort", "simplify"]


@query(_dealt_sql("ltl, nnf, expand, flatten, distribute, sort, simplify", goldens.REWRITES, "o_orderkey, nnf, expand, flatten, distribute, sort, simplify"))
def ltl_rewrites(spark, d):
    """Each rewrite on its own."""
    df = _dealt_trees(spark, d, [f for f, *_ in goldens.REWRITES])
    return udfs.over_distinct(df, ["ast"], **{s: udfs.ltl_show(udfs.ltl_rewrite(F.col("ast"), s)) for s in _STEPS}).select("o_orderkey", *_STEPS)


@query(_gold_sql("depth, operators, propositions, atoms", [(k, depth(f), operators(f), len(atoms(f)), ",".join(atoms(f))) for k, f in enumerate(_PARSED)], "o_orderkey, depth, operators, propositions, atoms"))
def complexity_measures(spark, d):
    return _trees(spark, d).select("o_orderkey", folds.tree_depth("ast").alias("depth"), folds.operator_count("ast").alias("operators"), folds.proposition_count("ast").alias("propositions"), F.array_join(folds.atoms("ast"), ",").alias("atoms"))


# The golden formulas' pattern classes, exact and as first published.
_CLASSES = [("G(p)", "invariance", None), ("F(q)", "eventuality", None), ("X(r)", "general", None), ("p U q", "until", None), ("p R q", "release", None), ("p W q", "general", None), ("G(p -> F(q))", "response", None), ("!q W p", "precedence", None), ("G(!p)", "invariance", None), ("G(F(p))", "reactivity", "invariance"), ("F(G(p))", "stability", "eventuality"), ("G(p & q)", "invariance", None), ("F(p | q)", "eventuality", None), ("G(request -> F(acknowledge))", "response", None), ("G(try -> F(success | G(failure)))", "response", None), ("G(send -> X(F(receive)))", "invariance", None), ("G(alarm -> (alarm U reset))", "invariance", None)]
_CLASS = {f: (c, o or c) for f, c, o in _CLASSES}


@query(_gold_sql("pattern, compat_pattern", [(k, *_CLASS[ltl]) for k, (ltl, _, _) in enumerate(GOLDEN)], "o_orderkey, pattern, compat_pattern"))
def pattern_class(spark, d):
    return _trees(spark, d).select("o_orderkey", folds.classify("ast").alias("pattern"), folds.classify("ast", compat=True).alias("compat_pattern"))


def _structured_sql() -> str:
    said = [(p, k, t) for p, ts in text.STRUCTURED.items() for k, t in enumerate(ts)]
    g = _dealt_sql("ltl, pattern, p, q", goldens.OPERANDS, "o_orderkey, pattern, p, coalesce(q, '') as q")
    return f"select o_orderkey, pattern, replace(replace(t, '{{p}}', p), '{{q}}', q) as phrase from ({g}) join {values(said)} as s(name, n, t) on name = pattern"


@query(_structured_sql())
def structured_paraphrases(spark, d):
    df = _dealt_trees(spark, d, [f for f, *_ in goldens.OPERANDS]).withColumn("itl", folds.itl_render("ast"))
    return stages.structured_paraphrases(df, "ast", "itl").select("o_orderkey", "pattern", "phrase")


@query(_dealt_sql("ltl, published, itl, nnf, sexpr", goldens.TEXTS, "o_orderkey, published, itl, nnf, sexpr, true as same_json"))
def ltl_texts(spark, d):
    """LaTeX as published, English, normal form and the tree's own text; JSON that reads back as the tree."""
    df = _dealt_trees(spark, d, [f for f, *_ in goldens.TEXTS]).withColumn("json", folds.to_json("ast"))
    back = udfs.over_distinct(df, ["json"], back=udfs.ast_from_json(F.col("json")))
    return back.select("o_orderkey", folds.ltl_published("ast").alias("published"), folds.itl_render("ast").alias("itl"), folds.nnf_text("ast").alias("nnf"), folds.sexpr("ast").alias("sexpr"), (F.col("back") == F.col("ast")).alias("same_json"))


# The golden texts that do not read back as their formula ("not" reaches over what follows it).
_FAIL = {"!q W p"}
_BACK = dict(goldens.BACK)
_CHECKED = [*goldens.CHECKS, *[(ltl, i, _BACK[i], True, None) for ltl, i, _ in GOLDEN if ltl not in _FAIL]]


@query(_dealt_sql("formula, itl_text, reconstructed, is_correct, verification_errors", _CHECKED, "o_orderkey, reconstructed, is_correct, verification_errors"))
def roundtrip_check(spark, d):
    """English read back and compared with its formula, rows that fail by what they say included."""
    df = _dealt(spark, d, "formula string, itl_text string", [r[:2] for r in _CHECKED])
    return stages.verified(df).select("o_orderkey", "reconstructed", "is_correct", "verification_errors")


@query(_dealt_sql("before, spot_formulas, canonical_form", goldens.REVALIDATED, "o_orderkey, spot_formulas, canonical_form"))
def revalidated_formulas(spark, d):
    df = _dealt(spark, d, "spot_formulas string", [(r[0],) for r in goldens.REVALIDATED]).withColumn("canonical_form", F.lit("kept"))
    return stages.revalidated(df).select("o_orderkey", "spot_formulas", "canonical_form")


@query(f"select f.id as formula_id, g.itl as itl_text, true as canonical_form, 'canonical_mapping' as generation_method, false as verified from formulas f join {GOLD} on g.k = f.id % 31 where coalesce(canonical_form, '') <> 'ERROR'", "formulas")
def rendered_itl(spark, d):
    """The ITL table made from the formulas: canonical text, else converted, else original."""
    return stages.rendered(frame(spark, d, "formulas"))


# Pairs of formulas, whether they mean the same.
_PAIRS = [
    ("G(p)", "!F(!p)", True),
    ("F(p | q)", "F(p) | F(q)", True),
    ("G(p | q)", "G(p) | G(q)", False),
    ("p W q", "(p U q) | G(p)", True),
    ("p R q", "!(!p U !q)", True),
    ("F(G(p))", "G(F(p))", False),
    ("p U (q U q)", "p U q", True),
    ("X(p & q)", "X(p) & X(q)", True),
    ("p M q", "q U (p & q)", True),
    ("p ->", "p", None),
]

@query(f"select o_orderkey, same, valid from orders join {values([(k, s, s is not None) for k, (_, _, s) in enumerate(_PAIRS)])} as g(k, same, valid) on g.k = o_orderkey % 10")
def ltl_equivalence(spark, d):
    g = _golden(spark, "k int, a string, b string", [(k, a, b) for k, (a, b, _) in enumerate(_PAIRS)])
    df = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).cast("int").alias("k")).join(g, "k")
    out = udfs.over_distinct(df, ["a", "b"], same=udfs.ltl_equivalent(F.col("a"), F.col("b")), p=udfs.ltl_parse(F.col("a")))
    return out.select("o_orderkey", "same", F.col("p.valid").alias("valid"))


@query(_dealt_sql("a, b, edits, nodes", goldens.DISTANCES, "o_orderkey, edits::double as edits, round(edits::double / nodes, 9) as distance"))
def tree_edit_distance(spark, d):
    df = _dealt(spark, d, "a string, b string", [r[:2] for r in goldens.DISTANCES])
    pair = F.col("a"), F.col("b")
    found = udfs.over_distinct(df, ["a", "b"], edits=udfs.tree_edit_distance(*pair, normalised=False), distance=udfs.tree_edit_distance(*pair))
    return found.select("o_orderkey", "edits", _r("distance", 9).alias("distance"))


# Formulas that are tautologies (true), contradictions (false) or neither.
_TRUTHS = [("!p | p", True), ("G(p) | F(!p)", True), ("F(p) | G(!p)", True), ("(p -> q) | (q -> p)", True), ("(p & q) -> p", True), ("!p & p", False), ("G(p) & F(!p)", False), ("p U q", None), ("G(p) -> p", True), ("(p U q) -> F(q)", True), ("(p W q) <-> (q R (p | q))", True), ("(p U q) & G(!q)", False), ("X(p) <-> !X(!p)", True), ("F(G(p)) -> G(F(p))", True), ("G(F(p)) -> F(G(p))", None), ("1", True), ("0 | (p & 0)", False)]


@query(_dealt_sql("ltl, tautology, contradiction", [(f, t is True, t is False) for f, t in _TRUTHS], "o_orderkey, tautology, contradiction"))
def tautologies(spark, d):
    df = _dealt_trees(spark, d, [f for f, _ in _TRUTHS])
    return udfs.over_distinct(df, ["ast"], tautology=udfs.ltl_tautology(F.col("ast")), contradiction=udfs.ltl_contradiction(F.col("ast"))).select("o_orderkey", "tautology", "contradiction")


@query(_dealt_sql("formula, spot, status", goldens.CONVERTED, "o_orderkey, spot, status"))
def latex_conversion(spark, d):
    df = _dealt(spark, d, "formula string", [(f,) for f, *_ in goldens.CONVERTED])
    return stages.converted(df).select("o_orderkey", F.col("spot_formulas").alias("spot"), "status")


@query()
def generated_formulas(spark, d):
    return stages.generated(spark, 2000, seed=42, decided=False).select("id", "formula", "canonical_hash", F.size("ast").alias("nodes"))


@query()
def unique_formulas(spark, d):
    return stages.unique_formulas(spark, 500).select("id", "formula", "canonical_hash", "depth")


@query()
def translated_and_judged(spark, d):
    """Prompt, stub model, reply parsing and verdict over every formula with its English."""
    f, i = frame(spark, d, "formulas"), frame(spark, d, "itl").filter("canonical_form")
    df = f.join(i.select(F.col("formula_id").alias("id"), "itl_text"), "id").withColumn("domain", F.element_at(F.array(*map(F.lit, DOMAINS)), (F.col("id") % 13 + 1).cast("int")))
    asked = stages.replied(df, stages.translation_prompt(F.col("formula"), F.col("itl_text"), F.col("domain")), stages.stub_translator).withColumn("r", text.response(F.col("response"))).filter("r is not null")
    told = asked.select("id", "formula", "itl_text", "r.domain", "r.activity", "r.translation")
    judged = stages.replied(told, stages.judge_prompt(F.col("formula"), F.col("itl_text"), F.col("translation")), stages.stub_judge).withColumn("j", text.judge_parse(F.col("response")))
    return judged.select("id", "domain", "translation", "j.is_correct", "j.score")


# --- experiments


@query(
    """, pr as (select item_id, max(prediction) filter (variant = 'direct') as a, max(prediction) filter (variant = 'two_stage') as b, max(reference) as r, max(depth) as depth, max(operators) as operators, max(propositions) as propositions
    from predictions where prediction is not null and prediction <> '[Generation failed]' group by 1 having a is not null and b is not null),
    x as (select unnest(['depth_' || depth::varchar, 'operators_' || (operators // 5 * 5)::varchar || '-' || (operators // 5 * 5 + 4)::varchar, 'propositions_' || propositions::varchar]) as bin, (a = r)::double as sa, (b = r)::double as sb from pr)
    select bin, count(*) as n, round(avg(sa), 6) as first_mean, round(avg(sb), 6) as second_mean, round(avg(sa) - avg(sb), 6) as difference from x group by 1 having count(*) >= 5""",
    "predictions",
)
def value_of_itl(spark, d):
    out = experiments.value_of_itl(frame(spark, d, "predictions"), metrics.exact_match)
    return out.withColumns({c: _r(c) for c in ("first_mean", "second_mean", "difference")})


_SQL["value_of_itl"] = _SQL["value_of_itl"].replace(") , pr as", "), pr as")


@query("select 'operators_' || (operators // 5 * 5)::varchar || '-' || (operators // 5 * 5 + 4)::varchar as bin, count(*) as n, round(avg((prediction = reference)::double), 6) as mean from predictions where prediction is not null and prediction <> '[Generation failed]' group by 1 having count(*) >= 5", "predictions")
def sensitivity_to_operators(spark, d):
    return experiments.sensitivity(frame(spark, d, "predictions"), metrics.exact_match, "ltl_to_nl", "operators").withColumn("mean", _r("mean"))


def _renamed(spark: SparkSession, d: str, names: dict[str, str]) -> DataFrame:
    p = frame(spark, d, "predictions")
    return p.withColumn("variant", F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("variant")))


@query(
    """, pr as (select item_id, max(prediction) filter (variant = 'direct') as a, max(prediction) filter (variant = 'two_stage') as b, max(reference) as r, max(domain) as domain
    from predictions where prediction is not null and prediction <> '[Generation failed]' group by 1 having a is not null and b is not null)
    select domain, count(*) as n, round(avg((a = r)::double), 6) as first_mean, round(avg((b = r)::double), 6) as second_mean, round(avg((a = r)::double) - avg((b = r)::double), 6) as difference from pr group by 1 having count(*) >= 10""",
    "predictions",
)
def impact_of_context(spark, d):
    out = experiments.impact_of_context(_renamed(spark, d, CONTEXT), metrics.exact_match)
    return out.withColumns({c: _r(c) for c in ("first_mean", "second_mean", "difference")})


_SQL["impact_of_context"] = _SQL["impact_of_context"].replace(") , pr as", "), pr as")


@query("select case variant when 'direct' then 'lodo' else 'few_shot_5' end as variant, domain, count(*) as n, round(avg((prediction = reference)::double), 6) as mean from predictions where prediction is not null and prediction <> '[Generation failed]' group by 1, 2", "predictions")
def domain_generalisation(spark, d):
    return experiments.domain_generalisation(_renamed(spark, d, DOMAIN_RUNS), metrics.exact_match).withColumn("mean", _r("mean"))


@query(
    """, a as (select row_number() over (order by item_id) as position, prediction as first, reference, item_id from predictions where variant = 'direct'),
    b as (select row_number() over (order by item_id) as position, prediction as second from predictions where variant = 'two_stage')
    select position, item_id, first, second, reference from a join b using (position)""",
    "predictions",
)
def positional_pairs(spark, d):
    p = frame(spark, d, "predictions")
    return experiments.paired_by_position(p.filter("variant = 'direct'"), p.filter("variant = 'two_stage'"))


_SQL["positional_pairs"] = _SQL["positional_pairs"].replace(") , a as", "), a as")


# Prediction, reference, exact match, meaning, edits of the tree over its nodes, whether the prediction is a formula.
_SCORED = [("G(p)", "G(p)", 1, 1, 0.0, 1), ("g(P)", "G(p)", 0, None, None, 0), ("F(G(p))", "G(F(p))", 0, 0, 2 / 3, 1), ("p W q", "(p U q) | G(p)", 0, 1, 4 / 6, 1), ("p ->", "p", 0, None, None, 0), ("[Generation failed]", "p", 0, None, None, 0), (None, "p", 0, None, None, 0)]


@query(
    f"""select count(*) as n, round(avg(exact), 9) as exact_match, round(avg((lower(p) = lower(r))::double), 9) as normalized_exact_match, null::double as rouge_l, null::double as meteor,
    round(avg(same), 9) as semantic_equivalence, round(avg(distance), 9) as tree_edit_distance, round(avg(valid), 9) as syntactic_correctness
    from ({_dealt_sql("p, r, exact, same, distance, valid", _SCORED, "*")}) where p <> '[Generation failed]'"""
)
def ltl_metrics(spark, d):
    """All metrics of formula targets over a table of predictions; failed and missing ones do not count."""
    out = metrics.metric_table(_dealt(spark, d, "prediction string, reference string", [r[:2] for r in _SCORED]), "ltl")
    return out.withColumns({c: _r(c, 9) for c in out.columns if c != "n"})


@query(
    f"""select item_id, to_json({{'item_id': item_id, 'prediction': p, 'reference': r, 'ratings': {{'accuracy': null, 'fluency': null, 'domain_fit': null}}}})::varchar as json
    from (select conv_id * 4294967296 + turn as item_id, p, r from ({_TURNS})) order by {_H.format(42, 'item_id')}, item_id limit 100"""
)
def human_packet(spark, d):
    return experiments.human_packet(_turns(spark, d).select((F.col("conv_id") * (1 << 32) + F.col("turn")).alias("item_id"), F.col("p").alias("prediction"), F.col("r").alias("reference")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


