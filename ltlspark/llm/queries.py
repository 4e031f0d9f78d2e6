"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import fingerprint, headers, langid, licenses, lm, minhash, packing, pieces, substring, topk, urls

#: The rules that op9 judges by.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    model = langid.learn(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.kept_words(table(spark, sf_dir, "documents"), window=35)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    scorer, counts = lm.learn(docs.filter(~held_out))
    scored = lm.score(docs, scorer, counts)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5, scale=256)


OP5_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id,
                 list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint as score
          from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = pieces.decode(pieces.encode(docs, path), path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files source/lang/doc_id."""
    return licenses.scan(_files(spark, sf_dir)).withColumn("score", F.round("score", 9))


def op10_license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files against full licence texts, notices, titles and SPDX lines, in windows of words."""
    return headers.scan(_files(spark, sf_dir)).withColumn("score", F.round("score", 9))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")


OP9_SQL = f"""
with rules(h, p, v) as (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
rest as (select row_number() over () as k, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (select k, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
fits as (select k, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v from parts, rules
         where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by k)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from parts left join fits using (k)
"""


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


OP2_SQL = f"""
with w as (select row_number() over () as k, doc_id, {_words_sql("text")} as ws from documents),
win as (select k, unnest(range(1, len(ws) - 33)) as i, ws from w where len(ws) >= 35),
runs as (select k, i, array_to_string(ws[i:i + 34], ' ') as g from win),
hits as (select k, i from runs where g in (select g from runs group by g having count(*) > 1)),
gone as (select distinct k, i + j as p from hits, range(35) r(j)),
each as (select k, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
kept as (select k, string_agg(word, ' ' order by p) as said from each anti join gone using (k, p) group by k),
lost as (select k, count(*) as n from gone group by k)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(said, '')) as kept_sha256 from w left join kept using (k) left join lost using (k)
"""

OP6_SQL = f"""
with recursive w as (select doc_id, {_words_sql(f"translate(text, {_LETTERS})")} as ws from documents),
grams as (select doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
sets as (select distinct doc_id, g from grams),
sizes as (select doc_id, count(*) as n from sets group by 1),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from sets a join sets b using (g) where a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared s join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * s.n >= 80 * (x.n + y.n - s.n)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select distinct a as doc_id, a as other from both_ways union select r.doc_id, e.b from reach r join both_ways e on e.a = r.other),
lowest as (select doc_id, min(other) as c from reach group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(c, doc_id) as component_id, doc_id = coalesce(c, doc_id) as kept from documents left join sizes using (doc_id) left join lowest using (doc_id)
"""


OP10_SQL = f"""
with templates(name, said) as (values {", ".join(f"('{n}', '{t}')" for n, t in licenses.TEMPLATES.items())}),
parts as (select name, unnest(regexp_extract_all(translate(said, {_LETTERS}), '[0-9a-z]+')) as w from templates),
tw as (select name, w, count(*) as tf from parts group by all),
docs as (select row_number() over () as k, doc_id, concat_ws('/', source, lang, doc_id::varchar) as path, concat_ws('/', source, lang) as dir, coalesce(text, '') as text from documents),
lines as (select k, unnest(string_split(text, chr(10))) as said from docs),
units as (select k, row_number() over (order by k) as u, said from lines union all select k, -k, text from docs),
tok as (select k, u, unnest(regexp_extract_all(translate(said, {_LETTERS}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) as w from units),
df as (select v.w, count(distinct t.k) as n from (select distinct w from tw) v left join (select k, w from tok where u < 0) t on t.w = v.w group by 1),
idf as (select w, ln((1 + (select count(*) from docs))::double / (1 + n)) + 1 as x from df),
rare as (select ln((1 + (select count(*) from docs))::double) + 1 as x),
tf as (select k, u, tok.w, count(*) as n, any_value(idf.x) as x from tok left join idf on idf.w = tok.w group by k, u, tok.w),
norms as (select k, u, sqrt(sum(case when x is null then n * (select x * x from rare) else (n * x) * (n * x) end)) as norm from tf group by 1, 2 having count(x) > 0),
lengths as (select name, sqrt(sum((tf * x) * (tf * x))) as norm from tw join idf using (w) group by 1),
dots as (select k, u, name, sum(tf.n * tf.x * tw.tf * tf.x) as dot from tf join tw on tw.w = tf.w group by 1, 2, 3),
cosines as (select k, u, name, dot / n.norm / l.norm as c from dots join norms n using (k, u) join lengths l using (name)),
ranked as (select *, row_number() over (partition by k, u < 0 order by c desc, name) as r from cosines),
best as (select k, max(c) filter (u > 0) as lc, max(name) filter (u > 0) as lt, max(c) filter (u < 0) as wc, max(name) filter (u < 0) as wt from ranked where r = 1 group by 1),
found as (select d.k, doc_id, path, dir, coalesce(lc, 0) as lc, coalesce(wc, 0) as wc,
                 case when wc >= {licenses.WHOLE} and wc >= lc then wt when lc >= {licenses.HEADER} then lt when wc >= {licenses.WHOLE} then wt end as own, coalesce(wc >= {licenses.WHOLE}, false) as is_file from docs d left join best using (k)),
given as (select dir, min(path) as p, arg_min(own, path) as l from found where is_file group by 1),
near as (select f.k, arg_max(g.p, length(g.dir)) as p, arg_max(g.l, length(g.dir)) as l from found f join given g on g.dir = f.dir or g.dir = '' or starts_with(f.dir, g.dir || '/') group by 1)
select doc_id, path, coalesce(own, l) as license, round(greatest(lc, wc), 9) as score,
       case when own is not null then case when is_file then 'file' else 'header' end when p is not null then 'inherited' else 'none' end as origin, case when own is null then p end as license_path
from found left join near using (k)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring": OP2_SQL, "op5_topk": OP5_SQL, "op6_minhash": OP6_SQL, "op9_url_filter": OP9_SQL, "op10_license": OP10_SQL}
