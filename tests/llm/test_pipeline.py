"""The pipeline's stages, each on its own input, against brute force."""

import corpus_pipeline
import pandas as pd
from compare import SMALL
from pyspark.sql import functions as F
from test_ops import check_packing, components, removed, words
from tokenizers import Tokenizer

from ltlspark.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    frame = pd.read_parquet(f"{SMALL}/documents.parquet")
    passage = " ".join(f"passage{k}" for k in range(55))
    more = [(10_001, "12345 --- 678", None, "p"), (10_002, f"first own words {passage} and an end of its own", None, "p"), (10_003, f"quite another beginning here {passage} then something else", None, "p"), (10_004, None, None, None), (10_005, "", "en", "p")]
    planted = pd.DataFrame(more, columns=["doc_id", "text", "lang", "source"]).assign(n_chars=lambda d: d.text.str.len())
    rows = [[None if pd.isna(x) else int(x) if c in ("doc_id", "n_chars") else x for c, x in zip(COLUMNS, r)] for r in pd.concat([frame, planted])[COLUMNS].astype(object).values.tolist()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs.toPandas())
    language, unique, cut, packed = out
    assert all(list(x.columns) == COLUMNS for x in out[:-1])
    before = {k: t for k, t in zip([*frame.doc_id, *planted.doc_id], [*frame.text, *planted.text])}
    assert set(before) - set(language.doc_id) == {10_001, 10_004, 10_005}
    assert dict(zip(language.doc_id, language.text)) == {k: before[k] for k in language.doc_id} and language.lang.notna().all()

    groups = components(dict(zip(language.doc_id, language.text)), 5, 80)
    assert set(unique.doc_id) == {k for k, (_, top) in groups.items() if top == k}

    texts = dict(zip(unique.doc_id, unique.text))
    left = dict(zip(cut.doc_id, cut.text))
    for (k, t), gone in zip(texts.items(), removed([words(t) for t in texts.values()], corpus_pipeline.WINDOW)):
        if not any(gone):
            assert left[k] == t
        elif all(gone):
            assert k not in left
        else:
            assert words(left[k]) == [w for w, g in zip(words(t), gone) if not g]
    assert "passage20" not in left[10_002] and "passage20" not in left[10_003] and left[10_002].startswith("first own words")
    assert (cut.n_chars == cut.text.str.len()).all()

    tokens = Tokenizer.from_file(tokenizer_path())
    want = {k: [*tokens.encode(t, add_special_tokens=False).ids, 2] for k, t in left.items()}
    check_packing(packed.to_dict("records"), want, 4096)


def test_run(spark):
    import os

    from ltlspark.runtime import shared_dir

    got = corpus_pipeline.run(spark, SMALL)
    assert got.count() > 0
    left = [x for x in os.listdir(shared_dir(spark)) if x.startswith("pipeline-")]
    assert len(left) == 1 and left[0].startswith("pipeline-3-packing")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "packing"]


def test_odd_rows_through_all_stages(spark, odd):
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.unionByName(docs.filter("doc_id = 8").withColumn("doc_id", F.lit(108).cast("long"))).unionByName(docs.filter("doc_id = 9"))
    got = corpus_pipeline.run(spark, SMALL, docs).collect()
    kept = {r["doc_id"] for r in got}
    assert {1, 5, 8, 9} <= kept and not kept & {2, 3, 4, 7, 108}  # texts without a letter and the later copy are gone
    assert sum(r["start"] == 0 for r in got if r["doc_id"] == 9) == 2  # copies of a row, shorter than a window, stay
    assert sum(r["length"] for r in got if r["doc_id"] == 5) == next(r["doc_tokens"] for r in got if r["doc_id"] == 5) > 40_000
    empty = corpus_pipeline.run(spark, SMALL, docs.limit(0))
    assert empty.count() == 0 and "sequence_id" in empty.columns


def test_the_language_stage_does_not_depend_on_the_number_of_languages(spark):
    sentences = {
        "en": "the cat and the dog were in the house with the children when it rained",
        "de": "der hund und die katze sind nicht im haus wenn es regnet und die kinder",
        "fr": "le chat et le chien sont dans la maison avec les enfants quand il pleut",
        "es": "el gato y el perro estan en la casa con los ninos cuando llueve mucho",
        "it": "il gatto e il cane sono nella casa con i bambini quando piove molto",
        "nl": "de hond en de kat zijn niet in het huis met de kinderen als het regent",
    }
    kept = []
    for n in (1, 2, 6):
        rows = [(k, " ".join(s.split()[k % 5 :]), lang, "s", 1) for lang, s in list(sentences.items())[:n] for k in range(30)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        kept.append(corpus_pipeline.language(spark, docs, SMALL).count() / len(rows))
    assert kept == [1, 1, 1]
