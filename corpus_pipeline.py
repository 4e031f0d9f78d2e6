"""From raw documents to packed sequences: language, near-duplicates, repeated passages, packing.

Each stage reads what its predecessor wrote. A stage that rejects or changes
documents returns the columns of documents; clean ones stay as they are.

Null, empty and blank texts and texts without a letter are of no language and go in
the first stage; a null label is filled, other nulls stay. Texts of any length are
read whole. Of repeated rows, and rows that share an id, the second stage keeps those
whose id is the smallest of their group: copies under one id all stay, and the third
stage takes their words, as it does all words of passages that occur twice. Rows with
a null id are never near-duplicates. A document of which no word is left goes, so a
text of one window or more that stands whole within another document is kept in
neither. Ties in language go to the first by name. An empty table gives no sequence.
Columns other than those of documents are dropped, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ltlspark.llm import langid, minhash, packing, substring
from ltlspark.llm.queries import tokenizer_path
from ltlspark.runtime import delete, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a repeated window.
WINDOW = 35
#: A text is of a language that was learnt if its output is this large or leads by this much; however many languages there are.
LEAST_MARGIN, LEAST_LEAD = 0.3, 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; und and texts like none go. Null labels are filled."""
    docs = docs.select(*COLUMNS)
    found = langid.identify(docs, langid.learn(docs))
    kept = found.filter((F.col("lang_pred") != "und") & ((F.col("margin") >= LEAST_MARGIN) | (F.col("lead") >= LEAST_LEAD)))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group that shares four fifths of its five-word shingles."""
    kept = minhash.near_duplicates(docs, shingle=5, percent=80).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere; those that are left without a word go."""
    cut = substring.strip_repeats(docs.select(*COLUMNS), window=WINDOW).filter("n_removed = 0 or n_removed < n_words")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]

#: Trained models, connected components and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """All stages over docs, or the documents of sf_dir, each written to the shared folder and read again.

    A stage's folder is deleted once the next one is written; the last is the result's.
    """
    docs, before = table(spark, sf_dir, "documents") if docs is None else docs, None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{k}-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
