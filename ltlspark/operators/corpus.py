"""The corpus' queries over its tables: formulas, itl, translations and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import fraction_sample


def untranslated(formulas: DataFrame, itl: DataFrame, translations: DataFrame, min_depth: int, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Formulas from a depth on with a canonical ITL that has no translation yet, in order of id."""
    f = formulas.filter(F.col("depth") >= min_depth).select("id", F.coalesce(F.nullif("spot_formulas", F.lit("")), "formula").alias("formula"), "depth")
    i = itl.filter("canonical_form").select(F.col("id").alias("itl_id"), "formula_id", "itl_text")
    done = translations.select("formula_id", "itl_id")
    out = f.join(i, F.col("id") == F.col("formula_id")).join(done, ["formula_id", "itl_id"], "left_anti").select("id", "itl_id", "formula", "itl_text", "depth")
    return out if limit is None else out.orderBy("id", "itl_id").offset(offset).limit(limit)


def triplets(formulas: DataFrame, itl: DataFrame, translations: DataFrame) -> DataFrame:
    """Translation, ITL and formula, the translation's pair of keys against the ITL's."""
    f = formulas.select(F.col("id").alias("formula_id"), "formula", F.col("canonical_form").alias("ltl_canonical"), "depth")
    i = itl.select(F.col("id").alias("itl_id"), "formula_id", "itl_text", F.col("canonical_form").alias("itl_canonical"))
    t = translations.select(F.col("id").alias("translation_id"), "formula_id", "itl_id", "domain", "activity", "translation")
    return t.join(i, ["formula_id", "itl_id"]).join(f, "formula_id")


def complete_triplets(formulas: DataFrame, itl: DataFrame, translations: DataFrame) -> DataFrame:
    """As outer joins, kept where both sides are there; the optimiser makes them inner."""
    i = itl.select(F.col("id").alias("itl_id"), F.col("formula_id").alias("of"), "itl_text", F.col("canonical_form").alias("itl_canonical"))
    t = translations.select(F.col("formula_id").alias("tf"), F.col("itl_id").alias("ti"), "domain", "translation")
    joined = formulas.join(i, (formulas["id"] == F.col("of")) & F.col("itl_canonical"), "left").join(t, (F.col("tf") == formulas["id"]) & (F.col("ti") == F.col("itl_id")), "left")
    return joined.filter(F.col("itl_text").isNotNull() & F.col("translation").isNotNull()).select(formulas["id"].alias("id"), "formula", "itl_text", "domain", "translation")


def judge_candidates(formulas: DataFrame, itl: DataFrame, translations: DataFrame, results: DataFrame, percent: int = 18, seed: int = 42) -> DataFrame:
    """An exact share of the translations without a verdict."""
    open_ = translations.join(results.select(F.col("translation_id").alias("id")), "id", "left_anti")
    return fraction_sample(triplets(formulas, itl, open_), "translation_id", percent, seed)


def unverified(formulas: DataFrame, itl: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """ITL that is still to be checked, with its formula; a page of it in order of id."""
    f = formulas.select(F.col("id").alias("formula_id"), "formula", "spot_formulas", "canonical_form")
    i = itl.filter(~F.col("verified")).select(F.col("id").alias("itl_id"), "formula_id", "itl_text")
    out = i.join(f, "formula_id").select("itl_id", "formula_id", "formula", "spot_formulas", "canonical_form", "itl_text")
    return out if limit is None else out.orderBy("itl_id").offset(offset).limit(limit)


def to_convert(formulas: DataFrame) -> DataFrame:
    return formulas.filter(F.col("spot_formulas").isNull() | F.col("canonical_form").isNull())


def depth_distribution(formulas: DataFrame) -> DataFrame:
    """Formulas by depth, with the number of all of them."""
    by = formulas.groupBy("depth").agg(F.count("*").alias("n"))
    return by.join(F.broadcast(formulas.agg(F.count("*").alias("total"))))


def pending(formulas: DataFrame, translations: DataFrame) -> DataFrame:
    """Whether each formula still waits for a translation."""
    done = translations.select(F.col("formula_id").alias("id"), F.lit(True).alias("done")).distinct()
    return formulas.select("id").join(done, "id", "left").select("id", F.col("done").isNull().alias("pending"))


def row_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out


def conversion_status(formulas: DataFrame, parsed_valid: str, fallback_valid: str) -> DataFrame:
    """valid, basic or error by which reading of a formula holds."""
    return formulas.withColumn("status", F.when(F.col(parsed_valid), "valid").when(F.col(fallback_valid), "basic").otherwise("error"))
