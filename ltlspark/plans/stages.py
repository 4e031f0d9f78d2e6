"""The corpus' stages as lazy plans: generate, convert, render, check, translate, judge."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folds, text, udfs
from ..ltl import decide, generate, rewrite
from ..ltl.ast import to_arena
from ..ltl.parse import LATEX, show
from ..operators import store
from ..schema import AST

_GENERATED = f"id bigint, formula string, latex string, canonical_hash string, ast {AST}, tautology boolean, contradiction boolean"


def generated(spark: SparkSession, n: int, *, seed: int = 42, start: int = 0, max_depth: int = 5, decided: bool = False, partitions: int | None = None) -> DataFrame:
    """n random formulas by number, the same however they are partitioned."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"].tolist():
                f = generate.formula(seed, i, max_depth)
                rows.append((i, show(f), show(f, LATEX), rewrite.canonical_hash(f), to_arena(f), decide.tautology(f, states=400) if decided else None, decide.contradiction(f, states=400) if decided else None))
            yield pd.DataFrame(rows, columns=["id", "formula", "latex", "canonical_hash", "ast", "tautology", "contradiction"])

    numbers = spark.range(start, start + n, numPartitions=partitions) if partitions else spark.range(start, start + n)
    return numbers.mapInPandas(run, _GENERATED)


def unique_formulas(spark: SparkSession, target: int, *, seed: int = 42, max_depth: int = 5, useful: bool = False, attempts: int = 10) -> DataFrame:
    """target formulas of distinct canonical hash, the first by number; useful leaves out tautologies and contradictions.

    Numbers are tried in rounds that double; at most attempts * target are tried.
    """
    tried = target
    while True:
        tried = min(tried * 2, target * attempts)
        made = generated(spark, tried, seed=seed, max_depth=max_depth, decided=useful)
        if useful:
            made = made.filter(~F.coalesce("tautology", F.lit(False)) & ~F.coalesce("contradiction", F.lit(False)))
        first = store.insert_ignore(None, made.select("id", "formula", "latex", "canonical_hash", "ast"), "canonical_hash", "id")
        if tried >= target * attempts or first.count() >= target:
            return first.orderBy("id").limit(target).withColumn("depth", folds.paren_depth(F.col("latex")))


def converted(formulas: DataFrame, formula: str = "formula", dialect: str = "latex") -> DataFrame:
    """formulas with spot_formulas, canonical_form and status: the parser's reading, else plain replacement if that parses, else an error."""
    df = formulas.drop("spot_formulas", "canonical_form", "status").withColumn("__basic", text.basic_conversion(F.col(formula)))
    df = udfs.over_distinct(df, [formula, "__basic"], __p=udfs.ltl_parse(F.col(formula), dialect), __b=udfs.ltl_parse(F.col("__basic")))
    status = F.when(F.col("__p.valid"), "valid").when(F.col("__b.valid"), "basic").otherwise("error")
    ast = F.when(F.col("__p.valid"), F.col("__p.ast")).when(F.col("__b.valid"), F.col("__b.ast"))
    df = df.withColumn("status", status).withColumn("__ast", ast)
    spot = F.when(F.col("status") == "error", F.concat(F.lit("ERROR: "), F.coalesce("__p.error", F.lit("")))).otherwise(udfs.ltl_show(F.col("__ast")))
    return df.withColumn("spot_formulas", spot).withColumn("canonical_form", F.when(F.col("status") == "error", "ERROR").otherwise(udfs.ltl_canonical(F.col("__ast")))).drop("__basic", "__p", "__b", "__ast")


def revalidated(formulas: DataFrame) -> DataFrame:
    """formulas with a converted column checked again: readable text gets its canonical form, other text becomes an error.

    Rows without one, and rows that already say they are errors, stay as they are.
    """
    spot = F.col("spot_formulas")
    due = spot.isNotNull() & ~F.startswith(spot, F.lit("ERROR:"))
    once = udfs.over_distinct(formulas.withColumn("__s", F.when(due, spot)), ["__s"], __p=udfs.ltl_parse(F.col("__s")))
    once = once.withColumn("__ast", F.when(due, F.col("__p.ast")))
    canonical = F.when(due & ~F.col("__p.valid"), "ERROR").when(due, udfs.ltl_canonical(F.col("__ast"))).otherwise(F.col("canonical_form"))
    text_ = F.when(due & ~F.col("__p.valid"), F.concat(F.lit("ERROR: "), spot)).otherwise(spot)
    return once.withColumns({"canonical_form": canonical, "spot_formulas": text_}).select(*formulas.columns)


def rendered(formulas: DataFrame) -> DataFrame:
    """One ITL row for each formula without an error: canonical text from the canonical form, or else the formula."""
    source = text.first_filled(F.col("canonical_form"), F.col("spot_formulas"), F.col("formula"))
    rows = formulas.filter(~F.coalesce(F.startswith(F.col("canonical_form"), F.lit("ERROR")), F.lit(False)))
    parsed = udfs.over_distinct(rows.withColumn("__s", text.repair_operators(source)), ["__s"], __p=udfs.ltl_parse(F.col("__s")))
    parsed = parsed.withColumn("__ast", F.col("__p.ast"))
    ok = F.col("__p.valid")
    return parsed.select(
        F.col("id").alias("formula_id"),
        F.when(ok, folds.itl_render("__ast")).otherwise(F.concat(F.lit("Error generating ITL: "), F.coalesce("__p.error", F.lit("")))).alias("itl_text"),
        F.lit(True).alias("canonical_form"),
        F.when(ok, "canonical_mapping").otherwise("error").alias("generation_method"),
        F.lit(False).alias("verified"),
    )


def verified(itl: DataFrame, formula: str = "formula", itl_text: str = "itl_text", compat: bool = False) -> DataFrame:
    """itl with reconstructed, is_correct and verification_errors; rows that say they are errors fail, undecided ones stay null."""
    failed = F.startswith(F.col(itl_text), F.lit("Error generating ITL:"))
    back = udfs.over_distinct(itl, [itl_text], reconstructed=udfs.itl_to_ltl(F.col(itl_text), compat))
    same = udfs.over_distinct(back, [formula, "reconstructed"], __same=udfs.ltl_equivalent(F.col(formula), F.col("reconstructed")))
    detail = F.concat(F.lit("ITL '"), F.col(itl_text), F.lit("' translates to '"), F.col("reconstructed"), F.lit("' which is not equivalent to '"), F.col(formula), F.lit("'"))
    correct = F.when(failed | F.col("reconstructed").isNull(), False).otherwise(F.col("__same"))
    return same.withColumn("is_correct", correct).withColumn("verification_errors", F.when(failed, F.col(itl_text)).when(F.col("reconstructed").isNull(), F.lit("Failed to parse ITL")).when(~F.col("is_correct"), detail)).drop("__same")


class Translator(Protocol):
    def __call__(self, prompts: pd.Series) -> pd.Series:
        """Replies for prompts of one Arrow batch."""


def translation_prompt(formula: Column, itl: Column, domain: Column) -> Column:
    return F.concat(F.lit("Translate this temporal logic formula into natural language.\nLTL Formula: "), formula, F.lit("\nITL Representation: "), itl, F.lit("\nDomain: "), domain, F.lit("\nAnswer with the tags <domain>, <activity> and <translation> only."))


def judge_prompt(formula: Column, itl: Column, translation: Column) -> Column:
    return F.concat(F.lit("Does this translation capture the formula exactly?\nLTL Formula: "), formula, F.lit("\nITL Representation: "), itl, F.lit("\nNatural Language: "), translation, F.lit("\nAnswer as JSON with is_correct, score (0-10), issues and reasoning."))


def stub_translator(prompts: pd.Series) -> pd.Series:
    """Replies made from the prompt, for runs without a model."""
    itl = prompts.str.extract(r"ITL Representation: (.*)", expand=False)
    domain = prompts.str.extract(r"Domain: (.*)", expand=False)
    return "<domain>" + domain + "</domain><activity>" + domain + " operation</activity><translation>" + itl + ".</translation>"


def stub_judge(prompts: pd.Series) -> pd.Series:
    """A verdict by whether the translation is the ITL text."""
    itl = prompts.str.extract(r"ITL Representation: (.*)", expand=False)
    nl = prompts.str.extract(r"Natural Language: (.*)", expand=False)
    same = itl.str.rstrip(".") == nl.str.rstrip(".")
    return pd.Series(['{"is_correct": true, "score": 9, "issues": [], "reasoning": "same text"}' if s else '{"is_correct": false, "score": 3, "issues": ["differs"], "reasoning": "other text"}' for s in same])


def replied(df: DataFrame, prompt: Column, model: Callable[[pd.Series], pd.Series], out: str = "response") -> DataFrame:
    """df with a model's reply to a prompt; the model sees whole Arrow batches."""

    @F.pandas_udf("string")
    def ask(s: pd.Series) -> pd.Series:
        return model(s)

    return df.withColumn(out, ask(prompt))


# The six tasks' source texts and target columns.
TASKS = {
    "ltl_to_nl": ("translate LTL to NL: ", True, "ltl: ", "formula", "translation"),
    "itl_to_nl": ("translate ITL to NL: ", True, "itl: ", "itl_text", "translation"),
    "nl_to_ltl": ("translate NL to LTL: ", True, "nl: ", "translation", "formula"),
    "nl_to_itl": ("translate NL to ITL: ", True, "nl: ", "translation", "itl_text"),
    "ltl_to_itl": ("translate LTL to ITL: ", False, "ltl: ", "formula", "itl_text"),
    "itl_to_ltl": ("translate ITL to LTL: ", False, "itl: ", "itl_text", "formula"),
}


def task_rows(triplets: DataFrame, context: bool = True) -> DataFrame:
    """task, source_text and target of every triplet for all six tasks; without context the two NL targets lose theirs."""
    made = []
    for name, (lead, has, mark, source, target) in TASKS.items():
        with_context = has and (context or not name.endswith("_to_nl"))
        middle = [F.lit("domain: "), F.col("domain"), F.lit(" activity: "), F.col("activity"), F.lit(" ")] if with_context else []
        made.append(F.struct(F.lit(name).alias("task"), F.concat(F.lit(lead), *middle, F.lit(mark), F.col(source)).alias("source_text"), F.col(target).alias("target")))
    return triplets.withColumn("__t", F.explode(F.array(*made))).select(*triplets.columns, "__t.*")


def structured_paraphrases(df: DataFrame, ast: str, itl: str) -> DataFrame:
    """df with phrase: sentences by a formula's pattern class, from its operands' texts."""
    kind = folds.classify(ast)
    operand = folds.fold(ast, "case when n.a = 0 then array(n.v) else array_append(transform(x, y -> element_at(y, -1)), case when n.a = 1 then concat(n.k, '(', element_at(x[0], -1), ')') else concat('(', array_join(transform(x, y -> element_at(y, -1)), concat(' ', n.k, ' ')), ')') end) end", "array<string>")
    one, two = F.try_element_at(F.col("__o"), F.lit(1)), F.try_element_at(F.col("__o"), F.lit(2))
    bare = lambda c: F.regexp_replace(c, r"^[a-z]+\((.*)\)$", "$1")
    implied = r"^\((.*) implies eventually\((.*)\)\)$"
    places = {"response": (F.regexp_extract(one, implied, 1), F.regexp_extract(one, implied, 2)), "precedence": (bare(one), two), "reactivity": (bare(one), two), "stability": (bare(one), two)}
    out = df.withColumn("pattern", kind).withColumn("__o", F.slice(operand, F.lit(1), F.greatest(F.size(operand) - 1, F.lit(0))))
    phrases = None
    for name, sentences in text.STRUCTURED.items():
        p, q = places.get(name, (one, two))
        phrases = (F.when if phrases is None else phrases.when)(F.col("pattern") == name, F.array(*[text.filled(s, p=p, q=q) for s in sentences]))
    phrases = phrases.otherwise(F.array(F.col(itl), text.rephrase(F.col(itl))))
    return out.withColumn("phrase", F.explode(F.array_distinct(F.array_compact(phrases)))).drop("__o")
