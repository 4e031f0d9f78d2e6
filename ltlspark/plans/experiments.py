"""The four experiments over a predictions table (schema.PREDICTIONS)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import valid_pairs
from ..operators.aggregates import operator_bin


def paired(predictions: DataFrame, task: str, a: str, b: str) -> DataFrame:
    """Items with a prediction of both variants, by item, not by position."""
    own = valid_pairs(predictions).filter((F.col("task") == task) & F.col("variant").isin(a, b))
    by = own.groupBy("item_id").agg(
        *[F.max(F.when(F.col("variant") == v, F.col("prediction"))).alias(n) for n, v in (("first", a), ("second", b))],
        *[F.max(c).alias(c) for c in ("reference", "domain", "depth", "operators", "propositions")],
    )
    return by.filter(F.col("first").isNotNull() & F.col("second").isNotNull())


def paired_by_position(first: DataFrame, second: DataFrame, order: str = "item_id") -> DataFrame:
    """The published way to pair two runs: their rows by position, in order, as far as the shorter goes."""
    from ..operators.store import with_ids

    a = with_ids(first.select(order, "prediction", "reference"), [order], 0, "position")
    b = with_ids(second.select(order, "prediction"), [order], 0, "position")
    return a.withColumnRenamed("prediction", "first").join(b.select("position", F.col("prediction").alias("second")), "position")


def difference(pairs: DataFrame, score, by: list[Column] | None = None, least: int = 1) -> DataFrame:
    """n, both variants' means of score(prediction, reference) and their difference, by groups of at least so many."""
    scored = pairs.withColumns({"__a": score(F.col("first"), F.col("reference")), "__b": score(F.col("second"), F.col("reference"))})
    out = scored.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg("__a").alias("first_mean"), F.avg("__b").alias("second_mean"))
    return out.filter(F.col("n") >= least).withColumn("difference", F.col("first_mean") - F.col("second_mean"))


def value_of_itl(predictions: DataFrame, score, least: int = 5) -> DataFrame:
    """Direct against two-stage by depth, operators and propositions."""
    pairs = paired(predictions, "ltl_to_nl", "direct", "two_stage")
    bins = F.array(F.concat(F.lit("depth_"), F.col("depth").cast("string")), operator_bin(F.col("operators")), F.concat(F.lit("propositions_"), F.col("propositions").cast("string")))
    return difference(pairs.withColumn("bin", F.explode(bins)), score, [F.col("bin")], least)


def impact_of_context(predictions: DataFrame, score, task: str = "ltl_to_nl", least: int = 10) -> DataFrame:
    """With against without context, by domain."""
    return difference(paired(predictions, task, "with_context", "without_context"), score, [F.col("domain")], least)


def domain_generalisation(predictions: DataFrame, score, task: str = "ltl_to_nl") -> DataFrame:
    """Mean score by variant (lodo, few_shot_k) and domain."""
    own = valid_pairs(predictions).filter((F.col("task") == task) & (F.col("variant").startswith("lodo") | F.col("variant").startswith("few_shot")))
    return own.withColumn("__s", score(F.col("prediction"), F.col("reference"))).groupBy("variant", "domain").agg(F.count("*").alias("n"), F.avg("__s").alias("mean"))


def sensitivity(predictions: DataFrame, score, task: str, measure: str, least: int = 5) -> DataFrame:
    """Mean score by one complexity measure."""
    key = operator_bin(F.col(measure)) if measure == "operators" else F.concat(F.lit(f"{measure}_"), F.col(measure).cast("string"))
    own = valid_pairs(predictions).filter(F.col("task") == task).withColumn("__s", score(F.col("prediction"), F.col("reference")))
    return own.groupBy(key.alias("bin")).agg(F.count("*").alias("n"), F.avg("__s").alias("mean")).filter(F.col("n") >= least)


def human_packet(pairs: DataFrame, k: int = 100, seed: int = 42) -> DataFrame:
    """Up to k items as JSON with three empty marks from 1 to 5."""
    from ..operators.sampling import fixed_sample

    rated = fixed_sample(pairs, "item_id", k, seed).withColumn("ratings", F.create_map(*[x for n in ("accuracy", "fluency", "domain_fit") for x in (F.lit(n), F.lit(None).cast("int"))]))
    return rated.select("item_id", F.to_json(F.struct(*rated.columns)).alias("json"))


def grid(spark: SparkSession, models: list[str], tasks: list[str]) -> DataFrame:
    """One row for each run of a model on a task; both lists are short."""
    return spark.createDataFrame([(m, t) for m in models for t in tasks], "model string, task string")
