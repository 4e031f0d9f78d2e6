"""Aggregates of the corpus' reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import partitions_of


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where whole is 0."""
    return F.try_divide(part * 100.0, whole)


def zero_filled_counts(df: DataFrame, column: str, dimension: DataFrame) -> DataFrame:
    """Rows for each value of the dimension (a small table with that column), 0 where there are none."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(dimension).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample deviation, min, quartiles (interpolated) and max."""
    c = F.col(column).cast("double")
    q = lambda p: F.percentile(c, F.lit(p))
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max(c).alias("max"))


def dense_histogram(df: DataFrame, column: str, lo: int, hi: int) -> DataFrame:
    """Rows and percentage for each whole number of lo..hi; others are left out of the bins, not of the percentage's base."""
    counts = df.groupBy(F.col(column).alias("bin")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("all"))
    bins = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("bin"))
    filled = F.broadcast(bins).join(counts, "bin", "left").join(F.broadcast(total))
    return filled.select("bin", F.coalesce("n", F.lit(0)).alias("n"), percent(F.coalesce("n", F.lit(0)), F.col("all")).alias("percentage"))


def fixed_bins(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Rows of each of as many bins of equal width from min to max; max is in the last bin."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x = F.col(column).cast("double")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((x - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins))).otherwise(1)
    return df.filter(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def verification_summary(itl: DataFrame) -> DataFrame:
    """Rows, verified, correct and incorrect with percentages of the verified."""
    n = itl.agg(F.count("*").alias("total"), F.count_if("verified").alias("verified"), F.count_if(F.col("verified") & F.col("is_correct")).alias("correct"), F.count_if(F.col("verified") & ~F.col("is_correct")).alias("incorrect"))
    return n.withColumns({"correct_pct": percent(F.col("correct"), F.col("verified")), "incorrect_pct": percent(F.col("incorrect"), F.col("verified"))})


def judge_statistics(results: DataFrame) -> DataFrame:
    """One row of verdict, score and time statistics; a score outside 0..10 counts as invalid and enters no average."""
    s = F.when(F.col("score").between(0, 10), F.col("score"))
    ok = F.coalesce(F.col("is_correct"), F.lit(False))
    t = F.col("verification_time")
    out = results.agg(
        F.count("*").alias("total_verified"),
        F.count_if(ok).alias("correct"),
        F.count_if(~ok).alias("incorrect"),
        F.count_if(~F.coalesce(F.col("score").between(0, 10), F.lit(False))).alias("invalid_scores"),
        F.avg(s).alias("average_score"),
        F.median(s).alias("median_score"),
        F.avg(t).alias("average_time"),
        F.min(t).alias("min_time"),
        F.max(t).alias("max_time"),
    )
    return out.withColumns({"correct_percentage": percent(F.col("correct"), F.col("total_verified")), "incorrect_percentage": percent(F.col("incorrect"), F.col("total_verified"))})


def status_counters(df: DataFrame, status: str, good: str, seconds: float | None = None) -> DataFrame:
    """Rows by outcome, success rate, and rows per second if the time is given."""
    out = df.agg(F.count("*").alias("total"), F.count_if(F.col(status) == good).alias("success"), F.count_if(F.col(status) != good).alias("failed"), F.count_if(F.col(status).isNull()).alias("skipped"))
    out = out.withColumn("success_rate", percent(F.col("success"), F.col("total")))
    return out if seconds is None else out.withColumn("rows_per_second", F.try_divide(F.col("total"), F.lit(seconds)))


def operator_bin(n: Column) -> Column:
    low = F.floor(n / 5) * 5
    return F.concat(F.lit("operators_"), low.cast("string"), F.lit("-"), (low + 4).cast("string"))


def complexity_bins(df: DataFrame, depth: Column, operators: Column, propositions: Column, value: Column, least: int = 5) -> DataFrame:
    """Mean of value by depth, by operators in fives and by propositions, for bins of at least so many rows, in one pass."""
    bins = F.array(F.concat(F.lit("depth_"), depth.cast("string")), operator_bin(operators), F.concat(F.lit("propositions_"), propositions.cast("string")))
    spread = df.select(F.explode(bins).alias("bin"), value.alias("v"))
    return spread.groupBy("bin").agg(F.count("*").alias("n"), F.avg("v").alias("mean")).filter(F.col("n") >= least)


def paired_by_group(df: DataFrame, group: str, variant: Column, value: Column, least: int = 10) -> DataFrame:
    """Mean of value of both variants (true, false) and their difference, for groups with at least so many of each."""
    out = df.groupBy(group).agg(F.count_if(variant).alias("n_with"), F.count_if(~variant).alias("n_without"), F.avg(F.when(variant, value)).alias("with"), F.avg(F.when(~variant, value)).alias("without"))
    return out.filter((F.col("n_with") >= least) & (F.col("n_without") >= least)).withColumn("difference", F.col("with") - F.col("without"))


def paired_sums(left: DataFrame, right: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """For each key of both sides the sum of value over all pairs of a left and a right row, both added; a pair with a null is left out.

    Each side is one row a key before they meet, so a key of many rows makes no pairs, and partitions follow the larger table.
    """
    n = max(partitions_of(left), partitions_of(right))

    def once(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, value).repartition(n, *keys).groupBy(*keys).agg(F.sum(value).alias(f"s{side}"), F.count(value).alias(f"n{side}"))

    met = once(left, "l").hint("merge").join(once(right, "r"), keys)
    return met.select(*keys, F.when((F.col("nl") > 0) & (F.col("nr") > 0), F.col("sl") * F.col("nr") + F.col("sr") * F.col("nl")).alias(out))


def statistics_report(one_row: DataFrame, histogram: DataFrame) -> DataFrame:
    """Long form of a report in two sections: section, key, value."""
    names = one_row.columns
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names]))
    first = one_row.select(F.lit("summary").alias("section"), pairs.alias("p")).select("section", "p.key", "p.value")
    return first.union(histogram.select(F.lit("scores"), F.col("bin").cast("string"), F.col("n").cast("string")))
