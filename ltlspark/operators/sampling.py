"""Samples, splits and balanced draws that depend on a seed and the rows' ids alone.

Every choice is by rank of md5(seed, id). A rank is exact at any size without one
task for a group: rows are ranked within (group, range of the hash), and the rows of
the ranges before, a table of groups x ranges counts, are added. There are as many
ranges as give each about BUCKET rows, by a count in the plan. Rows of one id share a
range: ids are meant to tell rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range of hashes, over all groups.
BUCKET = 100_000


def md5_number(*parts: Column) -> Column:
    """The first 32 bits of the md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def ranked(df: DataFrame, id_col: str, seed: int | str, group: list[str] | None = None, rank: str = "rank", size: str = "size") -> DataFrame:
    """df with the 1-based rank of md5(seed:id) within its group, and the group's size."""
    group = group or []
    width = df.agg(F.ceil(F.lit(1 << 32) / F.ceil((F.count("*") + 1) / BUCKET)).alias("__width"))
    hashed = df.withColumn("__h", md5_number(F.lit(str(seed)), F.col(id_col))).join(F.broadcast(width)).withColumn("__b", F.floor(F.col("__h") / F.col("__width"))).drop("__width")
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(f"__g{k}") for k, g in enumerate(group)]
    names = [f"__g{k}" for k in range(len(group))]
    hashed = hashed.select("*", *keys)
    counts = hashed.groupBy(*names, "__b").agg(F.count("*").alias("__n"))
    over = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(over.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(size, F.sum("__n").over(over)).drop("__n")
    within = F.row_number().over(Window.partitionBy(*names, "__b").orderBy("__h", id_col))
    out = hashed.withColumn("__r", within).join(before, [*names, "__b"])
    return out.withColumn(rank, (F.col("__r") + F.col("__before")).cast("long")).drop("__h", "__b", "__r", "__before", *names)


def fraction_sample(df: DataFrame, id_col: str, percent: int = 18, seed: int | str = 42) -> DataFrame:
    """floor(n * percent / 100) rows."""
    return ranked(df, id_col, seed).filter(F.col("rank") * 100 <= F.col("size") * percent).drop("rank", "size")


def fixed_sample(df: DataFrame, id_col: str, k: int, seed: int | str = 42) -> DataFrame:
    """k rows, or all if there are fewer."""
    return df.orderBy(md5_number(F.lit(str(seed)), F.col(id_col)), id_col).limit(k)


def stratified_split(df: DataFrame, id_col: str, stratum: str, seed: int | str = 42) -> DataFrame:
    """df with split: in each stratum floor(n / 10) test, then as many val, the rest train."""
    tenth = F.floor(F.col("size") / 10)
    part = F.when(F.col("rank") <= tenth, "test").when(F.col("rank") <= 2 * tenth, "val").otherwise("train")
    return ranked(df, id_col, seed, [stratum]).withColumn("split", part).drop("rank", "size")


def leave_one_out(df: DataFrame, domain: str) -> DataFrame:
    """Per held-out domain: rows of its test set and of the others' training set, by counts alone."""
    counts = df.groupBy(domain, "split").agg(F.count("*").alias("n"))
    total = counts.filter("split = 'train'").agg(F.sum("n").alias("all"))
    per = counts.groupBy(F.col(domain).alias("held_out")).agg(F.sum(F.when(F.col("split") == "test", F.col("n")).otherwise(0)).alias("test_rows"), F.sum(F.when(F.col("split") == "train", F.col("n")).otherwise(0)).alias("own"))
    return per.join(F.broadcast(total)).select("held_out", (F.coalesce("all", F.lit(0)) - F.col("own")).alias("train_rows"), "test_rows")


def leave_one_out_rows(df: DataFrame, domain: str, held_out: str) -> DataFrame:
    """The training rows of a held-out domain's run; the filter reaches the scan."""
    return df.filter((F.col(domain) != held_out) & (F.col("split") == "train"))


def few_shot(df: DataFrame, id_col: str, domain: str, ks: tuple[int, ...] = (1, 5, 10, 25, 50), first: int = 3, seed: int | str = 42) -> DataFrame:
    """k, domain and id of the shots of the first domains in order that have the largest k of training rows and a test row."""
    counts = df.groupBy(domain).agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))
    fit = counts.filter(F.col(domain).isNotNull()).orderBy(domain).limit(first).filter((F.col("train") >= max(ks)) & (F.col("test") > 0)).select(domain)
    train = df.filter("split = 'train'").join(F.broadcast(fit), domain)
    shots = ranked(train.select(id_col, domain), id_col, f"{seed}:shot", [domain])
    return shots.filter(F.col("rank") <= max(ks)).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter(F.col("rank") <= F.col("k")).select("k", domain, id_col)


def balanced_probabilities(counts: DataFrame, name: str, count: str, temperature: float = 0.3) -> DataFrame:
    """Softmax of -ln(count + 1) / temperature over a table of as many rows as there are domains."""
    logit = -F.ln(F.col(count) + 1) / temperature
    top = counts.withColumn("__l", logit).withColumn("__e", F.exp(F.col("__l") - F.max("__l").over(Window.partitionBy(F.lit(0)))))
    return top.withColumn("probability", F.col("__e") / F.sum("__e").over(Window.partitionBy(F.lit(0)))).drop("__l", "__e")


def assign_balanced(df: DataFrame, id_col: str, probabilities: DataFrame, name: str, seed: int | str = 42) -> DataFrame:
    """df with a domain drawn by inverse distribution; the distribution has as many rows as there are domains and is broadcast."""
    over = Window.partitionBy(F.lit(0)).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    steps = probabilities.withColumn("to", F.sum("probability").over(over)).agg(F.sort_array(F.collect_list(F.struct("to", F.col(name).alias("d")))).alias("steps"))
    u = md5_number(F.lit(str(seed)), F.col(id_col)) / F.lit(float(1 << 32))
    drawn = df.withColumn("__u", u).join(F.broadcast(steps))
    pick = F.filter("steps", lambda s: s["to"] > F.col("__u"))
    return drawn.withColumn(name, F.coalesce(F.try_element_at(pick, F.lit(1))["d"], F.element_at("steps", -1)["d"])).drop("__u", "steps")
