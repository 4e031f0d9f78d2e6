"""Key-value stores as tables: what the sinks do, as plans that make the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise

#: Ranges of the order that a running average is dealt out by.
RANGES = 64


def insert_ignore(existing: DataFrame | None, new: DataFrame, key: str, id_col: str) -> DataFrame:
    """The rows of new that a unique key lets in: of each key the smallest id, and no key that is there already.

    The survivor comes from an aggregate, so a key that many rows share is combined before the shuffle.
    """
    first = new.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), id_col).alias("__row"))
    out = first.select(key, "__row.*").select(*new.columns)
    return out if existing is None else out.join(existing.select(key), key, "left_anti").select(*new.columns)


def update_by_key(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with columns taken from updates where it has the key (a null there is kept as the new value).

    Of updates that share a key the largest by the columns in order counts (null is least); a row is never multiplied.
    """
    new = updates.groupBy(key).agg(F.max(F.struct(*columns)).alias("__new"))
    joined = table.join(new, key, "left")
    return joined.withColumns({c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns}).select(*table.columns)


def add_missing_columns(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """table with null columns for those that it does not have."""
    return table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in table.columns})


def with_ids(new: DataFrame, order: list[str], start: int | Column = 0, id_col: str = "id") -> DataFrame:
    """new with consecutive ids after start, in the given order, without bringing all rows to one task.

    The rows are sorted by range and written once; a partition's ids start after the
    counts of the partitions before it, a table of one row for each partition.
    """
    sorted_ = materialise(new.orderBy(*order).withColumn("__p", F.monotonically_increasing_id()), "numbered")
    part = sorted_.withColumn("__k", F.col("__p") % (1 << 33)).withColumn("__p", F.shiftright("__p", 33))
    sizes = part.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__p", before.alias("__before"))
    return part.join(starts, "__p").withColumn(id_col, F.col("__k") + F.col("__before") + 1 + start).drop("__p", "__k", "__before")


def with_next_ids(existing: DataFrame, new: DataFrame, order: list[str], id_col: str = "id", time_col: str | None = None) -> DataFrame:
    """new with consecutive ids after the largest of existing, and the time of the run if a column is named for it."""
    last = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__last"))
    out = with_ids(new, order, 0, id_col).join(F.broadcast(last)).withColumn(id_col, F.col(id_col) + F.col("__last")).drop("__last")
    return out.withColumn(time_col, F.current_timestamp()) if time_col else out


def existing_keys(candidates: DataFrame, table: DataFrame, key: str, present: bool = True) -> DataFrame:
    """The candidates whose key is (or is not) in the table."""
    return candidates.join(table.select(key), key, "left_semi" if present else "left_anti")


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(limit)


def running_average(df: DataFrame, order: str, value: str, group: str) -> DataFrame:
    """Average of value so far, by order (a number, date or time), within each group.

    The order's values are cut into RANGES of about equal numbers of rows. Sums run within
    (group, range) and start from the sums of the ranges before, a table of RANGES rows a group at
    most, so a group that holds most rows is dealt out. A null value counts for nothing.
    """
    marks = [k / RANGES for k in range(1, RANGES)]
    cuts = df.agg(F.percentile_approx(order, marks, F.lit(100 * RANGES)).alias("__cuts"))
    placed = df.join(F.broadcast(cuts)).withColumn("__part", F.size(F.filter(F.coalesce("__cuts", F.array()), lambda c: c < F.col(order)))).drop("__cuts")
    sums = placed.groupBy(group, "__part").agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce(F.sum("__s").over(earlier), F.lit(0.0)).alias("__s"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"))
    joined = placed.join(before, placed[group].eqNullSafe(before["__g"]) & (placed["__part"] == before["__p"]))
    w = Window.partitionBy(group, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total, n = F.col("__s") + F.coalesce(F.sum(value).over(w), F.lit(0.0)), F.col("__n") + F.count(value).over(w)
    return joined.withColumn("running", F.try_divide(total, n)).select(*df.columns, "running")
