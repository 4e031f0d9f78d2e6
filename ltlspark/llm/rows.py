"""Rows that travel through an operator under names of our own, so that no column of theirs can clash with its."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(names: list[str]) -> Column:
    """One struct of the named columns."""
    return F.struct(F.lit(True).alias("is_row"), *[column(c).alias(f"c{k}") for k, c in enumerate(names)]).alias("row")


def unpacked(names: list[str]) -> dict[str, Column]:
    """The columns of such a struct, by their names."""
    return {c: F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)}


def fresh(names: list[str], stem: str) -> str:
    """stem, with as many underscores as make it a name that is not there yet."""
    taken = {n.lower() for n in names}
    while stem.lower() in taken:
        stem += "_"
    return stem
