"""SQL names for the functions, and a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..ltl import decide, itl, rewrite, treedist
from ..ltl.parse import ParseError, parse, scan
from . import metrics


class LtlTokens:
    """kind and text of each token of a formula, in order; none of one that cannot be read."""

    def eval(self, formula: str) -> Iterator[tuple[int, str, str]]:
        try:
            yield from ((i, kind, said) for i, (kind, said) in enumerate(scan(formula or "")))
        except ParseError:
            return


def _text(body):
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            try:
                out.append(None if x is None else body(x))
            except (ParseError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


def _pair(body):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            try:
                out.append(None if x is None or y is None else body(parse(x), parse(y)))
            except (ParseError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


def _valid(s: pd.Series) -> pd.Series:
    return _text(lambda x: bool(parse(x)))(s).notna()


def register(spark: SparkSession) -> None:
    """ltl_valid, ltl_canonical, ltl_hash, ltl_to_itl, itl_to_ltl, ltl_equivalent, ltl_tree_edit_distance, rouge_l, meteor, and the table function ltl_tokens."""
    one = {
        "ltl_canonical": lambda x: rewrite.canonical_text(parse(x)),
        "ltl_hash": lambda x: rewrite.canonical_hash(parse(x)),
        "ltl_to_itl": lambda x: itl.render(parse(x)),
        "itl_to_ltl": lambda x: itl.operand_text(itl.parse_itl(x)),
    }
    for name, body in one.items():
        spark.udf.register(name, F.pandas_udf(_text(body), "string"))
    spark.udf.register("ltl_valid", F.pandas_udf(_valid, "boolean"))
    spark.udf.register("ltl_equivalent", F.pandas_udf(_pair(decide.equivalent), "boolean"))
    spark.udf.register("ltl_tree_edit_distance", F.pandas_udf(_pair(treedist.normalised), "double"))
    spark.udf.register("rouge_l", F.pandas_udf(metrics._rouge_l, "double"))
    spark.udf.register("meteor", F.pandas_udf(metrics._meteor, "double"))
    spark.udtf.register("ltl_tokens", F.udtf(LtlTokens, returnType="position int, kind string, said string"))
