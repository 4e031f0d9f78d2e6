"""Arrow UDFs for what folds cannot express: reading text, structure rewrites, decisions and tree distance.

Each takes and gives whole Arrow batches; nulls and unreadable text give null (or
valid = false with the reason). `over_distinct` runs one once for each distinct
argument, so a corpus with few formulas pays for those alone.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ltl import decide, itl, rewrite, treedist
from ..ltl.ast import from_arena, from_dict, to_arena
from ..ltl.parse import ParseError, parse, show
from ..schema import AST

PARSED = f"struct<valid:boolean,ast:{AST},error:string>"


@lru_cache(100_000)
def _parsed(text: str, dialect: str):
    try:
        return parse(text, dialect), None
    except (ParseError, RecursionError) as e:
        return None, str(e)


@lru_cache(100_000)
def _english(text: str, compat: bool):
    try:
        return itl.parse_itl(text, compat), None
    except (ParseError, RecursionError) as e:
        return None, str(e)


def _structs(found) -> pd.DataFrame:
    return pd.DataFrame([(f is not None, None if f is None else to_arena(f), e) for f, e in found], columns=["valid", "ast", "error"])


def ltl_parse(text: Column, dialect: str = "spot") -> Column:
    """struct(valid, ast, error) of a formula's text in any notation."""

    @F.pandas_udf(PARSED)
    def read(s: pd.Series) -> pd.DataFrame:
        return _structs(_parsed(x, dialect) if isinstance(x, str) else (None, "null") for x in s)

    return read(text)


def itl_parse(text: Column, compat: bool = False) -> Column:
    """struct(valid, ast, error) of controlled English."""

    @F.pandas_udf(PARSED)
    def read(s: pd.Series) -> pd.DataFrame:
        return _structs(_english(x, compat) if isinstance(x, str) else (None, "null") for x in s)

    return read(text)


def itl_to_ltl(text: Column, compat: bool = False) -> Column:
    """Formula text of controlled English, binary operands in parentheses; null if it is none."""

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        found = (_english(x, compat)[0] if isinstance(x, str) else None for x in s)
        return pd.Series([None if f is None else itl.operand_text(f) for f in found], dtype=object)

    return read(text)


def _rewriter(kind: str, body):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else body(from_arena(a)) for a in s], dtype=object)

    return run


def ast_from_json(text: Column) -> Column:
    """The tree of nested JSON of type, value and children; null if it is none."""

    @F.pandas_udf(AST)
    def read(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            try:
                out.append(None if x is None else to_arena(from_dict(json.loads(x))))
            except (ValueError, KeyError, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return read(text)


def ltl_canonical(ast: Column) -> Column:
    """Canonical text: simplified, flattened, operands sorted."""
    return _rewriter("string", lambda f: rewrite.canonical_text(f))(ast)


def ltl_canonical_hash(ast: Column, compat: bool = False) -> Column:
    """sha-256 of the canonical key."""
    return _rewriter("string", lambda f: rewrite.canonical_hash(f, compat))(ast)


def ltl_compat_key(ast: Column) -> Column:
    return _rewriter("string", lambda f: rewrite.compat_key(rewrite.compat_canonical(f)))(ast)


def ltl_rewrite(ast: Column, step: str) -> Column:
    """The tree after one step: nnf, expand, flatten, distribute, sort, simplify."""
    steps = {"nnf": rewrite.nnf, "expand": rewrite.expand, "flatten": rewrite.flatten, "distribute": rewrite.distribute, "sort": rewrite.sort_operands, "simplify": rewrite.simplify}
    body = steps[step]
    return _rewriter(AST, lambda f: to_arena(body(f)))(ast)


def compat_rejects(ast: Column) -> Column:
    return _rewriter("boolean", lambda f: rewrite.compat_rejects(f))(ast)


def ltl_tautology(ast: Column) -> Column:
    return _rewriter("boolean", lambda f: decide.tautology(f))(ast)


def ltl_contradiction(ast: Column) -> Column:
    return _rewriter("boolean", lambda f: decide.contradiction(f))(ast)


def _pairs(kind: str, body):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            f, g = (_parsed(t, "spot")[0] if isinstance(t, str) else None for t in (x, y))
            out.append(None if f is None or g is None else body(f, g))
        return pd.Series(out, dtype=object)

    return run


def ltl_equivalent(a: Column, b: Column) -> Column:
    """Whether two formula texts mean the same; null if one is no formula or the budget runs out."""
    return _pairs("boolean", lambda f, g: decide.equivalent(f, g))(a, b)


def tree_edit_distance(a: Column, b: Column, normalised: bool = True) -> Column:
    """Edit distance of two formula texts' trees, by default over the larger one's nodes; null if one is no formula."""
    return _pairs("double", lambda f, g: treedist.normalised(f, g) if normalised else float(treedist.distance(f, g)))(a, b)


def ltl_show(ast: Column) -> Column:
    return _rewriter("string", lambda f: show(f))(ast)


def over_distinct(df: DataFrame, columns: list[str], **computed) -> DataFrame:
    """df with columns computed once for each distinct combination of the given ones, joined back null-safely."""
    once = df.select(*columns).distinct().withColumns(computed)
    named = once.select(*[F.col(c).alias(f"__{c}") for c in columns], *computed)
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
    return df.join(named, on, "left").drop(*[f"__{c}" for c in columns])
