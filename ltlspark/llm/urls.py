"""Operator 9: URL rules by hashed host-suffix and path-prefix expressions.

A rule names a host (its subdomains too) and a path prefix. Every URL is expanded
into the host-suffix + path-prefix strings that some rule could name: the pairs of
label count and path length that occur among the rules, one array for the whole plan,
bound the expansion, however long the URL. Expressions meet rules in an equi-join on the first four bytes of
their SHA-256; full digests confirm, and the longest rule wins.

Each distinct URL is judged once, so a host or URL that fills a third of the table
costs no more than its distinct URLs; only the join back sees repeated rows, and
there the rules' side is unique, so a hot key can be split at run time.

Null URLs and those without "://" have an empty host and path and fit no rule; URLs of
any length are judged whole. A rule listed twice with both verdicts blocks. Rules with
a null or empty host fit nothing; a null path is an empty one. Repeated pages are
judged each, and an empty table gives no row. Other columns of pages are kept,
whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import column, fresh

#: Rules up to this number are broadcast (at most some 150 bytes each); more are shuffled.
BROADCAST_RULES = 100_000


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return _lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; rules has host, path and verdict (allow or block).

    rule is the longest fitting rule's host and path as one string, else null; without one the verdict is default.
    Columns of pages that have one of the four names are replaced.
    """
    known = (
        rules.select(_lower(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v"))
        .filter((F.col("h") != "") & F.col("v").isNotNull())
        .groupBy("h", "p")
        .agg(F.max("v").alias("v"))
        .withColumn("rule", F.concat("h", "p"))
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("prefix", F.substring("digest", 1, 8))
    )
    side = known.select("prefix", "digest", "rule", "v")
    if known.count() <= BROADCAST_RULES:
        side = F.broadcast(side)
    # one row: the pairs of label count and path length that rules have
    shapes = known.agg(F.collect_set(F.struct(_labels(F.col("h")).alias("n"), F.length("p").alias("l"))).alias("shapes"))

    host, path = host_path(F.col("of"))
    urls = pages.select(column(url_col).alias("of")).filter(F.col("of").isNotNull()).distinct().withColumns({"h": host, "p": path})
    sized = urls.withColumns({"labels": _labels(F.col("h")), "size": F.length("p")}).join(F.broadcast(shapes))
    expressions = sized.select("of", F.expr("explode(transform(filter(shapes, s -> labels >= s.n and size >= s.l), s -> concat(substring_index(h, '.', -s.n), substring(p, 1, s.l))))").alias("e"))
    hashed = expressions.select("of", F.sha2("e", 256).alias("full")).withColumn("prefix", F.substring("full", 1, 8))
    fitting = hashed.join(side, "prefix").filter(F.col("full") == F.col("digest"))
    best = fitting.groupBy("of").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "v")).alias("best"))

    # names that pages does not have; its other columns need not reach the join
    of, found = fresh(pages.columns, "of"), fresh(pages.columns, "best")
    joined = pages.join(best.toDF(of, found), column(url_col) == F.col(of), "left")
    host, path = host_path(column(url_col))
    made = {"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit("")), "rule": F.col(f"{found}.rule"), "verdict": F.coalesce(f"{found}.v", F.lit(default))}
    kept = [c for c in pages.columns if c not in made]
    return joined.select(*[column(c) for c in kept], *[c.alias(n) for n, c in made.items()])
