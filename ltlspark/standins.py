"""The corpus' tables made from the test tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .runtime import table
from .schema import DOMAINS, GOLDEN


def quoted(v) -> str:
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "(values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


GOLD = values([(k, ltl, itl) for k, (ltl, itl, _) in enumerate(GOLDEN)]) + " as g(k, ltl, itl)"
DOMAIN = values(list(enumerate(DOMAINS))) + " as d(k, name)"

#: Variants of a prediction as the experiments on context and domains name them.
CONTEXT, DOMAIN_RUNS = {"direct": "with_context", "two_stage": "without_context"}, {"direct": "lodo", "two_stage": "few_shot_5"}

SQL = {
    "formulas": f"""select o_orderkey as id, g.ltl as formula, g.ltl as latex, cast(o_custkey as string) as canonical_hash, cast(o_orderkey % 6 as int) as depth,
        case when o_orderkey % 7 = 0 then null else g.ltl end as spot_formulas,
        case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then 'ERROR' else g.ltl end as canonical_form
        from orders join {GOLD} on g.k = o_orderkey % 31""",
    "itl": f"""select cast(o_orderkey * 10 + 1 as bigint) as id, o_orderkey as formula_id, g.itl as itl_text, o_orderkey % 5 <> 0 as canonical_form,
        case when o_orderkey % 17 = 0 then 'error' else 'canonical_mapping' end as generation_method, o_orderkey % 3 = 0 as verified,
        case when o_orderkey % 3 = 0 then o_orderkey % 4 <> 1 end as is_correct
        from orders join {GOLD} on g.k = o_orderkey % 31""",
    "translations": f"""select cast(l_orderkey * 10 + l_linenumber as bigint) as id, l_orderkey as formula_id, cast(l_orderkey * 10 + 1 as bigint) as itl_id, d.name as domain,
        concat('activity ', cast(l_linenumber as string)) as activity, concat('text ', cast(l_suppkey as string)) as translation, l_quantity / 10 as generation_time
        from lineitem join {DOMAIN} on d.k = l_partkey % 13 where l_orderkey % 4 <> 0""",
    "results": """select cast(l_orderkey * 10 + 2 as bigint) as translation_id, l_quantity > 20 as is_correct, cast(l_quantity as int) % 12 as score, l_extendedprice / 1000 as verification_time
        from lineitem where l_linenumber = 2""",
    # predictions: the variants of an item are the turns of a conversation
    "predictions": """select 'ltl_to_nl' as task, case when turn % 2 = 0 then 'direct' else 'two_stage' end as variant, cast(conv_id * 4294967296 + floor(turn / 2) as bigint) as item_id,
        case when conv_id % 19 = 0 then '[Generation failed]' else role end as prediction, 'user' as reference, cast(conv_id % 13 as string) as domain,
        cast(conv_id % 5 as int) as depth, cast(conv_id % 17 as int) as operators, cast(conv_id % 4 as int) as propositions from conversations where turn is not null""",
}
_BASE = ["orders", "lineitem", "conversations"]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    query = SQL[name]
    base = next(t for t in _BASE if f"from {t}" in query)
    return spark.sql(query.replace(f"from {base}", f"from {{{base}}}"), **{base: table(spark, sf_dir, base)})


def with_tables(query: str, *names: str) -> str:
    """DuckDB SQL that sees the named stand-ins."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + " " + query
