"""Every query with SQL against DuckDB on the small tables; the others give rows and keep their schema."""

import pytest
from compare import SMALL, rows

from ltlspark.queries import oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SMALL).toPandas(), duck(SMALL).sql(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_package(monkeypatch):
    import importlib.util

    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("ltlspark.llm", "corpus_pipeline")) else real(name, *a))
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert __spark_entry__.oracle_sql() == SQL
