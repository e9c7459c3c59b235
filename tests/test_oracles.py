"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

import pytest

from checks import oracles, queries
from checks.compare import duckdb_rows, rows_of
from tests.conftest import SF_DIR

TEXTS = oracles.texts()


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_same_rows_as_sql(spark, name):
    df = queries.registered()[name](spark, SF_DIR)
    columns, expected = duckdb_rows(SF_DIR, TEXTS[name])
    assert sorted(df.columns) == columns
    assert rows_of(df.columns, df.collect()) == expected
    assert expected


def test_every_sql_has_a_query():
    assert set(TEXTS) <= set(queries.registered())


@pytest.mark.parametrize("name", sorted(set(queries.registered()) - set(TEXTS)))
def test_queries_without_sql_run(spark, name):
    df = queries.registered()[name](spark, SF_DIR)
    assert df.columns and df.collect()
