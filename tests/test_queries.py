"""Every registered query with SQL gives the same schema and values as DuckDB."""

import __spark_entry__ as entry
import pytest
from oracle_check import compare, duck

SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    assert compare(entry.queries()[name](spark, sf), duck(sf), SQL[name]) is None


def test_entry_has_every_day(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 2499
    assert (rows[-1]["date"] - rows[0]["date"]).days + 1 == len(rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
