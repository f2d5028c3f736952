"""Every query of the core library at the smallest scale, against its SQL."""

import pytest

from pathloom.plans.queries import ORACLE_SQL, QUERIES
from tests.sql import SF, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_and_repeats(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    assert rows and columns
    assert spark_rows(QUERIES[name](spark, SF)) == (columns, rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
