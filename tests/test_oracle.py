"""Every registered query against its DuckDB text on the derived inputs."""

import pytest
from compare import connect, rows_of_duck, rows_of_spark

from __spark_entry__ import entry, oracle_sql, queries
from runlens.checks.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(set(ORACLES)))
def test_query(spark, sf_dir, name):
    columns, rows = rows_of_spark(queries()[name](spark, sf_dir))
    want_columns, want = rows_of_duck(connect(sf_dir), oracle_sql()[name])
    assert columns == want_columns
    assert rows == want and rows


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_core_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(ORACLES) <= set(oracle_sql()) <= set(queries())
