"""The operators' queries that SQL can express, against DuckDB over the same files."""

import pytest

from tests.test_oracle import agrees, oracle  # noqa: F401  a fixture
from tidewater.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_oracle(spark, sf, oracle, name):  # noqa: F811
    agrees(spark, sf, oracle, name, SQL[name])
