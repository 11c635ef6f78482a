"""Every query with SQL against DuckDB over the same files."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tidewater.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


def plain(x):
    if isinstance(x, (decimal.Decimal, float)):
        return None if math.isnan(x) else round(float(x), 5)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows(names, data):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in at) for r in data), key=repr)


@pytest.fixture(scope="session")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf)}/{t}.parquet'")
    return con


def agrees(spark, sf, oracle, name, sql):
    got = contract.queries()[name](spark, sf)
    want = oracle.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_oracle(spark, sf, oracle, name):
    agrees(spark, sf, oracle, name, SQL[name])


def test_queries_are_named_without_a_session():
    assert set(SQL) <= set(contract.queries())
