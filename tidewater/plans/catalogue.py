"""All registered queries with the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import relational, scalars, statements

PARTS = (scalars, relational, statements)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.queries()["flagship"](spark, sf_dir)


def queries() -> dict:
    return {name: query for part in PARTS for name, query in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}
