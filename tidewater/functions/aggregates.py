"""Aggregates of the dialect as compositions of Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listagg(x: Column, delimiter: str = "") -> Column:
    """Texts in their own order, nulls left out. A group's texts are gathered, so use it for groups of bounded size."""
    return F.array_join(F.sort_array(F.collect_list(x)), delimiter)


def mode(x: Column) -> Column:
    """The most frequent value, the least of equally frequent ones."""
    return F.mode(x, True)


def percentile_cont(x: Column, p: float) -> Column:
    return F.percentile(x, p)


def percentile_disc(name: str, p: float) -> Column:
    """Of a column by its name, as an aggregate over an ordered group takes no other expression here."""
    quoted = name.replace("`", "``")
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{quoted}`)")


def kurtosis(x: Column) -> Column:
    """Excess of a sample, without bias."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def skew(x: Column) -> Column:
    """Of a sample, without bias."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))


def object_agg(rows: DataFrame, by: list[str], key: Column, value: Column, name: str) -> DataFrame:
    """For each group of `by`, a JSON object of its keys in order. Of equal keys the greatest value stays; pairs with a
    null key or a null value don't count. Keys are reduced first, so a group gathers its different keys only."""
    pairs = rows.select(*by, key.alias("__k"), value.alias("__v")).groupBy(*by, "__k").agg(F.max("__v").alias("__v"))
    pair = F.when(F.col("__k").isNotNull() & F.col("__v").isNotNull(), F.struct("__k", "__v"))
    return pairs.groupBy(*by).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(pair)))).alias(name))


def ratio_to_report(x: Column, over) -> Column:
    return x / F.sum(x).over(over)
