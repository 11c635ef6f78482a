"""Operators on DataFrames: row sources, ordering with the dialect's nulls, QUALIFY, FLATTEN, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stages import scratch

#: Bins that a range is in, beyond which bins of the next size are taken, so many times as wide.
BINS = 16


def generator(spark: SparkSession, rows: int, name: str = "seq") -> DataFrame:
    """Rows with the numbers from 1."""
    return spark.range(1, rows + 1).withColumnRenamed("id", name)


def numbered(df: DataFrame, name: str = "seq") -> DataFrame:
    """Adds numbers from 0 without gaps. Only the counts of partitions meet in one place, not the rows.

    Rows are written with their places first, so that a task that runs again can't number them anew.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "numbered")
    df.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    spot = spark.read.parquet(path)
    part, row = F.shiftrightunsigned(F.col(name), 33).cast("int"), F.col(name).bitwiseAND((1 << 33) - 1)
    total, rows = 0, []
    for r in spot.groupBy(part.alias("part")).count().orderBy("part").collect():
        rows.append((r["part"], total))
        total += r["count"]
    before = spark.createDataFrame(rows, "__part int, __before long")
    joined = spot.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.select(*df.columns, (row + F.col("__before")).alias(name))


def in_order(*keys: tuple[str, str] | str) -> list[Column]:
    """Sort keys: nulls come last upwards and first downwards."""
    out = []
    for key in keys:
        name, way = key if isinstance(key, tuple) else (key, "asc")
        out.append(F.col(name).asc_nulls_last() if way.lower() == "asc" else F.col(name).desc_nulls_first())
    return out


def top(df: DataFrame, n: int, *keys: tuple[str, str] | str) -> DataFrame:
    return df.orderBy(*in_order(*keys)).limit(n)


def qualify(df: DataFrame, predicate: Column, **windowed: Column) -> DataFrame:
    """Rows that a predicate over windowed columns lets through; the columns are kept if df has no such names."""
    return df.withColumns(windowed).where(predicate)


def flatten(df: DataFrame, array: str, value: str = "value", index: str | None = None, outer: bool = False) -> DataFrame:
    """A row for each element; with outer, one with null for empty arrays."""
    if index:
        make = F.posexplode_outer if outer else F.posexplode
        return df.select("*", make(array).alias(index, value))
    return df.select("*", (F.explode_outer if outer else F.explode)(array).alias(value))


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str], prefix: str = "right_", slot: str = "day") -> DataFrame:
    """Each left row with the values of the last right row of its key that isn't later, without pairs.

    Both sides become one stream, cut into slots of time, so that a key with very many rows is spread over tasks.
    Inside a slot the last right row seen is carried on in order of time; what a slot begins with is the last right
    row of the slots before, of which there is one row for each key and slot.
    """
    carried = F.struct(F.col(at), *values)
    rows = F.struct(*left.columns)
    seen_type = right.select(carried.alias("x")).schema["x"].dataType
    row_type = left.select(rows.alias("x")).schema["x"].dataType
    common = [F.col(by).alias("__by"), F.col(at).alias("__at"), F.date_trunc(slot, F.col(at).cast("timestamp")).alias("__slot")]
    ours = left.select(*common, F.lit(1).alias("__side"), rows.alias("__row"), F.lit(None).cast(seen_type).alias("__seen"))
    both = ours.unionByName(right.select(*common, F.lit(0).alias("__side"), F.lit(None).cast(row_type).alias("__row"), carried.alias("__seen")))
    slots = both.groupBy("__by", "__slot").agg(F.max_by("__seen", F.when(F.col("__side") == 0, F.col("__at"))).alias("__end"))
    before = Window.partitionBy("__by").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = slots.select("__by", "__slot", F.last("__end", ignorenulls=True).over(before).alias("__begin"))
    inside = Window.partitionBy("__by", "__slot").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__last", F.last("__seen", ignorenulls=True).over(inside)).where("__side = 1")
    same = seen["__by"].eqNullSafe(begins["__by"]) & seen["__slot"].eqNullSafe(begins["__slot"])
    found = seen.join(begins, same).withColumn("__last", F.when(F.col("__row")[by].isNotNull(), F.coalesce("__last", "__begin")))
    return found.select("__row.*", F.col(f"__last.{at}").alias(f"{prefix}{at}"), *[F.col(f"__last.{v}").alias(f"{prefix}{v}") for v in values])


def range_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high) that they are in, by an equal join of bins and a check.

    A range of more than BINS bins takes wider ones, BINS times at each level, so it never makes more than BINS + 2 rows;
    a point has one bin at each level that some range is at, of which there are as many as the logarithm of the widest.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log(float(BINS), (F.col(high) - F.col(low)) / (width * BINS)))).cast("int")
    spread = ranges.where(F.col(high) > F.col(low)).withColumn("__level", level)
    levels = [r[0] for r in spread.select("__level").distinct().collect()]
    size = F.lit(width) * F.pow(F.lit(float(BINS)), F.col("__level"))
    dealt = spread.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))
    spots = points.withColumn("__level", F.explode(F.lit(levels or [0]).cast("array<int>"))).withColumn("__bin", F.floor(F.col(at) / size))
    joined = spots.join(dealt, ["__level", "__bin"])
    return joined.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__bin", "__level")


def null_safe_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    return left.join(right, left[left_key].eqNullSafe(right[right_key]), how)
