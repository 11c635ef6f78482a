"""INSERT, UPDATE, DELETE and MERGE as DataFrame rewrites, with the counts that the dialect reports."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def update(df: DataFrame, changes: Mapping[str, Column], where: Column) -> DataFrame:
    """df with changed columns in the rows where the predicate is true."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in df.columns])


def delete(df: DataFrame, where: Column) -> DataFrame:
    """df without the rows where the predicate is true; rows where it is null stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df with more rows; columns that they lack are null, types are df's."""
    lacking = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in rows.columns else F.col(f.name).cast(f.dataType) for f in df.schema]
    return df.union(rows.select(*lacking))


@dataclass
class Merge:
    """MERGE INTO target USING source: clauses are tried in the order in which they were added."""

    target: DataFrame
    source: DataFrame
    on: Column
    matched: list[tuple[Column, Mapping[str, Column] | None]] = field(default_factory=list)
    missing: list[tuple[Column, Mapping[str, Column]]] = field(default_factory=list)

    def when_matched_update(self, changes: Mapping[str, Column], where: Column | None = None) -> Merge:
        self.matched.append((F.lit(True) if where is None else where, changes))
        return self

    def when_matched_delete(self, where: Column | None = None) -> Merge:
        self.matched.append((F.lit(True) if where is None else where, None))
        return self

    def when_not_matched_insert(self, values: Mapping[str, Column], where: Column | None = None) -> Merge:
        self.missing.append((F.lit(True) if where is None else where, values))
        return self

    def result(self) -> DataFrame:
        """The merged rows. Columns are named t.x and s.x in conditions and values.

        The source must have one row at most for a target row; if it has more, the job fails.
        """
        names = self.target.columns
        t = self.target.withColumns({"__t": F.lit(True), "__id": F.monotonically_increasing_id()}).alias("t")
        s = self.source.withColumns({"__s": F.lit(True), "__new": -1 - F.monotonically_increasing_id()}).alias("s")
        # Source rows without a target row are counted by a number of their own, so that they don't meet in one task.
        same = Window.partitionBy(F.coalesce("__id", "__new"))
        both = t.join(s, self.on, "full").withColumn("__count", F.count("*").over(same))
        several = F.raise_error("a row of the target has several rows of the source").cast("boolean")
        both = both.where(F.when(F.col("__count") > 1, several).otherwise(True))
        in_both, new = F.col("__t").isNotNull() & F.col("__s").isNotNull(), F.col("__t").isNull()
        action = F.when(F.lit(False), -1)
        for k, (where, _) in enumerate(self.matched):
            action = action.when(in_both & where, 2 * k)
        for k, (where, _) in enumerate(self.missing):
            action = action.when(new & where, 2 * k + 1)
        columns = []
        for c in names:
            value = F.when(F.lit(False), F.col(f"t.{c}"))
            for k, (_, changes) in enumerate(self.matched):
                if changes and c in changes:
                    value = value.when(F.col("__action") == 2 * k, changes[c])
            for k, (_, values) in enumerate(self.missing):
                value = value.when(F.col("__action") == 2 * k + 1, values.get(c, F.lit(None)))
            columns.append(value.otherwise(F.col(f"t.{c}")).cast(self.target.schema[c].dataType).alias(c))
        removed = [2 * k for k, (_, changes) in enumerate(self.matched) if changes is None]
        rows = both.withColumn("__action", action).where(~(new & F.col("__action").isNull()))
        rows = rows.where(F.col("__action").isNull() | ~F.col("__action").isin(*removed)) if removed else rows
        return rows.select(*columns)

    def many_matches(self) -> int:
        """How many target rows have more than one source row, which MERGE forbids."""
        t = self.target.withColumn("__id", F.monotonically_increasing_id()).alias("t")
        return t.join(self.source.alias("s"), self.on).groupBy("__id").count().where("count > 1").count()


def counts(before: DataFrame, kind: str, where: Column | None = None) -> dict[str, int]:
    """The row of numbers that a statement reports: kind is inserted, updated or deleted."""
    rows = before if where is None else before.where(where)
    out = {f"number of rows {kind}": rows.count()}
    return out | ({"number of multi-joined rows updated": 0} if kind == "updated" else {})
