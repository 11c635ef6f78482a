"""Sessions: databases with schemas, variables, table statements with counts, and metadata as DataFrames."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stages import seed
from . import dml

DESCRIBED = ("name", "type", "kind", "null?", "default", "primary key", "unique key", "check", "expression", "comment", "policy name", "privacy domain")


def type_name(kind: T.DataType) -> str:
    """A type as DESCRIBE gives it."""
    if isinstance(kind, T.DecimalType):
        return f"NUMBER({kind.precision},{kind.scale})"
    fixed = {T.StringType: "VARCHAR(16777216)", T.BinaryType: "BINARY(8388608)", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP_NTZ(9)", T.TimestampType: "TIMESTAMP_TZ(9)", T.DoubleType: "FLOAT", T.FloatType: "FLOAT", T.ArrayType: "ARRAY", T.VariantType: "VARIANT", T.MapType: "OBJECT", T.StructType: "OBJECT"}
    if isinstance(kind, T.IntegralType):
        return "NUMBER(38,0)"
    return next((v for k, v in fixed.items() if isinstance(kind, k)), kind.simpleString().upper())


def described(df: DataFrame) -> DataFrame:
    """A row for each column, as DESCRIBE TABLE gives it."""
    rows = [(f.name, type_name(f.dataType), "COLUMN", "Y" if f.nullable else "N", None, "N", "N", None, None, None, None, None) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(c, T.StringType()) for c in DESCRIBED]))


def plain(name: str) -> str:
    """Upper case unless quoted."""
    return name[1:-1] if name[:1] == '"' == name[-1:] else name.upper()


class Variables:
    """Session variables by upper-case name; a value keeps its type."""

    def __init__(self) -> None:
        self.variables: dict[str, object] = {}

    def set(self, name: str, value: object) -> None:
        self.variables[name.upper()] = value

    def unset(self, name: str) -> None:
        self.variables.pop(name.upper(), None)

    def variable(self, name: str) -> Column:
        if name.upper() not in self.variables:
            raise KeyError(f"Undefined session variable: ${name.upper()}")
        return F.lit(self.variables[name.upper()])


class Session(Variables):
    """A current database and schema, a role, a warehouse and variables over one Spark session.

    A schema of a database is one namespace of Spark's catalogue, DATABASE__SCHEMA, with Parquet tables in it.
    """

    def __init__(self, spark: SparkSession, database: str = "MAIN", schema: str = "PUBLIC", role: str = "SYSADMIN", warehouse: str = "DEFAULT_WAREHOUSE") -> None:
        super().__init__()
        self.viewed: dict[str, DataFrame] = {}
        self.spark, self.role, self.warehouse = spark, role, warehouse
        self.database = self.schema = ""
        self.use_database(database)
        self.use_schema(schema)

    def use_database(self, name: str) -> str:
        self.create_database(name)
        self.database, self.schema = plain(name), "PUBLIC"
        return "Statement executed successfully."

    def use_schema(self, name: str) -> str:
        *database, schema = name.split(".")
        if database:
            self.use_database(database[0])
        self.create_schema(schema)
        self.schema = plain(schema)
        return "Statement executed successfully."

    def create_database(self, name: str) -> str:
        self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS `{plain(name)}__PUBLIC`")
        return f"Database {plain(name)} successfully created."

    def create_schema(self, name: str) -> str:
        self.spark.sql(f"CREATE NAMESPACE IF NOT EXISTS `{self.database}__{plain(name)}`")
        return f"Schema {plain(name)} successfully created."

    def resolve(self, name: str) -> str:
        """table, schema.table or database.schema.table as a name of Spark's catalogue."""
        *rest, table = name.split(".")
        schema = plain(rest[-1]) if rest else self.schema
        database = plain(rest[-2]) if len(rest) > 1 else self.database
        return f"`{database}__{schema}`.`{table.strip(chr(34))}`"

    def table(self, name: str) -> DataFrame:
        """A table, or a view of this session."""
        found = self.resolve(name)
        return self.viewed[found] if found in self.viewed else self.spark.table(found)

    def save(self, name: str, df: DataFrame, replace: bool = True) -> str:
        """CREATE [OR REPLACE] TABLE AS: the rows are written beside the old table, which then gives way."""
        beside = self.resolve(name)[:-1] + f"__{uuid.uuid4().hex}`"
        df.write.format("parquet").saveAsTable(beside)
        if replace:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.resolve(name)}")
        self.spark.sql(f"ALTER TABLE {beside} RENAME TO {self.resolve(name)}")
        return f"Table {name.split('.')[-1].upper()} successfully created."

    def drop(self, name: str, kind: str = "TABLE") -> str:
        """Drops a TABLE, a VIEW, or a SCHEMA of the current database with what stands in it."""
        if kind == "VIEW":
            self.viewed.pop(self.resolve(name), None)
        elif kind == "SCHEMA":
            self.spark.sql(f"DROP NAMESPACE IF EXISTS `{self.database}__{plain(name)}` CASCADE")
        else:
            self.spark.sql(f"DROP {kind} IF EXISTS {self.resolve(name)}")
        return f"{name.upper()} successfully dropped."

    def truncate(self, name: str) -> str:
        self.spark.sql(f"TRUNCATE TABLE {self.resolve(name)}")
        return "Statement executed successfully."

    def view(self, name: str, df: DataFrame) -> str:
        """A name for a DataFrame in the current schema, as long as this session lasts."""
        self.viewed[self.resolve(name)] = df
        return f"View {plain(name.split('.')[-1])} successfully created."

    def add_column(self, name: str, column: str, kind: str) -> str:
        """ALTER TABLE ADD COLUMN: rows that are there have null in it."""
        self.spark.sql(f"ALTER TABLE {self.resolve(name)} ADD COLUMNS (`{column}` {kind})")
        return "Statement executed successfully."

    def drop_column(self, name: str, column: str) -> str:
        """ALTER TABLE DROP COLUMN: the table is written again."""
        self.save(name, self.table(name).drop(column))
        return "Statement executed successfully."

    def insert(self, name: str, rows: DataFrame) -> dict[str, int]:
        """Rows are counted as they are written."""
        seen = Observation()
        dml.insert(self.table(name).limit(0), rows).observe(seen, F.count(F.lit(1)).alias("n")).write.insertInto(self.resolve(name))
        return {"number of rows inserted": seen.get["n"]}

    def write_pandas(self, name: str, frame: pd.DataFrame) -> tuple[bool, int, int, list]:
        """Inserts a frame's rows by place: success, chunks, rows, and no further output. An empty frame adds nothing."""
        added = 0
        if len(frame):
            rows = seed(self.spark, frame)
            added = self.insert(name, rows.toDF(*self.table(name).columns))["number of rows inserted"]
        return True, 1, added, []

    def update(self, name: str, changes: dict[str, Column], where: Column) -> dict[str, int]:
        before = self.table(name)
        found = dml.counts(before, "updated", where)
        self.save(name, dml.update(before, changes, where))
        return found

    def delete(self, name: str, where: Column) -> dict[str, int]:
        before = self.table(name)
        found = dml.counts(before, "deleted", where)
        self.save(name, dml.delete(before, where))
        return found

    def merge(self, name: str, merge: dml.Merge) -> None:
        if merge.many_matches():
            raise ValueError("a row of the target has several rows of the source")
        self.save(name, merge.result())

    def describe(self, name: str) -> DataFrame:
        return described(self.table(name))

    def namespaces(self) -> DataFrame:
        """database_name and schema_name of all schemas."""
        rows = self.spark.sql("SHOW NAMESPACES").where(F.contains("namespace", F.lit("__"))).select(F.split("namespace", "__").alias("x"))
        return rows.select(F.upper(F.col("x")[0]).alias("database_name"), F.upper(F.col("x")[1]).alias("schema_name"))

    def databases(self) -> DataFrame:
        return self.namespaces().select(F.col("database_name").alias("name")).distinct()

    def schemas(self) -> DataFrame:
        """name and database_name of the current database's schemas."""
        here = self.namespaces().where(F.col("database_name") == self.database.upper())
        return here.select(F.col("schema_name").alias("name"), "database_name")

    def objects(self) -> DataFrame:
        """name and kind of the current schema's tables and views."""
        return self.tables().union(self.views())

    def tables(self) -> DataFrame:
        """name and kind of what stands in the current schema."""
        try:
            found = self.spark.sql(f"SHOW TABLES IN `{self.database}__{self.schema}`").where("not isTemporary")
        except AnalysisException:
            found = self.spark.createDataFrame([], "tableName string")
        return found.select(F.col("tableName").alias("name"), F.lit("TABLE").alias("kind"))

    def views(self) -> DataFrame:
        """name and kind of the current schema's views."""
        here = f"`{self.database}__{self.schema}`."
        return self.spark.createDataFrame([(v.removeprefix(here).strip("`"), "VIEW") for v in self.viewed if v.startswith(here)], "name string, kind string")

    def columns(self) -> DataFrame:
        """table_name, column_name, ordinal_position, data_type and is_nullable of the current schema's tables and views."""
        names = [r.name for r in self.objects().collect()]
        rows = [(n, f.name, k, type_name(f.dataType), "YES" if f.nullable else "NO") for n in names for k, f in enumerate(self.table(n).schema, 1)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")

    def context(self) -> DataFrame:
        """What CURRENT_DATABASE() and its like give."""
        values = {"current_database": self.database, "current_schema": self.schema, "current_role": self.role, "current_warehouse": self.warehouse}
        return self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
