"""Stages (folders of files), seeds and row sinks."""

from __future__ import annotations

import base64
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a local one in local mode if none is set, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def put(spark: SparkSession, source: str, stage: str, kind: str = "text") -> int:
    """Copies the files that a path or pattern names into a stage folder, in tasks and in any store that Spark reads;
    returns how many. Files of text stay whole, each in a folder of its own; other kinds (parquet, orc) keep their rows."""
    if kind != "text":
        files = spark.read.format(kind).load(source)
        files.write.mode("append").format(kind).save(stage)
        return len(files.inputFiles())
    files = spark.read.text(source, wholetext=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    whole = files.select(F.regexp_replace("value", r"\n\z", "").alias("value"), "file")  # the writer ends a file with a line end
    whole.write.mode("append").partitionBy("file").text(stage)
    return len(files.inputFiles())


def read_stage(spark: SparkSession, stage: str, schema: T.StructType, kind: str = "csv", **options: str) -> DataFrame:
    """The rows of a stage's files (csv, json, parquet or orc) under a schema."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").options(**options).format(kind).load(stage)


def seed(spark: SparkSession, data: pd.DataFrame | dict | list[dict]) -> DataFrame:
    """A DataFrame of a few literal rows; NaN and NaT are null. No rows are a ValueError."""
    frame = data if isinstance(data, pd.DataFrame) else pd.DataFrame(data)
    if frame.empty:
        raise ValueError("nothing to seed")
    table = pa.Table.from_pandas(frame, preserve_index=False)
    return spark.createDataFrame(table)


def batches(df: DataFrame, size: int = 10_000) -> Iterator[list]:
    """Rows in lists of `size`, a partition at a time in the driver."""
    rows: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        rows.append(row)
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


def pandas_batches(df: DataFrame, size: int = 10_000) -> Iterator[pd.DataFrame]:
    """The same as frames; no rows give no frame."""
    for rows in batches(df, size):
        yield pd.DataFrame([tuple(r) for r in rows], columns=df.columns)


def arrow_batches(df: DataFrame, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The same as record batches under the schema of df."""
    schema = to_arrow_schema(df.schema)
    for rows in batches(df, size):
        yield pa.RecordBatch.from_pylist([r.asDict(recursive=True) for r in rows], schema)


def arrow_text(df: DataFrame) -> str:
    """A small result as an Arrow stream in base64."""
    table, out = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return base64.b64encode(out.getvalue().to_pybytes()).decode()
