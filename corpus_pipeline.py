"""A corpus pipeline: from raw documents to packed sequences of token ids. Part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents. Rows with null or empty texts pass through every filter that has nothing against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import minhash, packing, quality, secrets, substring
from tidewater.llm._common import stored, table
from tidewater.llm.tokens import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs.select(*COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (five words, similarity 0.8): that with the least id, a null id last.

    Rows are compared by a number of their own, so repeated and null ids are documents like others.
    """
    rows = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")), "numbered")
    found = minhash.near_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text"), minhash.Setting(words=5))
    order = rows.select("row_key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*COLUMNS).alias("content"), "row_key").alias("place"))
    groups = found.select(F.col("doc_id").alias("row_key"), "component_id").join(order.hint("merge"), "row_key")
    kept = groups.groupBy("component_id").agg(F.min("place").alias("place")).select("place.row_key")
    return rows.join(kept.hint("merge"), "row_key", "left_semi").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words that documents with smaller ids have; other texts stay as they are."""
    found = substring.deduplicate(docs, keep=COLUMNS[1:])
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark."""
    ledger = secrets.Ledger(spark)
    ledger.update(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))
    found = ledger.known().where(F.size("findings") > 0)
    rows = docs.select(*COLUMNS).withColumn("blob_id", F.sha2(F.coalesce("text", F.lit("")), 256)).join(found, "blob_id", "left")
    text = F.when(F.col("findings").isNotNull(), secrets.redact(F.col("text"), F.col("findings"))).otherwise(F.col("text"))
    out = rows.select("doc_id", text.alias("text"), "lang", "source", "n_chars", F.col("findings").isNotNull().alias("hit"))
    return out.withColumn("n_chars", F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("hit")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 ids along a Hilbert curve."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=1, length=2048)


STAGES = [
    ("quality classifier", keep_good_texts),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, so the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; what each stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
