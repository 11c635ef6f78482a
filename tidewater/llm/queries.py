"""One query for each operator, over its whole table, as __spark_entry__ registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowfile, bpe, embeddings, media, minhash, oracle, packing, quality, secrets, substring, toxicity
from ._common import table
from .tokens import vocabulary


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_texts(table(spark, sf_dir, "documents")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predicted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.deduplicate(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Setting(words=2))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predicted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_arrow_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = arrowfile.write(table(spark, sf_dir, "documents"), arrowfile.folder(spark), vocabulary("byte_bpe_50k.json"), end_id=2)
    return arrowfile.digests(notes)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1, length=2048)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions come in two batches, dealt by a hash of their path; the second scans only what the first has not seen."""
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    ledger = secrets.Ledger(spark)
    for batch in range(2):
        ledger.update(versions.where(F.pmod(F.xxhash64("path"), F.lit(2)) == batch))
    found = ledger.by_path(versions)
    text = secrets.as_text(F.col("findings"))
    counts = [secrets.count_kind(F.col("findings"), r.kind).alias(f"n_{r.kind}") for r in secrets.BASE_RULES]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_media, op2_bpe, op3_toxicity, op4_substring, op5_embeddings, op6_minhash, op7_quality, op8_arrow_file, op9_packing, op10_secrets)}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring": oracle.substring(), "op5_embeddings": oracle.embeddings(), "op6_minhash": oracle.minhash(), "op10_secrets": oracle.secrets()}
