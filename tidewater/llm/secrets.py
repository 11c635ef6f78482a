"""Secret scans: a ledger of content-addressed blobs, each scanned once for each version of the rules. DataFrame functions only."""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import scratch, stored


@dataclass(frozen=True)
class Rule:
    """A pattern of Java's regular expressions; a match counts if the given group has `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int


#: The three base rules. Runs of one class may name their least length, since a run that is too short holds no longer one.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
LEDGER = T.StructType([T.StructField(n, T.StringType()) for n in ("blob_id", "rules_version")] + [T.StructField("findings", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("to", T.LongType()), T.StructField("kind", T.StringType())])))])


def no_findings() -> Column:
    return F.array().cast(LEDGER["findings"].dataType)


def _lengths(strings: Column) -> Column:
    return F.transform(strings, lambda x: F.length(x).cast("long"))


def _matches(content: Column, rule: Rule, rank: int) -> Column:
    """What stands between a rule's matches, and the matches themselves, as lengths in characters."""
    found = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(rule.group))
    both = F.arrays_zip(
        _lengths(F.slice(F.split(content, rule.pattern, -1), F.lit(1), F.size(found))).alias("gap"),
        _lengths(found).alias("size"),
        _lengths(tested).alias("tested"),
    )
    return F.when(content.rlike(rule.pattern), F.struct(F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), both.alias("matches")))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob_id and findings, sorted by place, of the blobs that have any.

    Matches of a rule are those of a search from left to right; a match's place is the sum of all lengths before it.
    """
    each = blobs.select("blob_id", F.explode(F.array(*(_matches(F.col("content"), r, k) for k, r in enumerate(rules)))).alias("r")).where("r is not null")
    rows = each.select("blob_id", "r.rank", "r.kind", "r.least", F.posexplode("r.matches").alias("at", "m"))
    before = Window.partitionBy("blob_id", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("to", F.sum(F.col("m.gap") + F.col("m.size")).over(before)).where("m.tested >= least")
    span = F.struct((F.col("to") - F.col("m.size")).alias("from"), "rank", "to", "kind")
    return placed.groupBy("blob_id").agg(F.sort_array(F.collect_list(span)).alias("findings"))


def version_of(rules: tuple[Rule, ...]) -> str:
    """A digest of the rules, so that changed rules are another version."""
    return hashlib.sha256(repr([astuple(r) for r in rules]).encode()).hexdigest()[:16]


def _blob_id() -> Column:
    return F.sha2(F.coalesce("content", F.lit("")), 256)


class Ledger:
    """A table in the shared folder: the findings of each blob under each version of the rules, written once.

    versions, wherever they are asked for, has a path and its content at some time; a null content is an empty one and
    a null path is one like others. One content under many paths or at many times is one blob and is scanned once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = BASE_RULES) -> None:
        self.spark, self.path, self.rules, self.version = spark, path or scratch(spark, "ledger"), rules, version_of(rules)
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        """blob_id, rules_version and findings of all blobs and versions."""
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def known(self) -> DataFrame:
        """blob_id and findings under these rules. Two writers at a time may both have scanned a blob; their rows are equal."""
        return self.rows().where(F.col("rules_version") == self.version).select("blob_id", "findings")

    def unseen(self, versions: DataFrame) -> DataFrame:
        """blob_id and content of the blobs that the ledger lacks under these rules, each once."""
        blobs = versions.select(_blob_id().alias("blob_id"), F.coalesce("content", F.lit("")).alias("content"))
        return blobs.dropDuplicates(["blob_id"]).join(self.known().select("blob_id"), "blob_id", "left_anti")

    def update(self, versions: DataFrame) -> None:
        """Scans what is unseen and appends it; a blob without findings gets an empty list."""
        new = stored(self.unseen(versions), "unseen")
        found = scan(new, self.rules)
        rows = new.select("blob_id").join(found, "blob_id", "left")
        rows.select("blob_id", F.lit(self.version).alias("rules_version"), F.coalesce("findings", no_findings()).alias("findings")).write.mode("append").parquet(self.path)

    def by_path(self, versions: DataFrame) -> DataFrame:
        """Every row of versions with the findings of its blob; both sides are read from tables, so that Spark can split
        the paths of a very common blob."""
        paths = versions.select("path", _blob_id().alias("blob_id"))
        known = stored(self.known().dropDuplicates(["blob_id"]), "known")
        return paths.join(known, "blob_id", "left").select("path", "blob_id", F.coalesce("findings", no_findings()).alias("findings"))


def as_text(findings: Column) -> Column:
    """kind:start:end of all findings, joined by commas."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["from"], x["to"])), ",")


def count_kind(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda x: x["kind"] == kind)).cast("long")


def redact(content: Column, findings: Column, mark: str = "[secret]") -> Column:
    """The content with every finding replaced by the mark; findings that overlap are replaced as one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        inside = x["from"] < state["at"]
        part = F.substring(content, (state["at"] + 1).cast("int"), F.greatest(x["from"] - state["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(state["at"], x["to"]).alias("at"), F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(part, F.lit(mark)))).alias("kept"))

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["kept"], ""), F.substring(content, (state["at"] + 1).cast("int"), F.length(content)))

    return F.when(F.size(findings) > 0, F.aggregate(findings, start, step, finish)).otherwise(content)
