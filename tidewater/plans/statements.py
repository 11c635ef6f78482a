"""Queries of statements, sources and streams, each with the SQL of the oracle."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import dialect
from ..operators import dml, session
from ..sources import stages
from ..streaming import channels

FOUND: dict[str, tuple] = {}


def query(sql: str | None = None):
    def register(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return register


@query("SELECT * FROM region UNION ALL SELECT n_nationkey + 100, NULL FROM nation")
def dml_01_insert(t, *_):
    return dml.insert(t("region"), t("nation").select((F.col("n_nationkey") + 100).alias("r_regionkey")))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'POOR' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_02_update(t, *_):
    return dml.update(t("customer"), {"c_mktsegment": F.lit("POOR"), "c_acctbal": F.lit(0)}, F.col("c_acctbal") < 0).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) > 10, false)")
def dml_03_delete(t, *_):
    return dml.delete(t("customer"), F.nullif("c_nationkey", F.lit(3)) > 10).select("c_custkey")


@query("SELECT coalesce(c.c_custkey, o.k) AS c_custkey, CASE WHEN c.c_custkey IS NULL THEN -1 WHEN o.k IS NOT NULL THEN o.n ELSE c.c_nationkey END AS c_nationkey FROM customer c FULL JOIN (SELECT o_custkey * 2 AS k, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.k WHERE NOT (c.c_custkey IS NOT NULL AND o.k IS NOT NULL AND o.n > 15)")
def dml_04_merge(t, *_):
    source = t("orders").groupBy((F.col("o_custkey") * 2).alias("k")).agg(F.count("*").cast("int").alias("n"))
    merge = dml.Merge(t("customer"), source, F.col("t.c_custkey") == F.col("s.k"))
    merge.when_matched_delete(F.col("s.n") > 15).when_matched_update({"c_nationkey": F.col("s.n")})
    merge.when_not_matched_insert({"c_custkey": F.col("s.k"), "c_nationkey": F.lit(-1)})
    return merge.result().select("c_custkey", "c_nationkey")


@query("SELECT n_nationkey, n_name FROM nation")
def dml_05_insert_overwrite(t, spark, _):
    path = stages.scratch(spark, "overwrite")
    t("region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")).write.parquet(path)
    t("nation").select("n_nationkey", "n_name").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def src_11_12_put_copy(t, spark, _):
    path = stages.scratch(spark, "stage")
    rows = t("customer").select("c_custkey", "c_name", "c_nationkey")
    rows.write.csv(f"{path}/from", header=True)
    stages.put(spark, f"{path}/from/part-*.csv", f"{path}/stage")
    return stages.read_stage(spark, f"{path}/stage", rows.schema, "csv", header="true")


@query("SELECT * FROM (VALUES (1, 'Alice', 1.5), (2, NULL, NULL)) AS v(id, name, score)")
def src_14_seed(_, spark, __):
    return stages.seed(spark, [{"id": 1, "name": "Alice", "score": 1.5}, {"id": 2, "name": None, "score": float("nan")}]).withColumn("score", F.nanvl("score", F.lit(None)))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def src_15_ndjson(t, spark, _):
    path = stages.scratch(spark, "ndjson")
    rows = t("orders").select("o_orderkey", "o_orderstatus")
    rows.write.json(path)
    return stages.read_stage(spark, path, rows.schema, "json")


@query("SELECT event_id, user_id, event_type FROM events")
def strm_02_append_rows(t, spark, _):
    """All events, appended by two channels; one batch is sent twice and counts once, a stale writer lands nothing."""
    rows = t("events").select("event_id", "user_id", "event_type")
    pipe = channels.Pipe(spark, stages.scratch(spark, "pipe"), rows.schema)
    clicks = F.coalesce(F.col("event_type") == "click", F.lit(False))
    stale, token, other = pipe.open("c1"), pipe.open("c1"), pipe.open("c2")
    try:
        pipe.append(stale, rows, "o0")
    except channels.StaleToken:
        pipe.append(token, rows.where(clicks), "o1")
    pipe.append(token, rows.where(clicks), "o1")
    pipe.drain()
    pipe.append(other, rows.where(~clicks), "o1")
    return pipe.drain()


@query("SELECT * FROM (SELECT 'c1' AS channel, 2 AS sequencer, 'o2' AS offset, 2 AS appends, count(*) AS rows FROM events UNION ALL SELECT 'c2', 1, 'begin', 0, 0)")
def strm_01_03_04_05_channels(t, spark, _):
    """The state of channels after opening twice, appending under offset tokens, and dropping one."""
    rows = t("events").select("event_id", "event_type")
    pipe = channels.Pipe(spark, stages.scratch(spark, "pipe"), rows.schema)
    pipe.open("c1")
    token = pipe.open("c1")
    pipe.open("c2", "begin")
    pipe.open("c3")
    pipe.drop("c3")
    clicks = F.coalesce(F.col("event_type") == "click", F.lit(False))
    pipe.append(token, rows.where(clicks), "o1")
    pipe.append(token, rows.where(~clicks), "o2")
    return pipe.channels().select("channel", "sequencer", "offset", F.col("appends").cast("int").alias("appends"), "rows")


@query("SELECT start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,6))) AS total FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS start, event_type, value FROM events, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2)) GROUP BY ALL")
def strm_09_sliding(t, spark, sf_dir):
    """Windows of three hours, every hour, over a stream."""
    events = spark.readStream.schema(t("events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = channels.windowed_counts(events, "ts", "3 hours", "event_type", value="value", slide="1 hour")
    return channels.run_to_table(counts, stages.scratch(spark, "windows")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,6))) AS total FROM events GROUP BY ALL")
def strm_09_tumbling(t, spark, sf_dir):
    events = spark.readStream.schema(t("events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = channels.windowed_counts(events, "ts", "1 hour", "event_type", value="value")
    return channels.run_to_table(counts, stages.scratch(spark, "windows")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def strm_09_sessions(t, *_):
    sessions = t("events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return sessions.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT * FROM (VALUES ('o_orderkey', 'NUMBER(38,0)', 'Y'), ('o_custkey', 'NUMBER(38,0)', 'Y'), ('o_orderstatus', 'VARCHAR(16777216)', 'Y'), ('o_totalprice', 'FLOAT', 'Y'), ('o_orderdate', 'TIMESTAMP_NTZ(9)', 'Y'), ('o_orderpriority', 'VARCHAR(16777216)', 'Y')) AS v(name, type, nullable)")
def ddl_14_describe(t, *_):
    return session.described(t("orders")).select("name", "type", F.col("`null?`").alias("nullable"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT'")
def ddl_12_variables(t, *_):
    values = session.Variables()
    values.set("limit", 100_000)
    values.set("priority", "1-URGENT")
    return t("orders").where((F.col("o_totalprice") > values.variable("LIMIT")) & (F.col("o_orderpriority") == values.variable("priority"))).select("o_orderkey")


def _session(spark) -> session.Session:
    """A database of its own, so that queries of one catalogue don't meet."""
    return session.Session(spark, f"Q{uuid.uuid4().hex}")


@query("SELECT n_nationkey, upper(n_name) AS n_name, CAST(NULL AS INTEGER) AS n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, upper(r_name), r_regionkey FROM region")
def ddl_01_09_tables(t, spark, _):
    """Databases, schemas, CREATE [OR REPLACE] TABLE AS, TRUNCATE, ADD and DROP COLUMN, and a view of the result."""
    s = _session(spark)
    s.use_schema("work")
    s.save("n", t("region"))
    s.truncate("n")
    s.save("n", t("nation").select("n_nationkey", "n_name"))
    s.add_column("n", "more", "string")
    s.drop_column("n", "more")
    s.add_column("n", "n_regionkey", "int")
    s.insert("work.n", t("region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey")))
    s.save("gone", t("region"))
    s.drop("gone")
    s.view("v", s.table("n").withColumn("n_name", F.upper("n_name")))
    return s.table("work.v")


@query("SELECT * FROM (VALUES ('n', 'n_nationkey', 1, 'NUMBER(38,0)'), ('n', 'n_name', 2, 'VARCHAR(16777216)'), ('v', 'r_name', 1, 'VARCHAR(16777216)')) AS v(table_name, column_name, ordinal_position, data_type)")
def ddl_18_columns(t, spark, _):
    s = _session(spark)
    s.save("n", t("nation").select("n_nationkey", "n_name"))
    s.view("v", t("region").select("r_name"))
    return s.columns().select("table_name", "column_name", "ordinal_position", "data_type")


@query("SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN -1 WHEN k IS NOT NULL THEN n ELSE bal END AS c_acctbal FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS bal FROM customer WHERE NOT c_mktsegment = 'BUILDING') c FULL JOIN (SELECT o_custkey * 2 AS k, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = k")
def dml_02_04_stored(t, spark, _):
    """UPDATE, DELETE and MERGE of a stored table."""
    s = _session(spark)
    s.save("c", t("customer").select("c_custkey", "c_mktsegment", "c_acctbal"))
    s.update("c", {"c_acctbal": F.lit(0)}, F.col("c_acctbal") < 0)
    s.delete("c", F.col("c_mktsegment") == "BUILDING")
    source = t("orders").groupBy((F.col("o_custkey") * 2).alias("k")).agg(F.count("*").alias("n"))
    merge = dml.Merge(s.table("c"), source, F.col("t.c_custkey") == F.col("s.k")).when_matched_update({"c_acctbal": F.col("s.n")})
    s.merge("c", merge.when_not_matched_insert({"c_custkey": F.col("s.k"), "c_acctbal": F.lit(-1)}))
    return s.table("c").select("c_custkey", "c_acctbal")


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name FROM supplier UNION ALL SELECT * FROM (VALUES (-1, 'x'), (-2, NULL)) AS v(id, name)")
def src_13_write_pandas(t, spark, _):
    """Rows of a pandas frame go into a stored table by place."""
    s = _session(spark)
    s.save("sup", t("supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name")))
    s.write_pandas("sup", pd.DataFrame({"a": [-1, -2], "b": ["x", None]}))
    return s.table("sup")


@query("SELECT * FROM (VALUES ('SCHEMA', 'PUBLIC'), ('SCHEMA', 'WORK'), ('TABLE', 'n'), ('VIEW', 'v')) AS x(kind, name)")
def ddl_15_18_show(t, spark, _):
    """Schemas of the current database, and what stands in the current schema."""
    s = _session(spark)
    s.use_schema("work")
    s.save("n", t("nation"))
    s.view("v", t("region"))
    return s.schemas().select(F.lit("SCHEMA").alias("kind"), "name").union(s.objects().select("kind", "name"))


@query("SELECT r_regionkey, 'SALES' AS current_database, 'EU' AS current_schema, 'SYSADMIN' AS current_role, 'DEFAULT_WAREHOUSE' AS current_warehouse FROM region")
def sys_01_context(t, spark, _):
    """What a session stands in, beside the rows of a table."""
    return t("region").select("r_regionkey").crossJoin(session.Session(spark, "sales", "eu").context())


@query("SELECT p_partkey, CAST(make_time(p_size % 24, p_size, 59) AS VARCHAR) AS clock FROM part")
def dt_15_time_from_parts(t, spark, _):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    return t("part").select("p_partkey", dialect.time_from_parts(F.col("p_size") % 24, "p_size", F.lit(59).cast("decimal(16,6)")).cast("string").alias("clock"))


@query()
def str_17_soundex(t, *_):
    return t("part").select("p_partkey", F.soundex("p_name").alias("code"))


@query()
def num_13_14_random(t, *_):
    return t("part").select("p_partkey", dialect.uniform(1, 6, 42).alias("dice"), F.rand(7).alias("share"))


@query()
def hash_04_hash(t, *_):
    return t("part").select("p_partkey", F.xxhash64("p_name", "p_size").alias("h"))


@query()
def sys_01_03_context(t, *_):
    return t("region").select("r_regionkey", F.current_user().alias("user"), F.current_schema().alias("schema"), F.uuid().alias("id"), F.current_timestamp().alias("now"))


def queries() -> dict:
    def make(f):
        def run(spark, sf_dir):
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark, sf_dir)

        return run

    return {name: make(f) for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
