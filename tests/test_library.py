"""Sessions, DML, stages and channels, beyond what the oracle's queries show."""

from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tidewater.functions import aggregates
from tidewater.functions import dialect as d
from tidewater.operators import dml, relational
from tidewater.operators.session import Session
from tidewater.sources import stages
from tidewater.streaming import channels


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.fixture(scope="module")
def session(spark):
    return Session(spark, "tests")


def test_statements_and_counts(spark, session):
    assert session.save("t", spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id int, v int")) == "Table T successfully created."
    assert session.insert("t", spark.createDataFrame([(4, 40)], "id int, v int")) == {"number of rows inserted": 1}
    assert session.update("t", {"v": F.col("v") + 1}, F.col("v") > 20) == {"number of rows updated": 2, "number of multi-joined rows updated": 0}
    assert session.delete("t", F.col("id") == 1) == {"number of rows deleted": 1}
    assert sorted(map(tuple, session.table("TESTS.public.t").collect())) == [(2, None), (3, 31), (4, 41)]
    source = spark.createDataFrame([(2, 20), (9, 90)], "id int, v int")
    merge = dml.Merge(session.table("t"), source, F.col("t.id") == F.col("s.id"))
    session.merge("t", merge.when_matched_update({"v": F.col("s.v")}).when_not_matched_insert({"id": F.col("s.id"), "v": F.col("s.v")}))
    assert sorted(map(tuple, session.table("t").collect())) == [(2, 20), (3, 31), (4, 41), (9, 90)]
    twice = dml.Merge(session.table("t"), source.union(source), F.col("t.id") == F.col("s.id")).when_matched_delete()
    with pytest.raises(ValueError):
        session.merge("t", twice)
    session.truncate("t")
    assert session.table("t").count() == 0


def test_metadata(spark, session):
    session.save("kinds", spark.createDataFrame([], "id int, name string, amount decimal(10,2), at timestamp_ntz, ok boolean"))
    assert [(r.name, r.type) for r in session.describe("kinds").collect()] == [("id", "NUMBER(38,0)"), ("name", "VARCHAR(16777216)"), ("amount", "NUMBER(10,2)"), ("at", "TIMESTAMP_NTZ(9)"), ("ok", "BOOLEAN")]
    assert "kinds" in [r.name for r in session.tables().collect()]
    session.use_schema("extra")
    assert session.context().first().current_schema == "EXTRA"
    assert "TESTS" in [r.name for r in session.databases().collect()]
    assert session.tables().count() == 0
    session.use_schema("public")
    session.drop("kinds")
    assert "kinds" not in [r.name for r in session.tables().collect()]


def test_variables(spark, session):
    session.set("limit", 3)
    assert spark.range(9).where(F.col("id") < session.variable("LIMIT")).count() == 3
    session.unset("Limit")
    with pytest.raises(KeyError, match="Undefined session variable: \\$LIMIT"):
        session.variable("limit")


def test_seeds_and_batches(spark):
    assert stages.seed(spark, pd.DataFrame({"a": [1, 2], "b": ["x", None]})).count() == 2
    with pytest.raises(ValueError):
        stages.seed(spark, [])
    assert [len(b) for b in stages.batches(spark.range(25), 10)] == [10, 10, 5]
    mixed = spark.createDataFrame([(k, [f"x{k}", None]) for k in range(25)], "id long, xs array<string>")
    frames, records = list(stages.pandas_batches(mixed, 10)), list(stages.arrow_batches(mixed, 10))
    assert [len(f) for f in frames] == [10, 10, 5] == [r.num_rows for r in records] and list(frames[0].columns) == ["id", "xs"]
    assert sorted(x for r in records for x in r.column("id").to_pylist()) == list(range(25)) and records[0].column("xs").to_pylist()[0][1] is None
    assert list(stages.pandas_batches(mixed.limit(0))) == [] == list(stages.arrow_batches(mixed.limit(0)))
    assert stages.arrow_text(spark.range(3))


def test_channels_fence_stale_writers(spark):
    schema = spark.createDataFrame([], "id long, name string").schema
    pipe = channels.Pipe(spark, stages.scratch(spark, "pipe"), schema)
    old = pipe.open("c")
    pipe.append(old, [{"id": 1, "name": "a", "more": 5}, {"id": 2}], "o1")
    new = pipe.open("c")
    with pytest.raises(channels.StaleToken):
        pipe.append(old, [{"id": 3}], "o2")
    pipe.append(new, [{"id": 1, "name": "a"}, {"id": 2}], "o1")
    pipe.append(new, [{"id": 4}], "o2")
    assert sorted(map(tuple, pipe.drain().collect())) == [(1, "a"), (2, None), (4, None)]
    pipe.append(new, [{"id": 5}], "o3")
    assert pipe.drain().count() == 4
    assert pipe.status("c", "none")["c"].offset == "o3"
    again = channels.Pipe(spark, pipe.folder, schema)  # another driver: what the log says holds for it too
    with pytest.raises(channels.StaleToken):
        again.append(old, spark.createDataFrame([(6, "x")], schema), "o4")
    later = again.open("c")
    with pytest.raises(channels.StaleToken):
        pipe.append(new, [{"id": 7}], "o5")
    again.append(later, spark.createDataFrame([(8, "y", 1)], "id long, name string, more int"), "o6")
    again.append(later, spark.range(1).select("id"))
    with pytest.raises(Exception):
        again.append(later, spark.range(3).select(F.raise_error("no").alias("name")), "o7")
    with pytest.raises(channels.StaleToken):
        again.append("nobody:1", [{"id": 9}])
    assert sorted(map(tuple, again.drain().collect())) == [(0, None), (1, "a"), (2, None), (4, None), (5, None), (8, "y")]
    found = again.status("c")["c"]
    assert (found.sequencer, found.rows, found.appends, found.errors, found.offset) == (3, 6, 5, 1, "o6") and "no" in found.last_error
    pipe.drop("c")
    assert pipe.status("c") == {} and pipe.channels().count() == 0
    with pytest.raises(KeyError):
        pipe.drop("c")


def test_fixed_expectations(spark):
    """Values that the dialect documents."""
    one = spark.range(1)
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    checks = [
        (d.datediff("hour", ts("2024-01-15 00:59:00"), ts("2024-01-15 01:01:00")), 1),
        (d.datediff("month", ts("2024-01-31"), ts("2024-02-01")), 1),
        (d.datediff("year", ts("2023-12-31"), ts("2024-01-01")), 1),
        (d.datediff("week", ts("2024-01-01"), ts("2024-01-14")), 1),
        (d.dayofweek(F.lit("2024-01-15").cast("date")), 1),
        (d.trunc(F.lit(-3.567), 1), -3.5),
        (d.array_slice(F.array(*map(F.lit, range(1, 6))), 1, 3), [2, 3, 4]),
        (d.array_position(3, F.array(F.lit(1), F.lit(2), F.lit(3))), 2),
        (d.decode(F.lit(None).cast("int"), None, "none", "other"), "none"),
        (d.object_insert(F.lit('{"a":1}'), "b", F.lit(2)), '{"a":1,"b":2}'),
        (d.split_part(F.lit("a,b"), ",", 0), ""),
        (d.regexp_replace(F.lit("a1b2"), "[0-9]", "X"), "aXb2"),
        (d.mod(F.lit(-1), F.lit(0)), None),
        (d.time_slice(ts("2024-02-29 10:17:00"), 1, "week").cast("string"), "2024-02-26 00:00:00"),
    ]
    row = one.select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(checks)]).first()
    assert list(row) == [v for _, v in checks]


def test_numbers_without_gaps(spark):
    rows = relational.numbered(spark.range(0, 1000, 1, 7).where("id % 3 = 0"), "n").collect()
    assert sorted(r.n for r in rows) == list(range(len(rows)))


def test_the_rest_imports_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['tidewater.llm'] = None; import __spark_entry__ as e; assert e.queries() and 'pipeline' not in e.queries(); e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=contract.__file__.rpartition("/")[0]).returncode == 0


def test_merge_fails_where_a_target_row_has_several_source_rows(spark):
    target = spark.createDataFrame([(1, 10), (2, 20)], "id int, v int")
    source = spark.createDataFrame([(2, 21), (9, 90), (9, 91)], "id int, v int")

    def merged(rows):
        merge = dml.Merge(target, rows, F.col("t.id") == F.col("s.id")).when_matched_update({"v": F.col("s.v")})
        return merge.when_not_matched_insert({"id": F.col("s.id"), "v": F.col("s.v")}).result()

    assert sorted(map(tuple, merged(source).collect())) == [(1, 10), (2, 21), (9, 90), (9, 91)]
    for run in (lambda df: df.collect(), lambda df: df.count()):
        with pytest.raises(Exception, match="several rows of the source"):
            run(merged(source.union(source)))


def test_late_rows_of_a_stream_are_left_out(spark, tmp_path):
    kind = "ts timestamp, value double"
    for k, hours in enumerate(([0, 9], [8, 1], [14])):  # 01:00 comes when the watermark is past its window
        rows = [(f"2024-01-01 {h:02}:10:00", 1.0) for h in hours]
        spark.createDataFrame(rows, "ts string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "value").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        events = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        counts = channels.windowed_counts(events, "ts", "2 hours", value="value", late="2 hours", slide="1 hour")
        got = channels.run_to_table(counts, f"{tmp_path}/out", mode="append")
    starts = {r.start.hour: r.n for r in got.where("start >= '2024-01-01'").collect()}
    assert starts == {0: 1, 7: 1, 8: 2, 9: 1}


def test_ranges_of_any_width(spark):
    ranges = [(0, -5.0, 5.0), (1, 0.0, 100_000.0), (2, 3.0, 3.0), (3, 7.5, 8.0), (4, 9.0, 2.0), (5, -1e6, 1e6), (6, None, 4.0)]
    points = [(k, k * 0.75 - 20) for k in range(200)] + [(900, 99_999.9), (901, -1e6), (902, None)]
    got = relational.range_join(spark.createDataFrame(points, "p int, at double"), "at", spark.createDataFrame(ranges, "r int, low double, high double"), "low", "high", 1.0)
    want = {(p, r) for p, at in points for r, low, high in ranges if at is not None and low is not None and low <= at < high}
    rows = [(x.p, x.r) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert relational.range_join(spark.createDataFrame(points, "p int, at double"), "at", spark.createDataFrame([], "r int, low double, high double"), "low", "high", 1.0).count() == 0


def test_exact_numbers_and_repeated_keys(spark):
    big = spark.createDataFrame([(9007199254740993, Decimal("12345678901234567.89"), -2.75)], "i long, d decimal(20,2), x double")
    row = big.select(d.trunc("i"), d.trunc("i", -3), d.trunc("d").cast("decimal(20,0)"), d.trunc("x"), d.trunc("x", 1)).first()
    assert tuple(row) == (9007199254740993, 9007199254740000, Decimal(12345678901234567), -2.0, -2.7)
    pairs = spark.createDataFrame([(1, "a", 1), (1, "a", 3), (1, None, 4), (1, "b", None), (2, None, None)], "g int, k string, v int")
    assert {r.g: r.o for r in aggregates.object_agg(pairs, ["g"], F.col("k"), F.col("v"), "o").collect()} == {1: '{"a":3}', 2: "{}"}


def test_a_missing_module_is_not_taken_for_a_missing_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['tokenizers'] = sys.modules['ahocorasick'] = None; import __spark_entry__"
    assert b"ahocorasick" in subprocess.run([sys.executable, "-c", code], cwd=contract.__file__.rpartition("/")[0], capture_output=True).stderr or not contract.corpus_pipeline


def test_sample_is_about_a_tenth(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    got = contract.queries()["rel_15_sample"](spark, sf)
    assert 0.05 < got.count() / orders.count() < 0.15 and got.join(orders, "o_orderkey", "left_anti").isEmpty()


def test_write_pandas_and_listings(spark):
    s = Session(spark, "frames")
    s.save("t", spark.createDataFrame([], "id long, name string"))
    assert s.write_pandas("t", pd.DataFrame({"x": [1, 2, 3], "y": ["a", None, "c"]})) == (True, 1, 3, [])
    assert s.write_pandas("t", pd.DataFrame({"x": [], "y": []})) == (True, 1, 0, [])
    assert sorted(map(tuple, s.table("t").collect())) == [(1, "a"), (2, None), (3, "c")]
    s.create_schema("more")
    assert sorted(r.name for r in s.schemas().collect()) == ["MORE", "PUBLIC"]
    assert [tuple(r) for r in s.objects().collect()] == [("t", "TABLE")]
