"""Queries of relational operators, each with the SQL of the oracle."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import dialect as d
from ..operators import relational as rel

FOUND: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Registers a function of (t, spark, sf_dir), where t(name) reads a table."""

    def register(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return register


def dec(x: Column) -> Column:
    """Exact sums need exact terms."""
    return x.cast("decimal(18,4)")


def _net() -> Column:
    return F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))


# --- scans, projection, filters ---


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_01_scan_join(t, *_):
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(id, name)")
def src_02_values(_, spark, __):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, name string")


@query("SELECT 1 AS one, 'x' AS two")
def src_03_no_from(_, spark, __):
    return spark.range(1).select(F.lit(1).alias("one"), F.lit("x").alias("two"))


@query("SELECT i AS n, i - 1 AS seq FROM generate_series(1, 1000) AS g(i)")
def src_04_05_generator_seq(_, spark, __):
    return rel.numbered(rel.generator(spark, 1000, "n"), "seq")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS value FROM part")
def src_08_flatten(t, *_):
    return rel.flatten(t("part").withColumn("words", d.split("p_name", " ")), "words").select("p_partkey", "value")


@query("SELECT p_partkey, i - 1 AS at, string_split(p_name, ' ')[i] AS value FROM part, generate_series(1, 20) AS g(i) WHERE i <= len(string_split(p_name, ' '))")
def src_09_lateral_flatten(t, *_):
    return rel.flatten(t("part").withColumn("words", d.split("p_name", " ")), "words", "value", "at").select("p_partkey", "at", "value")


@query("SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS net FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'N') AND l_tax IS NOT NULL")
def rel_01_02_project_filter(t, *_):
    rows = t("lineitem").where((F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "N") & F.col("l_tax").isNotNull())
    return rows.select("l_orderkey", "l_linenumber", _net().alias("net"))


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%a%1' OR p_name ILIKE 'B%' OR regexp_matches(p_name, '7[0-9]')")
def rel_03_04_like(t, *_):
    name = F.col("p_name")
    return t("part").where(name.like("%a%1") | name.ilike("B%") | name.rlike("7[0-9]")).select("p_partkey")


@query("WITH big AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS total FROM orders GROUP BY 1), best AS (SELECT max(total) AS top FROM big) SELECT o_custkey FROM big, best WHERE total > top / 2")
def rel_06_07_cte_scalar_subquery(t, *_):
    big = t("orders").groupBy("o_custkey").agg(F.sum(dec(F.col("o_totalprice"))).alias("total"))
    return big.crossJoin(F.broadcast(big.agg(F.max("total").alias("top")))).where("total > top / 2").select("o_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def rel_08_group_having(t, *_):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query("SELECT DISTINCT p_brand, p_size FROM part")
def rel_09_distinct(t, *_):
    return t("part").select("p_brand", "p_size").distinct()


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) <= 2")
def rel_10_qualify(t, *_):
    window = Window.partitionBy("o_custkey").orderBy(*rel.in_order(("o_totalprice", "desc"), "o_orderkey"))
    return rel.qualify(t("orders"), F.col("rn") <= 2, rn=F.row_number().over(window)).select("o_custkey", "o_orderkey")


@query("SELECT p_size, sum(CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END) AS small, sum(CASE WHEN p_type = 'LARGE' THEN 1 ELSE 0 END) AS large FROM part GROUP BY p_size")
def rel_15_pivot(t, *_):
    wide = t("part").groupBy("p_size").pivot("p_type", ["SMALL", "LARGE"]).count().na.fill(0)
    return wide.select("p_size", F.col("SMALL").alias("small"), F.col("LARGE").alias("large"))


@query("SELECT s_suppkey, 'a' AS k, CAST(s_nationkey AS DOUBLE) AS v FROM supplier UNION ALL SELECT s_suppkey, 'b', s_acctbal FROM supplier")
def rel_15_unpivot(t, *_):
    rows = t("supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("a"), F.col("s_acctbal").alias("b"))
    return rows.unpivot("s_suppkey", ["a", "b"], "k", "v")


def _years(table: str) -> str:
    return f"WITH RECURSIVE years(y, last) AS (SELECT min(year(o_orderdate)), max(year(o_orderdate)) FROM {table} UNION ALL SELECT y + 1, last FROM years WHERE y < last)"


@query(_years("orders") + " SELECT y, n FROM years LEFT JOIN (SELECT year(o_orderdate) AS oy, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON y = oy")
def rel_15_recursive_cte(t, spark, _):
    """Every year from the first order to the last, with the number of its large orders; only years are recursive."""
    years = spark.sql(_years("{orders}") + " SELECT y FROM years", orders=t("orders"))
    large = t("orders").where("o_totalprice > 400000").groupBy(F.year("o_orderdate").alias("oy")).agg(F.count("*").alias("n"))
    return years.join(large, F.col("y") == F.col("oy"), "left").select("y", "n")


@query("SELECT * EXCLUDE (o_totalprice, o_orderdate, o_orderpriority) FROM orders")
def rel_15_exclude(t, *_):
    return t("orders").drop("o_totalprice", "o_orderdate", "o_orderpriority")


@query()
def rel_15_sample(t, *_):
    """About a tenth of all orders; a sample has no values to compare."""
    return t("orders").sample(0.1, seed=15).select("o_orderkey")


# --- joins ---


@query("SELECT c_custkey, o_orderkey, l_linenumber FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING'")
def join_01_08_inner_many(t, *_):
    buyers = t("customer").where("c_mktsegment = 'BUILDING'")
    return buyers.join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("c_custkey", "o_orderkey", "l_linenumber")


def _outer(kind: str) -> str:
    return f"SELECT c_custkey, o_custkey, o_orderkey FROM customer {kind} JOIN orders ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'"


def _joined(t, how: str):
    """All customers and all orders; customers of another segment match nothing."""
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_mktsegment") == "BUILDING")
    return t("customer").join(t("orders"), on, how).select("c_custkey", "o_custkey", "o_orderkey")


@query(_outer("LEFT"))
def join_02_left(t, *_):
    return _joined(t, "left")


@query(_outer("RIGHT"))
def join_02_right(t, *_):
    return _joined(t, "right")


@query(_outer("FULL"))
def join_02_full(t, *_):
    return _joined(t, "full")


def _outer_whole(kind: str) -> str:
    return f"SELECT c_custkey, o_custkey, o_orderkey FROM customer {kind} JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0"


def _joined_whole(t, how: str):
    """All customers and all orders; customers in debt match nothing, so their orders stay alone."""
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_acctbal") > 0)
    return t("customer").join(t("orders"), on, how).select("c_custkey", "o_custkey", "o_orderkey")


@query(_outer_whole("LEFT"))
def join_02_whole_left(t, *_):
    return _joined_whole(t, "left")


@query(_outer_whole("RIGHT"))
def join_02_whole_right(t, *_):
    return _joined_whole(t, "right")


@query(_outer_whole("FULL"))
def join_02_whole_full(t, *_):
    return _joined_whole(t, "full")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_03_cross(t, *_):
    return t("nation").crossJoin(F.broadcast(t("region"))).select("n_name", "r_name")


@query("SELECT p_partkey, b.lo FROM part JOIN (SELECT DISTINCT CAST(s_nationkey * 100 AS DOUBLE) AS lo FROM supplier) b ON p_retailprice >= lo AND p_retailprice < lo + 150")
def join_04_range(t, *_):
    ranges = t("supplier").select((F.col("s_nationkey") * 100).cast("double").alias("lo")).distinct().withColumn("hi", F.col("lo") + 150)
    return rel.range_join(t("part"), "p_retailprice", ranges, "lo", "hi", 150.0).select("p_partkey", "lo")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def join_05_semi(t, *_):
    return t("customer").join(t("orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_05_anti(t, *_):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT k, n_name, s_suppkey FROM (SELECT n_nationkey AS k, n_name FROM nation) JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier) USING (k)")
def join_06_using(t, *_):
    return t("nation").select(F.col("n_nationkey").alias("k"), "n_name").join(t("supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey"), "k")


@query("SELECT n_name, c_custkey FROM nation, LATERAL (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2)")
def join_07_lateral(t, *_):
    """The two richest customers of each nation, by a subquery that looks at the nation's row."""
    richest = t("customer").where(F.col("c_nationkey") == F.col("n_nationkey").outer()).orderBy(F.desc("c_acctbal"), "c_custkey").limit(2)
    return t("nation").lateralJoin(richest.select("c_custkey")).select("n_name", "c_custkey")


@query("SELECT e.event_id, r.event_id AS right_event_id, r.ts AS right_ts FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) r ON e.user_id = r.user_id AND e.ts >= r.ts")
def join_09_asof(t, *_):
    right = t("events").where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    out = rel.asof_join(t("events").where("event_type = 'error'"), right, "user_id", "ts", ["event_id"])
    return out.select("event_id", "right_event_id", "right_ts")


@query("SELECT x AS key, parts, suppliers FROM (SELECT CASE WHEN p_size > 25 THEN NULL ELSE p_size END AS x, count(*) AS parts FROM part GROUP BY 1) a JOIN (SELECT CASE WHEN s_nationkey > 20 THEN NULL ELSE s_nationkey END AS y, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.x IS NOT DISTINCT FROM b.y")
def join_10_null_safe(t, *_):
    """How many parts and suppliers have each key, null too; both sides are counted first, so no pairs are made."""
    a = t("part").groupBy(F.when(F.col("p_size") <= 25, F.col("p_size")).alias("x")).agg(F.count("*").alias("parts"))
    b = t("supplier").groupBy(F.when(F.col("s_nationkey") <= 20, F.col("s_nationkey")).alias("y")).agg(F.count("*").alias("suppliers"))
    return rel.null_safe_join(a, b, "x", "y").select(F.col("x").alias("key"), "parts", "suppliers")


@query("SELECT p_partkey, n AS suppliers FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN NULL ELSE p_size END AS x FROM part) a JOIN (SELECT CASE WHEN s_nationkey > 20 THEN NULL ELSE s_nationkey END AS y, count(*) AS n FROM supplier GROUP BY 1) b ON a.x IS NOT DISTINCT FROM b.y")
def join_10_whole_null_safe(t, *_):
    """All parts with how many of all suppliers have their key; suppliers are counted first, so no pairs are made."""
    a = t("part").select("p_partkey", F.when(F.col("p_size") <= 25, F.col("p_size")).alias("x"))
    b = t("supplier").groupBy(F.when(F.col("s_nationkey") <= 20, F.col("s_nationkey")).alias("y")).agg(F.count("*").alias("suppliers"))
    return rel.null_safe_join(a, b, "x", "y").select("p_partkey", "suppliers")


# --- aggregates ---


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, sum(CAST(l_quantity AS DECIMAL(18,4))) AS qty, round(avg(l_extendedprice), 2) AS price, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY ALL")
def agg_01_02_basic(t, *_):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum(dec(F.col("l_quantity"))).alias("qty"), F.round(F.avg("l_extendedprice"), 2).alias("price"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@query("SELECT p_brand, median(p_size) AS med, quantile_cont(p_size, 0.25) AS q, quantile_disc(p_size, 0.25) AS qd FROM part GROUP BY p_brand")
def agg_03_12_13_percentiles(t, *_):
    return t("part").groupBy("p_brand").agg(F.median("p_size").alias("med"), agg.percentile_cont(F.col("p_size"), 0.25).alias("q"), agg.percentile_disc("p_size", 0.25).cast("int").alias("qd"))


@query("SELECT p_brand, min(p_size) AS m FROM (SELECT *, max(n) OVER (PARTITION BY p_brand) AS top FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size)) WHERE n = top GROUP BY p_brand")
def agg_04_mode(t, *_):
    return t("part").groupBy("p_brand").agg(agg.mode(F.col("p_size")).alias("m"))


@query("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def agg_05_listagg(t, *_):
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(agg.listagg(F.col("n_name"), ", ").alias("names"))


@query("SELECT n_regionkey, any_value(n_regionkey) AS v, array_to_string(list_sort(array_agg(n_nationkey)), ',') AS keys FROM nation GROUP BY n_regionkey")
def agg_06_08_any_array(t, *_):
    return t("nation").groupBy("n_regionkey").agg(F.any_value("n_regionkey", True).alias("v"), F.array_join(F.sort_array(F.collect_list("n_nationkey")), ",").alias("keys"))


@query()
def agg_07_approx_count_distinct(t, *_):
    return t("lineitem").agg(F.approx_count_distinct("l_partkey").alias("n"))


@query("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey")
def agg_09_object_agg(t, *_):
    return agg.object_agg(t("nation"), ["n_regionkey"], F.col("n_name"), F.col("n_nationkey"), "o")


@query("SELECT c_nationkey, '{' || coalesce(string_agg('\"' || k || '\":' || v, ',' ORDER BY k) FILTER (WHERE k IS NOT NULL AND v IS NOT NULL), '') || '}' AS o FROM (SELECT c_nationkey, nullif(c_mktsegment, 'BUILDING') AS k, max(CASE WHEN c_acctbal > 0 THEN c_custkey END) AS v FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def agg_09_object_agg_repeated(t, *_):
    """Keys that repeat and keys and values that are null."""
    return agg.object_agg(t("customer"), ["c_nationkey"], F.nullif("c_mktsegment", F.lit("BUILDING")), F.when(F.col("c_acctbal") > 0, F.col("c_custkey")), "o")


@query("SELECT p_brand, quantile_disc(p_size * 2 + 1, 0.4) AS qd FROM part GROUP BY p_brand")
def agg_13_percentile_disc_expression(t, *_):
    return t("part").withColumn("twice", F.col("p_size") * 2 + 1).groupBy("p_brand").agg(agg.percentile_disc("twice", 0.4).cast("int").alias("qd"))


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(CAST(l_extendedprice AS DECIMAL(18,2))) AS BIGINT) AS whole, l_partkey - l_partkey % 100 AS hundreds, trunc(CAST(l_extendedprice AS DECIMAL(18,2)) * 10) / 10 AS tenths FROM lineitem")
def num_03_trunc_exact(t, *_):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return t("lineitem").select("l_orderkey", "l_linenumber", d.trunc(price).cast("long").alias("whole"), d.trunc("l_partkey", -2).alias("hundreds"), d.trunc(price, 1).cast("double").alias("tenths"))


@query("SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS s, round(stddev_pop(c_acctbal), 4) AS sp, round(var_samp(c_acctbal) / 1e6, 6) AS v, round(var_pop(c_acctbal) / 1e6, 6) AS vp, round(kurtosis(c_acctbal), 5) AS k, round(skewness(c_acctbal), 5) AS w, round(covar_pop(c_acctbal, c_nationkey), 3) AS cp, round(covar_samp(c_acctbal, c_nationkey), 3) AS cs, round(corr(c_acctbal, c_nationkey), 6) AS r FROM customer GROUP BY c_mktsegment")
def agg_10_11_14_17_moments(t, *_):
    x, y = F.col("c_acctbal"), F.col("c_nationkey")
    return t("customer").groupBy("c_mktsegment").agg(
        F.round(F.stddev_samp(x), 4).alias("s"), F.round(F.stddev_pop(x), 4).alias("sp"), F.round(F.var_samp(x) / 1e6, 6).alias("v"), F.round(F.var_pop(x) / 1e6, 6).alias("vp"), F.round(agg.kurtosis(x), 5).alias("k"), F.round(agg.skew(x), 5).alias("w"),
        F.round(F.covar_pop(x, y), 3).alias("cp"), F.round(F.covar_samp(x, y), 3).alias("cs"), F.round(F.corr(x, y), 6).alias("r"),
    )


@query("SELECT p_brand, bit_and(p_size) AS a, bit_or(p_size) AS o, bit_xor(p_size) AS x, bool_and(p_size > 1) AS ba, bool_or(p_size > 49) AS bo FROM part GROUP BY p_brand")
def agg_18_19_bits_bools(t, *_):
    size = F.col("p_size")
    return t("part").groupBy("p_brand").agg(F.bit_and(size).alias("a"), F.bit_or(size).alias("o"), F.bit_xor(size).alias("x"), F.bool_and(size > 1).alias("ba"), F.bool_or(size > 49).alias("bo"))


@query("SELECT p_brand, sum(coalesce(nullif(p_size, 7), 0)) AS s, count(*) FILTER (WHERE p_size > 10) AS f, count(DISTINCT p_type) AS d FROM part GROUP BY p_brand")
def agg_20_22_filter_distinct(t, *_):
    return t("part").groupBy("p_brand").agg(F.sum(F.zeroifnull(F.nullif("p_size", F.lit(7)))).alias("s"), F.count_if(F.col("p_size") > 10).alias("f"), F.countDistinct("p_type").alias("d"))


@query("SELECT p_brand, p_type, count(*) AS n, grouping(p_brand) AS gb, grouping(p_type) AS gt FROM part GROUP BY CUBE (p_brand, p_type)")
def agg_21_cube(t, *_):
    return t("part").cube("p_brand", "p_type").agg(F.count("*").alias("n"), F.grouping("p_brand").alias("gb"), F.grouping("p_type").alias("gt"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)")
def agg_21_rollup(t, *_):
    return t("part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def agg_21_grouping_sets(t, *_):
    b, y = F.col("p_brand"), F.col("p_type")
    return t("part").groupingSets([[b], [y], []], b, y).agg(F.count("*").alias("n"))


# --- windows ---

W = "PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey"


def _w():
    return Window.partitionBy("o_custkey").orderBy(*rel.in_order("o_orderdate", "o_orderkey"))


@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS nt, round(cume_dist() OVER w, 6) AS cd, round(percent_rank() OVER w, 6) AS pr FROM orders WINDOW w AS (" + W + "), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def win_01_02_06_07_ranks(t, *_):
    w, v = _w(), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t("orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.ntile(4).over(w).alias("nt"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.round(F.percent_rank().over(w), 6).alias("pr"))


@query("SELECT o_orderkey, lag(o_totalprice) OVER w AS a, lead(o_totalprice, 2, -1) OVER w AS b, first_value(o_orderkey) OVER f AS c, last_value(o_orderkey) OVER f AS d, nth_value(o_orderkey, 2) OVER f AS e FROM orders WINDOW w AS (" + W + "), f AS (" + W + " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_03_04_05_values(t, *_):
    w = _w()
    f = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t("orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("a"), F.lead("o_totalprice", 2, -1.0).over(w).alias("b"), F.first("o_orderkey").over(f).alias("c"), F.last("o_orderkey").over(f).alias("d"), F.nth_value("o_orderkey", 2).over(f).alias("e"))


@query("SELECT o_orderkey, sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER (" + W + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, count(*) OVER (PARTITION BY o_custkey) AS n, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS year FROM orders")
def win_08_09_11_frames(t, *_):
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    year = Window.partitionBy("o_custkey").orderBy(day).rangeBetween(-365 * 86_400_000_000, 0)
    return t("orders").select("o_orderkey", F.sum(dec(F.col("o_totalprice"))).over(_w().rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"), F.count("*").over(year).alias("year"))


@query("SELECT n_nationkey, sum(n_nationkey) OVER () AS total FROM nation")
def win_10_whole(t, *_):
    return t("nation").crossJoin(F.broadcast(t("nation").agg(F.sum("n_nationkey").alias("total")))).select("n_nationkey", "total")


@query("SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS r FROM supplier")
def win_12_ratio_to_report(t, *_):
    return t("supplier").select("s_suppkey", F.round(agg.ratio_to_report(F.col("s_acctbal"), Window.partitionBy("s_nationkey")), 6).alias("r"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 7) DESC NULLS FIRST, p_partkey) AS rn FROM part")
def win_13_null_order(t, *_):
    rows = t("part").withColumn("x", F.nullif("p_size", F.lit(7)))
    return rows.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(*rel.in_order(("x", "desc"), "p_partkey"))).alias("rn"))


# --- order and limit, sets ---


@query("SELECT p_partkey, nullif(p_size, 50) AS x FROM part ORDER BY x DESC NULLS FIRST, p_partkey LIMIT 20")
def sort_02_05_top_desc(t, *_):
    return rel.top(t("part").select("p_partkey", F.nullif("p_size", F.lit(50)).alias("x")), 20, ("x", "desc"), "p_partkey")


@query("SELECT p_partkey, nullif(p_size, 1) AS x FROM part ORDER BY p_brand DESC NULLS FIRST, x ASC NULLS LAST, p_partkey LIMIT 20 OFFSET 5")
def sort_01_04_mixed_offset(t, *_):
    rows = t("part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("x"), "p_brand")
    return rows.orderBy(*rel.in_order(("p_brand", "desc"), "x", "p_partkey")).offset(5).limit(20).select("p_partkey", "x")


@query("SELECT p_partkey, nullif(p_size, 1) AS x FROM part ORDER BY x ASC NULLS FIRST, p_partkey LIMIT 15")
def sort_03_explicit_nulls(t, *_):
    rows = t("part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("x"))
    return rows.orderBy(F.col("x").asc_nulls_first(), "p_partkey").limit(15)


def _keys(t):
    return t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))


def _set(word: str) -> str:
    return f"SELECT c_nationkey AS k FROM customer {word} SELECT s_nationkey FROM supplier"


@query(_set("UNION ALL"))
def set_01_union_all(t, *_):
    a, b = _keys(t)
    return a.union(b)


@query(_set("UNION"))
def set_02_union(t, *_):
    a, b = _keys(t)
    return a.union(b).distinct()


@query(_set("INTERSECT"))
def set_03_intersect(t, *_):
    a, b = _keys(t)
    return a.intersect(b)


@query(_set("INTERSECT ALL"))
def set_03_intersect_all(t, *_):
    a, b = _keys(t)
    return a.intersectAll(b)


@query("SELECT p_size AS k FROM part EXCEPT SELECT s_nationkey FROM supplier")
def set_04_except(t, *_):
    return t("part").select(F.col("p_size").alias("k")).subtract(_keys(t)[1])


@query(_set("EXCEPT ALL"))
def set_04_except_all(t, *_):
    a, b = _keys(t)
    return a.exceptAll(b)


@query("SELECT n_nationkey AS a, n_name AS b, NULL AS c FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def set_05_union_by_name(t, *_):
    return t("nation").select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("b")).unionByName(t("region").select(F.col("r_name").alias("c"), F.col("r_regionkey").alias("a")), allowMissingColumns=True)


# --- a larger query ---

FLAGSHIP = "SELECT n_name, o_orderpriority, count(*) AS lines, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY ALL"


@query(FLAGSHIP)
def flagship(t, *_):
    """Revenue by nation and priority. The filter and the columns reach the scans; lines are summed before they meet."""
    lines = t("lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select("l_orderkey", _net().alias("net"))
    by_order = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("net").alias("net"))
    rows = by_order.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "o_orderpriority").agg(F.sum("lines").alias("lines"), F.sum("net").alias("revenue"))


def queries() -> dict:
    def make(f):
        def run(spark, sf_dir):
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark, sf_dir)

        return run

    return {name: make(f) for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
