"""Joins whose inputs are whole tables."""

import __spark_entry__ as contract


def keys(spark, sf, table, key):
    return sorted(r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect())


def test_outer_joins_have_every_customer_and_order(spark, sf):
    got = {k: contract.queries()[f"join_02_whole_{k}"](spark, sf).collect() for k in ("left", "right", "full")}
    for kind in ("left", "full"):
        assert sorted({r.c_custkey for r in got[kind]} - {None}) == keys(spark, sf, "customer", "c_custkey")
    for kind in ("right", "full"):
        assert sorted(r.o_orderkey for r in got[kind] if r.o_orderkey is not None) == keys(spark, sf, "orders", "o_orderkey")
    assert any(r.o_orderkey is None for r in got["left"]) and any(r.c_custkey is None for r in got["right"])


def test_null_safe_join_counts_every_supplier(spark, sf):
    sizes = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    nations = [r.s_nationkey for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_nationkey").collect()]
    known = [n if n <= 20 else None for n in nations]
    want = {p: known.count(size if size <= 25 else None) for p, size in sizes.items()}
    got = {r.p_partkey: r.suppliers for r in contract.queries()["join_10_whole_null_safe"](spark, sf).collect()}
    assert got == {p: n for p, n in want.items() if n}
