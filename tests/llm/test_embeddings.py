import numpy as np
import pytest

from tidewater.llm import embeddings, queries


def brute(rows, least=0.93):
    good = {}
    for k, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            good[k] = (np.array(v, np.float32).astype(np.float64), label)
    links, root = {k: 0 for k, _, _ in rows}, {k: k for k, _, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(good)
    for i, a in enumerate(keys):
        x, lx = good[a]
        for b in keys[:i]:
            y, ly = good[b]
            if lx == ly and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[a] += 1
                links[b] += 1
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {k: (links[k], top(k), top(k) == k) for k, _, _ in rows}


def run(spark, rows, **how):
    data = spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], y, 1, "n") for k, v, y in rows], "vec_id long, embedding array<float>, label int, node int, cells string")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(data, **how).collect()}


@pytest.mark.parametrize(("dims", "parts", "chunk"), [(16, 4, 20), (10, 3, 7), (2, 4, 1000)])
def test_op5_against_brute_force(spark, dims, parts, chunk):
    rng = np.random.default_rng(dims)
    rows = []
    for _ in range(14):
        base = rng.normal(size=dims) * rng.uniform(0.1, 5)
        rows += [base + rng.normal(size=dims) * np.linalg.norm(base) * s / np.sqrt(dims) for s in rng.uniform(0, 0.6, 8)]
        rows += [base, base]
    rows = [(k, v.astype(np.float32).tolist(), int(rng.integers(0, 2))) for k, v in enumerate(rows)]
    at = len(rows)
    rows += [(at, None, 0), (at + 1, [0.0] * dims, 0), (at + 2, [float("nan")] * dims, 0), (at + 3, [None] * dims, 1), (at + 4, rows[0][1], None), (at + 5, [], 0), (at + 6, [1.0] * (dims + 1), 0), (at + 7, [2.0] * (dims + 1), 0), (at + 8, [float("inf")] + [1.0] * (dims - 1), 1)]
    assert run(spark, rows, parts=parts, chunk=chunk) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, None, 1), (2, [1.0], None)]) == {1: (0, 1, True), 2: (0, 2, True)}


def test_query_on_the_small_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op5_embeddings(spark, sf).collect()} == brute(rows)
