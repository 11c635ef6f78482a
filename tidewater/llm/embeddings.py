"""Embedding near-duplicates: a pigeonhole join over blocks of rotated vectors, with exact checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import sampled, stored
from .graph import components

#: Vectors that the rotation is fitted on, or hardly more, and vectors of one side of a comparison.
SAMPLE, CHUNK = 4_000, 1_536
#: Room for rounding: a block's distance may exceed its budget by SLACK, and a first, faster look by ten times that.
SLACK = 1e-9


@dataclass(frozen=True)
class Blocks:
    """A rotation whose columns are dealt to blocks, and the squared distance that each block may have."""

    rotation: np.ndarray
    parts: int
    budget: float
    least: float

    @property
    def width(self) -> float:
        return float(np.sqrt(self.budget + SLACK) * (1 + SLACK))

    def turn(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors after the rotation; a block is every `parts`-th column."""
        return (rows / np.linalg.norm(rows, axis=1, keepdims=True)) @ self.rotation


def blocks(sample: np.ndarray, least: float, parts: int = 4) -> Blocks:
    """Blocks for pairs of a cosine of `least` or more.

    Unit vectors of that cosine have a squared distance of 2 - 2 * least at most, so that in one block at least it is
    not above an equal part. The rotation has the main axes of the sample, dealt to the blocks in turn, and each
    block's first coordinate spreads as far as can be. Any rotation gives the same links.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(np.cov(unit.T) if len(unit) > 1 else np.eye(sample.shape[1]))
    parts = min(parts, sample.shape[1])
    return Blocks(axes.reshape(sample.shape[1], -1)[:, ::-1], parts, (2 - 2 * least) / parts, least)


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _cell_task(found: Blocks, size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead = found.turn(_rows(batch.column(3), size))[:, : found.parts]
                cells = pa.array(list(np.floor(lead / found.width).astype(np.int32)), pa.list_(pa.int32()))
                yield pa.record_batch([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return task


def _low(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that links lead to, for places 0 to count."""
    low = np.arange(count)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            return low


def _compare_task(found: Blocks, size: int):
    """Links between two chunks of vectors whose cells in one block touch, or within one chunk."""

    def task(got: pa.Table) -> pa.Table:
        got = got.sort_by([("right", "ascending"), ("node", "ascending")]).combine_chunks()
        block, alone = got.column("block")[0].as_py(), got.column("alone")[0].as_py()
        node, copies = got.column("node").to_numpy(), got.column("copies").to_numpy()
        plain = _rows(got.column("vec").combine_chunks(), size)
        turned, norms = found.turn(plain), np.linalg.norm(plain, axis=1)
        cut = int((~got.column("right").to_numpy()).sum())
        left, right = (slice(0, len(node)),) * 2 if alone else (slice(0, cut), slice(cut, len(node)))
        x, y = turned[left, block :: found.parts], turned[right, block :: found.parts]
        far = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T
        near = far <= found.budget + 10 * SLACK
        a, b = np.nonzero(np.triu(near, 1) if alone else near)
        b = b + right.start
        linked = np.zeros(len(a), bool)
        for at in range(0, len(a), 100_000):  # exactly, and only in the first block that fits
            i, j = a[at : at + 100_000], b[at : at + 100_000]
            apart = (turned[i] - turned[j]) ** 2
            fits = np.stack([apart[:, p :: found.parts].sum(axis=1) for p in range(block + 1)], axis=1) <= found.budget + SLACK
            close = np.einsum("ij,ij->i", plain[i], plain[j]) / (norms[i] * norms[j]) >= found.least
            linked[at : at + 100_000] = close & fits[:, block] & ~fits[:, :block].any(axis=1)
        a, b = a[linked], b[linked]
        links = np.bincount(a, copies[b], len(node)).astype(np.int64) + np.bincount(b, copies[a], len(node)).astype(np.int64)
        low = _low(len(node), a, b)
        some = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[some]), "links": pa.array(links[some]), "low": pa.array(node[low[some]])})

    return task


def _usable(column: Column) -> Column:
    """Neither null nor without a component, all components finite, not all zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return column.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(column, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, least: float = 0.93, parts: int = 4, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).

    Equal vectors of a label are one node with a count. In each block a node stands in a cell of its leading coordinate,
    as wide as the block's budget reaches, so partners are in the same cell or the next. Cells are dealt out in chunks
    of about `chunk` nodes, and two chunks meet in one task, which returns counts and no pairs. A pair counts in the
    first block that fits. Vectors of unequal length are not compared.

    Rows that are unusable, without a label or without a vec_id link with nothing. Rows that share a vec_id stand for
    one node, if they are the least of their vectors.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = rows.where(_usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    nodes = stored(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).select("label", "node", "copies", F.col("embedding").alias("vec")), "nodes")
    found = None
    for size in sorted(r.n for r in nodes.select(F.size("vec").alias("n")).distinct().collect()):
        part = _compared(nodes.where(F.size("vec") == size), size, least, parts, chunk)
        found = part if found is None else found.union(part)
    schema = "node long, links long, low long"
    found = stored(found, "links") if found is not None else rows.sparkSession.createDataFrame([], schema)

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    own = nodes.select("label", F.col("vec").alias("embedding"), "node", "copies").join(links, "node", "left").join(known, "node", "left")
    own = own.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    out = good.select("vec_id", "embedding", "label").join(own, ["label", "embedding"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    bad = rows.where(~(_usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long"), "vec_id")
    return out.union(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compared(nodes: DataFrame, size: int, least: float, parts: int, chunk: int) -> DataFrame:
    sample = sampled(nodes, "node", SAMPLE).select("vec").collect() or nodes.select("vec").limit(1).collect()
    found = blocks(np.array([r.vec for r in sample], np.float64), least, parts)
    kinds = f"label {nodes.schema['label'].dataType.simpleString()}, node long, copies long, vec {nodes.schema['vec'].dataType.simpleString()}"
    placed = stored(nodes.select("label", "node", "copies", "vec").mapInArrow(_cell_task(found, size), f"{kinds}, cells array<int>"), "cells")
    each = placed.select("label", "node", "copies", "vec", F.posexplode("cells").alias("block", "cell"))
    counts = placed.select("label", F.posexplode("cells").alias("block", "cell")).groupBy("label", "block", "cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("n"))
    counts = stored(counts, "counts")

    def beside(step: int, name: str) -> DataFrame:
        return counts.select("label", "block", (F.col("cell") + step).alias("cell"), F.col("n").alias(name))

    sizes = counts.join(beside(-1, "after"), ["label", "block", "cell"], "left").join(beside(1, "before"), ["label", "block", "cell"], "left")
    mine = each.join(sizes, ["label", "block", "cell"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))

    def to(first: Column, end: Column) -> Column:
        """Numbers from first up to, not with, end; none if end is null."""
        return F.when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))

    zero = F.lit(0)
    turns = (  # right side or not, cell of the left side, step to the right side's cell, chunk of the left and of the right side
        (False, F.col("cell"), 0, None, to(F.col("own"), F.col("n"))),
        (True, F.col("cell"), 0, to(zero, F.col("own")), None),
        (False, F.col("cell"), 1, None, to(zero, F.col("after"))),
        (True, F.col("cell") - 1, 1, to(zero, F.col("before")), None),
    )
    sent = None
    for right, cell, step, left_chunks, right_chunks in turns:
        other = F.explode(left_chunks if right_chunks is None else right_chunks).alias("other")
        part = mine.select("label", "block", cell.alias("at"), F.lit(step).alias("step"), "own", other, F.lit(right).alias("right"), "node", "copies", "vec")
        part = part.select("label", "block", "at", "step", F.col("other" if right else "own").alias("x"), F.col("own" if right else "other").alias("y"), "right", "node", "copies", "vec")
        sent = part if sent is None else sent.union(part)
    sent = sent.withColumn("alone", (F.col("step") == 0) & (F.col("x") == F.col("y")))
    return sent.groupBy("label", "block", "at", "step", "x", "y").applyInArrow(_compare_task(found, size), "node long, links long, low long")
