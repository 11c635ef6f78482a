"""Quality: a small network that minimises the non-negative risk of positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import documents, held_out, stored
from .arrowfile import part_starts
from .tokens import rows_within
from .words import BLANK, HASHED, buffer, shingles, words

#: Labelled rows that are kept in one block, about: a step of the training reads all blocks.
BLOCK = 4_096

FEATURES = (
    "log_words", "word_length", "upper", "lower", "digit", "blank", "wide", "exclaim", "bar", "marks", "stops", "other",
    "entropy", "distinct_words", "repeated_word", "distinct_pairs", "line_length", "ends", "short", "bangs_per_word", "bars_per_word", "marks_per_word",
)


def _groups() -> np.ndarray:
    """Which of the byte groups (upper to other in FEATURES) each byte belongs to."""
    out = np.zeros((256, 9))
    for column, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "", "", "!", "|", "%$&*#@^~<>{}[]\\=+_/", ".,;:?'\"-()")):
        out[[ord(c) for c in chars], column] = 1
    out[BLANK, 3] = 1
    out[128:, 4] = 1
    return out


GROUPS = _groups()


def features(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each text; a text without words has zeros where a mean has no terms."""
    raw, offsets = buffer(texts)
    sizes = np.diff(offsets)
    doc, counts = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.zeros(len(sizes) * 256, np.int64)
    for at in range(0, len(raw), HASHED):
        part = slice(at, at + HASHED)
        counts += np.bincount(doc[part].astype(np.int64) * 256 + raw[part], minlength=len(counts))
    counts = counts.reshape(-1, 256)
    length = np.maximum(sizes, 1)[:, None]
    share = counts / length
    grouped = share @ GROUPS
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)
    hashes, starts = words(texts)
    n = np.diff(starts)
    some = np.maximum(n, 1)
    same = np.zeros(len(hashes) + 1)
    same[1:-1] = hashes[1:] == hashes[:-1] if len(hashes) else 0
    same[starts[:-1]] = 0
    repeated = np.add.reduceat(np.concatenate([same, [0]]), starts[:-1]) * (n > 0) if len(n) else np.zeros(0)
    distinct = [np.diff(shingles(texts, k, lower=False)[1]) / some for k in (1, 2)]
    lines = counts[:, 10] + 1
    visible = sizes - counts[:, BLANK].sum(axis=1)
    ends = counts[:, [ord(c) for c in ".!?"]].sum(axis=1)
    marks = share[:, [ord(c) for c in "%$&*#"]].sum(axis=1) * length[:, 0]
    columns = [
        np.log1p(n), np.minimum(visible / some, 40), *grouped.T, 1 - grouped.sum(axis=1), entropy, distinct[0], repeated / some, distinct[1],
        np.log1p(n / lines), np.minimum(ends / some, 3), n < 12, np.minimum(counts[:, 33] / some, 4), np.minimum(counts[:, 124] / some, 4), np.minimum(marks / some, 4),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def _feature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_within(batches, 1, HASHED):
        yield pa.record_batch([batch.column(0), pa.array(list(features(batch.column(1))), pa.list_(pa.float64()))], names=["doc_id", "x"])


def _vectors(docs: DataFrame) -> DataFrame:
    return documents(docs).mapInArrow(_feature_task, "doc_id long, x array<double>")


def _moment_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each feature and batch: how many rows, their sum and their sum of squares."""
    for batch in batches:
        x = batch.column(0).flatten().to_numpy().reshape(-1, len(FEATURES))
        size = x.shape[1]
        yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array([len(x)] * size, pa.int64()), pa.array(x.sum(axis=0)), pa.array((x * x).sum(axis=0))], names=["feature", "n", "total", "squares"])


def _moments(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    sums = vectors.select("x").mapInArrow(_moment_task, "feature int, n long, total double, squares double")
    found = sums.groupBy("feature").agg(F.sum("n"), F.sum("total"), F.sum("squares")).orderBy("feature").collect()
    n, total, squares = (np.array([r[k] for r in found], float) for k in (1, 2, 3))
    mean = total / n
    return mean, np.sqrt(np.maximum(squares / n - mean**2, 0))


def moments(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each feature over all documents; a row for each feature comes to the driver."""
    return _moments(_vectors(docs))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """A network with one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _raw(self.weights, _standard(x, self.mean, self.scale))

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def _raw(weights: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    a, b, c, d = weights
    return np.tanh(z @ a + b) @ c + d[0]


def _start(size: int, prior: float, hidden: int, seed: int) -> np.ndarray:
    """Weights to begin with, in one row: of the hidden units, their biases, the output and its bias."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 1 / np.sqrt(size), size * hidden), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), [np.log(prior / (1 - prior))]])


def _layers(flat: np.ndarray, size: int) -> list[np.ndarray]:
    hidden = (len(flat) - 1) // (size + 2)
    a, b, c, d = np.split(flat, np.cumsum([size * hidden, hidden, hidden]))
    return [a.reshape(size, hidden), b, c, d]


def _sums(flat: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The loss of calling rows positive when they are negative, and its slope by each weight, summed over the rows."""
    a, b, c, d = _layers(flat, z.shape[1])
    held = np.tanh(z @ a + b)
    p = _sigmoid(held @ c + d[0])
    slope = p * (1 - p)
    inner = np.outer(slope, c) * (1 - held**2)
    return np.concatenate([[p.sum()], (z.T @ inner).ravel(), inner.sum(axis=0), held.T @ slope, [slope.sum()]])


def _descend(sums: Callable[[np.ndarray], np.ndarray], sizes: np.ndarray, priors: np.ndarray, size: int, hidden: int = 16, turns: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Fits a model for each prior, all side by side; gives a row of weights for each.

    `sums` gives _sums() of each model over its positives and over its unlabelled rows, and `sizes` how many there are.
    Only these sums look at rows, so they may be spread out. Minimises
    prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with the sigmoid loss. When the part in max()
    falls below zero, a step goes up its gradient instead, as non-negative learning asks.
    """
    flat = np.stack([_start(size, p, hidden, seed) for p in priors])
    shrunk = np.concatenate([np.ones(size * hidden), np.zeros(hidden), np.ones(hidden), [0]])
    moment, second = np.zeros_like(flat), np.zeros_like(flat)
    for turn in range(1, turns + 1):
        means = sums(flat) / np.maximum(sizes, 1)[:, :, None]
        ours, every = means[:, 0] * np.asarray(priors)[:, None], means[:, 1]
        negative = every - ours
        grad = np.where(negative[:, :1] >= 0, negative - ours, -negative)[:, 1:] + decay * shrunk * flat
        moment = 0.9 * moment + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        flat = flat - rate * (moment / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return flat


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, mean: np.ndarray | None = None, scale: np.ndarray | None = None, hidden: int = 16, turns: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """A model of rows in memory, by _descend(). Without a mean and a scale those of the given rows are taken."""
    every = np.concatenate([positive, unlabelled])
    model = Model(every.mean(axis=0) if mean is None else mean, (every.std(axis=0) if scale is None else scale) + 1e-6, [])
    z = [_standard(x, model.mean, model.scale) for x in (positive, unlabelled)]
    flat = _descend(lambda flat: np.array([[_sums(flat[0], x) for x in z]]), np.array([[len(x) for x in z]]), [prior], every.shape[1], hidden, turns, rate, decay, seed)
    model.weights = _layers(flat[0], every.shape[1])
    return model


def _error(positive: int, unlabelled: int) -> float:
    return np.sqrt(np.log(40) / (2 * positive)) + np.sqrt(np.log(40) / (2 * unlabelled))


def _clipped(found: list[float], unlabelled: int) -> float:
    return float(np.clip(np.mean(found), 1 / (unlabelled + 2), 1 - 1 / (unlabelled + 2))) if found else 0.5


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray | None = None, scale: np.ndarray | None = None) -> float:
    """The share of positives among unlabelled rows in memory, from scores of both and no other label.

    A model of one half of the rows, fitted as if half of the unlabelled ones were positive, ranks the other half, and
    the other way round. Above any threshold the unlabelled rows hold at least prior times the share that the positives
    have there, so the least ratio of both shares bounds the prior from above, and is it where a threshold leaves no
    negatives. The ratio is taken where it is least together with its sampling error.
    """
    found = []
    for turn in (0, 1):
        model = fit(positive[turn::2], unlabelled[turn::2], 0.5, mean, scale, turns=120)
        ours, all_ = (np.sort(model.raw(x[1 - turn :: 2])) for x in (positive, unlabelled))
        if not len(ours) or not len(all_):
            continue
        cuts = np.unique(ours)
        p, u = 1 - np.searchsorted(ours, cuts) / len(ours), 1 - np.searchsorted(all_, cuts) / len(all_)
        best = int(np.argmin((u + _error(len(ours), len(all_))) / p))
        found.append(u[best] / p[best])
    return _clipped(found, len(unlabelled))


@dataclass
class Blocks:
    """All rows that a model is learnt from, as a stored table of blocks: their standardised features in one value.

    A block has four stretches of rows: label 0 and 1 of one half of the ids, label 0 and 1 of the other. `sizes` has
    the length of each over all blocks, by half and label. `held` are the same blocks, kept near the tasks that sum them.
    """

    rows: DataFrame
    held: RDD
    sizes: np.ndarray

    @classmethod
    def of(cls, vectors: DataFrame, known: DataFrame, mean: np.ndarray, scale: np.ndarray) -> Blocks:
        """known has doc_id and y, once for each id. Ids are dealt to halves and blocks by a hash."""
        count, key = -(-max(known.count(), 1) // BLOCK), F.xxhash64("doc_id")
        rows = vectors.join(known, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
        rows = rows.select("doc_id", F.pmod(key, F.lit(2)).alias("half"), F.pmod(F.shiftright(key, 1), F.lit(count)).alias("block"), (F.col("y") == 1).alias("ours"), "x")

        def block(found: pa.Table) -> pa.Table:
            found = found.sort_by([("half", "ascending"), ("ours", "ascending"), ("doc_id", "ascending")])
            x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
            kind = found["half"].to_numpy() * 2 + found["ours"].to_numpy()
            return pa.table({"sizes": pa.array([np.bincount(kind, minlength=4)], pa.list_(pa.int64())), "z": [_standard(x, mean, scale).tobytes()]})

        kept = stored(rows.groupBy("block").applyInArrow(block, "sizes array<long>, z binary"), "blocks")
        sizes = kept.select(*(F.coalesce(F.sum(F.get("sizes", F.lit(k))), F.lit(0)) for k in range(4))).first()
        held = kept.rdd.map(lambda r: (r.sizes, bytes(r.z))).persist(StorageLevel.MEMORY_AND_DISK)
        return cls(kept, held, np.array(sizes).reshape(2, 2))

    def sums(self, flat: np.ndarray, halves: list[tuple[int, ...]]) -> np.ndarray:
        """_sums() of each model over the positives, and over all rows, of its halves. Each task gives one array."""

        def task(blocks: Iterator[tuple[list[int], bytes]]) -> Iterator[np.ndarray]:
            total = np.zeros((len(flat), 2, flat.shape[1] + 1))
            for half, label, z in _stretches(blocks):
                for k in (k for k, own in enumerate(halves) if half in own):
                    found = _sums(flat[k], z)
                    total[k, 0] += found * label
                    total[k, 1] += found
            yield total

        return sum(self.held.mapPartitions(task).collect())

    def fit(self, priors: list[float], halves: list[tuple[int, ...]], turns: int = 250) -> np.ndarray:
        """Weights of a model for each prior, learnt from all rows of its halves."""
        sizes = np.array([[self.sizes[list(own), 1].sum(), self.sizes[list(own)].sum()] for own in halves])
        return _descend(lambda flat: self.sums(flat, halves), sizes, priors, len(FEATURES), turns=turns)

    def prior(self) -> float:
        """What class_prior() estimates, from all rows and every threshold; 0.5 where a half has no positives."""
        if not self.sizes[:, 1].all():
            return 0.5
        models = [_layers(x, len(FEATURES)) for x in self.fit([0.5, 0.5], [(1,), (0,)], turns=120)]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for half, label, z in _stretches(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                    yield pa.record_batch([pa.array(np.full(len(z), half)), pa.array(_raw(models[half], z)), pa.array(np.full(len(z), label))], names=["half", "cut", "ours"])

        scored = stored(self.rows.mapInArrow(task, "half long, cut double, ours long"), "scored")
        found = []
        for half in (0, 1):
            cuts = scored.where(F.col("half") == half).groupBy("cut").agg(F.sum("ours").alias("ours"), F.count("*").alias("every"))
            parts = stored(cuts.repartitionByRange(F.desc("cut")).withColumn("part", F.spark_partition_id()), "cuts")
            found.append(_least_ratio(parts, int(self.sizes[half, 1]), int(self.sizes[half].sum())))
        return _clipped(found, int(self.sizes.sum()))


def _stretches(blocks: Iterable[tuple[list[int], bytes]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Half, label and rows of each stretch of some blocks."""
    for sizes, z in blocks:
        rows, at = np.frombuffer(z, np.float64).reshape(-1, len(FEATURES)), 0
        for kind, size in enumerate(sizes):
            if size:
                yield kind // 2, kind % 2, rows[at : at + size]
            at += size


def _least_ratio(parts: DataFrame, positive: int, unlabelled: int) -> float:
    """The ratio that class_prior() asks for, over all cuts. Parts are ranges of cuts, the highest first."""
    for name in ("ours", "every"):
        before = part_starts(parts.sparkSession, parts.groupBy("part").agg(F.sum(name).alias("size")), "part", "size")
        parts = parts.join(F.broadcast(before.withColumnRenamed("before", f"{name}_before")), "part")
    so_far = Window.partitionBy("part").orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)
    p, u = ((F.col(f"{name}_before") + F.sum(name).over(so_far)) / n for name, n in (("ours", positive), ("every", unlabelled)))
    shares = parts.select("cut", "ours", p.alias("p"), u.alias("u")).where("ours > 0")
    least = shares.agg(F.min_by(F.col("u") / F.col("p"), F.struct((F.col("u") + float(_error(positive, unlabelled))) / F.col("p"), "cut")))
    return least.first()[0]


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from all trusted positives (label 1) and all unlabelled texts; None where no label 1 may be learnt from.

    Only rows outside the held-out fold give labels. Unlabelled texts are those of labelled rows outside that fold,
    whatever their label says. Every such row counts in every step: tasks sum slopes over the blocks that they read, and
    only sums and weights come to the driver. Means and scales of the features are those of all documents; the class
    prior is estimated from the scores of all positives and unlabelled texts. A document with several labels has the
    lowest, and rows that share a doc_id count once, with the least of their features. No documents give no model.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    vectors = stored(_vectors(docs), "vectors")
    if vectors.isEmpty():
        return None
    mean, scale = _moments(vectors)
    scale = scale + 1e-6
    blocks = Blocks.of(vectors, known, mean, scale)
    try:
        if not blocks.sizes[:, 1].sum():
            return None
        return Model(mean, scale, _layers(blocks.fit([blocks.prior()], [(0, 1)])[0], len(FEATURES)))
    finally:
        blocks.held.unpersist()


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row: the chance that a text is good. Without a model every score is 0.5."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_within(batches, 1, HASHED):
            got = model.score(features(batch.column(1))) if model else np.full(batch.num_rows, 0.5)
            yield pa.record_batch([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return documents(docs).mapInArrow(task, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores the threshold or more."""
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_within(batches, at, HASHED):
            texts = pc.fill_null(batch.column(at), "")
            good = model.score(features(texts)) >= threshold if model else np.full(batch.num_rows, 0.5 >= threshold)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(task, docs.schema)


def predicted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted. A null text is empty and gets a score too; a null doc_id isn't held out."""
    scored = score(docs, train(docs, labels))
    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
