"""Packing: documents near each other on a Hilbert curve fill the same sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, stored
from .arrowfile import part_starts, parts_for
from .tokens import piece_encoder, rows_within

#: Dimensions that hashed vectors are projected to, bits of each on the curve, and the reach of a coordinate.
DIMS, BITS, REACH = 3, 10, 0.25
PIECES = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long"


def projection(size: int, dims: int = DIMS, buckets: int = 1 << 12, seed: int = 20) -> np.ndarray:
    """For each id the projection of its hashed unit vector: ids share `buckets` random signs in each dimension."""
    rows = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (dims, buckets))
    hashed = (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
    return rows[:, hashed.astype(np.int64) % buckets]


def hilbert(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of whole coordinates, by Skilling's transposed form."""
    x = [grid[:, d].astype(np.int64).copy() for d in range(grid.shape[1])]
    for bit in (1 << b for b in range(bits - 1, 0, -1)):
        for d in range(len(x)):
            high = (x[d] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & (bit - 1))
            x[d] ^= swap if d else 0
            x[0] ^= np.where(high, bit - 1, swap if d else 0)
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ flip) >> b) & 1)
    return key


def curve_key(ids: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A Hilbert key for each document: the mean of its ids' projections, in cells of the curve."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lengths, some = np.maximum(ends - starts, 1), ends > starts
    grid = np.zeros((len(ends), len(table)), np.int64)
    for d, row in enumerate(table):
        sums = np.zeros(len(ends))
        if some.any():
            sums[some] = np.add.reduceat(row[ids], starts[some], dtype=np.float64)
        grid[:, d] = np.clip((sums / lengths / REACH + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(grid)


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (16 or 32 bits each, little-endian, with the end id) and the key on the curve."""
    wide = piece_encoder(tokenizer).tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer)
        table = projection(encoder.tokenizer.get_vocab_size())
        for batch in rows_within(batches, 1):
            ids, ends = encoder.encode(batch.column(1))
            flat = np.full(len(ids) + len(ends), end_id, "<u4" if wide else "<u2")
            inside = np.ones(len(flat), bool)
            inside[ends + np.arange(len(ends))] = False
            flat[inside] = ids
            bounds = np.concatenate([[0], (ends + np.arange(1, len(ends) + 1)) * flat.itemsize])
            blobs = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)])
            yield pa.record_batch([batch.column(0), blobs.cast(pa.binary()), pa.array(curve_key(ids, ends, table))], names=["doc_id", "ids", "key"])

    return documents(docs).mapInArrow(task, "doc_id long, ids binary, key long")


def pack(vectors: DataFrame, length: int, width: int, parts: int | None = None) -> DataFrame:
    """The pieces of all documents in sequences of `length` ids, in the order of the curve.

    Each part of the curve is cut every `length` ids. What is left at a part's end becomes sequences of sizes that
    are powers of two, so that nothing is filled up. Equal keys are ordered by doc_id, and ranges may part them.
    """
    spark = vectors.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sequence, room, rows = TaskContext.get().partitionId(), 0, length, []
        waiting: list[tuple[int | None, bytes, int]] = []  # what may stand in the last, short sequence
        held = 0

        def cut(found, sizes):
            """Deals ids out to sequences of the given sizes."""
            nonlocal sequence
            left, offset = next(sizes), 0
            for doc_id, blob, total, begin in found:
                at, count = 0, len(blob) // width
                while at < count:
                    if left == 0:
                        sequence, left, offset = sequence + 1, next(sizes), 0
                    take = min(left, count - at)
                    ids = np.frombuffer(blob, f"<u{width}", take, at * width)
                    rows.append((part, doc_id, begin + at, take, zlib.crc32(ids.astype("<u4")), total, sequence, offset))
                    at, left, offset = at + take, left - take, offset + take
            if offset:
                sequence += 1

        def batch_out():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [pa.int32(), *[pa.int64()] * 7]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, total, at = blob.as_buffer(), blob.as_buffer().size // width, 0
                while held + total - at >= length:  # the sequence is full
                    take = length - held
                    waiting.append((doc_id, ids[at * width : (at + take) * width], total, at))
                    cut(waiting, iter([length]))
                    at, held = at + take, 0
                    waiting.clear()
                if at < total:
                    waiting.append((doc_id, ids[at * width :], total, at))
                    held += total - at
            if rows:
                yield batch_out()
        if held:
            cut(waiting, iter([1 << b for b in range(length.bit_length(), -1, -1) if held >> b & 1]))
        if rows:
            yield batch_out()

    parts = parts or parts_for(vectors, "ids")
    ordered = vectors.repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    pieces = stored(ordered.select("doc_id", "ids").mapInArrow(task, PIECES), "pieces")
    sizes = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("size"))
    before = part_starts(spark, sizes, "part", "size")
    return pieces.join(F.broadcast(before), "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("sequence")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Packs every document. A null or empty text is its end id alone; repeated rows are documents of their own; no rows give none."""
    wide = piece_encoder(tokenizer).tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    return pack(stored(encoded(docs, tokenizer, end_id), "encoded"), length, 4 if wide else 2)
