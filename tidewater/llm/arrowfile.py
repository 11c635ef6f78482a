"""Token ids in Arrow IPC files: batches of equal-length fixed-size lists with masks, read again without copies."""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, scratch, stored
from .tokens import piece_encoder, rows_within

#: Ids in a row of a file, rows in a batch, and ids after which a new file begins (at a document's end).
LENGTH, ROWS, FILE_IDS = 1024, 256, 32 << 20
#: Bytes of texts, or of packed ids, that one part of the order gets.
PART_BYTES = 64 << 20
NOTES = "doc_id long, part int, file string, file_start long, part_start long, n_tokens long"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def parts_for(rows: DataFrame, column: str) -> int:
    """So many parts that each gets about PART_BYTES of a column, as many as a shuffle makes at least."""
    total = rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))


class Writer:
    """One Arrow IPC file. Ids run on from row to row; only the last row has a mask with false in it."""

    def __init__(self, path: str, kind: pa.DataType) -> None:
        store, at = filesystem(path)
        self.schema = pa.schema([("ids", pa.list_(kind, LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])
        self.kind, self.held, self.size, self.total = kind, [], 0, 0
        self.out = store.open_output_stream(at)
        self.file = pa.ipc.new_file(self.out, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= LENGTH * ROWS:
            flat, full = np.concatenate(self.held), LENGTH * ROWS
            for at in range(0, len(flat) - full + 1, full):
                self._batch(flat[at : at + full], full)
            self.held = [flat[len(flat) // full * full :]]
            self.size = len(self.held[0])

    def _batch(self, flat: np.ndarray, valid: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(x, LENGTH) for x in (pa.array(flat), pa.array(np.arange(len(flat)) < valid))]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            flat = np.concatenate(self.held)
            self._batch(np.concatenate([flat, np.zeros(-len(flat) % LENGTH, flat.dtype)]), len(flat))
        self.file.close()
        self.out.close()


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Encodes all documents in ascending doc_id order and writes their ids as Arrow files in `folder`.

    Returns where each document stands: its file, its first id in that file and in that part, and its count. A null
    text is an empty one, a null doc_id comes first, rows with one doc_id follow each other by text. A file's name is
    new for each attempt of a task and the returned rows name the files that count, so a repeated task does no harm.
    """
    spark = docs.sparkSession
    kind = pa.uint16() if piece_encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else pa.uint32()
    filesystem(folder)[0].create_dir(filesystem(folder)[1])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = piece_encoder(tokenizer), TaskContext.get().partitionId()
        out, path, start = None, "", 0
        for batch in rows_within(batches, 1):
            ids, ends = encoder.encode(batch.column(1))
            starts, rows = np.concatenate([[0], ends[:-1]]).astype(int), []
            for k, at in enumerate(starts):
                if out is None or out.total >= FILE_IDS:
                    if out is not None:
                        out.close()
                    path = f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.arrow"
                    out = Writer(path, kind)
                rows.append((path, out.total, start, int(ends[k]) - at + 1))
                out.add(ids[at : ends[k]])
                out.add(np.array([end_id]))
                start += rows[-1][-1]
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([batch.column(0), pa.array([part] * len(rows), pa.int32()), pa.array(columns[0]), *(pa.array(x, pa.int64()) for x in columns[1:])], names=[x.split()[0] for x in NOTES.split(", ")])
        if out is not None:
            out.close()

    parts = parts or parts_for(documents(docs), "text")
    ordered = documents(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(task, NOTES), "arrow-notes")


class Reader:
    """Random access to a file's ids. A local file is mapped into memory; its ids are views of the map."""

    def __init__(self, path: str) -> None:
        store, at = filesystem(path)
        self.file = pa.ipc.open_file(pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at))

    @functools.lru_cache(maxsize=4)  # noqa: B019  a reader lives as long as its task
    def _flat(self, batch: int) -> np.ndarray:
        return self.file.get_batch(batch).column("ids").flatten().to_numpy(zero_copy_only=True)

    def ids(self, start: int, count: int) -> np.ndarray:
        full, found = LENGTH * ROWS, []
        while count:
            batch, at = divmod(start, full)
            found.append(self._flat(batch)[at : at + count])
            start, count = start + len(found[-1]), count - len(found[-1])
        return found[0] if len(found) == 1 else np.concatenate(found)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of one row of the file."""
        batch = self.file.get_batch(row // ROWS)
        return tuple(batch.column(c).slice(row % ROWS, 1).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "mask"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened: dict[str, Reader] = {}
    for batch in batches:
        sums = []
        for path, start, count in zip(*(batch.column(c).to_pylist() for c in ("file", "file_start", "n_tokens")), strict=True):
            if path not in opened:
                opened.clear()
                opened[path] = Reader(path)
            sums.append(zlib.crc32(opened[path].ids(start, count).astype("<u4")))
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "part", "part_start", "n_tokens")), pa.array(sums, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def part_starts(spark: SparkSession, sizes: DataFrame, key: str, size: str) -> DataFrame:
    """What all parts before a part hold together. sizes has one row for each part, so they fit in the driver."""
    total, rows = 0, []
    for part, count in sorted((r[key], r[size]) for r in sizes.select(key, size).collect()):
        rows.append((part, total))
        total += count
    return spark.createDataFrame(rows, f"{key} int, before long")


def digests(notes: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read from the files that write() left."""
    sizes = notes.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = part_starts(notes.sparkSession, sizes, "part", "size")
    read = notes.repartition("file").sortWithinPartitions("file", "file_start").mapInArrow(_digests, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def folder(spark: SparkSession) -> str:
    return scratch(spark, "arrow")
