"""Substring dedup: shards of shared passages, each with a compressed FM-index through which documents are streamed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored
from .fmindex import FMIndex
from .tokens import rows_within
from .words import GOLD, HASHED, chain, new_key, pair, words

#: Words of a window, and of an anchor in it.
LENGTH, GRAM = 50, 16
#: Segments of a shard, and segments of one anchor beyond which it is dealt out to several shards.
SHARD, SPLIT = 4_000, 1_000
RUNS = "array<struct<from: int, count: int, first: long, window: long>>"


def anchors(hashes: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """Runs of windows that share their least gram: (text, first word, windows, anchor, digest of the words).

    Every window of `length` words chooses the least of its grams, the first of equal ones. So equal windows have
    equal anchors, whatever stands around them. A run's first and last window hold all of its words between them.
    """
    counts = np.diff(offsets)
    windows = np.maximum(counts - length + 1, 0)
    total = int(windows.sum())
    if not total:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    grams, whole = chain(hashes, gram), chain(hashes, length)
    wide = length - gram + 1
    keys = np.full(-(-(len(grams) + wide) // wide) * wide, np.uint64((1 << 64) - 1))
    keys[: len(grams)] = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    blocks = keys.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    doc = np.repeat(np.arange(len(counts)), windows)
    start = offsets[:-1][doc] + np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    chosen = (np.minimum(behind[start], ahead[start + wide - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [total]]))
    begin = start[first]
    digest = pair(whole[begin], whole[begin + size - 1]) + size.astype(np.uint64) * np.uint64(GOLD)
    return [doc[first], begin - offsets[:-1][doc[first]], size, grams[chosen[first]], digest]


def _anchor_task(length: int, gram: int, key: int):
    """A row for each text and each of its different segments, with all places where it begins."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_within(batches, 2, HASHED):
            doc, begin, size, anchor, segment = anchors(*words(batch.column(2), key=key), length, gram)
            order = np.lexsort((begin, segment, anchor, doc))
            doc, begin, size, anchor, segment = (x[order] for x in (doc, begin, size, anchor, segment))
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])
            first = np.flatnonzero(new)
            rows = pa.array(doc[first])
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(begin, pa.int32()))
            yield pa.record_batch(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor[first].view(np.int64)), pa.array(segment[first].view(np.int64)), pa.array(size[first].astype(np.int16)), places],
                names=["doc_id", "part", "anchor", "segment", "windows", "begins"],
            )

    return task


def _segment_task(length: int, key: int):
    """The words of the wanted segments of each text, as hashes."""
    names = ["shard", "split", "indexed", "streamed", "anchor", "segment"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_within(batches, 1, HASHED):
            hashes, offsets = words(batch.column(1), key=key)
            lists = batch.column(2)
            rows = lists.flatten()
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            begin = offsets[doc] + rows.field("begin").to_numpy(zero_copy_only=False)
            end = begin + rows.field("windows").to_numpy(zero_copy_only=False) - 1 + length
            blobs = [hashes[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
            yield pa.record_batch([*(rows.field(n) for n in names), batch.column(0).take(pa.array(doc)), pa.array(blobs, pa.binary())], names=[*names, "owner", "words"])

    return task


def _index_task(length: int):
    """A shard: its owners' segments are indexed, the others' are streamed through the index."""

    def task(got: pa.Table) -> pa.Table:
        got = got.combine_chunks()
        pairs = np.stack([got.column(c).to_numpy() for c in ("anchor", "segment")], axis=1)
        got = got.take(pa.array(np.unique(pairs, axis=0, return_index=True)[1]))  # a repeated row of docs gives its segments again
        passages = [np.frombuffer(x, "<u8") for x in got.column("words").to_pylist()]
        indexed, streamed = (np.flatnonzero(got.column(c).to_numpy(zero_copy_only=False)) for c in ("indexed", "streamed"))
        index = FMIndex([passages[k] for k in indexed], got.column("owner").to_numpy()[indexed], length)
        lengths, owners, base = index.match([passages[k] for k in streamed])
        split, kept, runs = got.column("split").to_numpy(zero_copy_only=False), [], []
        for k, at in zip(streamed, base, strict=True):
            count = len(passages[k]) - length + 1
            long_enough, first = lengths[at : at + count] >= length, owners[at : at + count]
            new = np.ones(count, bool)
            new[1:] = (first[1:] != first[:-1]) | split[k]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, count))
            window = chain(passages[k], length)[starts].view(np.int64) if split[k] else np.zeros(len(starts), np.int64)
            use = long_enough[starts]
            if use.any():
                kept.append(k)
                runs.append([{"from": f, "count": c, "first": o, "window": w} for f, c, o, w in zip(*(x[use].tolist() for x in (starts, sizes, first[starts], window)), strict=True)])
        rows = got.take(pa.array(kept, pa.int64()))
        kind = pa.list_(pa.struct([("from", pa.int32()), ("count", pa.int32()), ("first", pa.int64()), ("window", pa.int64())]))
        return pa.table({"anchor": rows.column("anchor"), "segment": rows.column("segment"), "split": rows.column("split"), "runs": pa.array(runs, kind)})

    return task


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, part and spans: the words (from, to) covered by windows that also start in a document with a smaller id.

    docs has doc_id, part (a number for rows that share a doc_id) and text. Each window belongs to the anchor that it
    chooses, and windows in a row with one anchor make a segment, which a document has once however often it repeats
    it. Only anchors of several documents go on. A segment is indexed if its least document isn't the anchor's last
    one, and streamed if some document behind the anchor's first one has it. A shard holds whole anchors: the words of
    its streamed segments run through its FM-index, whose matching statistics say where `length` words and more stand
    in the index, and each such match knows its least owner. Segments of an anchor with very many of them are dealt
    out to shards, indexed and streamed there, and the least owner over all shards is taken by the window's hash.
    A document then loses the windows whose least owner is below its own id.

    Tables that a later join meets by a hot key are written first, so that Spark can split their large partitions.
    """
    key = new_key()
    found = stored(docs.where("doc_id is not null").select("doc_id", "part", "text").mapInArrow(_anchor_task(length, gram, key), "doc_id long, part long, anchor long, segment long, windows short, begins array<int>"), "anchors")
    several = stored(found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"), "several")
    shared = stored(found.join(several.hint("merge"), "anchor"), "shared")

    least = F.min(F.struct("doc_id", "part", F.col("begins")[0].alias("begin"), "windows")).alias("at")
    segments = shared.groupBy("anchor", "segment").agg(least, F.max("doc_id").alias("last"), F.first("low").alias("low"), F.first("high").alias("high"))
    segments = stored(segments.select("anchor", "segment", "at.*", (F.col("at.doc_id") < F.col("high")).alias("indexed"), (F.col("last") > F.col("low")).alias("streamed")), "segments")
    shards = max(1, -(-segments.count() // SHARD))
    sizes = stored(segments.groupBy("anchor").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts")), "sizes")
    split = F.col("parts") > 1
    dealt = segments.join(sizes.hint("merge"), "anchor").select("doc_id", "part", F.struct(
        F.pmod(F.xxhash64("anchor", F.pmod("segment", F.col("parts"))), F.lit(shards)).cast("int").alias("shard"), split.alias("split"), (F.col("indexed") | split).alias("indexed"), (F.col("streamed") | split).alias("streamed"),
        "anchor", "segment", "begin", "windows").alias("one"))
    wanted = dealt.groupBy("doc_id", "part").agg(F.collect_list("one").alias("wanted"))
    sent = docs.select("doc_id", "part", "text").join(wanted, ["doc_id", "part"]).select("doc_id", "text", "wanted").mapInArrow(_segment_task(length, key), "shard int, split boolean, indexed boolean, streamed boolean, anchor long, segment long, owner long, words binary")
    matched = stored(sent.groupBy("shard").applyInArrow(_index_task(length), f"anchor long, segment long, split boolean, runs {RUNS}"), "matched")

    windows = matched.where("split").select("anchor", "segment", F.inline("runs"))
    over = stored(windows.groupBy("anchor", "window").agg(F.min("first").alias("first")), "least-owners")
    merged = windows.drop("first").join(over.hint("merge"), ["anchor", "window"]).groupBy("anchor", "segment").agg(F.collect_list(F.struct("from", "count", "first", "window")).alias("runs"))
    owners = matched.where("not split").select("anchor", "segment", "runs").union(merged)
    owners = stored(owners.withColumn("low", F.array_min(F.transform("runs", lambda run: run["first"]))), "owners")
    hit = shared.drop("low", "high").join(owners.hint("merge"), ["anchor", "segment"]).where("low < doc_id")

    def spans(begin):
        mine = F.filter("runs", lambda run: run["first"] < F.col("doc_id"))
        return F.transform(mine, lambda run: F.struct((begin + run["from"]).alias("from"), (begin + run["from"] + run["count"] - 1 + length).alias("to")))

    hit = hit.select("doc_id", "part", F.flatten(F.transform("begins", spans)).alias("mine"))
    return hit.groupBy("doc_id", "part").agg(F.flatten(F.collect_set("mine")).alias("spans"))


def _remove_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_within(batches, 1):
        kept, counts, removed = [], [], []
        lists = batch.column(2)
        for text, spans in zip(batch.column(1).to_pylist(), lists, strict=True):
            found = text.encode("utf-8", "surrogatepass").split()
            if spans.is_valid and len(spans):
                depth = np.zeros(len(found) + 1, np.int64)
                np.add.at(depth, spans.values.field("from").to_numpy(), 1)
                np.add.at(depth, spans.values.field("to").to_numpy(), -1)
                gone = np.cumsum(depth)[:-1] > 0
                left = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
            else:
                left = found
            counts.append(len(found))
            removed.append(len(found) - len(left))
            kept.append(b" ".join(left))
        yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (counts, removed)), pa.array(kept, pa.binary()).cast(pa.string()), *batch.columns[3:]], names=["doc_id", "n_words", "n_removed", "kept", *batch.schema.names[3:]])


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row, and columns to keep.

    Windows are judged on the input. A null text has no words. A null doc_id is neither smaller nor larger than
    another, so its text stays whole. Rows that share a doc_id don't take words from each other.
    """
    others = [F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("part"), *others)
    spans = repeated_spans(rows, length, gram)
    joined = rows.join(spans, ["doc_id", "part"], "left").select("doc_id", "text", "spans", *(f"kept_{k}" for k in range(len(keep))))
    kinds = "".join(f", kept_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    out = joined.mapInArrow(_remove_task, f"doc_id long, n_words long, n_removed long, kept string{kinds}")
    return out.select("doc_id", "n_words", "n_removed", "kept", *(F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)))
