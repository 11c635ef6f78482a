"""Near-duplicates: fast similarity sketches, bands, and exact checks of the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, stored
from .graph import components
from .tokens import gather, rows_within
from .words import GOLD, HASHED, WORD_MASK, chain, mix, new_key, shingles


@dataclass(frozen=True)
class Setting:
    """Shingle size in words, least similarity in percent, bins of a sketch and bins in a band.

    With 32 bands of 4 bins a pair of similarity 0.8 shares no band with a probability of 5e-8.
    """

    words: int = 5
    percent: int = 80
    bins: int = 128
    rows: int = 4


#: Unlinked members, and members, of a group that are compared with each other in one task, and their shingles there.
OPEN_BLOCK, ALL_BLOCK = 512, 2048
OPEN_SHINGLES, ALL_SHINGLES = 500_000, 1_500_000


def sketches(found: np.ndarray, offsets: np.ndarray, bins: int) -> np.ndarray:
    """A fast similarity sketch of each set: one row of `bins` numbers.

    In each of the first `bins` rounds every element goes to a random bin, and an empty bin takes its least element.
    A further round for each bin sends all elements there, so that no bin of a set with elements stays empty.
    """
    count = len(offsets) - 1
    out = np.zeros((count, bins), np.uint64)
    filled = np.diff(offsets)[:, None] == np.zeros(bins, int)  # sets without elements stay as they are
    doc = np.repeat(np.arange(count), np.diff(offsets))
    most = np.uint64(WORD_MASK)
    for turn in range(2 * bins):
        open_docs = ~filled.all(axis=1)
        if not open_docs.any():
            break
        keep = open_docs[doc]
        if not keep.all():
            found, doc = found[keep], doc[keep]
        hashed = mix(found + np.uint64((turn + 1) * GOLD & WORD_MASK))
        local = np.cumsum(open_docs) - 1
        least = np.full((int(open_docs.sum()), bins), most)
        place = hashed % np.uint64(bins) if turn < bins else np.uint64(turn - bins)
        np.minimum.at(least.reshape(-1), local[doc] * bins + place.astype(np.int64), hashed // np.uint64(bins))
        rows = np.flatnonzero(open_docs)
        takes = (least != most) & ~filled[rows]
        at, bin_ = np.nonzero(takes)
        out[rows[at], bin_] = mix(least[at, bin_] ^ np.uint64((turn + 1) * TURN & WORD_MASK))
        filled[rows[at], bin_] = True
    return out


#: Fixed value: keeps equal numbers of different rounds apart.
TURN = 0xA24BAED4963EE407


def _sketch_task(setting: Setting, key: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_within(batches, 1, HASHED):
            found, offsets = shingles(batch.column(1), setting.words, key=key)
            counts = np.diff(offsets)
            values = sketches(found, offsets, setting.bins)
            bands = setting.bins // setting.rows
            keys = chain(values.reshape(-1), setting.rows)[:: setting.rows].reshape(-1, bands) + np.arange(bands, dtype=np.uint64) * np.uint64(GOLD)
            sums = [np.concatenate([[0], np.cumsum(mix(found ^ np.uint64(s)), dtype=np.uint64)]).astype(np.uint64) for s in (1, 2)]
            digests = np.stack([s[offsets[1:]] - s[offsets[:-1]] for s in sums], axis=1)
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array([x.tobytes() for x in digests], pa.binary()), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array([x.tobytes() for x in values.astype(np.uint8)], pa.binary())],
                names=["doc_id", "version", "n_shingles", "digest", "bands", "sketch"],
            )

    return task


def _linked(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """For pairs of sets, left[a] and right[b], whether their similarity is high enough."""
    sizes_a, sizes_b = np.diff(left[1])[a], np.diff(right[1])[b]
    out = np.zeros(len(a), bool)
    fits = np.flatnonzero(100 * np.minimum(sizes_a, sizes_b) >= percent * np.maximum(sizes_a, sizes_b))
    step = 2_000_000
    cost = np.cumsum(sizes_a[fits] + sizes_b[fits])
    at = 0
    while at < len(fits):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + step)))
        part = fits[at:to]
        both, row = [], []
        for (found, offsets), chosen, size in ((left, a[part], sizes_a[part]), (right, b[part], sizes_b[part])):
            ends = np.cumsum(size)
            both.append(found[np.repeat(offsets[chosen] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)])
            row.append(np.repeat(np.arange(len(part)), size))
        values, rows = np.concatenate(both), np.concatenate(row)
        order = np.argsort(values, kind="stable")
        order = order[np.argsort(rows[order], kind="stable")]
        values, rows = values[order], rows[order]
        shared = np.bincount(rows[1:][(values[1:] == values[:-1]) & (rows[1:] == rows[:-1])], minlength=len(part))
        out[part] = 100 * shared >= percent * (sizes_a[part] + sizes_b[part] - shared)
        at = to
    return out


def _confirm_task(setting: Setting, key: int):
    """Rows of star, star_version, member, member_version, star_text, text, in the order of the first two: whether each pair is linked."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_within(rows_within(batches, 4), 5):
            stars, versions = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            starts = np.concatenate([[True], (stars[1:] != stars[:-1]) | (versions[1:] != versions[:-1])])[: len(stars)]
            a = np.cumsum(starts) - 1
            left, right = (shingles(x, setting.words, key=key) for x in (batch.column(4).take(pa.array(np.flatnonzero(starts))), batch.column(5)))
            linked = _linked(left, right, a, np.arange(len(stars)), setting.percent)
            yield pa.record_batch([*batch.columns[:4], pa.array(linked)], names=["star", "star_version", "member", "version", "linked"])

    return task


def _open_task(setting: Setting, key: int):
    """A block of open members and a block of all members of a star: links between different components.

    Two sets of similarity 0.8 agree in 102 of 128 bins on the mean; pairs that agree in fewer than 72 aren't compared,
    which loses one with a probability below 1e-8. A bin's last byte stands for it here.
    """
    need = setting.bins * setting.percent * 45 // 6400

    def task(got: pa.Table) -> pa.Table:
        got = got.combine_chunks()
        is_open = got.column("open").to_numpy()
        ids, group, sizes = (got.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
        marks = np.frombuffer(b"".join(got.column("sketch").to_pylist()), np.uint8).reshape(-1, setting.bins)
        ours, others, met = np.flatnonzero(is_open), np.flatnonzero(~is_open), []
        for row in ours:
            fits = 100 * np.minimum(sizes[row], sizes[others]) >= setting.percent * np.maximum(sizes[row], sizes[others])
            other = others[fits & (group[others] != group[row]) & (ids[others] != ids[row])]
            met.append(other[np.count_nonzero(marks[other] == marks[row], axis=1) >= need])
        used = np.unique(np.concatenate([*(x for x in met if len(x)), ours[[len(x) > 0 for x in met]], np.zeros(0, np.int64)]))
        found, offsets = shingles(got.column("text").take(pa.array(used)).combine_chunks(), setting.words, key=key)
        edges: list[tuple[int, int]] = []
        for row, other in zip(ours, met, strict=True):
            if not len(other):
                continue
            own, at = np.searchsorted(used, row), np.searchsorted(used, other)
            mine = found[offsets[own] : offsets[own + 1]]
            theirs, ends = gather(found, offsets[at], np.diff(offsets)[at])
            same = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            shared, total = np.diff(np.concatenate([[0], np.cumsum(same)])[np.concatenate([[0], ends])]), len(mine) + np.diff(ends, prepend=0)
            hit = other[100 * shared >= setting.percent * (total - shared)]
            _, one = np.unique(group[hit], return_index=True)  # a link to each component is enough
            edges += [(int(ids[row]), int(ids[x])) for x in hit[one]]
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([x for _, x in edges], pa.int64())})

    return task


def near_duplicates(docs: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Equal sets are one node, named by their least doc_id. The nodes that share a band form a bucket, whose least node
    is its star. All buckets with one star are one group: each member is compared with the star; a member that isn't
    linked to it is open and is compared with the group's members of other components, block by block. So each pair
    that shares a band is linked, known to be in one component, or compared, and no bucket is gathered in one task.

    Rows that share a doc_id but differ in text are versions of one document: each version is compared by its own
    text, and all their links lead to one component. Null texts are empty; texts without words are linked with
    nothing, not even by their doc_id. A row with a null doc_id takes the component of a doc_id with an equal set and
    isn't kept; if there is none, it stays alone and is kept.

    Both sides of a join grow with the corpus, so the joins are merges at every size.
    """
    key = new_key()
    docs = documents(docs).withColumn("version", F.xxhash64("text"))
    sketched = stored(docs.mapInArrow(_sketch_task(setting, key), "doc_id long, version long, n_shingles long, digest binary, bands array<long>, sketch binary"), "sketches")
    solid = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = stored(solid.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    nodes = solid.select("doc_id", "version", "n_shingles", "digest", "bands").join(classes.withColumnRenamed("node", "doc_id").hint("merge"), ["digest", "n_shingles", "doc_id"], "left_semi")
    keys = nodes.select(F.struct(F.col("doc_id").alias("node"), "version", F.col("n_shingles").alias("size")).alias("key"), F.explode("bands").alias("band"))
    stars = keys.groupBy("band").agg(F.min("key").alias("star"), F.max("key").alias("last")).where("star != last").select("band", "star")
    met = keys.join(stars.hint("merge"), "band").where("star != key")
    pairs = met.select(F.col("star.node").alias("star"), F.col("star.version").alias("star_version"), F.col("key.node").alias("member"), F.col("key.version").alias("version"), F.col("key.size").alias("size"), F.col("star.size").alias("star_size")).distinct()
    pairs = stored(pairs.withColumn("fits", 100 * F.least("size", "star_size") >= setting.percent * F.greatest("size", "star_size")).drop("star_size"), "pairs")

    wanted = pairs.select(F.col("star").alias("doc_id"), F.col("star_version").alias("version")).union(pairs.select("member", "version")).distinct()
    texts = stored(docs.join(wanted.hint("merge"), ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"]), "texts")
    both = pairs.where("fits").join(texts.select(F.col("doc_id").alias("member"), "version", "text").hint("merge"), ["member", "version"])
    both = both.join(texts.select(F.col("doc_id").alias("star"), F.col("version").alias("star_version"), F.col("text").alias("star_text")).hint("merge"), ["star", "star_version"])
    both = both.select("star", "star_version", "member", "version", "star_text", "text")
    checked = stored(both.mapInArrow(_confirm_task(setting, key), "star long, star_version long, member long, version long, linked boolean"), "checked")
    edges = checked.where("linked").select(F.col("star").alias("a"), F.col("member").alias("b")).union(_shared_ids(solid, classes))
    known = components(edges)

    edges = edges.union(_open_edges(pairs, checked, known, texts, sketched, setting, key))
    known = components(edges)
    member = classes.join(known, "node", "left").select("digest", "n_shingles", F.coalesce("component", "node").alias("component"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(member.hint("merge"), ["digest", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _shared_ids(solid: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of each doc_id that has several texts with the nodes of all of them."""
    several = solid.groupBy("doc_id").agg(F.min("version").alias("low"), F.max("version").alias("high")).where("low != high").select("doc_id")
    rows = solid.select("doc_id", "digest", "n_shingles").join(several.hint("merge"), "doc_id", "left_semi")
    return rows.join(classes.hint("merge"), ["digest", "n_shingles"]).where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def _open_edges(pairs: DataFrame, checked: DataFrame, known: DataFrame, texts: DataFrame, sketched: DataFrame, setting: Setting, key: int) -> DataFrame:
    """Links of members that aren't linked to their star with members of other components of the same star.

    A group is cut into blocks of bounded rows and shingles; groups without open members, or with one member, make none.
    """
    at, star = ["star", "star_version", "member", "version"], ["star", "star_version"]
    rows = pairs.join(checked.hint("merge"), at, "left").select(*at, "size", (~F.coalesce("linked", F.lit(False))).alias("is_open"))
    rows = stored(rows.join(known.withColumnRenamed("node", "member").hint("merge"), "member", "left").select(*at, "size", "is_open", F.coalesce("component", "member").alias("component")), "members")
    number = lambda column, most: F.ceil(F.sum(column) / most)
    is_open = F.col("is_open").cast("long")
    groups = rows.groupBy(*star).agg(
        F.greatest(number(is_open, OPEN_BLOCK), number(is_open * F.col("size"), OPEN_SHINGLES)).alias("across"),
        F.greatest(number(F.lit(1), ALL_BLOCK), number("size", ALL_SHINGLES)).alias("down"),
        F.sum(is_open).alias("open_rows"), F.count("*").alias("all_rows"), F.min("component").alias("low"), F.max("component").alias("high"),
    )
    groups = stored(groups.where("open_rows > 0 and all_rows > 1 and low < high").select(*star, "across", "down"), "groups")
    rows = rows.join(groups, star).select(*star, F.col("member").alias("node"), "version", F.col("size").alias("n_shingles"), "is_open", "component", "across", "down")
    spot = F.xxhash64("node", "version")
    common = [*star, "node", "version", "n_shingles", "component"]
    opened = rows.where("is_open").select(*common, F.lit(True).alias("open"), F.pmod(spot, F.col("across")).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("y"))
    others = rows.select(*common, F.lit(False).alias("open"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("x"), F.pmod(spot, F.col("down")).alias("y"))
    one = ["node", "version"]
    needed = rows.select(*one).distinct()
    marks = sketched.select(F.col("doc_id").alias("node"), "version", "sketch").join(needed.hint("merge"), one, "left_semi").dropDuplicates(one)
    full = stored(texts.withColumnRenamed("doc_id", "node").join(marks.hint("merge"), one), "marked-texts")
    blocks = opened.union(others).join(full.hint("merge"), one)
    return stored(blocks.groupBy(*star, "x", "y").applyInArrow(_open_task(setting, key), "a long, b long"), "open-links")
