"""Words of many texts at once, as 64-bit hashes: arithmetic of numpy on the UTF-8 bytes of a column."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers and the increments of a 64-bit mixing function.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
GOLD, PAIR = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
WORD_MASK = (1 << 64) - 1
#: Bytes of text that tasks hash at once; the arrays of a batch take some forty times as much.
HASHED = 3 << 19
#: Bytes of a word beyond which the xxhash library hashes it.
LONG = 512

BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def new_key() -> int:
    """A key for the hashes of one run, drawn in the driver, so that nobody can prepare texts whose hashes meet."""
    return int.from_bytes(os.urandom(8), "little")


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    return mix(a * np.uint64(PAIR) + b)


def chain(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of hashes[i : i + length] for each i, from those of runs whose lengths are powers of two."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    out, done, span, whole = None, 0, 1, hashes
    while True:
        if length & span:
            done += span
            count = len(hashes) - done + 1
            out = whole[:count] if out is None else pair(whole[:count], out[span : span + count])
        if 2 * span > length:
            return out
        whole, span = pair(whole[: len(whole) - span], whole[span:]), 2 * span


def spelled(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """A keyed hash of the bytes raw[start : end] of each word, eight bytes at a time. Up to eight bytes it is one to one."""
    sizes = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
    out = mix(sizes.astype(np.uint64) * np.uint64(GOLD) + np.uint64(key))
    live, at = np.flatnonzero(sizes <= LONG), 0
    while len(live):
        left = sizes[live] - at
        spare = (8 * np.clip(8 - left, 0, 7)).astype(np.uint64)
        out[live] = mix(out[live] ^ (eights[starts[live] + at] << spare))
        live, at = live[left > 8], at + 8
    for k in np.flatnonzero(sizes > LONG):
        out[k] ^= np.uint64(xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]].tobytes(), key))
    return out


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, where each begins and, last, where they end); nulls are empty."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def words(texts: pa.Array, lower: bool = False, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, for each text where its words begin and, last, where they end).

    Words are runs of characters other than the six ASCII white-space characters; `lower` folds A-Z.
    """
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    raw, offsets = buffer(texts)
    inside = np.ones(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a text's first byte never continues a word of the text before
    begin = inside[1:] & (~inside[:-1] | edge)
    end = inside[:-1] & (~inside[1:] | edge)
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    return spelled(LOWER[raw] if lower else raw, starts, ends, key), np.searchsorted(starts, offsets)


def shingles(texts: pa.Array, size: int, lower: bool = True, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of `size` words of all texts, sorted within each, where each text's begin and, last, end).

    A text with fewer words has its whole sequence as one shingle, a text without words has none.
    """
    hashes, offsets = words(texts, lower, key)
    counts = np.diff(offsets)
    grams = np.where(counts >= size, counts - size + 1, counts > 0)
    doc = np.repeat(np.arange(len(counts)), grams)
    starts = offsets[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams)
    found = np.zeros(len(doc), np.uint64)
    for length in range(1, size + 1):
        mine = np.flatnonzero(counts[doc] == length if length < size else counts[doc] >= size)
        if len(mine):
            found[mine] = chain(hashes, length)[starts[mine]]
    order = np.argsort(found)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(counts) < 1 << 16 else np.int64), kind="stable")]
    found, doc = found[order], doc[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[first], np.searchsorted(doc[first], np.arange(len(counts) + 1))
