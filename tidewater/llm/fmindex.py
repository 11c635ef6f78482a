"""A compressed full-text index over sequences of numbers: suffix order, wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with running counts, for rank."""

    def __init__(self, bits: np.ndarray) -> None:
        self.size = len(bits)
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """rank of any symbol before any place, a bit of the symbol at each level."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels, self.zeros = [], []
        self.depth = max(1, int(size - 1).bit_length())
        current = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = (current >> level) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        self.first = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.first[symbol]


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each place) of keys; equal keys share a rank."""
    order = np.argsort(keys, kind="stable")
    step = np.ones(len(keys), np.int64)
    step[1:] = keys[order][1:] != keys[order][:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(step) - 1
    return order, out


def _shared(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many numbers each row's suffix begins with that the row before begins with too; -1 at both ends.

    ranks[k] orders places by 2**k numbers, so equal ranks are that many equal numbers.
    """
    size = len(order)
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(size - 1, np.int32)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        inside = np.flatnonzero(np.maximum(a, b) < size)
        same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
        a[same] += step
        b[same] += step
        out[same] += step
    return np.concatenate([[-1], out, [-1]]).astype(np.int32)


def _smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest place before, and behind, each place that has a smaller value; values begin and end with the least."""
    before, behind = np.zeros(len(values), np.int64), np.full(len(values), len(values) - 1, np.int64)
    for value in range(int(values.max()) + 1):
        at = np.flatnonzero(values == value)
        if len(at):
            low = np.flatnonzero(values < value)
            k = np.searchsorted(low, at)
            before[at], behind[at] = low[k - 1], low[k]
    return before, behind


class FMIndex:
    """Over passages of words that each have an owner; `length` words are what counts as a match.

    Rows of the index are all suffixes in order. `shared` says how much each has in common with the row before. A bit
    marks each row whose first `length` words differ from those of the row before, so a rank over these bits names the
    class of a match, and each class knows its least owner.
    """

    def __init__(self, passages: list[np.ndarray], owners: np.ndarray, length: int) -> None:
        self.length = length
        self.values = np.unique(np.concatenate([*passages, np.zeros(0, np.uint64)]))
        if not len(self.values):
            return
        sizes = np.array([len(s) for s in passages])
        total = int(sizes.sum()) + len(passages)
        text = np.zeros(total, np.int64)
        inside = np.ones(total, bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        text[inside] = np.searchsorted(self.values, np.concatenate(passages)) + 1
        keys = text + len(passages)
        keys[~inside] = np.arange(len(passages))  # every end differs, so no match goes beyond one
        order, rank = _ranks(keys)
        ranks = [rank.astype(np.int32)]
        while rank.max() < total - 1:
            span = 1 << (len(ranks) - 1)
            ahead = np.zeros(total, np.int64)
            ahead[:-span] = rank[span:] + 1
            order, rank = _ranks(rank * (total + 1) + ahead)
            ranks.append(rank.astype(np.int32))
        self.size = total
        self.shared = _shared(order, ranks)
        self.up, self.down = _smaller(self.shared)
        edge = (self.shared[:-1] < length).astype(np.uint8)
        self.least = np.minimum.reduceat(np.repeat(owners, sizes + 1)[order], np.flatnonzero(edge))
        self.edges = Bits(edge)
        size = len(self.values) + 1
        self.tree = WaveletMatrix(text[order - 1], size)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])

    def _step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that begin with the symbol and go on as the rows from low to high do."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.before[symbol] + both[: len(low)], self.before[symbol] + both[len(low) :]

    def match(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of texts, which need not be indexed: (how many words from each place on stand somewhere in
        the index, the least owner of the `length` words from there where there are so many, else -1, where each text begins).

        All texts are read from their ends at once. A word before what has been matched is tried by backward search. If
        no row is left, the match gives up words at its end: the least that lets more rows in, as `shared` tells.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(sizes) - sizes
        flat = np.concatenate([*texts, np.zeros(0, np.uint64)])
        lengths, owners = np.zeros(len(flat), np.int32), np.full(len(flat), -1, np.int64)
        if not len(self.values):
            return lengths, owners, base
        symbols = np.searchsorted(self.values, flat)
        symbols = np.where(self.values[np.minimum(symbols, len(self.values) - 1)] == flat, symbols + 1, 0)
        place, stop = (base + sizes - 1)[sizes > 0], base[sizes > 0]
        low, high, depth = np.zeros(len(place), np.int64), np.full(len(place), self.size, np.int64), np.zeros(len(place), np.int32)
        while len(place):
            symbol = symbols[place]
            new_low, new_high = self._step(symbol, low, high)
            found = (symbol > 0) & (new_low < new_high)
            lost = ~found & ((depth == 0) | (symbol == 0))
            less = np.flatnonzero(~found & ~lost)
            a, b = low[less], high[less]
            keep = np.maximum(self.shared[a], self.shared[b])
            low[less], high[less], depth[less] = np.where(self.shared[a] == keep, self.up[a], a), np.where(self.shared[b] == keep, self.down[b], b), keep
            low = np.where(found, new_low, np.where(lost, 0, low))
            high = np.where(found, new_high, np.where(lost, self.size, high))
            depth = np.where(found, depth + 1, np.where(lost, 0, depth))
            lengths[place[found]] = depth[found]
            whole = np.flatnonzero(found & (depth >= self.length))
            owners[place[whole]] = self.least[self.edges.rank(low[whole] + 1) - 1]
            place = np.where(found | lost, place - 1, place)
            live = place >= stop
            if not live.all():
                place, stop, low, high, depth = (x[live] for x in (place, stop, low, high, depth))
        return lengths, owners, base
