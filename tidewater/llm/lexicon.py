"""A minimal acyclic transducer from words to their ids, as flat arrays in one file that tasks map into memory."""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

from .arrowfile import filesystem


def compile_words(words: list[bytes], ids: list[list[int]]) -> dict[str, np.ndarray]:
    """The least automaton that accepts the words, whose transitions' outputs add up to a word's number.

    Words are added in byte order; when a word leaves the path of the one before, the states left behind are replaced
    by equal ones met earlier, so that suffixes are shared. A transition's output is the number of words that come
    before those behind it in its state. Ids stand in one list, by the words' numbers.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    final: list[bool] = [False]
    edges: list[dict[int, int]] = [{}]
    met: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, byte) of the open word

    def close(depth: int) -> None:
        while len(path) > depth:
            state, byte = path.pop()
            child = edges[state][byte]
            edges[state][byte] = met.setdefault((final[child], *edges[child].items()), child)

    before = b""
    for k in order:
        word = words[k]
        common = 0
        while common < len(before) and common < len(word) and before[common] == word[common]:
            common += 1
        close(common)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for byte in word[common:]:
            final.append(False)
            edges.append({})
            edges[state][byte] = len(edges) - 1
            path.append((state, byte))
            state = len(edges) - 1
        final[state] = True
        before = word
    close(0)

    number, count, todo = {0: 0}, {}, [(0, False)]  # states that are left, and the words behind each
    while todo:
        state, done = todo.pop()
        if done:
            count[state] = final[state] + sum(count[c] for c in edges[state].values())
            continue
        if state in count:
            continue
        todo.append((state, True))
        todo += [(c, False) for c in edges[state].values() if c not in count]
    for state in sorted(count):
        number.setdefault(state, len(number))
    keys, targets, outputs = [], [], []
    for state in number:
        passed = int(final[state])
        for byte, child in sorted(edges[state].items()):
            keys.append(number[state] * 256 + byte)
            targets.append(number[child])
            outputs.append(passed)
            passed += count[child]
    sizes = [len(ids[k]) for k in order]
    return {
        "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "outputs": np.array(outputs, np.int32), "final": np.array([final[s] for s in number], np.uint8),
        "ends": np.cumsum([0, *sizes]).astype(np.int64), "ids": np.array([i for k in order for i in ids[k]], np.uint32),
    }


NAMES = {"keys": np.int64, "ends": np.int64, "targets": np.int32, "outputs": np.int32, "ids": np.uint32, "final": np.uint8}


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: the arrays' lengths, then the arrays, widest numbers first so that each is aligned."""
    store, at = filesystem(path)
    store.create_dir(os.path.dirname(at))
    with store.open_output_stream(at) as out:
        out.write(np.array([len(arrays[n]) for n in NAMES], np.int64).tobytes())
        for name, kind in NAMES.items():
            out.write(arrays[name].astype(kind).tobytes())


class Lexicon:
    """A saved transducer, mapped into memory. A file in a store of another kind is copied to this machine first."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        store, at = filesystem(path)
        if not isinstance(store, fs.LocalFileSystem):
            with store.open_input_stream(at) as source, tempfile.NamedTemporaryFile(delete=False) as copy:
                shutil.copyfileobj(source, copy)
            at = copy.name
        flat, start = np.memmap(at, np.uint8, "r"), 8 * len(NAMES)
        for (name, kind), count in zip(NAMES.items(), flat[:start].view(np.int64).tolist(), strict=True):
            end = start + count * np.dtype(kind).itemsize
            setattr(self, name, flat[start:end].view(kind))
            start = end

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for unknown ones; all words take their next step together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if not len(self.keys):
            return np.full(len(words), -1)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts, step = np.cumsum(sizes) - sizes, 0
        live = np.flatnonzero(sizes > 0)
        state[sizes == 0] = -1
        while len(live):
            key = state[live] * 256 + flat[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[live] = np.where(hit, self.targets[at], -1)
            total[live] += self.outputs[at]
            step += 1
            live = live[hit & (sizes[live] > step)]
        return np.where((state >= 0) & (self.final[np.maximum(state, 0)] > 0), total, -1)
