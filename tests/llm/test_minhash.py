import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import graph, minhash
from tidewater.llm.words import shingles
from tidewater.llm.words import words as words_of

from .fixtures import AWKWARD, frame, small, thue_morse


def sets(texts, size):
    out = []
    for text in texts:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return out


def brute(texts, size, percent=80):
    found = sets(texts, size)
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(found):
        for j in range(i):
            b = found[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [(len(s), top(k)) for k, s in enumerate(found)]


def near(count=60, seed=3):
    """Groups of copies with some words changed, so that some pairs are just under and some just over the limit."""
    rng = random.Random(seed)
    out = []
    for _ in range(count // 12):
        base = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(120)]
        for k in range(12):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_op6_against_brute_force(spark, sf, size, monkeypatch):
    monkeypatch.setattr(minhash, "OPEN_BLOCK", 2)
    monkeypatch.setattr(minhash, "ALL_BLOCK", 4)
    monkeypatch.setattr(minhash, "ALL_SHINGLES", 300)
    texts = AWKWARD + near() + small(spark, sf) + ["x", "X", "one two", "ONE two\n", "one two "]
    want = brute(texts, size)
    rows = minhash.near_duplicates(frame(spark, texts), minhash.Setting(words=size)).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_no_rows_and_repeated_ids(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = minhash.near_duplicates(frame(spark, ["a b c d e f", "a b c d e f", "q", "q"], [4, 4, None, 7])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, 7, False), (4, 4, True), (4, 4, True), (7, 7, True)]


def test_sketches_fill_every_bin_and_estimate():
    texts = ["x"] + near(24)
    found, offsets = shingles(pa.array(texts), 2)
    got = minhash.sketches(found, offsets, 64)
    assert (got != 0).all()
    exact = sets(texts, 2)
    miss = [(got[i] == got[j]).mean() - len(exact[i] & exact[j]) / len(exact[i] | exact[j]) for i in range(len(texts)) for j in range(i)]
    assert abs(np.mean(miss)) < 0.02 and np.max(np.abs(miss)) < 0.3


def test_words_do_not_depend_on_what_stands_around_them():
    texts = ["a bb  ccc " * 400, "", "x" * 999 + " y", " ".join(near(24)), "é\u3000z\x1cq", "x" * 998 + "z", "abcdefgh abcdefgh\0 abcdefg", " ".join("abcdefghijklmnopqrstuvwxyz"[:k] for k in range(27))]
    hashes, offsets = words_of(pa.array(texts), key=5)
    spelt = [w for t in texts for w in t.encode().split()]
    assert [int(n) for n in np.diff(offsets)] == [len(t.encode().split()) for t in texts]
    number = {}
    assert all(number.setdefault(w, h) == h for w, h in zip(spelt, hashes.tolist(), strict=True)) and len(set(number.values())) == len(number)
    alone = np.concatenate([words_of(pa.array([t]), key=5)[0] for t in texts])
    assert (alone == hashes).all() and not (words_of(pa.array(texts), key=6)[0] == hashes).any()


def test_words_whose_polynomials_meet_share_no_shingle(spark):
    one, other = thue_morse()
    rows = minhash.near_duplicates(frame(spark, [f"{one} {one}", f"{other} {other}", one, other, f"{one} {one}"]), minhash.Setting(words=2)).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 0)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 460)]
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in low.items() if k in got} and all(a == b or a in got for a, b in edges)


def test_texts_that_share_an_id_lead_to_one_component(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcde")
    texts = [a, b, c, a + " more", b + " more", c + " more", d, d, e, e + " more"]
    ids = [5, 5, 5, 6, 7, 8, 12, 18, 18, 19]
    rows = minhash.near_duplicates(frame(spark, texts, ids)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(5, 5, True)] * 3 + [(6, 5, False), (7, 5, False), (8, 5, False), (12, 12, True), (18, 12, False), (18, 12, False), (19, 12, False)]
