import random
import re

import numpy as np
import pytest

from tidewater.llm import substring
from tidewater.llm.fmindex import FMIndex, WaveletMatrix

from .fixtures import AWKWARD, frame, small, thue_morse


def brute(texts, ids, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    least = {}
    for k, w in zip(ids, split, strict=True):
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if k is not None:
                least[key] = min(k, least.get(key, k))
    out = []
    for k, w in zip(ids, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if k is not None and least[tuple(w[i : i + length])] < k:
                gone[i : i + length] = [True] * length
        out.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def passages(seed=5, count=40):
    """Texts that share passages of about 50 words, some within themselves, some periodic."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    shared = [[word() for _ in range(rng.choice([49, 50, 51, 60, 130]))] for _ in range(6)] + [["t", "u"] * 40, ["v"] * 70]
    out = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += [word() for _ in range(rng.randrange(0, 30))] + rng.choice(shared)
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize(("shard", "split"), [(4_000, 1_000), (20, 3)])
def test_op4_against_brute_force(spark, sf, monkeypatch, shard, split):
    monkeypatch.setattr(substring, "SHARD", shard)
    monkeypatch.setattr(substring, "SPLIT", split)
    texts = AWKWARD + passages() + small(spark, sf)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    ids[20], ids[30], ids[31], ids[40] = None, None, ids[32], ids[41]
    got = substring.deduplicate(frame(spark, texts, ids), 50).select("doc_id", "n_words", "n_removed", "kept").collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(map(tuple, got), key=order) == sorted(brute(texts, ids, 50), key=order)


def test_other_lengths_and_no_rows(spark):
    texts = passages(seed=9, count=15)
    got = substring.deduplicate(frame(spark, texts), 20, 7, keep=("lang", "key")).orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in got] == brute(texts, range(len(texts)), 20) and all(r.key == r.doc_id and r.lang == "en" for r in got)
    assert substring.deduplicate(frame(spark, [])).count() == 0


def test_wavelet_matrix_and_index():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 11, 300)
    tree = WaveletMatrix(symbols, 11)
    at, symbol = rng.integers(0, 301, 200), rng.integers(0, 11, 200)
    assert (tree.rank(symbol, at) == [(symbols[:a] == s).sum() for s, a in zip(symbol, at)]).all()


def test_matching_statistics_of_texts_that_are_not_indexed():
    """Against all substrings: lengths and least owners, also of words that no passage has."""
    rng = np.random.default_rng(4)
    for turn in range(60):
        signs, length = int(rng.integers(1, 5)), int(rng.integers(1, 7))
        passages = [rng.integers(0, signs, rng.integers(0, 30)).astype(np.uint64) for _ in range(turn % 8)]
        owners = rng.integers(0, 100, len(passages))
        least = {}
        for p, o in zip(passages, owners.tolist(), strict=True):
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    key = p[i:j].tobytes()
                    least[key] = min(o, least.get(key, o))
        texts = [rng.integers(0, signs + 1, rng.integers(0, 30)).astype(np.uint64) for _ in range(9)]
        lengths, found, base = FMIndex(passages, owners, length).match(texts)
        for t, at in zip(texts, base, strict=True):
            for i in range(len(t)):
                most = max([n for n in range(1, len(t) - i + 1) if t[i : i + n].tobytes() in least], default=0)
                assert lengths[at + i] == most and found[at + i] == (least[t[i : i + length].tobytes()] if most >= length else -1)


def test_backward_search_makes_the_result(spark, monkeypatch):
    """Without matches of the streamed texts nothing is removed."""
    texts = passages(seed=2, count=10)
    monkeypatch.setattr(substring, "_index_task", _blind)
    assert substring.deduplicate(frame(spark, texts)).agg({"n_removed": "sum"}).first()[0] == 0


def _blind(length):
    def task(got):
        import pyarrow as pa

        return pa.table({"anchor": pa.array([], pa.int64()), "segment": pa.array([], pa.int64()), "split": pa.array([], pa.bool_()), "runs": pa.array([], pa.list_(pa.struct([("from", pa.int32()), ("count", pa.int32()), ("first", pa.int64()), ("window", pa.int64())])))})

    return task


def test_words_whose_polynomials_meet(spark):
    """Two words of 1,024 letters that polynomial hashes modulo 2**64 can't part are different words."""
    one, other = thue_morse()
    common = " ".join(f"w{k}" for k in range(30))
    texts = [" ".join([common, one, *(f"a{k}" for k in range(30))]), " ".join([common, other, *(f"a{k}" for k in range(30))])]
    assert [r.n_removed for r in substring.deduplicate(frame(spark, texts)).collect()] == [0, 0]


def test_repeated_rows_lose_the_same_words(spark):
    texts = passages(seed=7, count=6)
    got = substring.deduplicate(frame(spark, texts + texts[3:] * 5, [*range(6), *[3, 4, 5] * 5])).collect()
    want = {k: (n, kept) for k, _, n, kept in brute(texts, range(6), 50)}
    assert len(got) == 21 and all((r.n_removed, r.kept) == want[r.doc_id] for r in got)
