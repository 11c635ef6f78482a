import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from tidewater.llm import bpe, lexicon
from tidewater.llm.tokens import vocabulary

from .fixtures import AWKWARD, frame, small

PATH = vocabulary("word_bpe_49k.json")


def wild(count=1500, seed=6):
    rng = random.Random(seed)
    signs = [" ", " ", "\n", "\t", "a", "the", "ing", "'s", "'ll", "1", "é", "É", "é", "ΑΣ", "Σ", "İ", ".", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "\xa0", "　", "\x85", "\x1c", "日本", "ß", "ﬁ", "\U0001f600", "tion"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(count)]


def test_op2_against_the_library(spark, sf):
    texts = AWKWARD + wild() + small(spark, sf) + ["Aa" * 3000]
    tokenizer = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe.encode_decode(frame(spark, texts), PATH, 500).collect()}
    for k, x in enumerate(tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert got[k].ids_sha256 == hashlib.sha256(np.array(x.ids, "<u4").tobytes()).hexdigest(), texts[k]
        assert got[k].n_tokens == len(x.ids)
        assert got[k].decoded_sha256 == hashlib.sha256(tokenizer.decode(x.ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(frame(spark, []), PATH).count() == 0


def test_side_by_side_merges_are_those_of_the_heap():
    rng = random.Random(3)
    words = ["".join(rng.choice("abeinorst'éß1") for _ in range(rng.randrange(1, 90))).encode() for _ in range(400)]
    model = bpe.word_bpe(PATH)
    ids, sizes = model.merge_all(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [model.merge(w) for w in words]


def test_transducer(tmp_path):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))).encode() + rng.choice([b"", b"ing", b"ings"]) for _ in range(900)})
    rng.shuffle(words)
    ids = [[k, len(w)][: 1 + k % 2] for k, w in enumerate(words)]
    arrays = lexicon.compile_words(words, ids)
    assert len(arrays["final"]) < sum(map(len, words)) / 3
    lexicon.save(arrays, f"{tmp_path}/x/words.bin")
    found = lexicon.Lexicon(f"{tmp_path}/x/words.bin")
    got = found.numbers(words)
    assert [found.ids[found.ends[n] : found.ends[n + 1]].tolist() for n in got] == ids
    others = [w for w in (b"", b"zzz", b"abcabcabcabc", b"ing", *[w + b"x" for w in words], *[w[:-1] for w in words]) if w not in set(words)]
    assert (found.numbers(others) == -1).all()
    lexicon.save(lexicon.compile_words([], []), f"{tmp_path}/y/words.bin")
    assert (lexicon.Lexicon(f"{tmp_path}/y/words.bin").numbers([b"a", b""]) == -1).all()


def test_repeated_rows_and_very_long_texts(spark):
    texts = ["a b", "a b", None, "one two three " * 120_000, "y" * 200_000]
    tokenizer = Tokenizer.from_file(PATH)
    got = bpe.encode_decode(frame(spark, texts, [4, 4, None, 9, 9]), PATH, 3).collect()
    want = [(i, len(x.ids), hashlib.sha256(np.array(x.ids, "<u4").tobytes()).hexdigest()) for i, x in zip([4, 4, None, 9, 9], tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False))]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in got), key=repr) == sorted(want, key=repr)
