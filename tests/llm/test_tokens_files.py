import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidewater.llm import arrowfile, packing
from tidewater.llm.tokens import PieceEncoder, vocabulary

from .fixtures import AWKWARD, frame, small

BYTES = "byte_bpe_50k.json"


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def whole(texts):
    t = Tokenizer.from_file(vocabulary(BYTES))
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_pieces_give_the_ids_of_whole_texts(spark, sf):
    texts = [x or "" for x in AWKWARD] + small(spark, sf)
    want = whole(texts)
    encoder = PieceEncoder(vocabulary(BYTES))
    for part in (texts, [x for x in texts if "\U0010ffff" not in x]):
        ids, ends = encoder.encode(pa.array(part))
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [w for x, w in zip(texts, want, strict=True) if x in set(part)]


def test_op8_files(spark, sf, monkeypatch):
    monkeypatch.setattr(arrowfile, "FILE_IDS", 5000)
    texts = AWKWARD + small(spark, sf)
    docs = frame(spark, texts)
    folder = arrowfile.folder(spark)
    notes = arrowfile.write(docs, folder, vocabulary(BYTES), 2)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in arrowfile.digests(notes).collect()}
    at = 0
    for k, ids in enumerate(whole(texts)):
        assert got[k] == (at, len(ids) + 1, crc([*ids, 2]))
        at += len(ids) + 1
    first = notes.orderBy("doc_id").first()
    ids, mask = arrowfile.Reader(first.file).sequence(0)
    assert len(ids) == len(mask) == arrowfile.LENGTH and ids[0] == 2 and mask[0]
    assert arrowfile.digests(arrowfile.write(docs.limit(0), arrowfile.folder(spark), vocabulary(BYTES), 2)).count() == 0


def test_op9_pieces(spark, sf):
    texts = AWKWARD + small(spark, sf)
    rows = packing.pack_documents(frame(spark, texts), vocabulary(BYTES)).collect()
    want = [[*x, 1] for x in whole(texts)]
    documents, sequences = {}, {}
    for r in rows:
        assert r.doc_tokens == len(want[r.doc_id]) and 0 < r.length <= 2048
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length])
        documents.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, sizes in ((documents, {k: len(x) for k, x in enumerate(want)}), (sequences, None)):
        for k, parts in spans.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == sizes[k] if sizes else at <= 2048 and at & (at - 1) == 0
    assert len(documents) == len(texts)
    assert packing.pack_documents(frame(spark, []), vocabulary(BYTES)).count() == 0


def test_hilbert_walks_from_neighbour_to_neighbour():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.array(list(np.ndindex(*[1 << bits] * dims)))
        order = grid[np.argsort(packing.hilbert(grid, bits))]
        assert sorted(packing.hilbert(grid, bits)) == list(range(len(grid)))
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_forgetting_changes_no_ids():
    """A memory that is full time and again gives the ids of one that holds everything."""
    from tidewater.llm.tokens import Remembered

    rng = np.random.default_rng(3)
    calls = []

    def encode(strings):
        calls.extend(strings)
        return strings[::-1], np.array([ord(c) for x in strings[::-1] for c in x], np.uint32), np.array([len(x) for x in strings[::-1]], np.int64)

    memory = Remembered(encode, 40)
    for k in range(60):
        strings = ["the", "of", *{f"w{n}" for n in rng.integers(0, 10 + 5 * k, 25).tolist()}, ""]
        numbers = memory(strings)
        got = ["".join(map(chr, memory.ids[a:b])) for a, b in zip(memory.ends[numbers], memory.ends[numbers + 1])]
        assert got == strings and len(memory.numbers) == len(memory.ends) - 1 == len(memory.again) <= 40 + len(strings)
    assert calls.count("the") < 6 and len(calls) > 400  # early on, all that was met again is over half of the memory


def test_repeated_and_null_ids(spark, monkeypatch):
    """Each row is a document of its own, whatever its id; the last sequence's mask covers its ids alone."""
    texts = ["a b c", "a b c", None, "", "x y z " * 900, "q"]
    docs = frame(spark, texts, [7, 7, None, None, 3, 9])
    want = sorted((len(x) + 1, crc([*x, 1])) for x in whole(texts))
    pieces = packing.pack_documents(docs, vocabulary(BYTES)).collect()
    assert sum(r.length for r in pieces) == sum(n for n, _ in want) and {r.doc_id for r in pieces} == {7, None, 3, 9}
    assert sorted((r.doc_tokens, r.ids_crc32) for r in pieces if r.length == r.doc_tokens) == [w for w in want if w in {(r.doc_tokens, r.ids_crc32) for r in pieces}]
    notes = arrowfile.write(docs, arrowfile.folder(spark), vocabulary(BYTES), 2)
    got = arrowfile.digests(notes).collect()
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(x) + 1, crc([*x, 2])) for x in whole(texts))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
