"""BPE over words: a lexicon of frequent words, exact merges for all others, and decoding."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, scratch, stored
from .lexicon import Lexicon, compile_words, save
from .tokens import Remembered, gather, listed, rows_within

#: Words of a lexicon at most, from the most frequent ones of all documents. Others are merged.
ENTRIES = 40_000
#: Bytes up to which words are merged side by side.
SHORT = 48
#: No rank, and bits of a symbol's place among those that are merged side by side.
NONE, PLACE = 1 << 20, 40

#: Fixed value: the word pattern of this kind of tokenizer. White space is spelt out as its library has it.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0  -     　\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself where it is visible, else the next one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for byte in range(256):
        out.append(chr(byte if byte in seen else spare))
        spare += byte not in seen
    return out


class WordBpe:
    """What a tokenizer file of this kind says: words end in a suffix, texts are composed (NFC) and in lower case."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = [""] * (max(*vocab.values(), *self.special.values()) + 1)
        for text, number in (*vocab.items(), *self.special.items()):
            self.token[number] = text
        if len(self.token) > 1 << 16:
            raise ValueError("a pair of ids must fit in 32 bits")
        letters = byte_letters()
        self.inside = np.array([vocab[c] for c in letters])
        self.last = np.array([vocab[c + suffix] for c in letters])
        pairs = [(vocab[a] << 16 | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])]
        self.rank = {key: (rank, new) for key, rank, new in reversed(pairs)}
        keys = sorted(self.rank)
        self.keys = np.array(keys)
        self.ranks, self.made = np.array([self.rank[k][0] for k in keys]), np.zeros(len(pairs), np.int64)
        for _, rank, new in pairs:
            self.made[rank] = new
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text without special tokens. Each letter is lowered by itself, so a final sigma is like any."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return WORD.findall(text.lower())

    def symbols(self, word: bytes) -> list[int]:
        return [*self.inside[list(word[:-1])].tolist(), int(self.last[word[-1]])]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word of any length, the best pair first and the leftmost of equal ones, by a heap."""
        ids = self.symbols(word)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(at: int) -> None:
            if at >= 0 and after[at] < len(ids):
                found = self.rank.get(ids[at] << 16 | ids[after[at]])
                if found:
                    heapq.heappush(heap, (found[0], at, ids[at], ids[after[at]]))

        for at in range(len(ids) - 1):
            push(at)
        while heap:
            rank, at, left, right = heapq.heappop(heap)
            nxt = after[at] if ids[at] == left else len(ids)
            if nxt >= len(ids) or ids[nxt] != right:
                continue
            ids[at], ids[nxt] = int(self.made[rank]), -1
            after[at] = after[nxt]
            if after[at] < len(ids):
                before[after[at]] = at
            push(before[at])
            push(at)
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has). Short words take their merges side by side, one in a round each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        long = {int(k): self.merge(words[k]) for k in np.flatnonzero(sizes > SHORT)}
        short = np.flatnonzero((sizes <= SHORT) & (sizes > 0))
        flat = np.frombuffer(b"".join(words[k] for k in short), np.uint8)
        ids, word = self.inside[flat], np.repeat(short, sizes[short])
        ends = np.cumsum(sizes[short]) - 1
        ids[ends] = self.last[flat[ends]]
        done_ids, done_words = [], []
        while len(ids):
            rank = np.full(len(ids), NONE)
            same = np.flatnonzero(word[1:] == word[:-1])
            pair = ids[same] << 16 | ids[same + 1]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank[same] = np.where(self.keys[at] == pair, self.ranks[at], NONE)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank << PLACE | np.arange(len(ids)), first)
            found = best >> PLACE < NONE
            place = (best & ((1 << PLACE) - 1))[found]
            going = np.repeat(found, np.diff(np.concatenate([first, [len(ids)]])))
            ids[place] = self.made[rank[place]]
            keep = np.ones(len(ids), bool)
            keep[place + 1] = False
            done_ids.append(ids[~going])
            done_words.append(word[~going])
            ids, word = ids[going & keep], word[going & keep]
        for k, found in long.items():
            done_ids.append(np.array(found))
            done_words.append(np.full(len(found), k))
        all_ids, all_words = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_ids, done_words))
        order = np.argsort(all_words, kind="stable")
        return all_ids[order], np.bincount(all_words, minlength=len(words))


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


class Encoder:
    """Ids of whole texts. Each distinct piece between spaces is taken apart once, each known word is looked up."""

    def __init__(self, path: str, lexicon: str) -> None:
        self.bpe, self.lexicon = word_bpe(path), Lexicon(lexicon)
        self.known = Remembered(self._new, 600_000)
        self.tokens = pa.array(self.bpe.token, pa.large_string())

    def _new(self, strings: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Ids of pieces: of their words and special tokens in turn."""
        numbers: dict[bytes, int] = {}
        order, counts = [], np.zeros(len(strings), np.int64)
        special = self.bpe.special
        for k, piece in enumerate(strings):
            parts = self.bpe.split.split(piece) if "<" in piece and self.bpe.split else [piece]
            for part in parts:
                found = [-1 - special[part]] if part in special else [numbers.setdefault(w.encode("utf-8", "surrogatepass"), len(numbers)) for w in self.bpe.words(part)]
                order += found
                counts[k] += len(found)
        words = list(numbers)
        place = self.lexicon.numbers(words)
        unseen = np.flatnonzero(place < 0)
        merged, sizes = self.bpe.merge_all([words[k] for k in unseen])
        base = len(self.lexicon.ids)
        table = np.concatenate([self.lexicon.ids, merged.astype(np.uint32), np.arange(len(self.bpe.token), dtype=np.uint32)])
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        seen = np.flatnonzero(place >= 0)
        start[seen], size[seen] = self.lexicon.ends[place[seen]], np.diff(self.lexicon.ends)[place[seen]]
        start[unseen], size[unseen] = base + np.cumsum(sizes) - sizes, sizes
        of = np.array(order, np.int64)
        plain = of >= 0
        starts, lengths = base + len(merged) - 1 - of, np.ones(len(of), np.int64)
        starts[plain], lengths[plain] = start[of[plain]], size[of[plain]]
        ids, ends = gather(table, starts, lengths)
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return strings, ids, np.diff(edge)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids end)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
        cut = lists.flatten().dictionary_encode()
        numbers = self.known(listed(cut.dictionary))[cut.indices.to_numpy()]
        ids, ends = gather(self.known.ids, self.known.ends[:-1][numbers], np.diff(self.known.ends)[numbers])
        return ids, np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The tokens of each text, joined by spaces, as files without a decoder have it."""
        offsets = pa.array(np.concatenate([[0], ends]), pa.int64())
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, self.tokens.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


@functools.lru_cache(maxsize=2)
def encoder(path: str, lexicon: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(path, lexicon)


def _count_task(path: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in rows_within(batches, 0):
            cut = pc.split_pattern(batch.column(0).cast(pa.large_string()), " ").flatten().value_counts()
            counts: dict[str, int] = {}
            for piece, times in zip(listed(cut.field(0)), cut.field(1).to_pylist(), strict=True):
                for word in bpe.words(piece):
                    counts[word] = counts.get(word, 0) + times
            yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    return task


def build_lexicon(docs: DataFrame, tokenizer: str, entries: int = ENTRIES) -> str:
    """Counts the words of all documents, compiles the most frequent ones and saves them in the shared folder.

    Words are in classes of like counts, eight to a doubling. The classes from the top down whose words are no more
    than `entries` together make the lexicon, so the driver gets a few hundred sums and then that many words at most.
    Words that occur once are left to the merges.
    """
    bpe = word_bpe(tokenizer)
    counts = documents(docs).select("text").mapInArrow(_count_task(tokenizer), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stored(counts.select("word", F.floor(8 * F.log2("n")).cast("int").alias("class")), "word-counts")
    cut, total = None, 0
    for r in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        total += r["count"]
        if total > entries:
            break
        cut = r["class"]
    best = counts.where(F.col("class") >= cut).collect() if cut is not None else []
    words = [r.word.encode("utf-8", "surrogatepass") for r in best]
    ids, sizes = bpe.merge_all(words)
    lists = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if words else []
    path = f"{scratch(docs.sparkSession, 'lexicon')}/words.bin"
    save(compile_words(words, lists), path)
    return path


def encode_decode(docs: DataFrame, tokenizer: str, entries: int = ENTRIES) -> DataFrame:
    """doc_id, n_tokens, and digests of ids and of the decoded text of every row.

    A null text is empty and has no ids; repeated rows are documents of their own, whatever their id; a text is encoded
    whole in one batch, however long it is; no rows give none; other columns are left out.
    """
    lexicon = build_lexicon(docs, tokenizer, entries)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, lexicon)
        for batch in rows_within(batches, 1, 8 << 20):
            ids, ends = coder.encode(batch.column(1))
            texts = coder.decode(ids, ends)
            starts, flat = np.concatenate([[0], ends[:-1]]).astype(np.int64), ids.astype("<u4")
            digests = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(starts, ends, strict=True)]
            decoded = [hashlib.sha256(x.as_buffer()).hexdigest() for x in texts]
            yield pa.record_batch([batch.column(0), pa.array(ends - starts, pa.int64()), pa.array(digests), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
