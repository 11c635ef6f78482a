"""Ids of whole texts by the tokenizers library, each distinct piece of a text encoded once."""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A place where a text can be cut: no piece of the byte-level pattern goes from a visible character over a space.
CUT = re.compile(r"(?<=\S)(?= )")
#: The same for RE2, which has no look-behind: white space of Unicode is spelt out.
BLANKS = r"\s\v\p{Z}\x{85}\x{1c}-\x{1f}"
VISIBLE_THEN_SPACE, BLANK_THEN_SPACE = f"([^{BLANKS}]) ", f"[{BLANKS}] "
#: Pieces in a text that the library gets.
JOINED = 2_000
#: A noncharacter that marks the cuts; texts that hold it are cut by CUT.
MARK = "\U0010ffff"


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts and how many each text has."""
    texts = texts.cast(pa.large_string())
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        lists = pa.array([CUT.split(x) for x in texts.to_pylist()], pa.large_list(pa.large_string()))
    else:
        marked, odd = pc.replace_substring(texts, " ", f"{MARK} "), pc.match_substring_regex(texts, BLANK_THEN_SPACE)
        if pc.any(odd).as_py():  # the slower way only where a space may follow a blank
            marked = pc.replace_with_mask(marked, odd, pc.replace_substring_regex(texts.filter(odd), VISIBLE_THEN_SPACE, rf"\1{MARK} "))
        lists = pc.split_pattern(marked, MARK)
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def listed(strings: pa.Array) -> list[str]:
    """What to_pylist() gives for strings without nulls, several times as fast."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start : start + length] of all rows, one after the other, and where each row ends."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(total)], ends


class Remembered:
    """The ids of distinct strings met so far, about `keep` strings at most.

    Beyond that, strings that were met in one batch only are forgotten first; the others go too if they fill half of it.
    encode(list of strings) gives (the strings in some order, ids of all of them, how many each has).
    """

    def __init__(self, encode, keep: int = 1_200_000) -> None:
        self.encode, self.keep = encode, keep
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids, self.ends, self.again = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _forget_rare(self) -> None:
        """Keeps what was met again, with new numbers; it has to be met once more to stay the next time."""
        stay, lengths = np.flatnonzero(self.again), np.diff(self.ends)
        if len(stay) > self.keep // 2:
            self._forget()
            return
        strings = list(self.numbers)  # numbers follow the order of insertion
        ids, ends = gather(self.ids, self.ends[:-1][stay], lengths[stay])
        self.numbers = {strings[k]: n for n, k in enumerate(stay.tolist())}
        self.ids, self.ends, self.again = ids, np.concatenate([[0], ends]), np.zeros(len(stay), bool)

    def __call__(self, strings: list[str]) -> np.ndarray:
        """A number for each string, for `self.ends` and `self.ids`."""
        if len(self.numbers) > self.keep:
            self._forget_rare()
        known, old = self.numbers, len(self.numbers)
        numbers = np.fromiter(map(known.get, strings, itertools.repeat(-1)), np.int64, len(strings))
        self.again[numbers[numbers >= 0]] = True
        missing = np.flatnonzero(numbers < 0)
        new = [strings[k] for k in missing.tolist()]
        for at in range(0, len(new), 50_000):
            part, ids, lengths = self.encode(new[at : at + 50_000])
            known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
            end = int(self.ends[-1])
            while end + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), 1 << 16), np.uint32)])
            self.ids[end : end + len(ids)] = ids
            self.ends = np.concatenate([self.ends, end + np.cumsum(lengths)])
        numbers[missing] = np.fromiter(map(known.__getitem__, new), np.int64, len(new))
        self.again = np.concatenate([self.again, np.zeros(len(known) - old, bool)])
        return numbers


class PieceEncoder:
    """Byte-level BPE over batches of texts. Same ids as encode(text, add_special_tokens=False).

    Texts are cut before spaces that follow a visible character. A piece's ids don't depend on what stands around it,
    so the library encodes each distinct piece once.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        found = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(found.values()) + 1, np.int64)
        for token, number in found.items():
            self.bytes[number] = len(token)  # each character of a byte-level token stands for a byte
        self.known = Remembered(self._new)

    def _new(self, strings: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pieces that begin with a space and end visibly go to the library one after the other, in long texts that are
        cut again by the bytes of their ids; others, and all beside a special token's string, go one by one."""
        alone = [not (x[:1] == " " and not x[-1].isspace()) for x in strings]
        beside = "\n".join(strings)  # no special token has a line end
        if any(s in beside for s in self.special):
            alone = [True] * len(strings)
        inner = [x for x, a in zip(strings, alone, strict=True) if not a]
        texts = ["".join(inner[at : at + JOINED]) for at in range(0, len(inner), JOINED)]
        ids = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([*ids, np.zeros(0, np.uint32)])
        ends = np.cumsum(self.bytes[ids])
        wanted = np.cumsum(pc.binary_length(pa.array(inner, pa.large_string())).to_numpy(zero_copy_only=False).astype(np.int64))
        counts = np.searchsorted(ends, wanted) + 1
        if len(wanted) and not (ends[counts - 1] == wanted).all():
            raise ValueError("an id goes over the edge of a piece")
        rest = [x for x, a in zip(strings, alone, strict=True) if a]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        ids = np.concatenate([ids, np.array([i for x in found for i in x], np.uint32)])
        return inner + rest, ids, np.concatenate([np.diff(counts, prepend=0), np.array([len(x) for x in found], np.int64)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids end)."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cut, counts = pieces(texts)
        cut = cut.dictionary_encode()
        numbers = self.known(listed(cut.dictionary))[cut.indices.to_numpy()]
        ids, piece_ends = gather(self.known.ids, self.known.ends[:-1][numbers], np.diff(self.known.ends)[numbers])
        return ids, np.concatenate([[0], piece_ends])[np.cumsum(counts)]


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One for each Python worker, kept from task to task."""
    return PieceEncoder(path)


def rows_within(batches, column: int, most: int = 8 << 20):
    """Record batches cut so that the column (and one row at least) has about so many bytes in each."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            pa.default_memory_pool().release_unused()
            at = to
