"""Toxicity: a learnt, weighted lexicon that an Aho-Corasick automaton finds in folded texts, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, held_out, sampled, stored
from .tokens import rows_within

#: Labelled rows that a lexicon is learnt from, or hardly more, chosen by a hash of their id.
SAMPLE = 20_000
#: Letters of a stem, least and most, and of a word that is an entry as a whole, most.
STEM, WHOLE = (4, 8), 64

#: Digits and signs that stand for letters. i and l fold into one, as 1 stands for either.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "l": "i"}
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "i", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a",
}
DOLLAR = re.compile(r"\$(?=\w)")


class _Folding(dict):
    """What a character becomes: a plain letter, a letter of its own kind, or a space."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        low = DIGITS.get(char) or LOOKALIKES.get(char)
        if low is None:
            plain = unicodedata.normalize("NFKD", char).lower()
            kept = "".join(c for c in plain if not unicodedata.combining(c))
            low = "".join(DIGITS.get(c) or LOOKALIKES.get(c) or (c if c.isalpha() else "" if unicodedata.category(c) in ("Cf", "Mn") else " ") for c in kept)
            if not kept:
                low = ""
        self[code] = low
        return low


FOLD = _Folding()


def fold(text: str) -> str:
    """Lower case without accents, look-alikes and digits as the letters they stand for, all else as spaces; a space at both ends."""
    if "$" in text:
        text = DOLLAR.sub("s", text)
    return f" {text.translate(FOLD)} "


def terms(word: str) -> list[str]:
    """What may stand for a folded word in a lexicon: its stems, and the whole word with its end if it isn't longer than any word is."""
    return [f" {word[:k]}" for k in range(STEM[0], min(STEM[1], len(word) - 1) + 1)] + ([f" {word} "] if 2 < len(word) <= WHOLE else [])


@dataclass
class Lexicon:
    """Weights of terms, phrases of two words that don't count, and how a text's sums become a score."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    line: tuple[float, float, float, float] = (0.0, 0.0, 0.0, -2.0)
    _automaton: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "line": self.line, "_automaton": []}

    def automaton(self) -> ahocorasick.Automaton:
        if not self._automaton:
            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                found.add_word(term, (len(term), weight))
            found.make_automaton()
            self._automaton.append(found)
        return self._automaton[0]

    def hits(self, folded: str) -> dict[int, float]:
        """Where matched words begin and the largest weight of the terms found there, without exception phrases."""
        found: dict[int, float] = {}
        if not self.weights:
            return found
        for end, (size, weight) in self.automaton().iter(folded):
            at = end - size + 1
            if weight > found.get(at, 0.0):
                found[at] = weight
        if found and self.exceptions:
            found = {at: w for at, w in found.items() if not self.exceptions.intersection(phrases(folded, at))}
        return found

    def sums(self, text: str) -> tuple[float, float, float]:
        """(sum of weights, that sum for a hundred words, the text's words): the logarithm of each."""
        folded = fold(text)
        total, size = sum(self.hits(folded).values()), len(folded.split())
        return math.log1p(total), math.log1p(100 * total / (size + 20)), math.log2(size + 4)

    def score(self, text: str) -> float:
        at = sum(a * b for a, b in zip(self.line, (*self.sums(text), 1.0), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, at))))


def phrases(folded: str, at: int) -> list[str]:
    """The word that begins after position `at`, with the word before it and with the word behind it."""
    end = folded.find(" ", at + 1)
    word, out = folded[at + 1 : end], []
    last = at
    while last > 0 and folded[last - 1] == " ":
        last -= 1
    if last:
        out.append(f"{folded[folded.rfind(' ', 0, last) + 1 : last]} {word}")
    first = end
    while first < len(folded) and folded[first] == " ":
        first += 1
    if first < len(folded):
        out.append(f"{word} {folded[first : folded.find(' ', first)]}")
    return out


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts with and without the label each term stands, and how often, for each batch. The empty term is every word."""
    names = ["clean", "toxic", "clean_words", "toxic_words"]
    for batch in rows_within(batches, 0, 8 << 20):
        counts = {n: Counter() for n in names}
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            label, seen = "toxic" if y > 0 else "clean", Counter()
            for word, times in Counter(fold(text).split()).items():
                for term in ("", *terms(word)):
                    seen[term] += times
            counts[label].update(seen.keys())
            counts[f"{label}_words"].update(seen)
        found = list(counts["clean"].keys() | counts["toxic"].keys())
        yield pa.record_batch([pa.array(found, pa.string()), *(pa.array([counts[n][t] for t in found], pa.int64()) for n in names)], names=["term", *names])


def _phrase_task(lexicon: Lexicon):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_within(batches, 0, 8 << 20):
            rows = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(text)
                rows += [(p, y) for p in {p for at in lexicon.hits(folded) for p in phrases(folded, at)}]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["phrase", "y"])

    return task


def _sum_task(lexicon: Lexicon):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_within(batches, 0, 8 << 20):
            found = [lexicon.sums(x) for x in batch.column(0).to_pylist()]
            yield pa.record_batch([*(pa.array([f[k] for f in found], pa.float64()) for k in range(3)), batch.column(1)], names=["total", "even", "size", "y"])

    return task


def _line(x: np.ndarray, y: np.ndarray, turns: int = 80) -> tuple[float, ...]:
    """A logistic fit with a slight pull to zero, by Newton's steps; the slopes of the sums are not below zero."""
    x = np.concatenate([x, np.ones((len(y), 1))], axis=1)
    w, pull = np.array([0.0, 0.0, 0.0, -1.0]), np.diag([0.02, 0.02, 0.02, 0.001])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - 0.7 * np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + pull, x.T @ (p - y) + pull @ w)
        w[:2] = np.maximum(w[:2], 0)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Learns weights, exception phrases and the score's line from labels outside the held-out fold.

    A term is an entry if its log-likelihood ratio is beyond what the best of so many terms would reach by chance. Its
    weight is the logarithm of its odds. A phrase of a match and a neighbour is an exception if it stands in five clean
    texts at least and in next to no toxic one. A document with several labels has the highest. Without labels of both
    kinds the lexicon is empty and every score is the same.
    """
    docs = documents(docs)
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    chosen = sampled(known, "doc_id", sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "y").persist()
    try:
        clean, toxic = (rows.where(F.col("y") == k).count() for k in (0, 1))
        if not clean or not toxic:
            return Lexicon({})
        counts = stored(rows.mapInArrow(_count_task, "term string, clean long, toxic long, clean_words long, toxic_words long").groupBy("term").agg(F.sum("clean").alias("n"), F.sum("toxic").alias("t"), F.sum("clean_words").alias("nw"), F.sum("toxic_words").alias("tw")).where("t >= 3"), "terms")
        all_words = counts.where("term = ''").first()
        if not all_words or not all_words.nw:
            return Lexicon({})
        counts = counts.where("term != ''")
        expected = (F.col("n") + F.col("t")) * toxic / (clean + toxic)
        both = F.col("n") + F.col("t")
        gain = 2 * (F.col("t") * F.log(F.col("t") / expected) + F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / (both - expected))).otherwise(0.0))
        weight = F.log((F.col("tw") + 0.5) / all_words.tw) - F.log((F.col("nw") + 0.5) / all_words.nw)
        ranked = counts.select("term", gain.alias("gain"), weight.alias("weight"), "t")
        least = 2 * math.log(max(2, ranked.count())) + 4
        best = ranked.where("weight > 1").where(F.col("gain") >= least).select("term", "weight").collect()
        lexicon = Lexicon({r.term: r.weight for r in best})
        found = rows.mapInArrow(_phrase_task(lexicon), "phrase string, y int").groupBy("phrase").agg(F.count("*").alias("n"), F.sum("y").alias("t"))
        spared = found.where("n - t >= 5 and t * 20 <= n").select("phrase").collect()
        lexicon = Lexicon(lexicon.weights, frozenset(r.phrase for r in spared))
        sums = np.array([tuple(r) for r in rows.mapInArrow(_sum_task(lexicon), "total double, even double, size double, y int").collect()])
        return Lexicon(lexicon.weights, lexicon.exceptions, _line(sums[:, :3], sums[:, 3]))
    finally:
        rows.unpersist()


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score (0 to 1) of every row. Null and empty texts have no match, and so the lowest score."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_within(batches, 1, 8 << 20):
            yield pa.record_batch([batch.column(0), pa.array([lexicon.score(x) for x in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return documents(docs).mapInArrow(task, "doc_id long, score double")


def predicted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a null doc_id isn't held out."""
    scored = score(docs, train(docs, labels, sample))
    fold_ = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", fold_.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
