import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import quality, toxicity

from .fixtures import AWKWARD, frame, small


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def accuracy(spark, sf_path, module, column):
    docs, known = (spark.read.parquet(f"{sf_path}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in module.predicted(docs, known).collect()}
    truth = {r.doc_id: r[column] for r in known.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 for k, r in rows.items())
    held = [(rows[k].predicted, y) for k, y in truth.items() if rows[k].held_out]
    return np.mean([p == y for p, y in held])


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, column):
    assert accuracy(spark, "/root/testdata/sf0.01", module, column) > 0.94


@pytest.mark.parametrize("module", [quality, toxicity])
def test_awkward_rows(spark, module):
    docs = frame(spark, AWKWARD)
    rows = [(k, k % 2, (k + 1) % 2) for k in range(len(AWKWARD))] + [(None, 1, 1), (3, None, None)]
    assert module.predicted(docs, labels(spark, rows)).count() == len(AWKWARD)
    assert {r.score for r in module.predicted(docs, labels(spark, [])).collect()} <= {0.5, *(toxicity.Lexicon({}).score(x or "") for x in AWKWARD)}
    assert module.predicted(docs.limit(0), labels(spark, rows)).count() == 0
    assert {r.held_out for r in module.predicted(frame(spark, ["a", "a"], [None, None]), labels(spark, [])).collect()} == {False}


def test_features_do_not_depend_on_the_batch():
    texts = [x or "" for x in AWKWARD]
    together = quality.features(pa.array(texts))
    alone = np.concatenate([quality.features(pa.array([x])) for x in texts])
    assert np.isfinite(together).all() and np.allclose(together, alone)


def plain_features(text):
    """The features, one text at a time, word by word."""
    raw = text.encode()
    spelt, size = raw.split(), len(raw)
    n, some, length = len(spelt), max(len(spelt), 1), max(size, 1)
    of = lambda chars: sum(raw.count(bytes([c])) for c in chars.encode())
    groups = [of(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\v\f\r")] + [sum(c > 127 for c in raw)] + [of(x) for x in ("!", "|", "%$&*#@^~<>{}[]\\=+_/", ".,;:?'\"-()")]
    entropy = -sum(raw.count(c) / size * math.log2(raw.count(c) / size) for c in {bytes([c]) for c in raw})
    pairs = {tuple(spelt[i : i + 2]) for i in range(max(n - 1, min(n, 1)))}
    marks, ends = of("%$&*#"), of(".!?")
    return [
        math.log1p(n), min((size - groups[3]) / some, 40), *(g / length for g in groups), 1 - sum(groups) / length, entropy, len(set(spelt)) / some, sum(a == b for a, b in zip(spelt, spelt[1:])) / some, len(pairs) / some,
        math.log1p(n / (raw.count(b"\n") + 1)), min(ends / some, 3), n < 12, min(groups[5] / some, 4), min(groups[6] / some, 4), min(marks / some, 4),
    ]


def test_op7_against_brute_force(spark, sf):
    """Features by plain counting, then the model's score of them, for every row."""
    texts = [x or "" for x in AWKWARD] + small(spark, sf) + ["a b " * 50_000]
    want = np.array([plain_features(x) for x in texts], float)
    assert np.allclose(quality.features(pa.array(texts)), want, atol=1e-9)
    docs = frame(spark, texts)
    rows = [(k, int(len(t) > 400), 0) for k, t in enumerate(texts)]
    model = quality.train(docs, labels(spark, rows))
    mean, scale = quality.moments(docs)
    assert np.allclose(mean, want.mean(axis=0)) and np.allclose(scale, want.std(axis=0), atol=1e-6)
    got = {r.doc_id: r for r in quality.predicted(docs, labels(spark, rows)).collect()}
    for k, x in enumerate(want):
        hidden = [math.tanh(sum(max(-6, min(6, (v - m) / s)) * w for v, m, s, w in zip(x, model.mean, model.scale, column)) + b) for column, b in zip(model.weights[0].T, model.weights[1])]
        score = 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, model.weights[2])) + model.weights[3][0])))
        assert abs(got[k].score - score) < 1e-6 and (abs(score - 0.5) < 1e-6 or got[k].predicted == int(score >= 0.5))


def test_op7_learns_from_every_labelled_row(spark):
    """More rows than one block holds, against the same model of all rows in memory, with every cut tried one by one."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "Of", "and.", "w!", "x|", "7%", f"v{k}"]) for _ in range(rng.randrange(2, 30))) for k in range(7_000)]
    marks = [int(("w!" not in t or rng.random() < 0.1) and "v" in t) for t in texts]
    docs, known = frame(spark, texts), labels(spark, [(k, y, 0) for k, y in enumerate(marks)] + [(5, 0, 0), (9_999, 1, 0)])
    marks[5] = 0
    x, half = quality.features(pa.array(texts)), np.array([r[0] for r in docs.orderBy("doc_id").selectExpr("pmod(xxhash64(doc_id), 2)").collect()])
    ours, learnt = np.array(marks) == 1, np.array([zlib.crc32(str(k).encode()) % 3 != 1 for k in range(len(texts))])
    assert learnt.sum() > quality.BLOCK
    mean, scale, found = x.mean(axis=0), x.std(axis=0), []
    for side in (0, 1):
        seen, other = learnt & (half != side), learnt & (half == side)
        raw = quality.fit(x[seen & ours], x[seen], 0.5, mean, scale, turns=120).raw(x)
        p, every = raw[other & ours], raw[other]
        error = math.sqrt(math.log(40) / (2 * len(p))) + math.sqrt(math.log(40) / (2 * len(every)))
        shares = [((every >= cut).mean(), (p >= cut).mean()) for cut in sorted(p)]
        found.append(min(((u + error) / s, u / s) for u, s in shares)[1])
    want = quality.fit(x[learnt & ours], x[learnt], np.mean(found), mean, scale)
    assert np.abs(quality.train(docs, known).score(x) - want.score(x)).max() < 1e-5


@pytest.mark.parametrize("share", [0.1, 0.4, 0.7, 0.9])
def test_class_prior_of_planted_shares(share):
    rng = np.random.default_rng(int(share * 10))
    mixed = np.concatenate([rng.normal(1, 1, (int(3000 * share), 5)), rng.normal(-1.5, 1, (3000 - int(3000 * share), 5))])
    rng.shuffle(mixed)
    assert abs(quality.class_prior(rng.normal(1, 1, (1500, 5)), mixed) - share) < 0.06


def plain_score(lexicon, text):
    """Every word against every entry, without an automaton."""
    spelt, total = toxicity.fold(text).split(), 0.0
    for k, word in enumerate(spelt):
        fits = [w for term, w in lexicon.weights.items() if (term == f" {word} " if term.endswith(" ") else word.startswith(term[1:]))]
        near = {" ".join(spelt[max(0, k - 1) : k + 1]), " ".join(spelt[k : k + 2])}
        if fits and not near & lexicon.exceptions:
            total += max(0.0, *fits, 0.0)
    a, b, c, d = lexicon.line
    return 1 / (1 + math.exp(-(a * math.log1p(total) + b * math.log1p(100 * total / (len(spelt) + 20)) + c * math.log2(len(spelt) + 4) + d)))


def test_op3_against_brute_force(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.train(docs, known)
    assert lexicon.weights
    some = max(lexicon.weights, key=lexicon.weights.get)
    odd = [x or "" for x in AWKWARD] + [f"{'y' * 300}   {some.strip()}   {'z' * 300}", some.strip() * 2, f"{some.strip()} " * 20_000]
    texts = odd + [r.text for r in docs.select("text").collect()]
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, texts), lexicon).collect()}
    assert max(abs(got[k] - plain_score(lexicon, t)) for k, t in enumerate(texts)) < 1e-9


def test_neighbours_of_any_length():
    folded = f" {'p' * 500}     word   {'q' * 500} "
    assert toxicity.phrases(folded, folded.index(" word")) == [f"{'p' * 500} word", f"word {'q' * 500}"]
    assert toxicity.phrases(" word ", 0) == []


def test_held_out_toxic_documents_are_found(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in toxicity.predicted(docs, known).collect()}
    held = [(rows[r.doc_id].predicted, r.toxic) for r in known.collect() if rows[r.doc_id].held_out]
    assert sum(p for p, y in held if y) >= 0.88 * sum(y for _, y in held) and sum(p for p, y in held if not y) <= 0.005 * len(held)


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (3000, 5)), rng.normal(-1.5, 1, (3000, 5))
    model = quality.fit(good[:800], np.concatenate([good[800:2200], bad[:600]]), prior=0.7)
    assert (model.score(good[2200:]) >= 0.5).mean() > 0.93 and (model.score(bad[600:]) < 0.5).mean() > 0.93


def test_folding():
    assert toxicity.fold("1D10T!").split() == toxicity.fold("idiot").split()
    assert toxicity.fold("ｌοѕｅr").split() == toxicity.fold("loser").split()
    assert toxicity.fold("mo​ron ré $cum").split() == ["moron", "re", "scum"]


def test_exception_phrases_and_obfuscation(spark):
    rng = random.Random(2)
    noise = [f"w{rng.randrange(400)}x" for _ in range(4000)]
    texts, rows = [], []
    for k in range(900):
        words = rng.sample(noise, 30)
        kind = k % 3
        if kind == 1:
            words[rng.randrange(1, 29)] = rng.choice(["grimble", "gr1mble", "Grіmble"])
        elif kind == 2 and k % 2:
            at = rng.randrange(1, 28)
            words[at : at + 2] = ["grimble", "fern"]
        texts.append(" ".join(words))
        rows.append((k, 1, int(kind == 1)))
    lexicon = toxicity.train(frame(spark, texts), labels(spark, rows))
    assert "grimbie fern" in lexicon.exceptions
    assert lexicon.score("some GR1MBLE here " + " ".join(noise[:20])) > 0.7
    assert lexicon.score("a grimble fern here " + " ".join(noise[:20])) < 0.3
