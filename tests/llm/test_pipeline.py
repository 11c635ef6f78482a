import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewater.llm import quality
from tidewater.llm.tokens import vocabulary

from .fixtures import AWKWARD, rows, small
from .test_minhash import brute as groups
from .test_secrets import brute as spans
from .test_substring import brute as passages
from .test_substring import passages as planted


def redacted(text):
    out, at = "", 0
    for start, _, end, _ in spans(text):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, end)
    return out + text[at:]


def test_run_against_brute_force(spark, sf, tmp_path):
    texts = [t or "" for t in AWKWARD] + planted(count=20) + [x for x in small(spark, sf)]
    spark.createDataFrame([r[:5] for r in rows(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = [(k, t) for k, t in enumerate(texts) if model.score(quality.features(pa.array([t])))[0] >= 0.5]
    assert 0 < len(good) < len(texts)
    root = groups([t for _, t in good], 5)
    good = [x for k, x in enumerate(good) if root[k][1] == k]
    cut = passages([t for _, t in good], [k for k, _ in good], 50)
    good = [(k, new if gone else old) for (k, old), (_, _, gone, new) in zip(good, cut, strict=True)]
    good = [(k, redacted(t)) for k, t in good]

    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        path = f"{tmp_path}/{stage.__name__}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == good
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0

    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert sorted(pieces) == [k for k, _ in good]
    for k, t in good:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        got = sorted((r.start, r.length, r.ids_crc32) for r in pieces[k])
        assert sum(x[1] for x in got) == len(ids)
        assert all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == c for a, n, c in got)
    assert not re.search(r"AKIA[A-Z0-9]{16,}", " ".join(t for _, t in good))


def test_one_row_of_each_group_of_copies_stays(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    data = [(1, a), (1, a), (None, b), (None, b), (None, c), (2, d), (None, d + " more"), (3, None), (None, "")]
    docs = spark.createDataFrame([(k, t, "en", "src", len(t or "")) for k, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (None, b), (None, c), (2, d), (3, None), (None, "")], key=repr)
