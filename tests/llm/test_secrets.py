import hashlib
import re

from pyspark.sql import functions as F

from tidewater.llm import queries, secrets

from .fixtures import AWKWARD, frame, small

#: The base patterns as the contract has them.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def brute(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


def versions(docs):
    return docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))


def test_op10_against_brute_force(spark, sf, tmp_path):
    texts = AWKWARD + small(spark, sf) + ["token=abcdefgh\U0001f600 secret: 'zzzzzz'"] * 3
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op10_secrets(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        want = brute(text)
        spans = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert got[k].spans == spans and got[k].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [got[k][f"n_{x[0]}"] for x in PATTERNS] == [sum(w[3] == x[0] for w in want) for x in PATTERNS]


def test_ledger_scans_only_what_is_new(spark):
    first = versions(frame(spark, ["token=abcdefgh", "token=abcdefgh", "clean"]))
    ledger = secrets.Ledger(spark)
    assert ledger.unseen(first).count() == 2
    ledger.update(first)
    second = first.union(versions(frame(spark, ["password: qwertyui"])))
    assert [r.content for r in ledger.unseen(second).collect()] == ["password: qwertyui"]
    ledger.update(second)
    ledger.update(second)
    assert ledger.rows().count() == 3 and ledger.by_path(second).where("size(findings) > 0").count() == 3
    fewer = secrets.Ledger(spark, ledger.path, secrets.BASE_RULES[1:])
    assert fewer.version != ledger.version and fewer.unseen(second).count() == 3
    fewer.update(second)
    assert fewer.by_path(second).where("size(findings) > 0").count() == 0
    again = secrets.Ledger(spark, ledger.path)  # opened a second time: nothing is lost or scanned again
    assert again.unseen(second).count() == 0 and again.rows().count() == 6


def test_odd_paths_long_texts_and_no_rows(spark):
    long = "x " * 300_000 + "token=abcdefgh " + "é" * 10 + " AKIA" + "A" * 16 + " y" * 300_000
    rows = spark.createDataFrame([(None, "token=abcdefgh"), (None, None), (1, long), (1, long), (1, "")], "path long, content string")
    ledger = secrets.Ledger(spark)
    ledger.update(rows)
    got = ledger.by_path(rows).select("path", secrets.as_text(F.col("findings")).alias("t")).collect()
    want = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in brute(long))
    assert sorted(((r.path or 0, r.t) for r in got)) == sorted([(0, "assign:0:14"), (0, ""), (1, want), (1, want), (1, "")])
    ledger.update(rows.limit(0))
    assert ledger.by_path(rows.limit(0)).count() == 0


def test_redaction(spark):
    docs = versions(frame(spark, ["x token=abcdefgh y", "clean", None, "secret: " + "0123456789abcdef" * 2 + " end"]))
    ledger = secrets.Ledger(spark)
    ledger.update(docs)
    found = ledger.by_path(docs).join(docs, "path")
    got = {r.path: r.t for r in found.select("path", secrets.redact(F.col("content"), F.col("findings")).alias("t")).collect()}
    assert got == {0: "x [secret] y", 1: "clean", 2: None, 3: "[secret] end"}
