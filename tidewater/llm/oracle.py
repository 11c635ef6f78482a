"""DuckDB SQL for the operators that SQL can express, by plain comparison of everything with everything."""

from __future__ import annotations

from .secrets import BASE_RULES

WORD = r"[^\x20\x09-\x0D]+"


def _components(nodes: str, links: str, key: str) -> str:
    """CTEs near(a, low): for each node the least node that links (a, b) lead to."""
    return f"""
    pairs AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
    reach AS (SELECT {key} AS a, {key} AS b FROM {nodes} UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
    near AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"""


def substring() -> str:
    return rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
    low AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN low USING (h) WHERE first < win.doc_id)),
    word AS (SELECT doc_id, p, ws[p] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
    kept AS (SELECT doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS kept FROM word LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def embeddings() -> str:
    return f"""
    WITH RECURSIVE good AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id > y.vec_id WHERE len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.93),
    {_components("embeddings", "links", "vec_id")},
    counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, low AS component_id, vec_id = low AS kept FROM embeddings JOIN near ON vec_id = near.a LEFT JOIN counts ON vec_id = counts.a"""


def minhash() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+1], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), least(len(ws) + 1, 2)))) AS i FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS pairs FROM s p JOIN s q ON p.x = q.x AND p.doc_id > q.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * pairs >= 80 * (p.n + q.n - pairs)),
    {_components("documents", "links", "doc_id")}
    SELECT doc_id, coalesce(n, 0) AS n_shingles, low AS component_id, doc_id = low AS kept FROM documents JOIN near ON doc_id = a LEFT JOIN n USING (doc_id)"""


def secrets() -> str:
    parts = []
    for rank, rule in enumerate(BASE_RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {rule.group}) AS tested, string_split_regex(t, '{pattern}') AS gaps FROM d")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    shown = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({" UNION ALL ".join(parts)}),
    each AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m),
    placed AS (
      SELECT doc_id, rank, kind, least, length(tested[i]) AS size, length(whole[i]) AS n,
        coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS a FROM each),
    found AS (SELECT doc_id, {counts}, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, rank) AS spans FROM placed WHERE size >= least GROUP BY doc_id)
    SELECT doc_id, {shown}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN found USING (doc_id)"""
