"""The same results in SQL that DuckDB runs, where SQL can express them."""

# Fixed by the contract: words are runs of bytes other than ASCII white space.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP10 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
stretch AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
),
least AS (SELECT k, min(doc_id) AS m FROM stretch GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, p
  FROM (
    SELECT s.doc_id, unnest(range(s.i, s.i + 13)) AS p
    FROM stretch s JOIN least l ON s.k = l.k AND l.m < s.doc_id
  )
),
word AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS x FROM w),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p
  GROUP BY word.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP1 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

# Letters are lowered in ASCII only. A shorter document's words are its one shingle.
OP3 = f"""
WITH RECURSIVE lowered AS (
  SELECT doc_id,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
w AS (SELECT doc_id, {WORDS} AS ws FROM lowered),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
overlap AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o
  FROM shingle x JOIN shingle y ON x.k = y.k AND x.doc_id <> y.doc_id
  GROUP BY ALL
),
link AS (
  SELECT a, b FROM overlap JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b
  WHERE 100 * o >= 85 * (s.n + t.n - o)
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM least LEFT JOIN size USING (doc_id)
"""

OP7 = """
WITH scaled AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM scaled q JOIN scaled c ON q.vec_id % 20 = 0 AND c.r <> q.r
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs
)
WHERE rank <= 20
"""

# Fixed by the contract, and the formats of issued keys as their issuers publish them.
SECRET_PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "key": r"gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
    r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
LEAST = {"assign": 6, "access": 20, "hex": 24, "key": 16}

_FOUND = " UNION ALL ".join(
    f"""
    SELECT uid, owner, '{kind}' AS kind, {rank} AS rank, i, len(g[i]) AS gap, f[i] AS found, v[i] AS value
    FROM (
      SELECT uid, owner, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS f,
             regexp_extract_all(t, '{pattern}', {int(kind == "assign")}) AS v
      FROM d
    ), unnest(range(1, len(f) + 1)) AS r(i)
    """
    for rank, (kind, pattern) in enumerate(SECRET_PATTERNS.items())
)
_LONG = " OR ".join(f"kind = '{kind}' AND len(value) >= {least}" for kind, least in LEAST.items())

OP9 = f"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t
  FROM documents
),
found AS ({_FOUND}),
placed AS (
  SELECT uid, owner, kind, rank, value,
         sum(gap + len(found)) OVER (PARTITION BY uid, kind ORDER BY i) - len(found) AS s, len(found) AS n
  FROM found
),
span AS (SELECT * FROM placed WHERE {_LONG}),
held AS (SELECT value, count(DISTINCT owner) AS owners FROM span GROUP BY value),
said AS (
  SELECT uid, kind, kind || ':' || s || ':' || (s + n) AS x, s, rank
  FROM span JOIN held USING (value) WHERE kind <> 'key' OR owners < 4
),
per AS (
  SELECT uid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b,
         count(*) FILTER (kind = 'hex') AS h,
         string_agg(x, ',' ORDER BY s, rank) FILTER (kind <> 'key') AS base,
         string_agg(x, ',' ORDER BY s, rank) AS spans
  FROM said GROUP BY uid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per ON d.uid = per.uid
"""

# Fixed by the contract: the terms of a text, and all integers of a score.
TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH held AS (
  SELECT row_number() OVER () AS d, doc_id, {TERMS} AS ts FROM documents WHERE text IS NOT NULL
),
size AS (SELECT d, doc_id, CAST(len(ts) AS BIGINT) AS n FROM held WHERE len(ts) > 0),
whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM size),
tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(ts) AS t FROM held) GROUP BY d, t),
weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * big_n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, whole GROUP BY t, big_n
),
item AS (SELECT row_number() OVER () AS q, item_id, {TERMS} AS ts FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT DISTINCT q, item_id, t FROM (SELECT q, item_id, unnest(ts) AS t FROM item)),
scored AS (
  SELECT q, item_id, doc_id, d,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN size USING (d), whole
  GROUP BY q, item_id, doc_id, d
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
WHERE rank <= 10
"""

OP12 = """
WITH scaled AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, o.r AS other, o.vec_id AS other_id, a.label = o.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, o.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM scaled a JOIN scaled o ON a.vec_id % 100 = 0 AND a.r <> o.r
),
positive AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) AS p FROM pairs WHERE same
),
ranked AS (
  SELECT x.anchor_id, x.other_id AS positive_id, y.other_id AS negative_id,
         x.score AS positive_score, y.score AS negative_score,
         row_number() OVER (PARTITION BY x.anchor, x.p ORDER BY y.score DESC, y.other_id) AS rank
  FROM positive x JOIN pairs y ON x.anchor = y.anchor AND x.p <= 5 AND NOT y.same
  WHERE 30 * x.score <= 100 * y.score AND 100 * y.score <= 90 * x.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""

OP13 = OP3.replace("100 * o >= 85 *", "100 * o >= 80 *").replace(
    "SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id\n",
    "SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept\n",
)

ORACLES = {
    "op1_exact_dedup": OP1,
    "op3_ngram_jaccard": OP3,
    "op7_topk_search": OP7,
    "op9_secret_scan": OP9,
    "op10_substring_dedup": OP10,
    "op11_lexical_search": OP11,
    "op12_hard_negatives": OP12,
    "op13_minhash_dedup": OP13,
}
