"""The operators' queries as SQL for DuckDB, where it can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components(ids: str, links: str, head: str) -> str:
    """CTEs ``reach (id, root)``: every id with the smallest one it reaches."""
    return f"""
    WITH RECURSIVE {head},
    both_ways AS (SELECT a, b FROM ({links}) UNION SELECT b, a FROM ({links})),
    walk(id, other) AS (
        SELECT id, id FROM ({ids})
        UNION
        SELECT w.id, e.b FROM walk w JOIN both_ways e ON e.a = w.other
    ),
    reach AS (SELECT id, min(other) AS root FROM walk GROUP BY id)"""


JACCARD = (
    _components(
        "SELECT doc_id AS id FROM documents",
        "SELECT a, b FROM links",
        f"""
    words AS (
        SELECT doc_id, list_filter(
            string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'),
            lambda w: w <> '') AS w
        FROM documents
    ),
    sets AS (
        SELECT doc_id, CASE
            WHEN len(w) = 0 THEN []
            WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
            END AS s
        FROM words
    ),
    tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
    links AS (
        SELECT a.doc_id AS a, b.doc_id AS b
        FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n
        HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    )""",
    )
    + """
    SELECT doc_id, len(s) AS n_shingles, root AS component_id FROM sets JOIN reach ON id = doc_id"""
)

EMBEDDINGS = (
    _components(
        "SELECT vec_id AS id FROM embeddings",
        "SELECT a, b FROM links",
        """
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
        WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95
    )""",
    )
    + """
    SELECT vec_id,
           (SELECT count(*) FROM both_ways e WHERE e.a = vec_id) AS n_links,
           root AS component_id, vec_id = root AS kept
    FROM embeddings JOIN reach ON id = vec_id"""
)

# The patterns of the spans, with runs taken whole and judged by ``keep``.
_KINDS = [
    ("assign", """(?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9+/_.=-]+""",
     """length(regexp_extract(m, '^(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?(.*)$', 1)) >= 6"""),
    ("access", "AKIA[A-Z0-9]{16,}", "true"),
    ("hex", "[0-9a-f]{24,}", "true"),
    ("key", "[A-Za-z0-9/+]+",
     "length(m) = 40 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"),
    ("endpoint", "https?://[A-Za-z0-9][A-Za-z0-9.-]*", "true"),
]


def _matches(rank: int, kind: str, pattern: str, keep: str) -> str:
    quoted = pattern.replace("'", "''")
    hint = {"key": "[A-Za-z0-9/+]{40}"}.get(kind, quoted)  # spares the texts without any
    return f"""
        SELECT doc_id, {rank} AS rank, '{kind}' AS kind, starts + length(m) AS "end", starts AS start, m
        FROM (SELECT doc_id, unnest(found) AS m,
                     unnest(list_transform(range(1, len(found) + 1), lambda i:
                         coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
                         + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0)))::BIGINT AS starts
              FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS found,
                           string_split_regex(text, '{quoted}') AS gaps
                    FROM documents WHERE regexp_matches(text, '{hint}')))
        WHERE {keep}"""


_JOINED = "string_agg(kind || ':' || start || ':' || \"end\", ',' ORDER BY start, rank)"

SECRETS = f"""
    WITH spans AS ({" UNION ALL ".join(_matches(i, *k) for i, k in enumerate(_KINDS))}),
    linked AS (
        SELECT * FROM spans WHERE rank < 3
        UNION ALL
        SELECT * FROM spans w WHERE rank >= 3 AND EXISTS (
            SELECT 1 FROM spans s WHERE s.doc_id = w.doc_id
            AND (s.kind = 'access' OR s.kind = 'assign' AND w.kind = 'endpoint')
            AND w.start <= s."end" + 256 AND s.start <= w."end" + 256)
    ),
    told AS (
        SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign,
               count(*) FILTER (WHERE kind = 'access') AS n_access,
               count(*) FILTER (WHERE kind = 'hex') AS n_hex,
               {_JOINED.replace("start, rank)", "start, rank) FILTER (WHERE rank < 3)")} AS base,
               {_JOINED} AS spans
        FROM linked GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
           coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN told t ON t.doc_id = d.doc_id"""

DEDUP = """
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))"""

# a word of this engine's regular expressions is what lies between the blanks, as everywhere
AUDIT = """
    WITH texts AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents
    ),
    words AS (
        SELECT doc_id, part, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS w,
               min(doc_id) OVER (PARTITION BY body) AS first_id
        FROM texts
    ),
    known AS (
        SELECT doc_id AS of_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
        FROM labels GROUP BY doc_id
    ),
    failed AS (
        SELECT part, coalesce(good, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic,
               (len(w) < 50)::INT
               + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
               + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body))::INT
               + 8 * regexp_matches(body, '[#$%&*|]')::INT
               + 16 * coalesce(first_id < doc_id, false)::INT AS mask
        FROM words LEFT JOIN known ON of_id = doc_id
    ),
    counted AS (
        SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good,
               count(*) FILTER (WHERE toxic) AS toxic
        FROM failed GROUP BY part, mask
    ),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
    orders AS (
        SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
    ),
    steps AS (
        SELECT filter_order, step, letter, bit,
               coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS earlier
        FROM orders, range(1, 6) r(step), letters WHERE letter = filter_order[step]
    ),
    told AS (
        SELECT part, filter_order, step::INT AS step, letter,
               sum(n * (mask & (earlier | bit) = 0)::INT)::BIGINT AS kept,
               sum(n * (mask & earlier = 0 AND mask & bit <> 0)::INT)::BIGINT AS removed,
               sum(n * (mask & earlier <> 0 AND mask & bit <> 0)::INT)::BIGINT AS redundant,
               sum(n * (mask = bit)::INT)::BIGINT AS unique_fails,
               sum(good * (mask & earlier = 0 AND mask & bit <> 0)::INT)::BIGINT AS good_lost,
               sum(toxic * (mask & earlier = 0 AND mask & bit <> 0)::INT)::BIGINT AS toxic_lost
        FROM counted, steps GROUP BY part, filter_order, step, letter
    )
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
    FROM told"""

SQL = {
    "op1_ngram_jaccard_join": JACCARD,
    "op2_embedding_near_dedup": EMBEDDINGS,
    "op7_secret_scans": SECRETS,
    "op9_exact_dedup": DEDUP,
    "op13_filter_audit": AUDIT,
}
