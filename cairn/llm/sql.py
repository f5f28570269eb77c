"""SQL twins of the training-data queries, for DuckDB on the same tables; only where SQL runs over the whole tables in a bearable time."""

from __future__ import annotations

_P7 = """
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e)),
found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))
"""

#: Runs of neighbouring places on one diagonal of a text and a test text, each place with the twelve words from there on.
_P7_RUNS = """
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
eg AS (SELECT item_id, j, array_to_string(w[j:j+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS j FROM e)),
at_ AS (SELECT DISTINCT doc_id, item_id, i, i - j AS diagonal FROM dg JOIN eg USING (g)),
runs AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS island FROM at_) GROUP BY doc_id, item_id, diagonal, island)
SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS exact_run FROM runs GROUP BY doc_id, item_id
"""

_P3 = """
WITH v AS (SELECT entry_id, min(vector) AS v FROM entries
           WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
           GROUP BY entry_id),
n AS (SELECT entry_id, list_transform(v, lambda x: x::DOUBLE) AS v FROM v),
p AS (SELECT a.entry_id AS a, b.entry_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM n a JOIN n b ON a.entry_id <> b.entry_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM p)
SELECT DISTINCT least(a, b) AS entry_a, greatest(a, b) AS entry_b FROM r WHERE k <= 10 AND s >= 0.85
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """SELECT DISTINCT 'wiki_docs' AS item_table, path AS item_key FROM wiki_docs WHERE strlen(body) > 3000
            UNION SELECT DISTINCT 'entries', CAST(entry_id AS VARCHAR) FROM entries WHERE strlen(text) > 3000""",
        "p2_rejoined": """WITH t AS (SELECT 'wiki_docs' AS item_table, path AS item_key, body AS x FROM wiki_docs UNION ALL SELECT 'entries', CAST(entry_id AS VARCHAR), text FROM entries)
            SELECT DISTINCT item_table, item_key, sha256(x) AS digest, true AS within, true AS overlaps FROM t WHERE strlen(x) > 3000""",
        "p3_found": _P3,
        "p3_recall": """SELECT count(DISTINCT entry_id) AS queries, true AS reached FROM entries WHERE entry_id % 100 = 0 AND len(vector) = 64
            AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0""",
        "p4_checks": "SELECT 0 AS other_code, 0 AS silent",
        "p6_checks": 'SELECT count(DISTINCT doc_id) AS docs, 0 AS broken, 0 AS cut, 0 AS "over", 0 AS misplaced, true AS tight FROM documents',
        "p7_runs": _P7_RUNS,
        "p7_found": _P7 + "SELECT doc_id, item_id FROM found",
        "p7_leaked_items": _P7 + "SELECT item_id, count(*) AS n_docs FROM found GROUP BY item_id",
    }
