"""SQL for queries that it can express on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w, least(13, len({_WORDS})) AS n FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM b, unnest(range(1, len(w) - n + 2)) t(i) WHERE n > 0),
g AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM d, (SELECT DISTINCT n FROM k), unnest(range(1, len(w) - n + 2)) t(i)),
m AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS item, n, i FROM g JOIN k USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS hit FROM m, unnest(range(i, i + n)) t(p) GROUP BY 1),
x AS (SELECT doc_id, count(DISTINCT item) AS many, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit, 0)::BIGINT AS n_hit, coalesce(many, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(hit, 0) > 0 AND 20 * coalesce(hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""

ORACLES = {"op1_decontamination": DECONTAMINATION}
