"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""

#: Every window that begins with one of an item's shingles (or ends with the document), compared in full.
DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
item_shingles AS (SELECT item_id, n, k, s, count(*) AS c FROM (SELECT item_id, n, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM i)) GROUP BY ALL),
doc_shingles AS MATERIALIZED (SELECT doc_id, m, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM (SELECT doc_id, w, len(w) AS m, k, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM i))),
starts AS (SELECT DISTINCT doc_id, item_id, n, k, least(p, greatest(1, m - n + 1)) AS st FROM doc_shingles JOIN item_shingles USING (k, s)),
counted AS (SELECT doc_id, item_id, st, s, n - k + 1 AS wanted, count(*) AS c FROM starts JOIN doc_shingles USING (doc_id, k) WHERE p BETWEEN st AND st + n - k GROUP BY ALL),
compared AS (SELECT doc_id, item_id, st, sum(least(counted.c, coalesce(item_shingles.c, 0))) AS both_, sum(counted.c) + any_value(wanted) AS total FROM counted LEFT JOIN item_shingles USING (item_id, s) GROUP BY ALL),
judged AS (SELECT doc_id, item_id, st, CAST(both_ AS DOUBLE) / (total - both_) AS similarity FROM compared)
SELECT doc_id, item_id, max(similarity) AS similarity, CAST(arg_min(st, (-similarity, st)) - 1 AS INTEGER) AS window_start FROM judged WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": EXACT_DEDUP,
        "op10_decontaminate": DECONTAMINATE,
    }
