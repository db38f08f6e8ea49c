"""DuckDB SQL of the contamination report: every window of every document against every window of every item."""

from __future__ import annotations

from .decontam import WINDOW

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

REPORT = f"""WITH doc AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS words FROM documents),
item AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS words FROM benchmark),
wanted AS (SELECT DISTINCT item, k, array_to_string(words[i:i + k - 1], ' ') AS w FROM (
  SELECT item, words, least({WINDOW}, len(words)) AS k, unnest(range(1, len(words) - least({WINDOW}, len(words)) + 2)) AS i FROM item WHERE len(words) > 0)),
own AS (SELECT n, i, k, array_to_string(words[i:i + k - 1], ' ') AS w FROM (
  SELECT n, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM doc CROSS JOIN (SELECT DISTINCT k FROM wanted) WHERE len(words) >= k)),
found AS (SELECT n, i, k, item FROM own JOIN wanted USING (k, w)),
hit AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + k)) AS p FROM found) GROUP BY n),
named AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item FROM found) GROUP BY n)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (n) LEFT JOIN named USING (n)"""
