"""DuckDB SQL for the queries that SQL can express: op4, op9 and op10, over whole tables and whole texts."""

from __future__ import annotations

from .secrets import ACCESS, ASSIGN, EXAMPLE_OWNERS, HEX, KINDS, MIXED, OPAQUE
from .substrings import LENGTH as WORDS
from .suffixes import LENGTH as BYTES


def _lead(col: str, by: int) -> str:
    return f"lead({col}, {by}) OVER (PARTITION BY d ORDER BY i)"


def _joined(col: str, unit: int, count: int, sep: str) -> str:
    """``count`` neighbours of ``unit`` places each; null where the document ends before."""
    return f" || '{sep}' || ".join([col, *[_lead(col, unit * k) for k in range(1, count)]])


def _covered(length: int) -> str:
    return f"max(again) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"


assert BYTES == 5 * 5 * 8 and WORDS == 5 * 4

#: Bytes as two hex digits; windows of 8 as they are, of 40 and of 200 as hashes of 128 bits of their parts.
OP4 = f"""
WITH docs AS (
    SELECT row_number() OVER () AS d, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), bytes AS (
    SELECT d, generate_subscripts(b, 1) AS i, unnest(b) AS x FROM (SELECT d, regexp_extract_all(h, '..') AS b FROM docs)
), w2 AS (SELECT d, i, x, {_joined("x", 1, 2, "")} AS w FROM bytes)
, w4 AS (SELECT d, i, x, {_joined("w", 2, 2, "")} AS w FROM w2)
, w8 AS (SELECT d, i, x, {_joined("w", 4, 2, "")} AS w FROM w4)
, w40 AS (SELECT d, i, x, md5({_joined("w", 8, 5, "")}) AS w FROM w8)
, w200 AS (SELECT d, i, x, md5({_joined("w", 40, 5, "")}) AS w FROM w40)
, starts AS (SELECT w FROM w200 WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1)
, marked AS (SELECT d, i, x, (s.w IS NOT NULL)::INT AS again FROM w200 LEFT JOIN starts s USING (w))
, judged AS (SELECT d, i, x, {_covered(BYTES)} AS gone FROM marked)
, runs AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY d ORDER BY i), 0) = 0 AS opens FROM judged)
, kept AS (
    SELECT d, count(*) AS n_bytes, sum(gone)::BIGINT AS n_removed, count(*) FILTER (opens) AS n_spans,
        string_agg(x, '' ORDER BY i) FILTER (gone = 0) AS h
    FROM runs GROUP BY d
)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM docs LEFT JOIN kept USING (d)
"""

#: The words of a window as one string; rows that repeat a doc_id and its text are one document, listed as often.
OP9 = f"""
WITH docs AS (
    SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS d, doc_id, text,
        list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
    FROM (SELECT DISTINCT doc_id, text FROM documents)
), words AS (SELECT d, generate_subscripts(ws, 1) AS i, unnest(ws) AS x FROM docs)
, w5 AS (SELECT d, i, x, {_joined("x", 1, 5, " ")} AS w FROM words)
, w20 AS (SELECT d, i, x, {_joined("w", 5, 4, " ")} AS w FROM w5)
, marked AS (SELECT d, i, x, (w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY d, i) > 1)::INT AS again FROM w20)
, judged AS (SELECT d, i, x, {_covered(WORDS)} AS gone FROM marked)
, kept AS (
    SELECT d, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (gone = 0) AS t FROM judged GROUP BY d
)
SELECT o.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents o JOIN docs ON o.doc_id IS NOT DISTINCT FROM docs.doc_id AND o.text IS NOT DISTINCT FROM docs.text LEFT JOIN kept USING (d)
"""


def _found(kind: int, pattern: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""
    SELECT r, {kind} AS kind, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits,
        regexp_extract_all(t, '{p}', {group}) AS vals
    FROM docs WHERE regexp_matches(t, '{p}')"""


_mixed = " AND ".join(f"regexp_matches(v, '{c}')" for c in MIXED)
_names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"

#: A match starts after the gaps and matches before it. n_owners counts a null source as one owner.
OP10 = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, source, split_part(source, '/', 1) AS owner, coalesce(text, '') AS t FROM documents
), found AS ({" UNION ALL ".join([_found(0, ASSIGN, 2), _found(1, ACCESS), _found(2, HEX), _found(3, OPAQUE)])}
), placed AS (
    SELECT r, kind, vals[i] AS v, length(hits[i]) AS n,
        (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found)
), spans AS (
    SELECT r, kind, v, a, a + n AS b FROM placed
    WHERE kind IN (1, 2) OR (kind = 0 AND length(v) >= 8) OR (kind = 3 AND {_mixed})
), owners AS (
    SELECT v, count(DISTINCT owner) + max((owner IS NULL)::INT) AS n_owners FROM spans JOIN docs USING (r) GROUP BY v
), judged AS (
    SELECT s.*, n_owners FROM spans s JOIN owners USING (v)
    WHERE kind < 3 OR (n_owners = 1 AND NOT EXISTS (SELECT 1 FROM spans o WHERE o.r = s.r AND o.kind < 3 AND o.a < s.b AND s.a < o.b))
), listed AS (
    SELECT *, ({_names})[kind + 1] || ':' || a || ':' || b AS line FROM judged
), every AS (
    SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(line, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(line, ',' ORDER BY a, kind) AS spans,
        count(*) FILTER (n_owners < {EXAMPLE_OWNERS}) AS n_live, count(*) FILTER (n_owners >= {EXAMPLE_OWNERS}) AS n_example
    FROM listed GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN every USING (r)
"""
