"""DuckDB SQL for op11 and op12 over whole tables."""

from __future__ import annotations

#: Unsigned crc32 of a string of ASCII characters; `crc_table` must be there.
CRC_TABLE = """crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t
)"""


def _crc(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT), lambda a, b: xor(a >> 8, t[1 + xor(a & 255, b)]), 4294967295))"


OP11 = f"""
WITH RECURSIVE {CRC_TABLE}, source AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
    FROM conversations
), fates AS (
    SELECT conv_id, turn, role, text, {_crc("k")} % 20 AS f FROM source, crc_table
), groups AS (
    SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)
), damaged AS (
    SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
        CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM fates WHERE f <> 0
), placed AS (
    SELECT g, turn, role, text, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
    FROM damaged JOIN groups ON damaged.conv_id IS NOT DISTINCT FROM groups.conv_id
), rows_ AS (
    SELECT g, i, turn, role, text, substr(role, 1, 1) AS a, lag(substr(role, 1, 1)) OVER (PARTITION BY g ORDER BY i) AS before,
        CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'd'
             WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
    FROM placed
), counts AS (
    SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND (before, a) NOT IN (('s', 'u'), ('u', 'a'), ('a', 'u'))) AS illegal
    FROM rows_ GROUP BY g
), follows(p, q, letter, inserted) AS (
    VALUES ('', 's', 's', ''), ('', 'u', 'u', ''), ('s', 'u', 'u', ''), ('a', 'u', 'u', ''), ('u', 'a', 'a', ''),
        ('', 'a', 'a', 'I'), ('s', 'a', 'a', 'I'), ('a', 'a', 'a', 'I'), ('u', 'u', 'u', 'I')
), edits AS (
    SELECT p, p AS q, '' AS letter, 'D' AS edit, 2 AS cost FROM (VALUES (''), ('s'), ('u'), ('a')) v(p)
    UNION ALL SELECT p, q, letter, inserted || 'K', 5 * length(inserted) FROM follows
    UNION ALL SELECT p, q, letter, inserted || 'R', 5 * length(inserted) + 1 FROM follows WHERE letter <> 's'
), ways AS (
    SELECT g, 0::BIGINT AS i, '' AS q, {{'cost': 0::BIGINT, 'audit': ''}} AS way FROM groups
    UNION ALL
    SELECT ways.g, rows_.i, edits.q, min({{'cost': way.cost + edits.cost + CASE WHEN fault = 't' AND right(edit, 1) <> 'D' THEN 5 ELSE 0 END, 'audit': way.audit || edit}})
    FROM ways JOIN rows_ ON rows_.g = ways.g AND rows_.i = ways.i + 1 JOIN edits ON edits.p = ways.q
    WHERE edit = 'D' OR fault NOT IN ('b', 'd') AND (right(edit, 1) = 'R' OR letter = a)
    GROUP BY ways.g, rows_.i, edits.q
), ends AS (
    SELECT ways.g, min({{'cost': way.cost + CASE q WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END, 'audit': way.audit || CASE q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END}}) AS way
    FROM ways JOIN (SELECT groups.g, coalesce(max(i), 0) AS n FROM groups LEFT JOIN rows_ USING (g) GROUP BY 1) sizes ON sizes.g = ways.g AND ways.i = n
    GROUP BY ways.g
), letters AS (
    SELECT g, unnest(string_split(way.audit, '')) AS edit, generate_subscripts(string_split(way.audit, ''), 1) AS j FROM ends WHERE way.audit <> ''
), met AS (
    SELECT g, j, edit, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY j) AS i,
        sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY j) AS o
    FROM letters
), shown AS (
    SELECT met.g, j, edit, o, role, text, a,
        max(CASE WHEN o = 1 AND edit = 'K' AND a = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY met.g) AS led
    FROM met LEFT JOIN rows_ ON rows_.g = met.g AND rows_.i = met.i AND edit <> 'I' WHERE edit <> 'D'
), repaired AS (
    SELECT g, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS r
    FROM shown GROUP BY g
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, way.cost AS cost, way.audit AS audit, sha256(coalesce(r, '')) AS repaired_sha256
FROM groups JOIN ends USING (g) LEFT JOIN counts USING (g) LEFT JOIN repaired USING (g)
"""

#: A node's key is the hashes of its turns in order, so that its subtree has its key as their prefix.
OP12 = f"""
WITH {CRC_TABLE}, turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, n, conv_id - conv_id % 5 AS base, {_crc("conv_id::VARCHAR")} % 9 AS h FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1), crc_table
), lent AS (
    SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS m FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
), steps AS (
    SELECT lent.conv_id, p AS d, role, text FROM lent JOIN turns ON turns.conv_id = base AND p <= h
    UNION ALL SELECT lent.conv_id, m + p - h, role, text FROM lent JOIN turns ON turns.conv_id = lent.conv_id AND p > h
), keyed AS (
    SELECT conv_id, d, strlen(text) AS bytes, string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM steps
), walks AS (
    SELECT conv_id, 0 AS d, 0 AS bytes, '' AS k FROM convs UNION ALL SELECT conv_id, d, bytes, k FROM keyed
), ends AS (
    SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(k) AS k FROM walks GROUP BY 1) GROUP BY 1
), nodes AS (
    SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * max(bytes) AS saved FROM walks GROUP BY 1, 2
), kids AS (
    SELECT left(k, 32 * (d - 1)) AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), below AS (
    SELECT a.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum(b.saved) AS saved_tokens
    FROM nodes a JOIN nodes b ON starts_with(b.k, a.k) LEFT JOIN kids ON kids.k = b.k GROUP BY 1
)
SELECT nodes.conv_id, nodes.d::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
    saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes LEFT JOIN nodes up ON nodes.d > 0 AND up.k = left(nodes.k, 32 * (nodes.d - 1)) LEFT JOIN kids ON kids.k = nodes.k
    JOIN below ON below.k = nodes.k LEFT JOIN ends ON ends.k = nodes.k
"""
