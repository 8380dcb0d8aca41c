"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

#: crc32 of the decimal text of c, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, byte: list_reduce(list_concat([xor(acc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda crc, turn: CASE WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END)), 4294967295)"""

OP12_PREFIX_TRIE = f"""
WITH own AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
        coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, c - c % 20 AS base, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
turn AS (
    SELECT conv.c, place, role, text FROM conv JOIN own ON own.c = conv.base AND place <= h
    UNION ALL SELECT conv.c, place + 4, role, text FROM conv JOIN own ON own.c = conv.c AND place > h),
seq AS (
    SELECT conv.c,
        coalesce(list(md5(length(role) || ':' || role || text) ORDER BY place) FILTER (place IS NOT NULL), []) AS keys,
        coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY place) FILTER (place IS NOT NULL), []) AS words
    FROM conv LEFT JOIN turn USING (c) GROUP BY conv.c),
pre AS (
    SELECT c, d, keys[1:d] AS k, CASE WHEN d = 0 THEN 0 ELSE words[d] END AS w, d = len(keys) AS ends
    FROM seq, unnest(range(0, len(keys) + 1)) AS depths(d)),
node AS (
    SELECT k, d, min(c) AS c, count(*) AS n, max(w) AS w,
        coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ending
    FROM pre GROUP BY k, d),
kid AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kid.n, 0) AS children FROM node LEFT JOIN kid USING (k)),
sub AS (
    SELECT k[1:a] AS k, sum((n - 1) * w) AS saved, count(*) FILTER (children = 0) AS leaves
    FROM full_node, unnest(range(0, d + 1)) AS above(a) GROUP BY ALL)
SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.children::BIGINT AS n_children,
    sub.leaves AS n_leaves, sub.saved::BIGINT AS saved_tokens, sha256(f.ending) AS ends_sha256
FROM full_node f JOIN sub ON sub.k = f.k LEFT JOIN node p ON f.d > 0 AND p.k = f.k[1:f.d - 1]
"""

OP13_HARD_NEGATIVES = """
WITH usable AS (
    SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END,
        'v': list_transform(embedding, lambda x: floor(x::DOUBLE * 256))}) AS r
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    GROUP BY vec_id),
score AS (
    SELECT a.vec_id AS a, b.vec_id AS b, a.r.label = b.r.label AS same, list_inner_product(a.r.v, b.r.v)::BIGINT AS s
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.r.v) = len(b.r.v) WHERE a.vec_id % 50 = 0),
positive AS (
    SELECT a, b, s FROM score WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER w::INT AS rank, n.b AS negative_id, p.s AS positive_score,
    n.s AS negative_score
FROM positive p JOIN score n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)
QUALIFY row_number() OVER w <= 3
"""

#: Tokenizers, trained models, shard files and iterations over links have no SQL; tests/llm checks them otherwise.
LLM_ORACLES: dict[str, str] = {
    "op12_prefix_trie": OP12_PREFIX_TRIE,
    "op13_hard_negatives": OP13_HARD_NEGATIVES,
}
