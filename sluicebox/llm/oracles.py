"""DuckDB SQL for the queries of this subpackage that SQL can state."""

from __future__ import annotations

# The remainder by 6 of the CRC-32 (reflected polynomial 0xEDB88320) of a number's decimal text.
_CRC = """
    xor(list_reduce(
        list_concat([4294967295::BIGINT],
            list_transform(range(1, len({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)),
        lambda a, b: list_reduce(
            list_concat([xor(a, b)], range(8)),
            lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) % 6
"""

PREFIX_TRIE = f"""
WITH own AS (
    SELECT conv_id,
        list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS xs
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), cut AS (
    SELECT *, {_CRC.format(text="CAST(conv_id AS VARCHAR)")} AS h FROM own
), rebuilt AS (
    SELECT c.conv_id AS c, list_concat(coalesce(b.xs[1:c.h], []), c.xs[c.h + 1:]) AS xs
    FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), way AS (
    SELECT c, d, sha256(CAST(to_json(xs[1:d]) AS VARCHAR)) AS id,
        CASE WHEN d > 0 THEN sha256(CAST(to_json(xs[1:d - 1]) AS VARCHAR)) END AS up,
        d = len(xs) AS ends, CASE WHEN d > 0 THEN length(xs[d].t) ELSE 0 END AS chars
    FROM rebuilt, unnest(range(0, len(xs) + 1)) AS s(d)
), node AS (
    SELECT id, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs,
        (count(*) - 1) * any_value(chars) AS own,
        sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends_sha256
    FROM way GROUP BY id
), kids AS (
    SELECT up AS id, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up
), sums AS (
    SELECT w.id, sum(n.own) AS saved, count(*) FILTER (k.id IS NULL) AS n_leaves
    FROM node n JOIN way w ON w.c = n.conv_id AND w.d <= n.depth LEFT JOIN kids k ON k.id = n.id
    GROUP BY w.id
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
    s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN sums s ON s.id = n.id LEFT JOIN kids k ON k.id = n.id LEFT JOIN node p ON p.id = n.up
"""


def _nearest(book: str) -> str:
    return f"""
    SELECT rid, part, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
        SELECT c.rid, c.part, b.e, sum((c.v - b.v) * (c.v - b.v)) AS d
        FROM component c JOIN {book} b ON b.part = c.part AND b.j = c.j GROUP BY c.rid, c.part, b.e
    ) GROUP BY rid, part
"""


def _moved(book: str, given: str) -> str:
    return f"""
    SELECT b.part, b.e, b.j, coalesce((s.t - ((s.t % s.n) + s.n) % s.n) // s.n, b.v) AS v FROM {book} b LEFT JOIN (
        SELECT c.part, a.e, c.j, sum(c.v)::BIGINT AS t, count(*) AS n
        FROM component c JOIN {given} a ON a.rid = c.rid AND a.part = c.part GROUP BY c.part, a.e, c.j
    ) s ON s.part = b.part AND s.e = b.e AND s.j = b.j
"""


VECTOR_CODES = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), component AS MATERIALIZED (
    SELECT rid, i // (len(embedding) // 16) AS part, i % (len(embedding) // 16) AS j,
        CAST(floor(256 * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS v
    FROM kept, unnest(range(0, len(embedding))) AS s(i)
), book0 AS MATERIALIZED (SELECT part, rid - 1 AS e, j, v FROM component WHERE rid <= 64
), given0 AS MATERIALIZED ({_nearest("book0")}
), book1 AS MATERIALIZED ({_moved("book0", "given0")}
), given1 AS MATERIALIZED ({_nearest("book1")}
), book2 AS MATERIALIZED ({_moved("book1", "given1")}
), given2 AS MATERIALIZED ({_nearest("book2")}
), coded AS (
    SELECT k.vec_id, k.label, g.code, g.error FROM kept k JOIN (
        SELECT rid, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
        FROM given2 GROUP BY rid
    ) g ON g.rid = k.rid
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
    (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, e, j)) FROM book2) AS codebooks_sha256
FROM coded
"""
