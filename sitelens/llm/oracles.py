"""DuckDB SQL for the operators that need more of it than a query."""

from __future__ import annotations

_CRC32 = """(4294967295 - list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
            lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                                     lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)))"""

PREFIX_TRIE = f"""
    WITH own AS MATERIALIZED (
        SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), taken AS (SELECT *, ({_CRC32} % 6)::INTEGER AS h FROM own),
    rebuilt AS MATERIALIZED (
        SELECT c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) AS seq
        FROM taken c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
    ), prefixes AS (
        SELECT conv_id, d::BIGINT AS depth, d = len(seq) AS ends, sha256(list_slice(seq, 1, d)::VARCHAR) AS node,
               CASE WHEN d > 0 THEN sha256(list_slice(seq, 1, d - 1)::VARCHAR) END AS parent,
               CASE WHEN d > 0 THEN length(seq[d].text) ELSE 0 END AS chars
        FROM rebuilt, unnest(range(len(seq) + 1)) AS t(d)
    ), nodes AS MATERIALIZED (
        SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
        FROM prefixes GROUP BY node, depth
    ), children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
    above AS (
        SELECT DISTINCT sha256(list_slice(seq, 1, a)::VARCHAR) AS node, sha256(list_slice(seq, 1, d)::VARCHAR) AS below
        FROM rebuilt, unnest(range(len(seq) + 1)) AS t(d), unnest(range(d + 1)) AS u(a)
    ), sums AS (
        SELECT a.node, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.chars)::BIGINT AS saved_tokens
        FROM above a JOIN nodes b ON b.node = a.below LEFT JOIN children c ON c.node = b.node GROUP BY a.node
    )
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.n_leaves, s.saved_tokens,
           n.ends_sha256
    FROM nodes n JOIN sums s USING (node) LEFT JOIN children c USING (node) LEFT JOIN nodes p ON p.node = n.parent"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Rounds of assignment and floored means, one pair of CTEs a round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
            SELECT v.vec_id, v.part, any_value(v.x) AS x, arg_min(b.entry, (d, b.entry)) AS entry, min(d) AS d
            FROM parts v JOIN b{k} b USING (part),
                 LATERAL (SELECT list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d)
            GROUP BY v.vec_id, v.part)""")
        if k < rounds:
            steps.append(f"""m{k} AS (
            SELECT part, entry, list(mean ORDER BY i) AS x FROM (
                SELECT part, entry, i, floor(sum(x[i]) / count(*))::BIGINT AS mean
                FROM a{k}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY part, entry, i) GROUP BY part, entry),
        b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))""")
    return f"""
    WITH v AS (
        SELECT vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    ), parts AS MATERIALIZED (
        SELECT vec_id, label, part, list_slice(x, part * len(x) // {parts} + 1, (part + 1) * len(x) // {parts}) AS x
        FROM v, unnest(range({parts})) AS t(part)
    ), b0 AS MATERIALIZED (
        SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts
        QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries}
    ), {", ".join(steps)},
    coded AS (
        SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
        FROM a{rounds} GROUP BY vec_id
    )
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
           (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
    FROM coded JOIN v USING (vec_id)"""
