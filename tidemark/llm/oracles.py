"""DuckDB SQL with the results of those queries of this folder that SQL can express."""

from __future__ import annotations

#: Payloads as they are written; equal ones of at least 1000 bytes are revisits of the last page that has them.
OP10 = """
WITH raw AS (
    SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages
), last AS (
    SELECT *, max(page_id) OVER (PARTITION BY html) AS origin FROM raw
)
SELECT page_id, size::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
    CASE WHEN size >= 1000 AND page_id <> origin THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN size >= 1000 AND page_id <> origin THEN origin END AS refers_to
FROM last
"""

#: Every order of the filters is a row of (order, step, filter, the filters before it); a part's documents are
#: counted by the set of filters that they fail, and each step sums over those sets.
OP12 = r"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), split AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts
), said AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), marked AS (
    SELECT s.part,
        (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN s.doc_id > min(s.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask,
        coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
    FROM split s LEFT JOIN said l ON s.doc_id = l.doc_id
), cells AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY ALL
), f AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(name, bit)
), orders AS (
    SELECT a.name || b.name || c.name || d.name || e.name AS filter_order,
        [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a, f b, f c, f d, f e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
), counted AS (
    SELECT part, filter_order, step, own,
        sum(CASE WHEN mask & (earlier | own) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & own <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & own <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
    redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
    toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""

#: CRC-32 of the decimal id, bit by bit; nodes are prefixes as lists, and a subtree is what has the prefix.
OP13 = r"""
WITH own AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
    SELECT *, xor(4294967295::BIGINT, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, byte: list_reduce(
            [xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) % 6 AS h
    FROM own
), seqs AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS seq
    FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), members AS (
    SELECT conv_id, len(seq) AS size, d, seq[1:d] AS p FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM seqs)
), nodes AS (
    SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256
    FROM members GROUP BY d, p
), kids AS (
    SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), facts AS (
    SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.p = n.p
), below AS (
    SELECT a AS d, p[1:a] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
        sum(CASE WHEN d > 0 THEN (n_convs - 1) * length(p[d].text) ELSE 0 END) AS saved
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM facts) GROUP BY ALL
)
SELECT f.conv_id, f.d::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
    f.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM facts f JOIN below b ON b.d = f.d AND b.p = f.p
LEFT JOIN nodes up ON up.d = f.d - 1 AND up.p = f.p[1:f.d - 1]
"""

ORACLES = {"op10_warc": OP10, "op12_filter_audit": OP12, "op13_prefix_trie": OP13}
