"""DuckDB SQL for the queries of this subpackage that SQL can express on a small table."""

from __future__ import annotations

#: Every 50-byte string of every text as hex digits, its least doc_id, and the runs of bytes that later documents' strings cover.
SUBSTRINGS = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS o, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT rid, o, u.i, substr(h, 2 * u.i + 1, 100) AS s FROM d, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS u(i)),
f AS (SELECT s, min(o) AS least FROM w GROUP BY s HAVING count(*) > 1),
c AS (SELECT w.rid, w.i FROM w JOIN f ON w.s = f.s AND w.o > f.least),
g AS (SELECT rid, i, CASE WHEN i > lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM c),
r AS (SELECT rid, min(i) AS a, max(i) + 50 AS b FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM g) GROUP BY rid, run),
p AS (SELECT r.rid, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r.rid ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r.rid ORDER BY a), 0))) AS before FROM r JOIN d USING (rid)),
k AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS stop, string_agg(before, '' ORDER BY a) AS kept FROM p GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""

_ASSIGN = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PATTERNS = [
    (0, "assign", _ASSIGN, 2, 8),
    (1, "access", "AKIA[A-Z0-9]+", 0, 16),
    (2, "hex", "[0-9a-f]+", 0, 32),
    (3, "pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    (4, "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
]
#: Matches of each kind and what lies between them give their places in code points.
LEDGER = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS ("
    + " UNION ALL ".join(f"SELECT rid, {k} AS k, '{name}' AS kind, {least} AS least, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS got, regexp_extract_all(t, '{p}', {group}) AS part FROM d WHERE regexp_matches(t, '{p}')" for k, name, p, group, least in _PATTERNS)
    + """), e AS (SELECT rid, k, kind, least, u.i, got[u.i] AS g, part[u.i] AS part, length(gaps[u.i]) AS gap FROM m, unnest(range(1, len(got) + 1)) AS u(i)),
    s AS (SELECT *, sum(gap + length(g)) OVER (PARTITION BY rid, k ORDER BY i) AS stop FROM e),
    x AS (SELECT rid, k, kind, stop - length(g) AS start, kind || ':' || (stop - length(g))::BIGINT || ':' || stop::BIGINT AS span FROM s WHERE length(part) >= least),
    a AS (SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS every FROM x GROUP BY rid)
    SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN a USING (rid)"""
)

#: All pairs that share a shingle, and everything that a document reaches by links.
JACCARD = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
u AS (SELECT rid, len(sh) AS n, unnest(sh) AS t FROM s),
c AS (SELECT a.rid AS x, b.rid AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common FROM u a JOIN u b ON a.t = b.t AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM c WHERE 100 * common >= 80 * (nx + ny - common)),
ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rid, rid AS reached FROM s UNION SELECT r.rid, ways.y FROM r JOIN ways ON r.reached = ways.x)
SELECT any_value(s.doc_id) AS doc_id, any_value(len(s.sh))::BIGINT AS n_shingles, min(o.doc_id) AS component_id FROM r JOIN s ON r.rid = s.rid JOIN s o ON r.reached = o.rid GROUP BY r.rid
"""

#: The same with two words, and which documents stay.
MINHASH = (
    JACCARD.replace("len(ws) < 5 ", "len(ws) < 2 ").replace("len(ws) - 3)", "len(ws))").replace("ws[i : i + 4]", "ws[i : i + 1]").replace("SELECT any_value(s.doc_id) AS doc_id", "SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM (SELECT any_value(s.doc_id) AS doc_id").rstrip() + ")"
)

_FLOORED = lambda s, n: f"(({s} - ((({s} % {n}) + {n}) % {n})) // {n})::BIGINT"
#: Each round compares every part with every entry.
VECTOR_CODES = (
    """
WITH kept AS (SELECT vec_id, label, row_number() OVER () AS rid, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS o, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT rid, o, part, list_slice(v, part * (len(v) // 8) + 1, (part + 1) * (len(v) // 8)) AS v FROM kept, unnest(range(8)) AS u(part)),
c0 AS MATERIALIZED (SELECT part, o - 1 AS entry, v FROM p WHERE o <= 16)"""
    + "".join(
        f""",
a{i} AS MATERIALIZED (SELECT p.rid, p.part, min(struct_pack(d := list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry := c.entry)) AS m FROM p JOIN c{i} c USING (part) GROUP BY ALL)"""
        + (
            f""",
s{i} AS (SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.part, a.m.entry AS entry, unnest(range(len(v))) AS place, unnest(v) AS x FROM a{i} a JOIN p ON a.rid = p.rid AND a.part = p.part) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT part, entry, list({_FLOORED("s", "n")} ORDER BY place) AS v FROM s{i} GROUP BY ALL) m USING (part, entry))"""
            if i < 6
            else ""
        )
        for i in range(7)
    )
    + """,
e AS (SELECT rid, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a6 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c6) AS codebooks_sha256 FROM kept JOIN e USING (rid)
"""
)

#: CRC-32 bit by bit: a byte goes in, then eight steps (-1) follow.
RESAMPLING = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
u AS MATERIALIZED (SELECT rid, unnest(ws) AS w FROM d),
k AS MATERIALIZED (SELECT w, xor(list_reduce(flatten(list_transform(range(length(hex(encode(w))) // 2), lambda i: [('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END, 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
    FROM (SELECT w FROM u UNION SELECT w FROM b)),
s AS (SELECT bucket, count(*) AS s FROM u JOIN k USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (w) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM u) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT rid, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM u JOIN k USING (w) JOIN g USING (bucket) GROUP BY rid),
x AS (SELECT rid, doc_id, len(ws) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n, weight) AS rank FROM x WHERE n >= 20)
SELECT doc_id, n::BIGINT AS n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (rid)
"""

ORACLES = {"op4_substrings": SUBSTRINGS, "op9_ledger": LEDGER, "op10_jaccard": JACCARD, "op11_vector_codes": VECTOR_CODES, "op12_resampling": RESAMPLING, "op13_minhash": MINHASH}
