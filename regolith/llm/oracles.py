"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from regolith.llm import secrets

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
e AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(8), lambda j: array_to_string(list_transform([32768, 1024, 32, 1],
      lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * j AS INT), 5) AS BIGINT) // q) % 32 AS INT), 1)), '')), '') AS payload_digest
  FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM e)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

DECONTAMINATE = r"""
WITH norm AS (
  SELECT 'd' AS side, doc_id AS id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM documents
  UNION ALL SELECT 'i', item_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) FROM benchmark),
w AS (SELECT side, id, t, string_split(t, ' ') AS w FROM norm WHERE t <> ''),
items AS (SELECT DISTINCT id AS item_id, t, w, least(5, len(w)) AS width FROM w WHERE side = 'i'),
s AS (SELECT DISTINCT item_id, t, width, array_to_string(w[k:k + width - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS k FROM items)),
n AS (SELECT item_id, t, count(*) AS n_item FROM s GROUP BY item_id, t),
dw AS (SELECT d.id AS doc_id, d.t AS dt, d.w, x.width FROM w d, (SELECT DISTINCT width FROM items) x WHERE d.side = 'd'),
ds AS (SELECT DISTINCT doc_id, dt, width, array_to_string(w[k:k + width - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - width + 2, 1))) AS k FROM dw)),
j AS (SELECT doc_id, dt, item_id, s.t, count(*) AS n_shared FROM ds JOIN s USING (width, s) GROUP BY doc_id, dt, item_id, s.t)
SELECT DISTINCT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM j JOIN n USING (item_id, t) WHERE n_shared >= 0.8 * n_item - 1e-9
"""


def _found(name: str, pattern: str, rank: int, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
{name}_m AS (
  SELECT rid, string_split_regex(t, '{quoted}') AS gap, regexp_extract_all(t, '{quoted}', 0) AS hit, regexp_extract_all(t, '{quoted}', {group}) AS val
  FROM d WHERE regexp_matches(t, '{quoted}')),
{name}_s AS (
  SELECT rid, {rank} AS rank, '{name}' AS kind, hit[k] AS h, val[k] AS value,
    CAST(list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS k FROM {name}_m) WHERE length(val[k]) >= {least})"""


SECRETS = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents),"
    + ",".join(
        _found(secrets.KINDS[r], p, r, g, n)
        for r, (p, g, n) in enumerate([(secrets.ASSIGN, 2, 8), (secrets.ACCESS, 0, 0), (secrets.HEX, 0, 0), (secrets.VENDOR, 0, 0)])
    )
    + """,
s AS (
  SELECT rid, rank, kind || ':' || start || ':' || (start + length(h)) AS span, start, value
  FROM (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s UNION ALL SELECT * FROM vendor_s)),
p AS (SELECT value, owner, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS n FROM s JOIN d USING (rid) GROUP BY value, owner),
o AS (SELECT value, count(*) >= 3 AND max(n) / sum(n) <= 0.9 AS example FROM p GROUP BY value),
g AS (
  SELECT rid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base, string_agg(span, ',' ORDER BY start, rank) AS spans,
    count(*) FILTER (NOT example AND len(list_distinct(string_split(value, ''))) >= 8) AS n_live, count(*) FILTER (example) AS n_example
  FROM s JOIN o USING (value) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN g USING (rid)
"""
)

SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT rid, i FROM win JOIN least_doc USING (s) WHERE doc_id > m),
gone AS (SELECT DISTINCT rid, i + k AS p FROM hit, range(13) t(k)),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

SUFFIXES = """
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, k, p, substring(h, 2 * p + 1, 100) AS s FROM (SELECT rid, k, h, unnest(range(0, CAST(length(h) // 2 AS BIGINT) - 49)) AS p FROM d)),
f AS (SELECT s, min(k) AS m FROM w GROUP BY s),
r AS (SELECT rid, p, coalesce(p > 50 + lag(p) OVER (PARTITION BY rid ORDER BY p), true) AS fresh FROM w JOIN f USING (s) WHERE k > m),
n AS (SELECT rid, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY rid ORDER BY p) AS run FROM r),
g AS (SELECT rid, run, min(p) AS b, max(p) + 50 AS e FROM n GROUP BY rid, run),
k AS (SELECT rid, b, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY b), 0) AS last_end FROM g),
x AS (
  SELECT d.rid, string_agg(substring(d.h, 2 * k.last_end + 1, 2 * (k.b - k.last_end)), '' ORDER BY k.b) || substring(any_value(d.h), 2 * max(k.e) + 1) AS kept,
    CAST(sum(k.e - k.b) AS BIGINT) AS n_removed, count(*) AS n_spans
  FROM k JOIN d USING (rid) GROUP BY d.rid)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(x.n_removed, 0) AS n_removed, coalesce(x.n_spans, 0) AS n_spans, sha256(unhex(coalesce(x.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN x USING (rid)
"""

COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - CAST(m AS BIGINT) + 2)) AS i FROM w, range(1, 6) AS s(m)) GROUP BY ALL),
c AS (SELECT * FROM g WHERE m > 1 AND f >= 100),
k AS (SELECT c.*, string_split(phrase, ' ') AS x, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.m, k.f AS a, k.k, l.f AS l, r.f AS r, n.n, (CAST(1000 AS HUGEINT) * k.f * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM k JOIN n USING (lang) JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(k.x[1:k.k], ' ') JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(k.x[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND 100 * c.f >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM q WHERE rank <= 2000
"""

SQL = {"op2_warc": WARC, "op4_top_k": TOP_K, "op6_decontaminate": DECONTAMINATE, "op7_secrets": SECRETS, "op8_substrings": SUBSTRINGS, "op11_collocations": COLLOCATIONS, "op13_suffix_dedup": SUFFIXES}
