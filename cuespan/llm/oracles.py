"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP5 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g USING (text)
"""

OP9 = """
WITH tab AS (
  SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)),
h AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x FROM documents),
d AS (
  SELECT doc_id, source, (length(x) // 2 + 1)::BIGINT AS size,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))::BIGINT AS text_crc32,
    coalesce('s' || source, 'n') AS stratum,
    ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM h, tab),
r AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, size, text_crc32) - 1 AS k,
    count(*) OVER (PARTITION BY stratum) AS n_source, count(*) OVER () AS n FROM d),
p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * k + 1)::DOUBLE / (2 * n_source)::DOUBLE, stratum, key, doc_id, size, text_crc32) - 1 AS pos FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 16 // n)::INT AS shard, (pos - ((pos * 16 // n) * n + 15) // 16)::BIGINT AS slot,
  NULL::INT AS grown_shard, source, n_source
FROM p
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, min(page_id) AS first_id FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha256(p.html) AS payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (html)
"""

#: Every 50-byte string with the smallest document it starts in, then the bytes that remain.
OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
p AS (SELECT doc_id, unnest(range(n_bytes)) AS p FROM d WHERE n_bytes > 0),
w AS (SELECT doc_id, p, x[2 * p + 1:2 * p + 100] AS w FROM p JOIN d USING (doc_id) WHERE p + 50 <= n_bytes),
m AS (SELECT w, min(doc_id) AS low FROM w GROUP BY w HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT w.doc_id, w.p FROM w JOIN m USING (w) WHERE m.low < w.doc_id),
b AS (
  SELECT p.doc_id, p.p, max(h.p) OVER (PARTITION BY p.doc_id ORDER BY p.p ROWS UNBOUNDED PRECEDING) >= p.p - 49 AS gone
  FROM p LEFT JOIN h ON h.doc_id = p.doc_id AND h.p = p.p),
s AS (SELECT doc_id, p, coalesce(gone, FALSE) AS gone FROM b),
f AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS first FROM s),
k AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans,
    string_agg(CASE WHEN gone THEN '' ELSE x[2 * p + 1:2 * p + 2] END, '' ORDER BY p) AS kept FROM f JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

#: Links by cosine, then the smallest vector reachable.
OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.q > 0 AND b.q > 0 AND list_dot_product(a.e, b.e) / sqrt(a.q) / sqrt(b.q) >= 0.98),
r AS (SELECT a AS node, b AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS low FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
  least(e.vec_id, coalesce(low, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

#: Five-word shingles, exact Jaccard of every pair that shares one, then the smallest document reachable.
OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r AS (SELECT a AS node, b AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS low FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id,
  least(w.doc_id, coalesce(low, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""

#: Every prefix of the rebuilt conversations as a hash, its members, and the prefixes that extend it.
OP11 = """
WITH tab AS (
  SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) r(n)),
t AS (
  SELECT conv_id, turn, strlen(coalesce(text, ''))::BIGINT AS bytes,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'k': k, 'b': bytes} ORDER BY turn NULLS FIRST, k) AS o FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, o, conv_id - conv_id % 5 AS base,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(length(conv_id::VARCHAR)), lambda i: ascii((conv_id::VARCHAR)[i + 1])::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 9 AS h
  FROM o, tab),
r AS (SELECT h.conv_id, coalesce(b.o[1:h.h], []) || h.o[h.h + 1:] AS o FROM h LEFT JOIN o b ON b.conv_id = h.base),
p AS (
  SELECT conv_id, d, sha256(array_to_string(list_transform(o[1:d], lambda x: x.k), ',')) AS node, sha256(array_to_string(list_transform(o[1:d - 1], lambda x: x.k), ',')) AS parent,
    CASE WHEN d = 0 THEN 0 ELSE o[d].b END AS bytes, d = len(o) AS ends
  FROM (SELECT conv_id, o, unnest(range(len(o) + 1)) AS d FROM r)),
n AS (
  SELECT node, any_value(CASE WHEN d > 0 THEN parent END) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY node),
c AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
u AS (SELECT DISTINCT a.node AS top, b.node FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.d <= b.d),
s AS (
  SELECT top, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
  FROM u JOIN n ON n.node = u.node LEFT JOIN c ON c.node = u.node GROUP BY top)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n LEFT JOIN n q ON q.node = n.parent LEFT JOIN c ON c.node = n.node JOIN s ON s.top = n.node
"""

#: Every window of 35 words and how often its sequence occurs, then the words that remain.
OP12 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(len(w))) AS p FROM w WHERE len(w) > 0),
k AS (SELECT doc_id, p, sha256(array_to_string(w[p + 1:p + 35], ' ')) AS k FROM p JOIN w USING (doc_id) WHERE p + 35 <= len(w)),
h AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1),
g AS (
  SELECT p.doc_id, p.p, coalesce(max(h.p) OVER (PARTITION BY p.doc_id ORDER BY p.p ROWS UNBOUNDED PRECEDING) >= p.p - 34, FALSE) AS gone
  FROM p LEFT JOIN h ON h.doc_id = p.doc_id AND h.p = p.p),
s AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w[p + 1], ' ' ORDER BY p) FILTER (NOT gone) AS kept
  FROM g JOIN w USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2, "op3_embedding_near_dedup": OP3, "op5_exact_dedup": OP5, "op8_minhash_near_dedup": OP8, "op9_sharding": OP9, "op10_warc": OP10, "op11_conversation_trie": OP11, "op12_substring_dedup": OP12}
