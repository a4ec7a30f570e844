"""DuckDB SQL of the queries that SQL expresses, written from their definitions."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

URL_FILTERS = r"""
WITH rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT page_id, host, path, h || p AS rule, verdict, length(h || p) AS n, length(h) AS hn FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT page_id, rule, verdict FROM fit QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, hn DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN low USING (s) WHERE m < doc_id),
one AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM one ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_FENCES = [("mean_word_chars", 16.0, 0.15, True), ("symbols_per_word", 8.0, 0.025, False), ("dup_line_share", 8.0, 0.06, False), ("repeat_share", 8.0, 0.03, False)]


#: Documents' worth of a parent's sketch in each sketch.
_PRIOR = 20


def _quality() -> str:
    value = {"mean_word_chars": "word_chars / greatest(n_words, 1)::DOUBLE", "symbols_per_word": "n_symbols / greatest(n_words, 1)::DOUBLE", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)::DOUBLE", "repeat_share": "n_repeat_words / greatest(n_words, 1)::DOUBLE"}
    long = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{f}' AS f, {v} AS v FROM counts WHERE NOT base_failed" for f, v in value.items())
    own = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{f}' AS f, {v} AS v FROM counts" for f, v in value.items())
    k, least, two = ("CASE f " + " ".join(f"WHEN '{r[0]}' THEN {r[i]}" for r in _FENCES) + " END" for i in (1, 2, 3))

    prior = f"{float(_PRIOR)}::DOUBLE"

    q = lambda b: f"CASE WHEN {b} = -1048576 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * pow(g, {b}) / (g + 1) END"
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 6)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM win JOIN (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, s)) GROUP BY doc_id),
base AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
counts AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
gamma AS (SELECT 1.01::DOUBLE / 0.99::DOUBLE AS g),
buckets AS (SELECT doc_id, lang, source, f, CASE WHEN v <= 1e-6 THEN -1048576 ELSE ceil(ln(v) / ln(g))::INTEGER END AS b FROM ({long}), gamma),
n_all AS (SELECT f, b, count(*) AS n FROM buckets GROUP BY ALL),
n_lang AS (SELECT lang, f, b, count(*) AS n FROM buckets GROUP BY ALL),
n_fine AS (SELECT lang, source, f, b, count(*) AS n FROM buckets GROUP BY ALL),
p_lang AS (SELECT lang, f, b, sum(n) AS n FROM (SELECT lang, f, b, n::DOUBLE AS n FROM n_lang UNION ALL SELECT lang, f, b, {prior} * n / sum(n) OVER (PARTITION BY lang, f) FROM (SELECT DISTINCT lang, f FROM n_lang) JOIN n_all USING (f)) GROUP BY ALL),
p_fine AS (SELECT lang, source, f, b, sum(n) AS n FROM (SELECT lang, source, f, b, n::DOUBLE AS n FROM n_fine UNION ALL
    SELECT g.lang, source, g.f, b, {prior} * n / sum(n) OVER (PARTITION BY g.lang, source, g.f) FROM (SELECT DISTINCT lang, source, f FROM n_fine) g JOIN p_lang p ON g.f = p.f AND g.lang IS NOT DISTINCT FROM p.lang) GROUP BY ALL),
upto AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, f ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, source, f) AS total FROM p_fine),
used AS (SELECT lang, source, f, min(b) FILTER (upto >= 0.25::DOUBLE * total - 1e-9 * total) AS b1, min(b) FILTER (upto >= 0.5::DOUBLE * total - 1e-9 * total) AS b2, min(b) FILTER (upto >= 0.75::DOUBLE * total - 1e-9 * total) AS b3 FROM upto GROUP BY ALL),
quart AS (SELECT lang, source, f, {q("b1")} AS q1, {q("b2")} AS q2, {q("b3")} AS q3 FROM used, gamma),
fence AS (SELECT lang, source, f, q2 + {k} * greatest(abs(q3 - q2), {least}) AS hi, CASE WHEN {two} THEN q2 - {k} * greatest(abs(q2 - q1), {least}) ELSE -1.0 END AS lo FROM quart),
outside AS (SELECT DISTINCT v.doc_id FROM ({own}) v JOIN fence ON v.f = fence.f AND v.lang IS NOT DISTINCT FROM fence.lang AND v.source IS NOT DISTINCT FROM fence.source WHERE v.v > hi OR v.v < lo)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND outside.doc_id IS NULL AS kept FROM counts LEFT JOIN outside USING (doc_id)
"""


QUALITY_RULES = _quality()

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0 AND list_dot_product(a.e, b.e) >= 0.9::DOUBLE * a.size * b.size),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""

MERKLE_MANIFEST = """
WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars, source, text, concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END, CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END) AS head,
    CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END AS tail FROM documents),
shown AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf, sha256(head || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS other FROM f),
bits AS (SELECT b, CASE WHEN b % 2 = 1 THEN xor(3988292384::UBIGINT, b >> 1) ELSE b >> 1 END AS c FROM (SELECT unnest(range(256))::UBIGINT AS b)),
table0 AS (SELECT 0 AS k, b, b AS c FROM bits UNION ALL SELECT k + 1, b, CASE WHEN c % 2 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END FROM table0 WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM table0 WHERE k = 8),
crc AS (SELECT DISTINCT doc_id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::BIGINT + 1])) AS c FROM shown, crc_table WHERE doc_id IS NOT NULL),
leaves AS (SELECT s.doc_id, g, leaf, CASE WHEN xor(c, 4294967295::UBIGINT) % 7 = 0 THEN other ELSE leaf END AS shown, row_number() OVER (PARTITION BY g ORDER BY s.doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM shown s LEFT JOIN crc ON s.doc_id = crc.doc_id),
tree AS (SELECT g, 0 AS level, pos, n, leaf AS h FROM leaves UNION ALL SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, level, pos // 2, n),
subroots AS (SELECT g, h AS subroot, level AS height, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, pos, n, subroot AS h FROM subroots UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
whole AS (SELECT h AS root FROM top WHERE n = 1),
nodes AS (SELECT g, level, pos, n, h FROM tree WHERE n > 1 UNION ALL SELECT s.g, s.height + t.level, t.pos, t.n, t.h FROM top t, subroots s WHERE t.n > 1),
places AS (SELECT l.g, l.pos, height, s.pos AS top_pos, doc_id, leaf, shown, row_number() OVER () AS id FROM leaves l JOIN subroots s ON l.g = s.g),
climb AS (SELECT id, g, 0 AS level, CASE WHEN height = 0 THEN top_pos ELSE pos END AS pos, height, top_pos, shown AS h, '' AS proof FROM places
  UNION ALL SELECT c.id, c.g, c.level + 1, CASE WHEN c.level + 1 = height THEN top_pos ELSE c.pos // 2 END, height, top_pos, CASE WHEN s.h IS NULL THEN sha256(c.h) WHEN c.pos % 2 = 1 THEN sha256(s.h || c.h) ELSE sha256(c.h || s.h) END, proof || coalesce(s.h, '')
  FROM climb c JOIN nodes o ON o.g = c.g AND o.level = c.level AND o.pos = c.pos LEFT JOIN nodes s ON s.g = c.g AND s.level = c.level AND s.pos = xor(c.pos, 1)),
ends AS (SELECT id, h, proof FROM climb QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, e.h AS folded_root, e.h = root AS verified FROM places p JOIN ends e USING (id) JOIN subroots s ON s.g = p.g, whole
"""

SOURCE_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
posts AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, sum(c)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM groups LEFT JOIN posts USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(posts.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(posts.c, 0) + 1)) // (s.n + l.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 1)) // (l.n + l.v) AS q
  FROM sizes s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN posts ON posts.lang = s.lang AND posts.source = s.source AND posts.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM found QUALIFY part = 'pair' OR rank <= 200
"""

ORACLE_SQL = {"op12_merkle_manifest": MERKLE_MANIFEST, "op13_source_divergence": SOURCE_DIVERGENCE, "op5_embedding_dedup": EMBEDDING_DEDUP, "op7_url_filters": URL_FILTERS, "op8_quality_rules": QUALITY_RULES, "op9_substring_dedup": SUBSTRING_DEDUP}
