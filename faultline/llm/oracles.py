"""SQL for the registered queries that SQL can express. The others are tested against brute force in tests/llm."""

from __future__ import annotations

from faultline.llm.queries import MIN_SITES

EDGES = "chr(32) || chr(9) || chr(13) || chr(11) || chr(12)"

LINES = f"""
WITH lines AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
           unnest(generate_series(1, len(string_split(text, chr(10))))) AS place
    FROM documents WHERE text IS NOT NULL),
keys AS (SELECT *, trim(line, {EDGES}) AS key FROM lines),
wide AS (
    SELECT key, min((doc_id, place)) AS first FROM keys WHERE key <> '' GROUP BY key
    HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {MIN_SITES}),
marked AS (
    SELECT k.*, (w.key IS NOT NULL AND (k.doc_id, k.place) <> w.first) AS gone FROM keys k LEFT JOIN wide w ON k.key = w.key AND k.key <> ''),
texts AS (
    SELECT doc_id, count(*) AS n_lines, sum(gone::INT) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
    FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(t.n_lines, 0)::INT AS n_lines, coalesce(t.n_removed, 0)::INT AS n_removed, t.text
FROM documents d LEFT JOIN texts t ON t.doc_id = d.doc_id
"""

MIXING = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
    SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
           source_size * 2.0::DOUBLE AS lim FROM s),
l AS (
    SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
               - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM w),
t AS (
    SELECT source, source_size,
           CASE WHEN lim <= level * weight THEN lim
                ELSE weight * (SELECT level FROM l WHERE lim > level * weight ORDER BY lim / weight, source NULLS LAST LIMIT 1) END AS target
    FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS base FROM t),
p AS (
    SELECT source, place, sum(size)::BIGINT AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY place)::BIGINT AS upto
    FROM d GROUP BY source, place),
c AS (
    SELECT p.source, p.place, (p.upto <= b.target - b.base * b.source_size
           OR (p.upto - p.n <= b.target - b.base * b.source_size AND 2 * (b.target - b.base * b.source_size - (p.upto - p.n)) > p.n))::BIGINT AS more,
           b.source_size, b.target, b.base
    FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, c.source_size, c.target, (d.size * (c.base + c.more))::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.place = c.place
"""

EXACT = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""

CHAT = r"""
WITH m AS (
    SELECT conv_id, turn, role, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words
    FROM conversations),
asked AS (
    SELECT u.*, a.text AS result, a.conv_id IS NOT NULL AS answered, e.conv_id IS NOT NULL AS met,
           CASE WHEN u.words > 40 THEN 'summarise' ELSE 'search' END AS name,
           CASE WHEN u.words > 40 THEN 'long' WHEN u.words % 7 = 0 THEN 'short' WHEN u.words % 5 = 0 THEN 'wrong' ELSE 'right' END AS kind
    FROM m u
    LEFT JOIN m a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    LEFT JOIN m e ON e.conv_id = u.conv_id AND e.turn = u.turn - 2 AND e.role = 'user'
    WHERE u.role = 'user')
SELECT conv_id, 2 * turn AS at, 0 AS level, 2 * turn AS turn, 0 AS part, 'message' AS kind, NULL::VARCHAR AS call_id, 'ok' AS status,
       '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' AS json
FROM m WHERE role <> 'assistant'
UNION ALL
SELECT conv_id, 2 * turn + 1, 0, 2 * turn + 1, 0, 'call', 'c' || turn,
       CASE WHEN turn >= 2 AND NOT met THEN 'unknown need' WHEN kind = 'short' THEN 'limit is missing' WHEN kind = 'wrong' THEN 'limit is no integer'
            WHEN NOT answered THEN 'no result' ELSE 'ok' END,
       '{"arguments":' || CASE kind
           WHEN 'long' THEN '{"text":' || to_json(text) || ',"words":' || words || '}'
           WHEN 'short' THEN '{"query":' || to_json(text) || '}'
           WHEN 'wrong' THEN '{"limit":"' || words || '","query":' || to_json(text) || '}'
           ELSE '{"limit":' || words || ',"query":' || to_json(text) || '}' END
       || ',"id":"c' || turn || '","name":"' || name || '"' || CASE WHEN answered THEN ',"result":' || to_json(result) ELSE '' END || ',"role":"assistant"}'
FROM asked
UNION ALL
SELECT m.conv_id, 2 * m.turn, 0, 2 * m.turn, 0, 'result', 'c' || (m.turn - 1),
       CASE WHEN u.conv_id IS NULL THEN 'no call' ELSE 'ok' END,
       '{"content":' || to_json(m.text) || ',"role":"tool","tool_call_id":"c' || (m.turn - 1) || '"}'
FROM m LEFT JOIN m u ON u.conv_id = m.conv_id AND u.turn = m.turn - 1 AND u.role = 'user'
WHERE m.role = 'assistant'
"""

SEARCH = """
WITH fine AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score,
           row_number() OVER (PARTITION BY q.uid ORDER BY list_inner_product(q.x, v.x) DESC, v.vec_id, v.uid) AS rank
    FROM fine q JOIN fine v ON q.uid <> v.uid WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

PHRASES = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spans AS (
    SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i
    FROM (SELECT lang, w, unnest(generate_series(1, least(5, len(w)))) AS m FROM words)),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*)::HUGEINT AS a FROM spans GROUP BY ALL),
totals AS (SELECT lang, sum(a)::HUGEINT AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND a >= 100),
cuts AS (
    SELECT c.lang, c.phrase, c.m, c.a, t.n, k, l.a AS l, r.a AS r, 1000 * c.a * t.n // (l.a * r.a) AS score
    FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM candidates) c
    JOIN totals t ON t.lang = c.lang
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT *, unnest(generate_series(1, m - s + 1)) AS i FROM (SELECT *, unnest(generate_series(2, m - 1)) AS s FROM candidates))
    GROUP BY ALL),
ranked AS (
    SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY l.score DESC, l.a DESC, encode(l.phrase)) AS rank
    FROM lowest l LEFT JOIN inside i ON i.lang = l.lang AND i.phrase = l.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * l.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

ORACLES = {
    "op1_line_dedup": LINES,
    "op4_source_mixing": MIXING,
    "op5_exact_dedup": EXACT,
    "op8_chat_format": CHAT,
    "op11_impact_search": SEARCH,
    "op13_collocations": PHRASES,
}
