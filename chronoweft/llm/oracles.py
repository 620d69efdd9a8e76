"""DuckDB SQL for the opN_<name> queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, doc_id, source, t, {_WORDS.format("t")} AS ws FROM d),
f AS (SELECT row, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM w),
l AS (SELECT row, doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT row, doc_id, source, line, {_WORDS.format("line")} AS ws FROM l),
g AS (SELECT row, doc_id, source, line, len(ws) AS n, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM lw WHERE len(ws) > 0),
dup AS (SELECT row, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM g GROUP BY row),
tri AS (SELECT row, k, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] AS g3 FROM (SELECT row, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS k FROM w)),
again AS (SELECT row, k FROM tri QUALIFY count(*) OVER (PARTITION BY row, g3) > 1),
rep AS (SELECT row, CAST(count(DISTINCT k + o) AS BIGINT) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) v(o) GROUP BY row),
freq AS (SELECT source, norm FROM g GROUP BY source, norm HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INTEGER) > 100),
lost AS (SELECT row, CAST(sum(n) AS BIGINT) AS removed_words FROM g JOIN freq ON g.norm = freq.norm AND g.source IS NOT DISTINCT FROM freq.source GROUP BY row),
j AS (SELECT f.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM f LEFT JOIN dup USING (row) LEFT JOIN rep USING (row) LEFT JOIN lost USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= n_words * 0.5 AS kept, removed_words
FROM j
"""


OP3 = """
WITH t AS (SELECT conv_id, turn, role, text, 'call-' || conv_id || '-' || CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS call_id FROM conversations),
n AS (SELECT *, CASE WHEN call_id IS NOT NULL AND role = 'user' THEN row_number() OVER (PARTITION BY role, call_id ORDER BY to_json({'query': text, 'turn': turn}) NULLS FIRST)
  WHEN call_id IS NOT NULL THEN row_number() OVER (PARTITION BY role, call_id ORDER BY turn, text NULLS FIRST) END AS k FROM t),
u AS (SELECT * FROM n WHERE role = 'user' AND k = 1), a AS (SELECT * FROM n WHERE role = 'assistant' AND k = 1),
p AS (SELECT *, CAST(turn AS BIGINT) - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM u),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM p),
c AS (SELECT coalesce(l.conv_id, a.conv_id) AS conv_id, coalesce(l.turn, a.turn) AS turn, coalesce(l.call_id, a.call_id) AS call_id, l.call_id IS NOT NULL AS called,
  CASE WHEN l.call_id IS NULL THEN 'orphan' WHEN a.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, level, l.text AS query, a.text AS result, l.turn AS call_turn
  FROM l FULL JOIN a ON l.call_id = a.call_id
  UNION ALL SELECT conv_id, turn, call_id, role = 'user', CASE WHEN call_id IS NULL THEN 'no_id' ELSE 'duplicate' END, CASE WHEN call_id IS NULL AND role = 'user' THEN 0 END,
    CASE role WHEN 'user' THEN text END, CASE role WHEN 'assistant' THEN text END, turn FROM n WHERE role IN ('user', 'assistant') AND coalesce(k, 0) <> 1
  UNION ALL SELECT conv_id, turn, NULL, FALSE, 'other_role', NULL, NULL, text, NULL FROM n WHERE role IS NULL OR role NOT IN ('user', 'assistant')),
e AS (SELECT *, CASE WHEN NOT called THEN 'no call' ELSE concat_ws('; ', CASE WHEN query IS NULL THEN 'query: missing' WHEN length(query) < 1 THEN 'query: too short' WHEN length(query) > 400 THEN 'query: too long' END,
  CASE WHEN call_turn IS NULL THEN 'turn: missing' END) END AS errors FROM c)
SELECT conv_id, turn, call_id, status, level, errors = '' AS valid, errors,
  '{"arguments":' || CASE WHEN called THEN '{' || concat_ws(',', '"query":' || CAST(to_json(query) AS VARCHAR), '"turn":' || call_turn) || '}' ELSE 'null' END
  || ',"id":' || coalesce('"' || call_id || '"', 'null') || ',"name":' || CASE WHEN called THEN '"answer"' ELSE 'null' END || ',"result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' AS json
FROM e
"""


#: crc32 step by step over the bytes of each different feature, with its table of 256 entries.
OP11 = r"""
WITH tab AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
x0 AS (SELECT TRUE AS own, doc_id AS id, text FROM documents UNION ALL SELECT FALSE, item_id, text FROM benchmark),
w AS (SELECT own, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x0),
f AS (SELECT own, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS g FROM w),
n AS (SELECT own, id, g, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM n)),
b AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
  lambda c, y: xor(c >> 8, tab[xor(c, y) % 256 + 1])), 4294967295) % 10000 AS bucket FROM x, tab),
c AS (SELECT bucket, sum(n) FILTER (own) AS s, sum(n) FILTER (NOT own) AS t FROM n JOIN b USING (g) GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM c),
gain AS (SELECT bucket, floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS gain FROM c, a),
d AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM n JOIN b USING (g) JOIN gain USING (bucket) WHERE own GROUP BY id),
r AS (SELECT w.id AS doc_id, len(ws) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || w.id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN d ON w.id = d.id WHERE own),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank FROM o
"""


OP12 = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents),
p AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS tf FROM w GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM d),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // len AS m FROM d, a),
i AS (SELECT item_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS q
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY ALL),
f AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, a GROUP BY w, docs),
s AS (SELECT item_id, doc_id, CAST(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN p USING (w) JOIN f USING (w) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_tool_calls": OP3, "op4_repeated_lines": OP4, "op11_resampling": OP11, "op12_lexical_search": OP12}
