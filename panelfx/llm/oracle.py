"""DuckDB SQL of the text queries that SQL can express; the others (nearest examples,
token merges, Viterbi, XXH64 majorities, exchange clustering) are tested against brute
force in tests/llm."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_tool_calls"] = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id, count(*) OVER (PARTITION BY conv_id, turn) AS n_calls,
         list_filter(CASE length(text) % 4 WHEN 0 THEN [turn + 2] WHEN 2 THEN [turn - 2] WHEN 3 THEN [turn - 4, turn - 2] ELSE [] END,
                     lambda x: x >= 0) AS needs
  FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1),
results AS (
  SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS call_id, count(*) OVER (PARTITION BY conv_id, turn) AS n_results
  FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1),
wanted AS (SELECT conv_id, turn AS child, unnest(needs) AS parent FROM calls),
edges AS (SELECT w.*, CAST(parent >= child AS BIGINT) AS forward FROM wanted w JOIN calls c ON c.conv_id = w.conv_id AND c.turn = w.parent),
missing AS (SELECT DISTINCT conv_id, child FROM wanted w
            WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = w.conv_id AND c.turn = w.parent)),
sizes AS (SELECT conv_id, count(*) AS n FROM calls GROUP BY 1),
bounds AS (SELECT conv_id, sum(forward) AS bound FROM edges GROUP BY 1),
walk AS (  -- every way of needs from every call; one with as many steps as there are calls has met a cycle
  SELECT conv_id, turn AS start, turn AS here, CAST(0 AS BIGINT) AS forwards, CAST(0 AS BIGINT) AS steps FROM calls
  UNION ALL
  SELECT w.conv_id, w.start, e.parent, w.forwards + e.forward, w.steps + 1
  FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.child = w.here JOIN sizes s ON s.conv_id = w.conv_id
  WHERE w.steps < s.n),
ends AS (SELECT w.conv_id, start, max(forwards) AS forwards, max(steps) >= any_value(s.n) AS cyclic FROM walk w JOIN sizes s USING (conv_id) GROUP BY 1, 2),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS turn, c.text AS prompt,
         r.turn AS result_pos, r.text AS content, c.needs, coalesce(c.n_calls, 0) AS n_calls, coalesce(r.n_results, 0) AS n_results,
         CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
         m.child IS NOT NULL AS missing, coalesce(e.cyclic, FALSE) AS cyclic,
         CASE WHEN e.cyclic THEN b.bound + 1 ELSE coalesce(e.forwards, 0) END AS layer
  FROM calls c FULL JOIN results r ON c.call_id = r.call_id
  LEFT JOIN missing m ON m.conv_id = c.conv_id AND m.child = c.turn
  LEFT JOIN ends e ON e.conv_id = c.conv_id AND e.start = c.turn LEFT JOIN bounds b ON b.conv_id = c.conv_id),
f AS (
  SELECT *, CASE WHEN status = 'orphan' THEN '' ELSE concat_ws('; ',
      CASE WHEN length(prompt) < 1 THEN '$.n_chars: minimum' END,
      CASE WHEN length(prompt) < 1 THEN '$.prompt: minLength' END,
      CASE WHEN length(prompt) > 400 THEN '$.prompt: maxLength' END,
      CASE WHEN turn > 6 THEN '$.turn: maximum' END,
      CASE WHEN missing THEN 'needs: missing' END) END AS errors
  FROM j)
SELECT conv_id, call_id, turn, result_pos, n_calls, n_results, status, CAST(layer AS BIGINT) AS layer, cyclic,
       status <> 'orphan' AND errors = '' AS valid, errors,
       '{"call":' || CASE WHEN status = 'orphan' THEN 'null' ELSE
         '{"arguments":{"n_chars":' || length(prompt) || ',"prompt":' || CAST(to_json(prompt) AS VARCHAR) || ',"turn":' || turn
         || '},"id":"' || call_id || '","name":"ask","needs":['
         || array_to_string(list_transform(needs, lambda x: '"' || conv_id || ':' || x || '"'), ',') || '],"turn":' || turn || '}' END
       || ',"result":' || CASE WHEN result_pos IS NULL THEN 'null' ELSE
         '{"content":' || CAST(to_json(content) AS VARCHAR) || ',"id":"' || call_id || '","turn":' || result_pos || '}' END || '}' AS json
FROM f"""

# Words of decontamination: runs of ASCII digits, letters and non-ASCII characters.
_WORDS6 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SQL["op6_decontaminate"] = rf"""
WITH b AS (SELECT item_id, {_WORDS6} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
         lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win, least(len(w), 10) AS n
       FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS6} AS w FROM documents),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
hit AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)"""

SQL["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s,
             max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))::INT) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM x"""

SQL["op9_line_chunks"] = r"""
WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
l AS (SELECT *, CAST(('0x' || substr(md5(line), 1, 15)) AS BIGINT) % 1000003 AS h,
        len(list_filter(regexp_split_to_array(line, '[ \t\n\v\f\r]+'), lambda x: x <> '')) >= 50 AS long,
        len(list_filter(regexp_split_to_array(line, '[ \t\n\v\f\r]+'), lambda x: x <> '')) AS nw FROM l0),
e AS (SELECT *, CASE WHEN (coalesce(lag(h) OVER w, 0) * 31 + h) % 2 = 0 OR long OR coalesce(lead(long) OVER w, TRUE) THEN 1 ELSE 0 END AS ends
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM e),
k AS (SELECT min(i) AS a, max(i) + 1 AS b, doc_id, string_agg(line, chr(10) ORDER BY i) AS body, sum(nw) AS words FROM c GROUP BY doc_id, chunk),
two AS (SELECT doc_id, i AS a, i + 2 AS b, line || chr(10) || lead(line) OVER w AS body, nw + lead(nw) OVER w AS words
        FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, a, b, body FROM k WHERE b - a > 1 AND words > 0 OR words >= 50
      UNION SELECT doc_id, a, b, body FROM two WHERE words > 0),
o AS (SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS f_doc, first_value(a) OVER w AS f_a
      FROM s WINDOW w AS (PARTITION BY body ORDER BY doc_id, a)),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS i FROM o WHERE nth > 1 AND NOT (doc_id = f_doc AND b - a = 2 AND a = f_a + 1)),
m AS (SELECT c.doc_id, c.i, chunk, line, g.i IS NOT NULL AS hit, CASE WHEN nw > 0 OR g.i IS NOT NULL THEN g.i IS NOT NULL END AS shown
      FROM c LEFT JOIN g ON g.doc_id = c.doc_id AND g.i = c.i),
n AS (SELECT *, hit OR shown IS NULL
        AND coalesce(last_value(shown IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE)
        AND coalesce(first_value(shown IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), FALSE) AS cut FROM m),
t AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT chunk) AS n_chunks, count(CASE WHEN cut THEN 1 END) AS n_cut_lines,
        count(DISTINCT chunk) - count(DISTINCT CASE WHEN NOT cut THEN chunk END) AS n_cut_chunks,
        string_agg(CASE WHEN NOT cut THEN line END, chr(10) ORDER BY i) AS rest FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_cut_lines, 0) AS n_cut_lines,
       coalesce(n_cut_chunks, 0) AS n_cut_chunks, CASE WHEN d.text IS NOT NULL THEN md5(coalesce(rest, '')) END AS clean_md5
FROM documents d LEFT JOIN t USING (doc_id)"""

_WORDS10 = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '')"

SQL["op10_host_rules"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS10} AS w FROM documents),
g AS (SELECT doc_id, p, win, count(*) OVER (PARTITION BY doc_id, win) AS n FROM (
        SELECT doc_id, unnest(range(1, len(w) - 6)) AS p,
               unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS win
        FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM g WHERE n > 1) GROUP BY 1),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY 1),
s AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \t\n\v\f\r]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 100 * n_symbols > 10 * n_words AS fails_symbols,
        100 * n_dup_lines > 5 * n_words AS fails_dup_lines, word_chars < 2 * n_words OR word_chars > 12 * n_words AS fails_word_chars FROM s),
h AS (SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(failed AS INT)) AS DOUBLE) AS x
      FROM (SELECT source, unnest(['base', 'symbols', 'dup_lines', 'word_chars']) AS rule,
                   unnest([base_failed, fails_symbols, fails_dup_lines, fails_word_chars]) AS failed FROM f) GROUP BY 1, 2),
t AS (SELECT rule, sum(n) AS N1, sum(x) AS X1, CAST(count(*) AS DOUBLE) AS H1, sum(n * n) AS nn, sum(x * x / n) AS xx FROM h GROUP BY 1),
m AS (SELECT rule, X1 / N1 AS m, CASE WHEN H1 > 1 THEN greatest(xx - X1 * X1 / N1, 0) / (H1 - 1) ELSE 0 END AS msb,
        CASE WHEN N1 > H1 THEN greatest(X1 - xx, 0) / (N1 - H1) ELSE 0 END AS msw,
        CASE WHEN H1 > 1 THEN (N1 - nn / N1) / (H1 - 1) ELSE 1 END AS n0 FROM t),
q AS (SELECT rule, m, CASE WHEN msb + (n0 - 1) * msw > 0 THEN least(greatest((msb - msw) / (msb + (n0 - 1) * msw), 1e-6), 1 - 1e-6) ELSE 1e-6 END AS rho FROM m),
p AS (SELECT source, rule, (x + m * (1 - rho) / rho) / (n + (1 - rho) / rho) AS rate FROM h JOIN q USING (rule)),
v AS (SELECT source, bool_or(rule = 'base' AND rate > 0.5) AS bad, bool_or(rule = 'symbols' AND rate > 0.05) AS sym,
             bool_or(rule = 'dup_lines' AND rate > 0.05) AS dup, bool_or(rule = 'word_chars' AND rate > 0.05) AS chars FROM p GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR bad OR fails_symbols AND sym OR fails_dup_lines AND dup OR fails_word_chars AND chars) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source"""

SQL["op12_hard_negatives"] = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT pos.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY pos.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""
