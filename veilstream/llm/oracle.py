"""DuckDB SQL for the queries of this folder that SQL can express on whole tables."""

from __future__ import annotations

from veilstream.llm.chat import CONTROLS, END, START

_ENDINGS = "|".join(x.replace("|", r"\|").replace("]", r"\]") for x in CONTROLS)

OP3 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, regexp_replace(text, '([<\[])(\\*)({_ENDINGS})', '\1\\\2\3', 'g') AS written FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum({len(START)} + length(role) + 1 + length(written) + {len(END) + 1}) AS formatted_chars
  FROM w GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""

OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON r.doc_id = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.root AS component_id, d.doc_id = d.root AS kept
FROM (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) d LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP12 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON r.doc_id = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.root AS component_id
FROM (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) d LEFT JOIN n ON n.doc_id = d.doc_id
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = rf"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
g AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
f AS (SELECT t, count(*) AS df FROM p GROUP BY 1),
c AS (SELECT doc_id, t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS c FROM p JOIN f USING (t), g),
s AS (SELECT item_id, doc_id, CAST(sum(c) AS BIGINT) AS score FROM q JOIN c USING (t) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""

OP13 = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, CAST(list_inner_product(a.q, e.q) AS BIGINT) AS s FROM e a JOIN e ON a.vec_id % 100 = 0 AND e.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, s AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.s AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.s AND 100 * s.s <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.s DESC, s.id) QUALIFY row_number() OVER w <= 10
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS x FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM d WHERE len(ws) > 7)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(8)) AS k) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
p AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(ws) AS base_failed
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id
"""

SECRETS = r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
"""

SHARDS = """
SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, CAST(16 AS BIGINT) AS shards, true AS gapless, true AS together, true AS even FROM documents
"""

MIX = rf"""
WITH RECURSIVE s AS (SELECT source, CAST(sum(len({_WORDS})) AS BIGINT) AS size FROM documents GROUP BY 1),
n AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM s),
f(round, source, size, w, target, fixed) AS (
  SELECT 0, source, size, w, CAST(0 AS DOUBLE), false FROM n
  UNION ALL SELECT round + 1, source, size, w, CASE WHEN fixed THEN target ELSE least(3.0 * size, share) END, fixed OR share >= 3.0 * size FROM (
    SELECT *, CASE WHEN fixed THEN 0 ELSE w * (sum(size) OVER () - coalesce(sum(target) FILTER (fixed) OVER (), 0)) / sum(w) FILTER (NOT fixed) OVER () END AS share FROM f) WHERE round < 12)
SELECT source, size, size AS source_size, round(target, 3) AS target, true AS met FROM f WHERE round = 12
"""
