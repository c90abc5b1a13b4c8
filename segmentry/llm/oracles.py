"""DuckDB SQL of the operators that SQL can express."""

from segmentry.llm.licenses import TEMPLATES

_OP3 = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
c AS MATERIALIZED (SELECT list_sort(sh) AS sh, min(doc_id) AS rep FROM s WHERE len(sh) > 0 GROUP BY 1),
u AS MATERIALIZED (SELECT rep, len(sh) AS n, unnest(sh) AS g FROM c),
links AS MATERIALIZED (
  SELECT a.rep AS x, b.rep AS y FROM u a JOIN u b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x AS rep, min(y) AS component FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(comp.component, s.doc_id) AS component_id, coalesce(comp.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh LEFT JOIN comp ON comp.rep = c.rep
"""

_OP9 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
own AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER (PARTITION BY conv_id) ELSE 0 END AS alone FROM rows),
placed AS (
  SELECT *, row_number() OVER w - 1 AS k, lag(role) OVER w AS before FROM own
  WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)),
t AS (
  SELECT *, CASE role WHEN 'system' THEN k = 0 WHEN 'user' THEN k = 0 OR before IN ('system', 'assistant', 'tool') WHEN 'assistant' THEN coalesce(before IN ('user', 'tool'), false)
    WHEN 'tool' THEN coalesce(before = 'assistant', false) ELSE false END AS allowed FROM placed)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(replace(role, chr(92), '..'), '<', '..'), chr(10), '..'))
    + length(replace(replace(text, chr(92), '..'), '<', '..'))) AS BIGINT) AS formatted_chars,
  min(k) FILTER (NOT allowed) AS bad_turn
FROM t GROUP BY conv_id, alone
"""

_OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, row_number() OVER () AS q, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
n AS (SELECT item_id, q, w, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
b AS MATERIALIZED (SELECT item_id, q, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' ')))) AS g FROM n),
size AS (SELECT q, count(*) AS n_item FROM b GROUP BY q),
s AS MATERIALIZED (SELECT doc_id, r, kk.k, unnest(list_distinct(list_transform(range(1, len(w) - kk.k + 2), lambda x: array_to_string(w[x:x + kk.k - 1], ' ')))) AS g
  FROM d, (SELECT DISTINCT k FROM b) kk WHERE len(w) >= kk.k)
SELECT s.doc_id, b.item_id, CAST(count(*) AS INTEGER) AS n_shared, CAST(n_item AS INTEGER) AS n_item
FROM s JOIN b ON s.k = b.k AND s.g = b.g JOIN size ON size.q = b.q
GROUP BY s.doc_id, s.r, b.item_id, b.q, n_item HAVING count(*) * 100 >= n_item * 80
"""

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BIGRAMS = "list_distinct(list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda z: z[1] || ' ' || z[2]))"
_OP2 = f"""
WITH tpl AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))}) t(i, name, text)),
tw AS (SELECT i, name, regexp_extract_all({_AZ.format("text")}, '[a-z0-9]+') AS w FROM tpl),
tl AS MATERIALIZED (SELECT i, name, {_BIGRAMS} AS b FROM tw),
tb AS MATERIALIZED (SELECT i, name, len(b) AS n, unnest(b) AS g FROM tl),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_AZ.format("coalesce(text, '')")} AS text FROM documents),
u AS (SELECT r, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS u FROM d UNION ALL SELECT r, -1, text FROM d WHERE contains(text, chr(10))),
uw AS (SELECT r, line, regexp_extract_all(u, '[a-z0-9]+') AS w FROM u),
ul AS MATERIALIZED (SELECT r, line, {_BIGRAMS} AS b FROM uw WHERE len(w) > 1),
ub AS MATERIALIZED (SELECT r, line, len(b) AS n, unnest(b) AS g FROM ul),
hit AS MATERIALIZED (SELECT r, line, i, name, count(*) AS shared, ub.n + tb.n AS total FROM ub JOIN tb ON ub.g = tb.g GROUP BY r, line, i, name, ub.n, tb.n HAVING 200 * count(*) >= 80 * (ub.n + tb.n)),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY 2.0 * shared / total DESC, i, line) AS k FROM hit),
units AS (SELECT r, count(DISTINCT line) AS n FROM hit GROUP BY r)
SELECT doc_id, name AS license, 2 * shared / CAST(total AS DOUBLE) AS dice, line, CAST(coalesce(units.n, 0) AS INTEGER) AS n_units
FROM d LEFT JOIN best ON best.r = d.r AND best.k = 1 LEFT JOIN units ON units.r = d.r
"""

_OP11 = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor, b.id, a.label = b.label AS own, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor, id, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS k FROM s WHERE own) WHERE k <= 5),
n AS (SELECT p.anchor, p.id AS positive, p.score AS positive_score, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS k
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(k AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score FROM n WHERE k <= 3
"""

_OP12 = """
WITH RECURSIVE u AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, least(x, min(y)) AS component FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(coalesce(component, vec_id) = vec_id, true) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN low ON low.x = e.vec_id
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, (VALUES (1), (2), (3)) t(k)) GROUP BY lang, k, g),
c AS MATERIALIZED (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, g, a, j, array_to_string(w[1:j], ' ') AS one, array_to_string(w[j + 1:k], ' ') AS two FROM c, (VALUES (1), (2)) t(j) WHERE j < k),
s AS (SELECT x.*, y.f AS l, z.f AS r, CAST((1000000::HUGEINT * a * a) // (y.f::HUGEINT * z.f) AS BIGINT) AS score FROM cuts x JOIN f y ON y.lang = x.lang AND y.k = x.j AND y.g = one JOIN f z ON z.lang = x.lang AND z.k = x.k - x.j AND z.g = two),
least AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, k, g ORDER BY score, j) AS i FROM s) WHERE i = 1),
within AS (SELECT DISTINCT t.lang, b.g FROM c t JOIN c b ON t.k = 3 AND b.k = 2 AND b.lang = t.lang AND b.g IN (array_to_string(t.w[1:2], ' '), array_to_string(t.w[2:3], ' ')) AND 100 * t.a >= 50 * b.a),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, score FROM least ANTI JOIN within USING (lang, g))
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN total USING (lang) WHERE rank <= 2000
"""

SQL = {"op2_license_scan": _OP2, "op3_minhash_dedup": _OP3, "op5_decontamination": _OP5, "op9_chat_format": _OP9, "op10_exact_topk": _OP10, "op11_hard_negatives": _OP11, "op12_vector_dedup": _OP12, "op13_collocations": _OP13}
