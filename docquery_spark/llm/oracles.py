"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"[^\x20\x09-\x0D]+"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null' || coalesce(md5(text), ''))) AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
         CAST(2 * source_size AS DOUBLE) AS cap
  FROM s
), o AS (
  SELECT *, coalesce(sum(cap) OVER before, 0)::DOUBLE AS full_caps,
         (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS open_weight,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM r WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT (total - full_caps) / open_weight AS level FROM o
  WHERE (total - full_caps) / open_weight < cap / weight ORDER BY cap / weight, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM l)) AS target FROM r
), q AS (
  SELECT row_number() OVER () AS k, d.doc_id, d.source, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS quota,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS begun
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT k, doc_id, source, size, source_size, target, quota, r.turn AS turn, begun + r.turn * source_size AS start, begun + r.turn * source_size + size AS stop
  FROM q, (VALUES (0), (1)) r(turn)
), p AS (
  SELECT k, doc_id, source, size, source_size, target, quota, turn, start, least(stop, quota) AS stop FROM u WHERE start < quota OR stop <= quota
  UNION ALL
  SELECT k, doc_id, source, size, source_size, target, quota, turn, greatest(start, quota), stop FROM u WHERE stop > quota
), st AS (
  SELECT *, stop - start AS words, CAST(sum(stop - start) OVER (
    ORDER BY CASE WHEN quota > 0 THEN stop::DOUBLE / quota ELSE 'inf'::DOUBLE END, source NULLS LAST, start, turn, doc_id NULLS LAST
    ROWS UNBOUNDED PRECEDING) - (stop - start) AS BIGINT) AS stream_start FROM p
)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(sum(greatest(0, least(words, (SELECT sum(floor(target + 0.5)) FROM t) - stream_start))) AS BIGINT) AS taken
FROM st GROUP BY k
"""

OP2 = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {AZ}) AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

_TOKENS = rf"regexp_extract_all(translate(text, {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce({_TOKENS}, []) AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, coalesce({_TOKENS}, []) AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS gram
       FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS gram
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)),
h AS (SELECT doc_id, n, i, item_id FROM dg JOIN bg USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORDS}'), []) AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
         FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, {AZ}), '{WORDS}'), []) AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 1), ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws)))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

OP7 = """
WITH t AS (SELECT DISTINCT conv_id, CASE WHEN conv_id IS NULL THEN md5(concat_ws('|', CAST(turn AS VARCHAR), role, text)) ELSE '' END AS own,
                  CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text) AS k,
             count(*) OVER (PARTITION BY conv_id, own) AS n FROM t),
p AS (SELECT conv_id, own, k, n, string_agg('|' || length(role) || '|' || role || '|' || length(text) || '|' || text, '')
             OVER (PARTITION BY conv_id, own ORDER BY k ROWS UNBOUNDED PRECEDING) AS prefix FROM o),
h AS (SELECT conv_id, own, k, n, sha256(prefix) AS h FROM p),
last AS (SELECT h, first(conv_id ORDER BY conv_id NULLS LAST, own) AS keep, first(own ORDER BY conv_id NULLS LAST, own) AS keep_own, count(*) AS copies
         FROM h WHERE k = n GROUP BY h),
kept AS (SELECT * FROM last WHERE h NOT IN (SELECT h FROM h WHERE k < n))
SELECT o.conv_id, max(o.n) AS n_turns, max(kept.copies) AS copies,
       sha256(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k)) AS rendered_sha256
FROM o JOIN kept ON o.conv_id IS NOT DISTINCT FROM kept.keep AND o.own = kept.keep_own GROUP BY o.conv_id, o.own
"""

ORACLES = {
    "op1_mixing": OP1,
    "op2_exact_dedup": OP2,
    "op3_decontamination": OP3,
    "op7_chat_formatting": OP7,
    "op8_substring_dedup": OP8,
    "op10_near_dedup": OP10,
}
