"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

#: regexp classes of the words, in SQL text
_SPACE_WORD = r"[^\x20\x09-\x0D]+"

ORACLE["op1_mixing"] = f"""
WITH docs AS (
  SELECT doc_id, coalesce('0' || source, '1') AS source_key, CAST(coalesce(len(regexp_extract_all(text, '{_SPACE_WORD}')), 0) AS BIGINT) AS size,
         substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 6) AS mark
  FROM documents),
totals AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source_key),
weighed AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1 AS INT)] AS weight FROM totals),
filled AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS fill FROM weighed),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER (ORDER BY fill, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM filled),
aims AS (
  SELECT source_key, source_size, CASE WHEN fill <= level THEN CAST(cap AS DOUBLE) ELSE weight * max(CASE WHEN fill > level THEN level END) OVER () END AS target
  FROM levels),
plan AS (
  SELECT *, target - whole * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM aims)),
coarse AS (SELECT source_key, substr(mark, 1, 3) AS bucket, sum(size) AS words FROM docs GROUP BY ALL),
run AS (SELECT *, sum(words) OVER (PARTITION BY source_key ORDER BY bucket) AS upto FROM coarse),
crossed AS (
  SELECT source_key, min(bucket) AS bucket, min(upto - words) AS passed FROM run JOIN plan USING (source_key) WHERE upto > rest GROUP BY source_key),
fine AS (
  SELECT d.source_key, mark, passed, sum(size) AS words
  FROM docs d JOIN crossed c ON d.source_key = c.source_key AND substr(d.mark, 1, 3) = c.bucket GROUP BY ALL),
fine_run AS (SELECT *, passed + sum(words) OVER (PARTITION BY source_key ORDER BY mark) AS upto FROM fine),
cuts AS (
  SELECT source_key, min(mark) AS cut, 2 * (any_value(rest) - min(upto - words)) >= arg_min(words, mark) AS inclusive
  FROM fine_run JOIN plan USING (source_key) WHERE upto > rest GROUP BY source_key),
drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN whole + CASE WHEN coalesce(mark < cut OR (inclusive AND mark = cut), false) THEN 1 ELSE 0 END ELSE 0 END AS repeats
  FROM docs JOIN plan USING (source_key) LEFT JOIN cuts USING (source_key))
SELECT doc_id, size, source_size, target, CAST(size * repeats AS BIGINT) AS taken FROM drawn
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op2_decontaminate"] = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_ALNUM_WORDS}, []) AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), chr(0) || 'null') AS label, {_ALNUM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT label, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT label, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT rid, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes)),
hits AS (SELECT DISTINCT rid, i, k, label FROM grams JOIN windows USING (k, g)),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
owners AS (SELECT rid, count(*) AS n_items, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT rid, label FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(labels, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN owners USING (rid)
"""

ORACLE["op9_repeats"] = f"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_SPACE_WORD}'), []) AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM grams),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE n > 1)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS rest, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

ORACLE["op12_exact_dedup"] = r"""
WITH docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
classes AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM docs GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM docs JOIN classes USING (t)
"""
