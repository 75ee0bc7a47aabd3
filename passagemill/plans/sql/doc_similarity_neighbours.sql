WITH t AS (
  SELECT source, doc_id, list_distinct(regexp_extract_all(lower(replace(coalesce(text, ''), 'İ', 'i̇')), '[a-z0-9]+')) AS a FROM documents WHERE source IS NOT NULL
), n AS (SELECT *, lead(doc_id) OVER w AS next_id, lead(a) OVER w AS b FROM t WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT doc_id, next_id, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE), 6) END AS similarity
FROM n WHERE next_id IS NOT NULL
