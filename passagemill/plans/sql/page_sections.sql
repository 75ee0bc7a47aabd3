WITH RECURSIVE t AS (
  SELECT concat_ws('#', source_id, CAST(raw_id AS VARCHAR)) AS id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM raw_doc WHERE text IS NOT NULL
), l AS (SELECT id, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM t),
m AS (SELECT *, length(regexp_extract(line, '^(#{1,6})[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]', 1)) AS level FROM l),
s AS (SELECT *, CAST(sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY no) AS BIGINT) AS section_no FROM m),
b AS (
  SELECT id, section_no, regexp_replace(string_agg(line, chr(10) ORDER BY no), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS body
  FROM s WHERE level = 0 AND NOT starts_with(line, 'Source page:') AND NOT starts_with(line, 'Page title:') GROUP BY ALL
), h AS (SELECT id, section_no, level, trim(regexp_replace(line, '^#{1,6}[ \t\n\x0B\f\r]+', '')) AS title FROM s WHERE level > 0),
r AS (
  SELECT id, CAST(0 AS BIGINT) AS section_no, CAST([] AS VARCHAR[]) AS trail FROM t
  UNION ALL
  SELECT r.id, h.section_no, list_append(list_slice(r.trail, 1, least(h.level - 1, len(r.trail))), h.title) FROM r JOIN h ON h.id = r.id AND h.section_no = r.section_no + 1
)
SELECT b.id AS source_id, b.section_no, array_to_string(r.trail, ' > ') AS trail, length(b.body) AS n_chars FROM b JOIN r USING (id, section_no) WHERE b.body <> ''
