-- the pattern of a mention is a fixed value
WITH names AS (SELECT source_id, row_number() OVER (ORDER BY source_id) AS no, list_distinct(list_filter(string_split(regexp_replace(lower(scheme_name), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: x <> '')) AS tokens FROM source_list WHERE scheme_name IS NOT NULL),
said AS (SELECT id, unnest(regexp_extract_all(coalesce(question, ''), '\b((?:[A-Z][A-Za-z0-9''\-]*\s+){0,5}[A-Z][A-Za-z0-9''\-]*\s+Fund)\b', 1)) AS mention FROM gold_question),
m AS (SELECT id, list_distinct(list_filter(string_split(regexp_replace(lower(mention), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: x <> '')) AS tokens FROM said),
fits AS (SELECT m.id, n.source_id, len(n.tokens) * 1000000 + n.no AS place FROM m JOIN names n ON len(m.tokens) > 0 AND len(list_filter(m.tokens, lambda x: NOT list_contains(n.tokens, x))) = 0)
SELECT g.id, f.slug FROM gold_question g LEFT JOIN (SELECT id, arg_min(source_id, place) AS slug FROM fits GROUP BY id) f USING (id)
