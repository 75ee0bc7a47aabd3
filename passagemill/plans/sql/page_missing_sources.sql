WITH specs AS (SELECT DISTINCT source_id, regexp_replace(url, '/+$', '') AS bare FROM source_list),
d AS (SELECT source_id, raw_id, regexp_replace(regexp_replace(regexp_replace(url, '/+$', ''), '/[^/]+$', ''), '/+$', '') AS bare FROM raw_doc WHERE http_status = 200),
kept AS (SELECT source_id, bare, max(raw_id) AS raw_id FROM d SEMI JOIN specs USING (source_id, bare) GROUP BY ALL)
SELECT source_id FROM specs ANTI JOIN kept USING (source_id, bare)
