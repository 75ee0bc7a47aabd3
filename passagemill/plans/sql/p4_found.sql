WITH rows_of AS (
  SELECT 'raw_doc' AS table_name, snapshot_no, regexp_replace(url, '/$', '') AS record_key,
         coalesce(lower(content_hash), sha256(coalesce(text, ''))) AS state, try_cast(fetched_at AS TIMESTAMPTZ) AS fetched
  FROM raw_doc WHERE http_status = 200 AND url IS NOT NULL AND snapshot_no IS NOT NULL
  UNION ALL
  SELECT 'chunk', snapshot_no, chunk_id, coalesce(lower(content_hash), substr(sha256(coalesce(text, '')), 1, 16)),
         try_cast(fetched_at AS TIMESTAMPTZ)
  FROM chunk WHERE chunk_id IS NOT NULL AND snapshot_no IS NOT NULL
), current_rows AS (
  SELECT table_name, snapshot_no, record_key, state FROM rows_of
  QUALIFY row_number() OVER (PARTITION BY table_name, snapshot_no, record_key ORDER BY fetched DESC NULLS LAST, state DESC) = 1
), numbered AS (
  SELECT table_name, snapshot_no, row_number() OVER (PARTITION BY table_name ORDER BY snapshot_no) AS seq
  FROM (SELECT DISTINCT table_name, snapshot_no FROM current_rows)
), r AS (
  SELECT c.*, n.seq FROM current_rows c JOIN numbered n USING (table_name, snapshot_no)
), both_sides AS (
  SELECT table_name, seq AS pair, record_key, state AS new_state, NULL AS old_state FROM r WHERE seq > 1
  UNION ALL
  SELECT r.table_name, r.seq + 1, r.record_key, NULL, r.state FROM r
  JOIN numbered n ON n.table_name = r.table_name AND n.seq = r.seq + 1
), merged AS (
  SELECT table_name, pair, record_key, max(new_state) AS new_state, max(old_state) AS old_state
  FROM both_sides GROUP BY ALL
)
SELECT m.table_name, n.snapshot_no, m.record_key,
       CASE WHEN m.old_state IS NULL THEN 'added' WHEN m.new_state IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM merged m JOIN numbered n ON n.table_name = m.table_name AND n.seq = m.pair
WHERE m.new_state IS DISTINCT FROM m.old_state
