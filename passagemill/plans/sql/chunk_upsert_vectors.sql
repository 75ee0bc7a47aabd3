WITH v AS (SELECT DISTINCT chunk_id FROM chunk_vector WHERE len(embedding) = 384),
one AS (
  SELECT chunk_id, source_id FROM chunk WHERE snapshot_no = 1
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, source_id DESC NULLS LAST, chunk_index DESC NULLS LAST, text DESC NULLS LAST) = 1
),
cur AS (
  SELECT chunk_id, source_id FROM chunk WHERE snapshot_no = (SELECT max(snapshot_no) FROM chunk)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, source_id DESC NULLS LAST) = 1
),
merged AS (SELECT * FROM cur UNION ALL SELECT * FROM one WHERE chunk_id NOT IN (SELECT chunk_id FROM cur WHERE chunk_id IN (SELECT chunk_id FROM v)))
SELECT chunk_id, source_id, 384 AS dimension FROM merged SEMI JOIN v USING (chunk_id)
