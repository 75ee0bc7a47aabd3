WITH one AS (
  SELECT chunk_id, source_id, chunk_index, text FROM chunk WHERE snapshot_no = 1
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, source_id DESC NULLS LAST, chunk_index DESC NULLS LAST, text DESC NULLS LAST) = 1
),
two AS (
  SELECT chunk_id, source_id, chunk_index, text FROM chunk WHERE snapshot_no = 2
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, source_id DESC NULLS LAST, chunk_index DESC NULLS LAST, text DESC NULLS LAST) = 1
)
SELECT chunk_id, source_id FROM one ANTI JOIN two USING (chunk_id)
