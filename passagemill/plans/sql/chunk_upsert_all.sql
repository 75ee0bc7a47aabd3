WITH arrived AS (
  SELECT snapshot_no, chunk_id, source_id, text FROM chunk WHERE snapshot_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, source_id DESC NULLS LAST, chunk_index DESC NULLS LAST, text DESC NULLS LAST) = 1
)
SELECT chunk_id, source_id, sha256(text) AS content FROM arrived QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY snapshot_no DESC) = 1
