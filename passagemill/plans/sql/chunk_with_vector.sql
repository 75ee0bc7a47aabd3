WITH cur AS (
  SELECT chunk_id, source_id FROM chunk WHERE snapshot_no = (SELECT max(snapshot_no) FROM chunk)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, source_id DESC NULLS LAST) = 1
)
SELECT source_id, count(*) AS n_chunks, count_if(chunk_id IN (SELECT chunk_id FROM chunk_vector WHERE embedding IS NOT NULL AND chunk_id IS NOT NULL)) AS n_vectors FROM cur GROUP BY source_id
