WITH cur AS (
  SELECT chunk_id, embed_text FROM chunk WHERE snapshot_no = (SELECT max(snapshot_no) FROM chunk)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, embed_text DESC NULLS LAST) = 1
)
SELECT count(*) AS n_vectors, CAST(count(*) > 0 AS BIGINT) AS n_dimensions, count_if(regexp_matches(embed_text, '^\s*$')) AS n_bad_norm FROM cur WHERE embed_text IS NOT NULL
