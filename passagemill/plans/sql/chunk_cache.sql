WITH one AS (
  SELECT chunk_id, source_id, chunk_index, text FROM chunk WHERE snapshot_no = 1
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, source_id DESC NULLS LAST, chunk_index DESC NULLS LAST, text DESC NULLS LAST) = 1
),
two AS (
  SELECT chunk_id, source_id, chunk_index, text FROM chunk WHERE snapshot_no = 2
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, source_id DESC NULLS LAST, chunk_index DESC NULLS LAST, text DESC NULLS LAST) = 1
),
k AS (SELECT text, text IN (SELECT text FROM one WHERE text IS NOT NULL) AS held FROM two WHERE text IS NOT NULL)
SELECT count(*) AS total, count_if(held) AS hits, count(DISTINCT CASE WHEN NOT held THEN text END) AS misses FROM k
