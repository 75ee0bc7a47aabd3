WITH arrived AS (
  SELECT snapshot_no, chunk_id, source_id, text FROM chunk WHERE snapshot_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, source_id DESC NULLS LAST, chunk_index DESC NULLS LAST, text DESC NULLS LAST) = 1
),
following AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next_no FROM (SELECT DISTINCT snapshot_no FROM arrived))
SELECT next_no AS snapshot_no, chunk_id, source_id FROM arrived a JOIN following USING (snapshot_no)
WHERE next_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM arrived b WHERE b.snapshot_no = next_no AND b.chunk_id = a.chunk_id)
