WITH arrived AS (
  SELECT snapshot_no, chunk_id, source_id, text FROM chunk WHERE snapshot_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, source_id DESC NULLS LAST, chunk_index DESC NULLS LAST, text DESC NULLS LAST) = 1
),
known AS (SELECT snapshot_no, text, min(snapshot_no) OVER (PARTITION BY text) AS first_no FROM arrived WHERE text IS NOT NULL)
SELECT s.snapshot_no, count(k.text) AS total, count(CASE WHEN first_no < k.snapshot_no THEN 1 END) AS hits, count(DISTINCT CASE WHEN first_no = k.snapshot_no THEN text END) AS misses
FROM (SELECT DISTINCT snapshot_no FROM arrived WHERE snapshot_no > (SELECT min(snapshot_no) FROM arrived)) s LEFT JOIN known k USING (snapshot_no) GROUP BY s.snapshot_no
