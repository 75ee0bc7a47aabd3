WITH cur AS (
  SELECT chunk_id, source_id, fetched_at, embed_text FROM chunk WHERE snapshot_no = (SELECT max(snapshot_no) FROM chunk)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, source_id DESC NULLS LAST, fetched_at DESC NULLS LAST, embed_text DESC NULLS LAST) = 1
)
SELECT source_id, count(*) AS n_chunks, coalesce(max(nullif(fetched_at, '')), '') AS newest, count_if(CAST(floor(len(list_filter(regexp_split_to_array(coalesce(embed_text,''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) * 1.35) AS INT) + 2 > 256) AS n_over FROM cur GROUP BY source_id
