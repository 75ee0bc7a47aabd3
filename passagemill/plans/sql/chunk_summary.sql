WITH cur AS (
  SELECT chunk_id, text, source_id FROM chunk WHERE snapshot_no = (SELECT max(snapshot_no) FROM chunk)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, text DESC NULLS LAST, source_id DESC NULLS LAST) = 1
)
SELECT count(*) AS n_chunks, coalesce(round(avg(length(text)), 1), 0) AS mean_chars, coalesce(round(avg(len(list_filter(regexp_split_to_array(coalesce(text,''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))), 1), 0) AS mean_words, coalesce(max(CAST(floor(len(list_filter(regexp_split_to_array(coalesce(text,''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) * 1.35) AS INT) + 2), 0) AS max_tokens, count(DISTINCT source_id) AS n_docs FROM cur
