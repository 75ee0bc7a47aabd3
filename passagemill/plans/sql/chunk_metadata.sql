WITH cur AS (
  SELECT chunk_id, text, source_id, scheme_name, scheme_slug, category, plan, url, page_title, heading_trail, chunk_index, char_len, word_count, content_hash, fetched_at FROM chunk WHERE snapshot_no = (SELECT max(snapshot_no) FROM chunk)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, text DESC NULLS LAST, source_id DESC NULLS LAST, scheme_name DESC NULLS LAST, scheme_slug DESC NULLS LAST, category DESC NULLS LAST, plan DESC NULLS LAST, url DESC NULLS LAST, page_title DESC NULLS LAST, heading_trail DESC NULLS LAST, chunk_index DESC NULLS LAST, char_len DESC NULLS LAST, word_count DESC NULLS LAST, content_hash DESC NULLS LAST, fetched_at DESC NULLS LAST) = 1
),
m AS (SELECT coalesce(chunk_id, '') AS chunk_id, coalesce(source_id, '') AS source_id, coalesce(scheme_name, '') AS scheme_name, coalesce(scheme_slug, '') AS scheme_slug, coalesce(category, '') AS category, coalesce(plan, '') AS plan, coalesce(url, '') AS url, coalesce(page_title, '') AS page_title, coalesce(array_to_string(list_filter(heading_trail, lambda x: x IS NOT NULL), ' > '), '') AS heading_trail, coalesce(chunk_index, 0) AS chunk_index, coalesce(char_len, 0) AS char_len, coalesce(word_count, 0) AS word_count, coalesce(content_hash, '') AS content_hash, coalesce(fetched_at, '') AS fetched_at FROM cur)
SELECT * EXCLUDE (fetched_at) FROM m
