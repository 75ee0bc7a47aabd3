SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n_pages, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text,''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS BIGINT) AS n_words FROM raw_doc GROUP BY 1
