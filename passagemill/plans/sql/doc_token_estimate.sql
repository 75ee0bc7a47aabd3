SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text,''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS n_words, CAST(floor(len(list_filter(regexp_split_to_array(coalesce(text,''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) * 1.35) AS INT) + 2 AS n_tokens FROM documents
