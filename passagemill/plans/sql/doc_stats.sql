SELECT domain, count(*) AS n_docs, round(avg(len(list_filter(regexp_split_to_array(coalesce(text,''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))), 1) AS mean_words, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text,''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))) AS BIGINT) AS n_words, max(CAST(floor(len(list_filter(regexp_split_to_array(coalesce(text,''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) * 1.35) AS INT) + 2) AS max_tokens FROM documents GROUP BY domain
