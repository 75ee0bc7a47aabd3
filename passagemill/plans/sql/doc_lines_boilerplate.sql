WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS n_lines, count_if((length(x) <= 200 AND (contains(lower(x), 'cookie') OR contains(lower(x), 'all rights reserved') OR contains(lower(x), 'terms of use') OR contains(lower(x), 'privacy policy') OR contains(lower(x), 'disclosure:') OR contains(lower(x), 'risk disclosures') OR contains(lower(x), 'know your customer')))) AS n_boilerplate FROM l GROUP BY doc_id
