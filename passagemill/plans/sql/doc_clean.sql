WITH t AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]', '', 'g'), '\r\n?', chr(10), 'g'), '[\t\x{00A0}]', ' ', 'g'), ' {2,}', ' ', 'g') AS t FROM documents
)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT (length(x) <= 200 AND (contains(lower(x), 'cookie') OR contains(lower(x), 'all rights reserved') OR contains(lower(x), 'terms of use') OR contains(lower(x), 'privacy policy') OR contains(lower(x), 'disclosure:') OR contains(lower(x), 'risk disclosures') OR contains(lower(x), 'know your customer')))), chr(10)) AS cleaned FROM t
