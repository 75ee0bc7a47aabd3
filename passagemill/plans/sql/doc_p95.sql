WITH n AS (
  SELECT domain, length(text) AS chars, row_number() OVER (PARTITION BY domain ORDER BY length(text)) AS no, count(*) OVER (PARTITION BY domain) AS total
  FROM documents WHERE text IS NOT NULL
)
SELECT domain, chars AS p95_chars FROM n WHERE no = CAST(round_even(0.95 * (total - 1), 0) AS INT) + 1
