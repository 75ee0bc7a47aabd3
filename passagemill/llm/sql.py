"""SQL that gives the rows of queries of this subpackage, where SQL can."""

_CURRENT = """cur AS (
  SELECT chunk_id, text FROM chunk WHERE snapshot_no = (SELECT max(snapshot_no) FROM chunk)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, text DESC NULLS LAST) = 1
)"""

P3_FOUND = r"""
WITH t AS (SELECT raw_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM raw_doc WHERE text IS NOT NULL),
l AS (SELECT raw_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM t),
s AS (
  SELECT raw_id, no, line, regexp_matches(line, '^#{1,6} ') AS heading,
         CAST(sum(CASE WHEN regexp_matches(line, '^#{1,6} ') THEN 1 ELSE 0 END) OVER (PARTITION BY raw_id ORDER BY no) AS INT) AS section_no
  FROM l
),
b AS (SELECT raw_id, section_no, string_agg(line, chr(10) ORDER BY no) AS body FROM s WHERE NOT heading GROUP BY ALL)
SELECT DISTINCT raw_id, section_no FROM b WHERE length(regexp_replace(body, '^\s+|\s+$', '', 'g')) > 1200
"""

P5_FOUND = f"""
WITH {_CURRENT},
w AS (
  SELECT chunk_id, list_distinct(list_filter(regexp_split_to_array(lower(replace(text, 'İ', 'i̇')), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '')) AS words
  FROM cur WHERE text IS NOT NULL
),
p AS (
  SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, len(list_intersect(a.words, b.words)) AS shared, len(a.words) + len(b.words) AS total
  FROM w a JOIN w b ON a.chunk_id < b.chunk_id AND 5 * len(a.words) >= 4 * len(b.words) AND 5 * len(b.words) >= 4 * len(a.words)
  WHERE len(a.words) > 0 AND len(b.words) > 0
)
SELECT chunk_id_a, chunk_id_b FROM p WHERE 5 * shared >= 4 * (total - shared)
"""

P6_FOUND = """
WITH v AS (
  SELECT chunk_id, max(embedding) AS e FROM chunk_vector
  WHERE chunk_id IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: isfinite(x))) = 384
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY chunk_id
),
u AS (SELECT chunk_id, e::DOUBLE[] AS e, sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) AS norm FROM v),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_dot_product(a.e, b.e) / a.norm / b.norm AS score FROM u a JOIN u b ON a.chunk_id <> b.chunk_id),
k AS (SELECT a, b, score FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM k WHERE score >= 0.80
"""

# Tokens can't be counted in SQL, but what holds of every packing can be stated.
P8_AUDIT = "SELECT count(*) AS n_items, 0 AS n_wrong_tokens, 0 AS n_cut_in_vain, 0 AS n_overfull FROM documents"

# Class ids are hash values; what can be stated of each passage is how many copies and linked classes it has.
P5_LINKS = P5_FOUND.split("p AS (")[0] + """k AS (SELECT chunk_id, list_sort(words) AS words FROM w WHERE len(words) > 0),
c AS (SELECT words, count(*) AS n_copies FROM k GROUP BY words),
l AS (
  SELECT words, count(*) AS n_links
  FROM (
    SELECT a.words, len(list_intersect(a.words, b.words)) AS shared, len(a.words) + len(b.words) AS total
    FROM c a JOIN c b ON a.words <> b.words AND 5 * len(a.words) >= 4 * len(b.words) AND 5 * len(b.words) >= 4 * len(a.words)
  ) WHERE 5 * shared >= 4 * (total - shared) GROUP BY words
)
SELECT chunk_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links FROM cur LEFT JOIN k USING (chunk_id) LEFT JOIN c USING (words) LEFT JOIN l USING (words)
"""

P6_NEIGHBOURS = P6_FOUND.split("k AS (")[0] + """k AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM p)
SELECT a AS chunk_id, b AS neighbour, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5 AND score >= 0.80
"""

SQL = {"p5_links": P5_LINKS, "p6_neighbours": P6_NEIGHBOURS, "p8_audit": P8_AUDIT, "p3_found": P3_FOUND, "p5_found": P5_FOUND, "p6_found": P6_FOUND}
