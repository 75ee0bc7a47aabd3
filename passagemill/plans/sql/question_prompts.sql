WITH RECURSIVE cur AS (
  SELECT chunk_id, text, url, source_id, fetched_at FROM chunk WHERE snapshot_no = (SELECT max(snapshot_no) FROM chunk)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, text DESC NULLS LAST, url DESC NULLS LAST, source_id DESC NULLS LAST, fetched_at DESC NULLS LAST) = 1
),
best AS (SELECT question_id, chunk_id, max(score) AS score FROM retrieved_chunk WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
hits AS (SELECT question_id AS query_id, chunk_id AS row_id, round(score, 6) AS score, text, url, source_id, fetched_at FROM best JOIN cur USING (chunk_id) WHERE text IS NOT NULL),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS INT) AS rank FROM hits QUALIFY rank <= 12),
tok AS (
  SELECT query_id, row_id, score, rank, list_distinct(regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '[a-z0-9]+')) AS tokens,
         CAST(floor(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) * 1.35) AS INT) + 2 AS cost
  FROM top WHERE score >= 0.35
),
greedy AS (
  SELECT query_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[][]) AS kept, CAST([] AS VARCHAR[]) AS ids FROM tok GROUP BY query_id
  UNION ALL
  SELECT g.query_id, g.n + 1,
         CASE WHEN alike THEN g.kept ELSE list_append(g.kept, t.tokens) END, CASE WHEN alike THEN g.ids ELSE list_append(g.ids, t.row_id) END
  FROM greedy g JOIN tok t ON t.query_id = g.query_id AND t.rank = g.n + 1,
  LATERAL (SELECT len(list_filter(g.kept, lambda k: CASE WHEN len(k) + len(t.tokens) = 0 THEN 1.0 ELSE len(list_intersect(k, t.tokens)) / CAST(len(k) + len(t.tokens) - len(list_intersect(k, t.tokens)) AS DOUBLE) END > 0.9)) > 0 AS alike)
),
folded AS (SELECT query_id, arg_max(ids, n) AS ids FROM greedy GROUP BY query_id),
cut AS (SELECT query_id, unnest(ids[1:6]) AS row_id, generate_subscripts(ids[1:6], 1) AS no FROM folded),
spent AS (SELECT cut.*, score, sum(cost) OVER (PARTITION BY query_id ORDER BY no) AS cost FROM cut JOIN tok USING (query_id, row_id)),
final AS (SELECT query_id, row_id, score, CAST(no AS INT) AS rank FROM spent WHERE no = 1 OR cost <= 2000)
SELECT f.query_id AS id, CAST(count(*) AS INT) AS n_blocks, sha256(string_agg('[Source ' || f.rank || '] ' || url || chr(10) || text, chr(10) || chr(10) ORDER BY f.rank)) AS blocks
FROM final f JOIN top t ON t.query_id = f.query_id AND t.row_id = f.row_id GROUP BY f.query_id
