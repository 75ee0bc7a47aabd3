WITH cur AS (
  SELECT chunk_id, text, url, source_id, fetched_at FROM chunk WHERE snapshot_no = (SELECT max(snapshot_no) FROM chunk)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, text DESC NULLS LAST, url DESC NULLS LAST, source_id DESC NULLS LAST, fetched_at DESC NULLS LAST) = 1
),
best AS (SELECT question_id, chunk_id, max(score) AS score FROM retrieved_chunk WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
hits AS (SELECT question_id AS query_id, chunk_id AS row_id, round(score, 6) AS score, text, url, source_id, fetched_at FROM best JOIN cur USING (chunk_id) WHERE text IS NOT NULL),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS INT) AS rank FROM hits QUALIFY rank <= 12),
outcomes AS (
  SELECT id, min(CASE WHEN source_id = expected_source_id AND contains(lower(text), lower(answer_span)) THEN rank END) AS rank,
         min(CASE WHEN source_id = expected_source_id THEN rank END) AS scheme_rank, count(rank) AS n_results
  FROM gold_question LEFT JOIN (SELECT * FROM top WHERE rank <= 6) t ON id = t.query_id GROUP BY id
)
SELECT * FROM outcomes
