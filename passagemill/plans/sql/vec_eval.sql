WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 50 = 0),
e AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS v, label FROM embeddings),
pairs AS (
  SELECT query_id, row_id, q.label AS q_label, e.label AS r_label,
         round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS score
  FROM q JOIN e ON q.query_id <> e.row_id
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS INT) AS rank FROM pairs),
outcomes AS (SELECT q.query_id, min(CASE WHEN r.q_label = r.r_label THEN r.rank END) AS rank FROM q LEFT JOIN (SELECT * FROM ranked WHERE rank <= 6) r ON q.query_id = r.query_id GROUP BY q.query_id),
both_ranks AS (SELECT rank, rank AS scheme_rank FROM outcomes)
SELECT count(*) AS n_questions, round(coalesce(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 0), 6) AS hit_at_1, round(coalesce(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 0), 6) AS hit_at_3, round(coalesce(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 0), 6) AS hit_at_5, round(coalesce(avg(CASE WHEN rank <= 6 THEN 1.0 ELSE 0.0 END), 0), 6) AS hit_at_6, round(coalesce(avg(CASE WHEN scheme_rank <= 1 THEN 1.0 ELSE 0.0 END), 0), 6) AS scheme_at_1, round(coalesce(avg(CASE WHEN scheme_rank <= 3 THEN 1.0 ELSE 0.0 END), 0), 6) AS scheme_at_3, round(coalesce(avg(CASE WHEN scheme_rank <= 5 THEN 1.0 ELSE 0.0 END), 0), 6) AS scheme_at_5, round(coalesce(avg(CASE WHEN scheme_rank <= 6 THEN 1.0 ELSE 0.0 END), 0), 6) AS scheme_at_6, round(coalesce(avg(coalesce(CAST(1.0 AS DOUBLE) / rank, 0)), 0), 6) AS mrr FROM both_ranks
