WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 50 = 0),
e AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS v, label FROM embeddings),
pairs AS (
  SELECT query_id, row_id, q.label AS q_label, e.label AS r_label,
         round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS score
  FROM q JOIN e ON q.query_id <> e.row_id
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS INT) AS rank FROM pairs)
SELECT query_id, row_id, score FROM ranked WHERE rank = 1
