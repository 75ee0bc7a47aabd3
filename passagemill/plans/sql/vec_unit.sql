SELECT vec_id, CAST(CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS squared FROM embeddings
