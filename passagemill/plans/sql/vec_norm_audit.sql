SELECT count(*) AS n_vectors, count(DISTINCT len(embedding)) AS n_dimensions, count_if(abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.01) AS n_bad_norm FROM embeddings
