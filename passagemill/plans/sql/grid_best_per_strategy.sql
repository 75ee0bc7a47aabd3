SELECT strategy, cell_no FROM (VALUES (0, 'recursive', 400, 0.9, 200, 300.0, 200, false), (1, 'recursive', 600, 1.0, 152, 480.5, 249, false), (2, 'heading_bound', 600, 1.0, 152, 480.5, 249, false), (3, 'semantic', 400, 0.9, 120, 350.0, 250, false), (4, 'semantic', 600, 1.0, 100, 600.0, 300, false), (5, 'recursive', 1000, 1.0, 90, 800.0, 250, true)) AS t(cell_no, strategy, size, recall_at_5, n_chunks, mean_chars, max_tokens, skipped) WHERE NOT skipped QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY max_tokens > 256, recall_at_5 DESC, n_chunks, cell_no) = 1
