"""Schemas of the records that pass between stages."""

SOURCE = "source_id string, scheme_name string, category string, plan string, url string"
RAW_DOC = f"{SOURCE}, page_title string, text string, fetched_at string, http_status int, content_hash string"
CHUNK = (
    "chunk_id string, text string, embed_text string, source_id string, scheme_name string, scheme_slug string, category string, plan string,"
    " url string, page_title string, heading_trail array<string>, chunk_index int, char_len int, word_count int, content_hash string, fetched_at string"
)
VECTOR = "chunk_id string, embedding array<float>"
GOLD = "id string, question string, fact_type string, expected_url string, expected_source_id string, answer_span string, must_include array<string>"
METRIC = "ts string, stage string, step string, q_hash string, n_chunks int, fetched int, kept int, dropped int, latency_ms double, ok boolean"
