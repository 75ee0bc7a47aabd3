SELECT doc_id, substr(sha256(concat_ws(':', source, doc_id)), 1, 16) AS hash_id, sha256(text) AS content_hash, substr(sha256('salt::' || text), 1, 10) AS q_hash, sha256('model::' || sha256(text)) AS cache_key FROM documents WHERE text IS NOT NULL
