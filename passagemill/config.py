"""Settings of the retrieval pipeline, with dotted lookup."""

from __future__ import annotations

from typing import Any

SETTINGS: dict[str, Any] = {
    "loading": {"min_extracted_chars": 200},
    "chunking": {"strategy": "recursive", "chunk_size": 600, "chunk_overlap": 60, "max_wordpieces": 256, "target_wordpieces": 200, "min_words": 3},
    "embedding": {"model_id": "hashing-384", "dimension": 384, "batch_size": 32},
    "retrieval": {"n_results": 12, "top_k": 6, "score_floor": 0.35, "dedupe_jaccard": 0.9, "max_context_tokens": 2000},
    "generation": {"max_sentences": 3},
    "freshness": {"max_age_days": 30},
}


def setting(path: str, default: Any = None, settings: dict[str, Any] = SETTINGS) -> Any:
    """The value at a dotted path, the default if any part of it is missing."""
    node: Any = settings
    for part in path.split("."):
        if not isinstance(node, dict) or part not in node:
            return default
        node = node[part]
    return node
