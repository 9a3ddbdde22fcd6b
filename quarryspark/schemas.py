"""Names that records of the engine share."""

from __future__ import annotations

#: Fields of a serialised hit; those a search does not give are null.
HIT_FIELDS = ["chunk_id", "file_path", "start_line", "end_line", "content", "symbol_name", "symbol_type", "score", "vector_rank", "keyword_rank", "rerank_score"]

#: Stage of an index job.
JOB_STATES = ["queued", "parsing", "embedding", "ready", "failed"]
SEARCH_MODES = ["semantic", "keyword", "hybrid"]
