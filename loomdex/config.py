"""Parameters of chunking, caches, search and synchronisation."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters and lines."""

    max_chunk: int = 8000
    min_chunk: int = 100
    lines: int = 50
    overlap: int = 10


@dataclass(frozen=True)
class EngineConfig:
    """Behaviour where there is a choice.

    search_mode: ``exact`` filters tenants before ranking; ``faithful`` ranks min(3k, 20) rows of all tenants first.
    commit_mode: ``last`` stores a root when its work is done; ``first`` before it.
    model_timeout, query_timeout, retry_pause: seconds that a call of a provider may take, that one for a query may take,
    and between the latter's attempts.
    """

    chunks: ChunkConfig = ChunkConfig()
    embedding_ttl_days: int = 90
    hash_ttl_days: int = 30
    top_k: int = 10
    top_k_cap: int = 20
    over_fetch: int = 3
    summary_batch: int = 50
    embedding_batch: int = 100
    dimensions: int = 1024
    search_mode: str = "exact"
    commit_mode: str = "last"
    model_timeout: float = 25.0
    query_timeout: float = 15.0
    retry_pause: float = 0.5
