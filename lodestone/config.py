"""Every tunable of the engine in one place; operators read no environment."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ModelPrice:
    model: str
    price_in: float
    price_out: float


@dataclass(frozen=True)
class Settings:
    chunk_chars: int = 900
    chunk_overlap: int = 180
    min_block_chars: int = 150
    structural_chunking: bool = True
    top_k: int = 5
    max_per_doc: int = 2
    hybrid_search: bool = True
    hybrid_candidates: int = 10
    contextual: bool = False
    rerank: bool = True
    rerank_candidates: int = 12
    rerank_chars: int = 700
    rerank_attempts: int = 5
    parent_vote: bool = False
    parent_vote_ratio: float = 0.5
    parent_vote_min_chunks: int = 2
    parent_vote_min_total: int = 2
    parent_vote_k: int = 3
    parent_context: bool = True
    parent_context_chars: int = 24_000
    parent_slack: float = 0.0
    neighbour_radius: int = 1
    table_assist: bool = True
    table_assist_max: int = 3
    table_phrase_max_docs: int = 8
    feedback_ordering: bool = True
    feedback_similarity: float = 0.92
    clarify_min_score: float = 0.95
    clarify_max_topics: int = 3
    clarify_always: bool = False
    min_score: dict[str, float] = field(default_factory=lambda: {"he": 0.30, "en": 0.5})
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rrf_k: int = 60
    named_code_chunks: int = 6
    query_expansion: bool = False
    query_chars: int = 300
    refusal_keeps_quoted: bool = False
    refusal_quote_check: bool = False
    refusal_offers_topics: bool = False
    unverified_allows_passages: bool = False
    sources_add_quoted: bool = False
    answer_applicability: bool = False
    answer_scope_first: bool = False
    concise: bool = False
    judge_with_question: bool = False
    judge_polar_kind: bool = False
    embed_batch: int = 64
    embed_attempts: int = 8
    embed_price_per_million: float = 0.02
    generate_attempts: int = 3
    price: ModelPrice = ModelPrice("local", 1.0, 5.0)


DEFAULT = Settings()
