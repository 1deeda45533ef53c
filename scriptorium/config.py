"""Settings of a run: one frozen object passed explicitly, checked when it is made."""

from __future__ import annotations

import math
from dataclasses import dataclass

from scriptorium.errors import SettingsError

STRATEGIES = ("fixed", "recursive", "semantic")


@dataclass(frozen=True)
class Settings:
    """Defaults are part of the operators' meaning."""

    chunk_strategy: str = "recursive"
    chunk_size: int = 1000
    chunk_overlap: int = 200
    chunk_semantic_similarity_threshold: float = 0.5
    embedding_model: str = "text-embedding-3-small"
    index_root_dir: str = "data/indexes"
    collection_prefix: str = "rag"
    index_batch_size: int = 500
    dedup_similarity_threshold: float = 0.95
    dense_top_k: int = 10
    sparse_top_k: int = 10
    rrf_dense_weight: float = 0.7
    rrf_sparse_weight: float = 0.3
    rrf_rank_constant: int = 60
    hybrid_top_k: int = 10
    rerank_candidate_k: int = 20
    rerank_top_k: int = 5
    reranker_model_name: str = "ms-marco-MiniLM-L-6-v2"
    reranker_batch_size: int = 32
    generation_model: str = "deterministic"
    citation_judge_model: str = "deterministic"
    evaluation_judge_model: str = "deterministic"
    confidence_citation_weight: float = 0.9
    confidence_retrieval_agreement_weight: float = 0.1
    confidence_threshold: float = 0.8

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise SettingsError(what)

        need(self.chunk_strategy in STRATEGIES, f"chunk_strategy must be one of {STRATEGIES}")
        need(self.chunk_size > 0 and 0 <= self.chunk_overlap < self.chunk_size, "need 0 <= chunk_overlap < chunk_size")
        need(-1 <= self.chunk_semantic_similarity_threshold <= 1, "the semantic threshold must lie in [-1, 1]")
        need(0 <= self.dedup_similarity_threshold <= 1, "the dedup threshold must lie in [0, 1]")
        for name in ("index_batch_size", "dense_top_k", "sparse_top_k", "hybrid_top_k", "rerank_candidate_k", "rerank_top_k", "reranker_batch_size"):
            need(getattr(self, name) > 0, f"{name} must be positive")
        need(self.rerank_top_k <= self.rerank_candidate_k, "rerank_top_k must not exceed rerank_candidate_k")
        need(min(self.rrf_dense_weight, self.rrf_sparse_weight) >= 0 and self.rrf_dense_weight + self.rrf_sparse_weight > 0, "RRF weights must be >= 0 with a positive sum")
        need(self.rrf_rank_constant >= 0, "rrf_rank_constant must be >= 0")
        weights = (self.confidence_citation_weight, self.confidence_retrieval_agreement_weight)
        need(all(map(math.isfinite, weights)) and min(weights) >= 0 and sum(weights) > 0, "confidence weights must be finite, >= 0, with a positive sum")
        need(math.isfinite(self.confidence_threshold) and 0 <= self.confidence_threshold <= 1, "confidence_threshold must lie in [0, 1]")
        for name in ("embedding_model", "reranker_model_name", "generation_model", "citation_judge_model", "evaluation_judge_model"):
            need(bool(getattr(self, name).strip()), f"{name} must not be blank")


DEFAULTS = Settings()
