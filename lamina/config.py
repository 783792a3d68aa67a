"""Parameters with their ranges, checked when made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, not {value}")


@dataclass(frozen=True)
class Retrieval:
    """Defaults and legal ranges of the retrieval pipelines."""

    chunk_size: int = 1200
    chunk_overlap: int = 150
    bm25_candidates: int = 20
    semantic_candidates: int = 20
    rerank_candidates: int = 20
    final_top_k: int = 5
    rrf_k: int = 60
    bm25_weight: float = 1.0
    semantic_weight: float = 1.0
    max_distance: float = 0.45
    min_rerank_score: float = 0.5
    multi_query_count: int = 3
    multi_query_max_chars: int = 300
    original_weight: float = 1.5
    variant_weight: float = 1.0
    per_query_candidates: int = 12
    parent_max_chars: int = 6000
    context_max_chars: int = 16000
    parent_child_limit: int = 3
    parent_rrf_k: int = 60
    parent_candidates: int = 10
    final_parent_top_k: int = 3
    reranker_max_length: int = 512
    reranker_batch: int = 4
    embedding_size: int = 768

    def __post_init__(self) -> None:
        if self.chunk_size <= 0 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_size > 0 and 0 <= chunk_overlap < chunk_size are needed")
        for name in ("bm25_candidates", "semantic_candidates", "rerank_candidates", "final_top_k", "per_query_candidates", "parent_candidates", "final_parent_top_k"):
            _within(name, getattr(self, name), 1, 100)
        for name in ("rrf_k", "parent_rrf_k"):
            _within(name, getattr(self, name), 1, 10_000)
        _within("min_rerank_score", self.min_rerank_score, 0, 1)
        _within("multi_query_count", self.multi_query_count, 1, 5)
        _within("multi_query_max_chars", self.multi_query_max_chars, 50, 1000)
        _within("parent_max_chars", self.parent_max_chars, 1000, 20_000)
        _within("context_max_chars", self.context_max_chars, 1000, 100_000)
        _within("parent_child_limit", self.parent_child_limit, 1, 20)
        _within("reranker_max_length", self.reranker_max_length, 64, 4096)
        _within("reranker_batch", self.reranker_batch, 1, 64)
        _within("embedding_size", self.embedding_size, 128, 3072)
        if self.final_top_k > self.rerank_candidates or self.final_parent_top_k > self.parent_candidates or self.context_max_chars < self.parent_max_chars:
            raise ValueError("a final number exceeds its candidates, or the context is smaller than a parent")
        for a, b in ((self.bm25_weight, self.semantic_weight), (self.original_weight, self.variant_weight)):
            if min(a, b) < 0 or max(a, b) == 0:
                raise ValueError("weights must be 0 or more, one of them above 0")
        if self.max_distance < 0:
            raise ValueError("max_distance must be 0 or more")

    @classmethod
    def load(cls, values: Mapping[str, str]) -> Retrieval:
        """From texts under the upper-case names of the parameters, an environment for example; absent or blank ones keep
        their defaults, what is no number of the right kind raises."""
        given = {}
        for field in fields(cls):
            text = (values.get(field.name.upper()) or "").strip()
            if text:
                try:
                    given[field.name] = int(text) if field.type == "int" else float(text)
                except ValueError:
                    raise ValueError(f"{field.name.upper()} must be a number, not {text!r}") from None
        return cls(**given)
