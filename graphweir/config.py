"""Query and pipeline settings; every default that the pipelines disagree on is explicit per pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class QuerySettings:
    mode: str = "hybrid"
    only_need_context: bool = False
    only_need_prompt: bool = False
    response_type: str = "Multiple Paragraphs"
    top_k: int = 60
    max_token_for_text_unit: int = 4000
    max_token_for_global_context: int = 4000
    max_token_for_local_context: int = 4000
    max_source_nodes: int = 40
    alpha: float = 50.0
    confidence: float = 0.7
    edge_weight_scheme: str = "original"
    min_flow_threshold: float = 0.01
    return_raw_clusters: bool = False
    cluster_batch: int = 10

    def __post_init__(self) -> None:
        if self.mode not in ("local", "global", "hybrid"):
            raise ValueError(f"unknown mode {self.mode!r}")


@dataclass(frozen=True)
class PassageSettings:
    linking_top_k: int = 10
    passage_node_weight: float = 0.05
    alpha: float = 1.5
    epsilon: float = 0.01
    step: float = 0.2
    rounds: int = 8
    edge_weight_scheme: str = "multiply"
    damping: float = 0.5
    synonymy_top_k: int = 2047
    synonymy_threshold: float = 0.8
    synonymy_most: int = 101
    retrieval_top_k: int = 200
    qa_top_k: int = 5
    chunk_words: int = 500
    chunk_overlap: int = 50


@dataclass(frozen=True)
class EntitySettings:
    chunk_tokens: int = 1200
    chunk_overlap: int = 100
    summary_tokens: int = 5000
    vector_threshold: float = 0.2
    cache_threshold: float = 0.95
