"""Tunable values of every stage, with the defaults the engine is specified for."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    # chunking
    chunk_min_tokens: int = 150
    chunk_max_tokens: int = 400
    chunk_overlap_tokens: int = 50
    similarity_threshold: float = 0.5
    refine_min_tokens: int = 80
    refine_min_terms: int = 4
    refine_max_similarity: float = 0.42
    coherence_min: float = 0.22
    coherence_single: float = 0.95
    # deduplication
    dedup_similarity: float = 0.85
    dedup_min_chars: int = 15
    # extraction
    entities_per_chunk: int = 24
    relations_per_chunk: int = 16
    relations_after_merge: int = 20
    augment_below: float = 0.38
    # graph selection
    max_entities: int = 250
    max_relationships: int = 500
    # retrieval
    retrieval_k: int = 8
    multi_topic_extra: int = 4
    retrieval_k_cap: int = 14
    vector_text_chars: int = 2000
    graph_text_chars: int = 10000
    context_chunks: int = 3
    context_chars: int = 400
    citations: int = 5
    citation_similarity: float = 0.92
    unscoped_edges: int = 100
    # event feed
    feed_max: int = 8000
    feed_keep: int = 5000
    feed_view: int = 61


DEFAULTS = Options()
