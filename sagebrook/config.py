"""Thresholds, weights and caps of the engine, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


# Results depend on each of them.
@dataclass(frozen=True)
class Config:
    confidence_high: float = 0.85
    confidence_medium: float = 0.70
    confidence_low: float = 0.50
    tier_weights: tuple[float, float, float] = (0.9, 0.7, 0.4)
    max_low_items: int = 5

    max_keywords: int = 5
    entities_per_keyword: int = 30
    edges_per_keyword: int = 40
    max_rules: int = 10
    session_turns: int = 5

    vector_top_k: int = 20
    expanded_documents: int = 5
    expansion_factor: float = 0.9
    max_phrases: int = 5
    rows_per_phrase: int = 10
    phrase_weight: int = 3
    max_search_keywords: int = 6
    rows_per_keyword: int = 15
    keyword_weight: int = 1
    max_title_keywords: int = 4
    rows_per_title: int = 10
    title_weight: int = 2
    keyword_results: int = 5

    evidence_entities: int = 5
    evidence_documents: int = 3
    evidence_confidence: float = 0.7

    promote_confidence: float = 0.5
    evidence_promote_confidence: float = 0.7
    min_sources: int = 1
    archive_below: float = 0.40
    merge_bonus: float = 0.05
    merge_bonus_cap: float = 0.10
    cross_document_bonus: float = 0.03
    feedback_deltas: tuple[tuple[str, float], ...] = (
        ("correct", 0.03),
        ("incorrect", -0.05),
        ("partial", -0.02),
        ("uncertain", 0.0),
    )
    fileback_below: float = 0.4
    fileback_down: float = -0.02
    fileback_up: float = 0.01

    rule_disable_applied: int = 50
    rule_disable_rate: float = 0.8
    rule_adjust_applied: int = 20
    rule_demote_rates: tuple[float, float] = (0.4, 0.8)

    stale_days: int = 90
    stale_rows: int = 100
    cache_similarity: float = 0.95
    cache_ttl_seconds: int = 3600
    memory_ttl_seconds: int = 3600

    chunk_chars: int = 800
    chunk_overlap_chars: int = 100
    extract_chunk_chars: int = 1000
    chunk_tokens: int = 512
    overlap_tokens: int = 50
    min_sentence_chars: int = 10
    extract_chars: int = 1200
    extract_names: int = 20
    max_hops: int = 2


CONFIG = Config()
