"""Thresholds of the analysis. Passed explicitly to every operator; nothing reads module globals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # The analysis is defined by these numbers.
    num_results: int = 10
    max_results: int = 100
    min_chars: int = 150
    max_features: int = 200
    min_df: int = 2
    min_page_tokens: int = 2
    min_token_chars: int = 3
    page_terms: int = 15
    min_score: float = 0.01
    top_terms: int = 50
    cloud_terms: int = 50
    entities_per_label: int = 15
    min_entity_chars: int = 3
    max_listed_surfaces: int = 200_000
    terms_per_cluster: int = 10
    max_clusters: int = 5
    cluster_rounds: int = 300
    local_pages: int = 2000
    min_sentiment_chars: int = 11
    modifier_words: int = 3
    cache_ttl_seconds: int = 7 * 24 * 60 * 60
    context_terms: int = 20
    context_cluster_terms: int = 8
    context_entities: int = 5
    context_reference_chars: int = 200
    display_url_chars: int = 70
    failed_preview: int = 5
    default_language: str = "de"
    languages: tuple[str, ...] = ("de", "en", "es", "fr")


DEFAULT = Params()
