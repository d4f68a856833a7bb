"""Every threshold of the engine, as one value that operators take."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # They must equal those that users' results were made with.
    text_duplicate: float = 0.995
    text_review: float = 0.75
    near_identical: float = 0.99
    vector_duplicate: float = 0.995
    vector_similar: float = 0.82
    version: float = 0.82
    document_short_circuit: float = 0.95
    document_final: float = 0.9
    page_match: float = 0.97
    requirement_duplicate: float = 0.97
    requirement_certain: float = 0.99
    review_suggestion: float = 0.85
    review_limit: int = 5
    chunk_ratio: float = 0.7
    chunk_fraction: float = 0.5
    max_chunk_chars: int = 900
    max_section_chars: int = 30_000
    sample_pages: int = 5
    top_k: int = 5


DEFAULT = Thresholds()
