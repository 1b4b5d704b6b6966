"""Thresholds of the note analytics, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Bars:
    """Bars that a similarity must reach, and sizes."""

    top_k: int = 30
    edge: float = 0.25  # a pair is an edge of the community graph, or a missing link
    listed: float = 0.12  # a pair is listed as related
    template: float = 0.02  # least overlap once common stems are gone
    orphan: float = 0.08  # lowest overlap of any proposal
    propose: float = 0.08  # least overlap without common stems of a proposal
    duplicate: float = 0.5  # overlap without common stems of near-duplicates
    stale: float = 0.02  # a written link below this has no substance
    index_out_degree: int = 12  # a note with more links is an index, its links are not judged
    common_share: float = 0.25  # a stem in more notes than this share is common
    common_notes: int = 20  # from so many notes on
    common_docs: int = 3  # and in so many at least
    rrf: int = 60
    k1: float = 1.5
    b: float = 0.75
    min_token: int = 3


BARS = Bars()
