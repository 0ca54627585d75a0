"""The choice between exact and approximate search."""

from __future__ import annotations

from sylva.model import Backend


def choose(asked: Backend, candidates: int, threshold: int, index_current: bool) -> Backend:
    """Adaptive search is exact up to the threshold or without a current index; an explicit choice stands."""
    if asked is not Backend.ADAPTIVE:
        return asked
    return Backend.EXACT if candidates <= threshold or not index_current else Backend.APPROXIMATE
