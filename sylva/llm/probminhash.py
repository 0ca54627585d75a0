"""ProbMinHash signatures of weighted sets, for whole batches of sets at once.

Every element starts a Poisson process whose rate is its share of its set's weight; each arrival belongs to one of m
components drawn at random, and a component keeps the element that arrives first. Two sets have equal components with
the probability Jaccard similarity of their weights; with equal weights that is the Jaccard similarity. Arrivals and
components follow from the element's hash alone. An element stops once its next arrival comes after the latest first
arrival of its set, so a set needs about m ln m arrivals in all, whatever its size.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def signatures(owner: np.ndarray, element: np.ndarray, sets: int, m: int, weight: np.ndarray | None = None) -> np.ndarray:
    """``sets`` x ``m`` components of the sets 0 ... sets - 1; ``owner`` has each element's set. Empty sets have zeros."""
    first = np.full(sets * m, np.inf, np.float32)
    kept = np.zeros(sets * m, np.uint64)
    time = np.zeros(len(element), np.float32)
    pace = np.ones(len(element), np.float32) if weight is None else (1 / weight).astype(np.float32)
    owner, seed, turn = owner.astype(np.int64), mix(element + _A), 0
    while len(owner):
        turn += 1
        draw = mix(seed + np.uint64(turn * int(_A) % 2**64))
        # 24 bits for the time, the high half for the component
        time = time - np.log(((draw & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)) * pace
        at = owner * m + ((draw >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        better = np.flatnonzero(time < first[at])
        if len(better):
            # Of equal times the arrival of an earlier turn stays, and within a turn that of the greatest element.
            spot, when, what = at[better], time[better], seed[better]
            np.minimum.at(first, spot, when)
            won = when == first[spot]
            spot, what = spot[won], what[won]
            kept[spot] = 0
            np.maximum.at(kept, spot, what)
        latest = first.reshape(sets, m).max(axis=1)
        on = time < latest[owner]
        owner, seed, time, pace = owner[on], seed[on], time[on], pace[on]
    return kept.reshape(sets, m)
