"""Spherical k-means on a bounded sample, the common ground of every vector index here."""

from __future__ import annotations

import numpy as np


def unit(data: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    data = np.asarray(data, dtype="f4")
    scale = np.abs(data).max(axis=1, keepdims=True) if data.size else np.ones((len(data), 1), "f4")
    data = data / np.where(scale > 0, scale, 1)
    length = np.sqrt((data.astype("f8") ** 2).sum(axis=1, keepdims=True))
    return (data / np.where(length > 0, length, 1)).astype("f4")


def fit_centroids(sample: np.ndarray, k: int, seed: int = 7, rounds: int = 8, balance: float = 0.0) -> np.ndarray:
    """At most k unit centroids of ``sample``; an empty cell restarts at a member of the fullest one.

    ``balance`` lowers the score of cells by that much per full multiple of the mean size, so that dense regions get
    more cells. One zero row stands for an empty sample.
    """
    data = unit(sample)
    if not len(data):
        return np.zeros((1, sample.shape[1]), "f4")
    rng = np.random.default_rng(seed)
    k = min(k, len(data))
    centroids = data[rng.choice(len(data), k, replace=False)].copy()
    penalty = np.zeros(k, "f4")
    for _ in range(rounds):
        cell = np.empty(len(data), "i8")
        for at in range(0, len(data), 4096):
            cell[at : at + 4096] = (data[at : at + 4096] @ centroids.T - penalty).argmax(1)
        size = np.bincount(cell, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, data)
        empty = np.flatnonzero(size == 0)
        if len(empty):
            full = np.flatnonzero(cell == size.argmax())
            sums[empty] = data[rng.choice(full, len(empty))]
        centroids = unit(sums)
        if balance:
            penalty = (balance * (size / (len(data) / k) - 1)).clip(-balance, 4 * balance).astype("f4")
    return centroids
