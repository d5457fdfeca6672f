"""NumPy kernels over one bounded block of points; Spark decides what a block holds."""

from __future__ import annotations

import numpy as np
import pandas as pd

METRICS = ("euclidean", "manhattan", "chebyshev", "cosine")


def matrix(features: pd.Series) -> np.ndarray:
    return np.stack(features.to_numpy()).astype(float)


def pairwise(left: np.ndarray, right: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of all rows of two blocks, added up one coordinate at a time."""
    if metric == "cosine":
        norms = np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None, :]
        return 1.0 - (left @ right.T) / norms
    out = np.zeros((len(left), len(right)))
    for dim in range(left.shape[1]):
        gap = left[:, dim][:, None] - right[:, dim][None, :]
        if metric == "euclidean":
            out += gap * gap
        elif metric == "manhattan":
            out += np.abs(gap)
        elif metric == "chebyshev":
            np.maximum(out, np.abs(gap), out=out)
        else:
            raise ValueError(f"unsupported metric: {metric}, must be one of {METRICS}")
    return np.sqrt(out) if metric == "euclidean" else out


def core_of(dist: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th neighbour of each row of a full block, the row itself not counted."""
    rank = min(k, len(dist) - 1)
    return np.partition(dist, rank, axis=1)[:, rank]


def spanning_edges(ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of a full weight matrix as (a, b, w), a < b.

    ``ids`` is sorted. Equal weights are ordered by (a, b), which makes the tree unique.
    """
    n = len(ids)
    best = np.full(n, np.inf)
    rank = np.zeros(n, dtype=np.int64)
    parent = np.zeros(n, dtype=np.int64)
    open_ = np.ones(n, dtype=bool)
    spot = np.arange(n)
    left, right, cost = [], [], []
    current = 0
    for _ in range(n - 1):
        open_[current] = False
        edge = np.minimum(spot, current) * n + np.maximum(spot, current)
        row = weights[current]
        nearer = open_ & ((row < best) | ((row == best) & (edge < rank)))
        best[nearer], rank[nearer], parent[nearer] = row[nearer], edge[nearer], current
        least = best[open_].min()
        ties = np.flatnonzero(open_ & (best == least))
        current = ties[np.argmin(rank[ties])]
        left.append(min(parent[current], current))
        right.append(max(parent[current], current))
        cost.append(least)
    return ids[np.array(left, dtype=int)], ids[np.array(right, dtype=int)], np.array(cost, dtype=float)
