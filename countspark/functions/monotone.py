"""Regression by a rising step function."""

from __future__ import annotations

import numpy as np


def pool_neighbours(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to ``values`` in weighted squares: neighbours out of order are pooled to their mean until none are."""
    means, sizes, counts = [], [], []
    for v, w in zip(np.asarray(values, float), np.asarray(weights, float)):
        means.append(v)
        sizes.append(w)
        counts.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            v, w, c = means.pop(), sizes.pop(), counts.pop()
            means[-1] = (means[-1] * sizes[-1] + v * w) / (sizes[-1] + w)
            sizes[-1] += w
            counts[-1] += c
    return np.repeat(means, counts)
