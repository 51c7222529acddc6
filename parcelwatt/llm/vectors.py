"""Vectors as rows of a matrix, and blocks of rows for work on pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def usable(column: str) -> Column:
    """True for a vector that is there and has only finite components."""
    return F.col(column).isNotNull() & ~F.coalesce(F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def matrix(vectors) -> np.ndarray:
    """Double matrix of vectors; shorter ones are filled with zeros."""
    vectors = list(vectors)
    width = max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array([np.asarray(v, np.float64) for v in vectors], np.float64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def hash_sample(rows: DataFrame, key: str, vector: str, size: int) -> np.ndarray:
    """A bounded sample of vectors, the same at every run: those of smallest key hash."""
    picked = rows.orderBy(F.xxhash64(key), key).limit(size).select(vector)
    return matrix(np.asarray(r[0], np.float64) for r in picked.toLocalIterator())


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of up to ``count`` distinct rows of ``sample``, beginning with the one farthest from the mean."""
    if not len(sample):
        return sample
    chosen = [int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    far = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]
