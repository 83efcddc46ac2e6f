"""Vectors as whole numbers, and their exact inner products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# a product of norms below this keeps every sum exact in float64
EXACT = float(1 << 52)
# the ends of a long
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def complete(vector: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def whole_numbers(vectors: list, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) row by row as float64, which holds them exactly; zero beyond a vector's end."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        out = np.floor(out * float(scale))
    return np.clip(out, -np.finfo(np.float64).max, np.finfo(np.float64).max)


def norms_of(values: np.ndarray) -> np.ndarray:
    """Euclidean norms without overflow on the way (infinite if they are beyond a double)."""
    most = np.abs(values).max(axis=1, initial=0.0)
    safe = np.where(most > 0, most, 1.0)
    with np.errstate(over="ignore"):
        return np.linalg.norm(values / safe[:, None], axis=1) * most


def exact_products(a: np.ndarray, b: np.ndarray, norms_a: np.ndarray | None = None, norms_b: np.ndarray | None = None) -> np.ndarray:
    """a @ b.T of whole numbers kept in float64; products beyond a long count as the nearest long.

    Where the norms keep every sum exact, in float64; only rows too large for
    that are multiplied as Python integers.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    norms_a, norms_b = (norms_of(x) if n is None else n for x, n in ((a, norms_a), (b, norms_b)))
    if norms_a.max() * norms_b.max() < EXACT:
        return (a @ b.T).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    limit = EXACT**0.5
    wide_a, wide_b = norms_a >= limit, norms_b >= limit
    out[np.ix_(~wide_a, ~wide_b)] = (a[~wide_a] @ b[~wide_b].T).astype(np.int64)
    for rows, cols in ((wide_a, np.ones(len(b), bool)), (~wide_a, wide_b)):
        if rows.any() and cols.any():
            left = [[int(x) for x in row] for row in a[rows]]
            right = [[int(x) for x in row] for row in b[cols]]
            out[np.ix_(rows, cols)] = [[min(max(sum(x * y for x, y in zip(p, q, strict=True)), LEAST), MOST) for q in right] for p in left]
    return out
