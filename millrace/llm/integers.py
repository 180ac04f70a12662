"""Vectors of whole numbers, shared by the searches over ``embeddings``.

A component x counts as floor(scale * x) in doubles, held to 64 bits. Vectors of different lengths meet as if the shorter one
went on in zeros. Inner products are exact; one beyond 64 bits counts as the nearest number of 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_LONG = np.iinfo(np.int64)


def usable(raw: Column | str) -> Column:
    """True where a vector is there and holds neither null nor a number that is not finite."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return raw.isNotNull() & ~F.coalesce(F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def whole(raw: Column | str, scale: int) -> Column:
    """floor(scale * x) of each component, kept as doubles."""
    return F.transform(raw, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))


def norm2(v: Column | str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """The rows of an Arrow list column, filled up with zeros to ``dim`` columns."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(lists) * dim and (ends == dim).all():
        return flat.reshape(len(lists), dim).astype(np.float64, copy=False)
    out = np.zeros((len(lists), dim))
    if len(flat):
        out[np.repeat(np.arange(len(ends)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: in doubles while 53 bits hold every sum, else in 64 bits, else in Python's integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max())
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(x) for x in row] for row in a], dtype=object) @ np.array([[int(x) for x in row] for row in b], dtype=object).T
    return np.array([[min(max(x, _LONG.min), _LONG.max) for x in row] for row in exact], dtype=np.int64).reshape(len(a), len(b))


class Lifted:
    """Inner products as distances: a data vector gets one more coordinate that brings its norm to the largest one, a query gets a
    zero there, so |q - v|^2 = |q|^2 + most - 2 <q, v> and the nearest vector is the one of the highest score.

    ``slack`` covers the rounding of distances; where scores may leave 64 bits it is infinite and nothing is ruled out.
    """

    def __init__(self, most: float, dim: int):
        self.most, self.dim = most, dim
        self.slack = 1e-6 * np.sqrt(most) if most < 2.0**62 else np.inf

    def data(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.most - (v * v).sum(axis=1), 0))])

    def query(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.zeros(len(v))])

    def distance(self, score: np.ndarray | float, own: np.ndarray | float) -> np.ndarray:
        """From a query of squared norm ``own`` to a data vector of this score."""
        return np.sqrt(np.maximum(own + self.most - 2.0 * score, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to those of b."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0))
