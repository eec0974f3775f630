"""Vector metrics as Column expressions and as NumPy kernels, in one registry.

Components are cast to double before arithmetic. Vectors of different sizes are compared over the shorter size;
``penalty`` adds a constant per missing component under the root of the Euclidean distance, and ``strict`` makes the
cosine distance of different sizes 1. A null vector gives a null result; an empty overlap gives 0 (cosine: 1).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Squared-distance surcharge per component by which two sizes differ; a fixed value of the data model.
MISMATCH_PENALTY = 0.01


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def vector_literal(values) -> Column:
    """A constant double vector, from any sequence of numbers."""
    return F.array(*[F.lit(float(x)) for x in values]) if len(values) else F.array().cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _overlap(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(doubles(a), 1, n), F.slice(doubles(b), 1, n)


def _paired(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    x, y = _overlap(a, b)
    return F.zip_with(x, y, f)


def dot(a: Column, b: Column) -> Column:
    return total(_paired(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """The vector divided by its norm; all-zero vectors stay as they are."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(_paired(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column, penalty: float = 0.0) -> Column:
    extra = F.abs(F.size(a) - F.size(b)) * F.lit(float(penalty)) if penalty else F.lit(0.0)
    return F.sqrt(squared_euclidean(a, b) + extra)


def cosine(a: Column, b: Column, strict: bool = False) -> Column:
    x, y = _overlap(a, b)
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)) * F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, v: s + v * v))
    ratio = total(F.zip_with(x, y, lambda p, q: p * q)) / length
    # greatest and least would hide a NaN
    value = F.when(length == 0, F.lit(1.0)).when(F.isnan(ratio), ratio).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    return F.when(F.size(a) != F.size(b), F.lit(1.0)).otherwise(value) if strict else value


def manhattan(a: Column, b: Column) -> Column:
    return total(_paired(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    d = _paired(a, b, lambda x, y: F.abs(x - y))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.array_max(d), F.lit(0.0)))


def hamming(a: Column, b: Column) -> Column:
    return total(_paired(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))


def _sq_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def _cos_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n == 0, 1.0, 1 - np.clip((a @ b.T) / n, -1, 1))


def _rowwise(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([f(b - x) for x in a]) if len(a) else np.zeros((0, len(b)))

    return block


@dataclass(frozen=True)
class Metric:
    """``column`` builds an expression, ``block`` all pairs of two matrices, ``pairs`` row by row of two equal-shaped
    matrices (exact: ``block`` may cancel for near-equal rows). Of a similarity the largest values are nearest."""

    name: str
    column: Callable[..., Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    pairs: Callable[[np.ndarray, np.ndarray], np.ndarray]
    similarity: bool = False


def _pairs_cos(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n == 0, 1.0, 1 - np.clip((a * b).sum(1) / n, -1, 1))


def _max(x: np.ndarray, axis: int = -1) -> np.ndarray:
    return np.abs(x).max(axis) if x.shape[axis] else np.zeros(x.shape[:-1])


METRICS = {
    m.name: m
    for m in (
        Metric("euclidean", euclidean, lambda a, b: np.sqrt(_sq_block(a, b)), lambda a, b: np.sqrt(((a - b) ** 2).sum(1))),
        Metric("squared_euclidean", squared_euclidean, _sq_block, lambda a, b: ((a - b) ** 2).sum(1)),
        Metric("cosine", cosine, _cos_block, _pairs_cos),
        Metric("manhattan", manhattan, _rowwise(lambda d: np.abs(d).sum(1)), lambda a, b: np.abs(a - b).sum(1)),
        Metric("chebyshev", chebyshev, _rowwise(_max), lambda a, b: _max(a - b)),
        Metric("hamming", hamming, _rowwise(lambda d: (d != 0).sum(1).astype(float)), lambda a, b: (a != b).sum(1).astype(float)),
        Metric("dot", dot, lambda a, b: a @ b.T, lambda a, b: (a * b).sum(1), similarity=True),
        Metric("inner", lambda a, b: -dot(a, b), lambda a, b: -(a @ b.T), lambda a, b: -(a * b).sum(1)),
    )
}

#: Other accepted names, compared without case and separators.
ALIASES = {"l2": "euclidean", "dotproduct": "dot", "innerproduct": "inner", "infinity": "chebyshev", "linf": "chebyshev", "l1": "manhattan", "squared": "squared_euclidean", "squaredeuclidean": "squared_euclidean"}


def metric(name: str) -> Metric:
    """The metric of a name or alias in any case; an unknown name means Euclidean."""
    key = (name or "").lower()
    key = key if key in METRICS else ALIASES.get(key.replace("_", "").replace("-", ""), "euclidean")
    return METRICS[key]


def register(name: str, pairs: Callable[[np.ndarray, np.ndarray], np.ndarray], similarity: bool = False) -> Metric:
    """A metric of one's own under ``name``, for every search and for graphs. ``pairs`` gives the distances of two matrices
    row by row. Expressions of it run as Arrow batches of Python, the slow way."""
    key = name.lower()
    if key in METRICS or key in ALIASES:
        raise ValueError(f"{name!r} is taken")

    def block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([pairs(np.broadcast_to(x, b.shape), b) for x in a]) if len(a) else np.zeros((0, len(b)))

    def column(a: Column, b: Column) -> Column:
        @F.pandas_udf("double")
        def apply(x: pd.Series, y: pd.Series) -> pd.Series:
            out = np.full(len(x), np.nan)
            for i, (p, q) in enumerate(zip(x, y)):
                if p is not None and q is not None:
                    n = min(len(p), len(q))
                    out[i] = pairs(np.asarray(p, np.float64)[None, :n], np.asarray(q, np.float64)[None, :n])[0]
            return pd.Series(out)

        return apply(doubles(a), doubles(b))

    METRICS[key] = Metric(key, column, block, pairs, similarity)
    return METRICS[key]


def database_distance(name: str, a: Column, b: Column, penalty: float = MISMATCH_PENALTY) -> Column:
    """The distance searches report: Euclidean pays for missing components, cosine of different sizes is 1."""
    m = metric(name)
    if m.name == "euclidean":
        return euclidean(a, b, penalty)
    return cosine(a, b, strict=True) if m.name == "cosine" else m.column(a, b)
