"""Distance of two five-point paths, on whole Arrow batches.

The 4 x 4 segment pairs make an expression too large for one compiled method, and lambdas over arrays are
interpreted; numpy on Arrow batches is many times faster than either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _points(xs: pa.Array, ys: pa.Array) -> np.ndarray:
    """Batch x steps x 2; lists that are null or hold nulls become NaN."""

    def one(values: pa.Array) -> np.ndarray:
        filled = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        size = next((len(v) for v in filled if v.is_valid), 1)
        if filled.null_count:
            filled = pa.array([v if v is not None else [None] * size for v in filled.to_pylist()], values.type)
        return filled.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(filled), -1)

    return np.stack([one(xs), one(ys)], axis=-1)


def _to_segments(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every segment of a line, smallest over both."""
    start, step = line[:, :-1], np.diff(line, axis=1)
    square = (step * step).sum(-1)
    best = np.full(len(points), np.inf)
    for i in range(points.shape[1]):
        away = points[:, i : i + 1] - start
        along = (away * step).sum(-1)
        share = np.where(square > 1e-12, np.clip(along / np.where(square > 1e-12, square, 1.0), 0.0, 1.0), 0.0)
        left = away - share[..., None] * step
        best = np.fmin(best, (left * left).sum(-1).min(axis=1))
    return best


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def line_distance(first: np.ndarray, second: np.ndarray, touching_counts: bool) -> np.ndarray:
    """Distances of n pairs of lines, arrays n x steps x 2.

    With `touching_counts`, zero orientations count as a crossing, so that segments on one straight line are at
    distance 0 even when they lie apart; steps of length zero do not cross.
    """
    a, b = first[:, :-1, None], first[:, 1:, None]
    c, d = second[:, None, :-1], second[:, None, 1:]
    one, two = _cross(a, b, c) * _cross(a, b, d), _cross(c, d, a) * _cross(c, d, b)
    if touching_counts:
        real = ((b - a) ** 2).sum(-1) * ((d - c) ** 2).sum(-1) > 0
        crossing = (one <= 0) & (two <= 0) & real
    else:
        crossing = (one < 0) & (two < 0)
    apart = np.sqrt(np.fmin(_to_segments(first, second), _to_segments(second, first)))
    return np.where(crossing.any(axis=(1, 2)), 0.0, apart)


def path_distance(ax: str, ay: str, bx: str, by: str, touching_counts: bool = False) -> Column:
    """Smallest distance of two paths given as arrays of coordinates."""

    @F.arrow_udf("double")
    def distance(xs: pa.Array, ys: pa.Array, us: pa.Array, vs: pa.Array) -> pa.Array:
        return pa.array(line_distance(_points(xs, ys), _points(us, vs), touching_counts), pa.float64())

    return distance(F.col(ax), F.col(ay), F.col(bx), F.col(by))
