"""Robust locally weighted regression of many points on one variable.

The curve is fitted at anchors that are dense enough to interpolate between (the ends of cells of a hundredth of the range, so at most a
few hundred) and every fit is exact: the distance to the k-th nearest of all points is found by counting, and a fit is a few weighted sums
over all points. Both are sums over tasks, so points are neither sorted nor moved, and a task sends a few numbers per anchor. Robustness
passes weigh points by their residuals against six times the median residual.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from countspark.session import collect_small, keep

#: Points of a block, candidates per round of counting, values between the last bounds that the driver may hold.
BLOCK, CANDIDATES, LEFT = 8192, 31, 20_000
_Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Curve:
    """Fitted values at rising anchors; between them lines, beyond them the ends."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, at: np.ndarray) -> np.ndarray:
        return np.interp(at, self.x, self.y)


def _summed(points: DataFrame, size: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all points of an array of ``size`` numbers made per block of points."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                total += part(*[batch.column(c).slice(at, BLOCK).to_numpy() for c in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["i", "v"])

    out = np.zeros(size)
    for r in collect_small(points.select("x", "y").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))):
        out[r["i"]] = r["v"]
    return out


def kth_smallest(points: DataFrame, measure: _Measure, ks: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per column of ``measure(x, y)`` (points × columns, within 0 and ``high``) its ``ks``-th smallest value, from 1, exactly.

    Each round counts, for a ladder of candidates between the bounds, how many values lie at or below; when few values are left between the
    bounds, these are listed, equal ones once.
    """
    columns = len(ks)
    low, high = np.full(columns, -1.0), np.array(high, dtype=float)
    below, upto = np.zeros(columns), np.full(columns, np.inf)
    for _ in range(12):
        ladder = np.maximum(low, 0)[:, None] + (high - np.maximum(low, 0))[:, None] * (np.arange(1, CANDIDATES + 1) / (CANDIDATES + 1))

        def count(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            values = np.sort(measure(x, y), axis=0)
            return np.concatenate([np.searchsorted(values[:, c], np.append(ladder[c], high[c]), side="right") for c in range(columns)]).astype(float)

        counts = _summed(points, columns * (CANDIDATES + 1), count).reshape(columns, -1)
        steps = np.column_stack([ladder, high])
        first = (counts >= ks[:, None]).argmax(axis=1)
        rows = np.arange(columns)
        before = np.maximum(first - 1, 0)
        below = np.where(first > 0, counts[rows, before], below)
        low = np.where(first > 0, steps[rows, before], low)
        high, upto = steps[rows, first], counts[rows, first]
        if (upto - below).sum() <= LEFT:
            break

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                values = measure(*[batch.column(c).slice(at, BLOCK).to_numpy() for c in (0, 1)])
                _, column = np.nonzero(inside := (values > low) & (values <= high))
                yield pa.RecordBatch.from_arrays([pa.array(column, pa.int32()), pa.array(values[inside])], ["i", "v"])

    left: list[list[tuple[float, int]]] = [[] for _ in ks]
    for r in collect_small(points.select("x", "y").mapInArrow(listed, "i int, v double").groupBy("i", "v").count().orderBy("i", "v")):
        left[r["i"]].append((r["v"], r["count"]))
    out = np.empty(columns)
    for c in range(columns):
        values, times = zip(*left[c])
        out[c] = values[int(np.searchsorted(np.cumsum(times) + below[c], ks[c]))]
    return out


def local_regression(points: DataFrame, x: str, y: str, *, span: float = 0.5, robust: int = 3, delta: float = 0.01) -> Curve:
    """Locally linear fit of ``y`` over ``x`` with tricube weights over the nearest ``span`` of all points, and ``robust`` reweighted passes.

    Anchors are the least and the greatest point of every cell of ``delta`` times the range. Rows with a null or NaN are left out.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    points = keep(points.where(fine(x) & fine(y)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    n, first, last = points.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        raise ValueError("no points to fit")
    reach = last - first
    cell = F.floor((F.col("x") - first) / (delta * reach)) if reach > 0 else F.lit(0)
    ends = collect_small(points.groupBy(cell.alias("cell")).agg(F.min("x").alias("a"), F.max("x").alias("b")))
    anchors = np.unique([v for r in ends for v in (r["a"], r["b"])])
    k = max(min(int(span * n + 1e-7), n), min(2, n))
    away: _Measure = lambda px, _: np.abs(px[:, None] - anchors)
    width = kth_smallest(points, away, np.full(len(anchors), k), np.maximum(anchors - first, last - anchors))
    curve, middle = None, 0.0
    for turn in range(robust + 1):
        if turn:
            size: _Measure = lambda px, py, curve=curve: np.repeat(np.abs(py - curve(px))[:, None], 2, axis=1)
            most = points.agg(F.max(F.abs("y"))).first()[0] + np.abs(curve.y).max()
            middle = 3 * kth_smallest(points, size, np.array([n // 2 + 1, n - n // 2]), np.full(2, most)).sum()
            if middle <= 1e-7 * np.abs(curve.y).mean():
                break  # the curve passes through half of the points

        def sums(px: np.ndarray, py: np.ndarray, turn=turn, curve=curve, middle=middle) -> np.ndarray:
            gap = px[:, None] - anchors
            d = np.abs(gap)
            with np.errstate(divide="ignore", invalid="ignore"):
                w = np.where(d <= 0.001 * width, 1.0, np.where(d <= 0.999 * width, (1 - (d / width) ** 3) ** 3, 0.0))
            if turn:
                r = np.abs(py - curve(px))
                w *= np.where(r <= 0.001 * middle, 1.0, np.where(r <= 0.999 * middle, (1 - (r / middle) ** 2) ** 2, 0.0))[:, None]
            return np.concatenate([w.sum(0), (w * gap).sum(0), (w * gap * gap).sum(0), py @ w, py @ (w * gap)])

        total, sx, sxx, sy, sxy = _summed(points, 5 * len(anchors), sums).reshape(5, -1)
        met = total > 0
        total = np.where(met, total, 1.0)
        centre, spread = sx / total, np.maximum(sxx / total - (sx / total) ** 2, 0)
        linear = np.sqrt(spread) > 0.001 * reach
        slope = np.where(linear, (sxy / total - centre * sy / total) / np.where(linear, spread, 1.0), 0.0)
        fitted = sy / total - centre * slope
        curve = Curve(anchors[met], fitted[met])  # an anchor all of whose neighbours are outliers is left to its neighbours
    return curve
