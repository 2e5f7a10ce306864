"""Whitening of embeddings from an exact scatter matrix, counted on bit slices.

Every component becomes an integer. The integers of a dimension, less their smallest, are written as bit planes: bit ``a`` of many rows
side by side in 64-bit words. The sum of products of two dimensions is then the sum, over pairs of planes, of ``2 ** (a + b)`` times
the number of ones in the AND of the planes, which is exact for any number of rows and in any order. Centring is done on the integers;
only the centred scatter matrix, with a row per dimension, reaches the driver and is decomposed there.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from countspark.llm.common import id_column
from countspark.session import keep_measured

#: Integer of a component c is floor(SCALE * c) + OFFSET; components of the result.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Integers are bounded here (components that large keep their rank only).
BOUND = 2 ** 62
#: Rows whose planes are counted at once; an eigenvalue below this share of the largest is zero.
BLOCK = 8192
ZERO = 1e-12
_LOW = 40


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a batch as integers, (rows, dim)."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values), -float(BOUND), float(BOUND)).astype(np.int64) + OFFSET


def bit_planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """Planes of non-negative integers (rows, dim): words of 64 rows, (dim, bits, words); missing rows are zero."""
    rows, dim = shifted.shape
    words = -(-rows // 64)
    out = np.zeros((dim, bits, words * 8), np.uint8)
    for b in range(bits):
        out[:, b, :-(-rows // 8)] = np.packbits((shifted >> b & 1).astype(np.uint8), axis=0, bitorder="little").T
    return out.view(np.uint64)


class Scatter:
    """Exact sums of products of all pairs of dimensions, kept as counts per power of two."""

    def __init__(self, widths: np.ndarray):
        self.widths, self.dim = widths, len(widths)
        self.bits = int(widths.max(initial=0))
        self.planes = np.array([(d, b) for d, w in enumerate(widths) for b in range(w)], np.int64).reshape(-1, 2)
        self.powers = 2 * self.bits + 1
        self.counts = np.zeros(self.dim * self.dim * self.powers, np.int64)

    def add(self, shifted: np.ndarray) -> None:
        d, b = self.planes.T
        words = bit_planes(shifted, self.bits)[d, b]
        for p in range(len(words)):
            ones = np.bitwise_count(words[p] & words[p:]).sum(1, dtype=np.int64)
            # two different planes of one dimension meet twice in its square
            power = b[p] + b[p:] + (d[p:] == d[p])
            power[0] = 2 * b[p]
            self.counts[(d[p] * self.dim + d[p:]) * self.powers + power] += ones

    def sums(self) -> Iterator[tuple[int, int, int]]:
        """``(i, j, sum of products)`` for i <= j, as Python integers."""
        counts = self.counts.reshape(self.dim, self.dim, self.powers)
        for i in range(self.dim):
            for j in range(i, self.dim):
                yield i, j, sum(int(n) << s for s, n in enumerate(counts[i, j].tolist()) if n)


def _dimension(rows: DataFrame) -> int:
    """The commonest length of the vectors, of equally common ones the longest."""
    got = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return got["dim"] if got else 0


def _ranges(rows: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray, list[int]]:
    """Number of rows; least and greatest integer and sum per dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total = 0, np.full(dim, 2 ** 63 - 1), np.full(dim, -2 ** 63), [0] * dim
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column(0), dim)
                n, low, high = n + len(x), np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
                halves = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
                total = [t + (a << 32) + b for t, a, b in zip(total, *halves)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), pa.array(low), pa.array(high),
                                              pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["i", "n", "low", "high", "total"])

    got = rows.select("v").mapInArrow(run, "i int, n bigint, low bigint, high bigint, total decimal(38,0)")
    got = got.groupBy("i").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total")).orderBy("i").collect()
    if not got:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64), []
    return got[0]["n"], np.array([r["low"] for r in got]), np.array([r["high"] for r in got]), [int(r["total"]) for r in got]


def scatter_sums(rows: DataFrame, dim: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of products of all pairs of dimensions of the integers less ``low``, as exact Python integers."""
    widths = np.array([int(b - a).bit_length() for a, b in zip(low.tolist(), high.tolist())], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter, some = Scatter(widths), False
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                scatter.add((integers(batch.column(0).slice(at, BLOCK), dim).view(np.uint64) - low.view(np.uint64)))
                some = True
        if some:
            i, j, total = zip(*scatter.sums())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([t & (1 << _LOW) - 1 for t in total], pa.int64()),
                                              pa.array([Decimal(t >> _LOW) for t in total], pa.decimal128(38, 0))], ["i", "j", "rest", "upper"])

    parts = rows.select("v").mapInArrow(run, "i int, j int, rest bigint, upper decimal(38,0)")
    out = np.zeros((dim, dim), object)
    for r in parts.groupBy("i", "j").agg(F.sum("rest").alias("rest"), F.sum("upper").alias("upper")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = (int(r["upper"]) << _LOW) + int(r["rest"])
    return out


def principal_axes(n: int, products: np.ndarray, sums: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, falling, eigenvectors as columns (largest entry positive), and trace of the covariance, centred on the integers."""
    centred = [[n * products[i, j] - sums[i] * sums[j] for j in range(len(sums))] for i in range(len(sums))]
    covariance = np.array([[c / (n * n) for c in row] for row in centred], np.float64)
    values, axes = np.linalg.eigh(covariance)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return values, axes, sum(centred[i][i] for i in range(len(sums))) / (n * n)


def _square_sums(away: np.ndarray) -> list[int]:
    """Exact row sums of squares of integers."""
    most = int(np.abs(away).max(initial=0))
    if most < 2 ** 52 and away.shape[1] <= 512:  # 26-bit halves: no sum of products overflows
        upper, rest = away >> 26, away & (2 ** 26 - 1)
        parts = [(a * b).sum(1).tolist() for a, b in ((upper, upper), (upper, rest), (rest, rest))]
        return [(a << 52) + (b << 27) + c for a, b, c in zip(*parts)]
    return [sum(x * x for x in row) for row in away.tolist()]


def whiten(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: key, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``,
    ``deviation_exact``.

    Vectors that are null or hold null or non-finite components take no part, nor do those whose length is not the commonest (of equally common
    ones the longest). ``deviation`` is null where it does not fit into a long, ``deviation_exact`` (38 digits) has it always. Components
    whose variance is zero (a share below 1e-12 of the largest) have no whitened value; without any variance ``explained`` and
    ``identity_error`` are null too. Repeated rows and null keys count as any others; other columns are ignored; an empty table, or vectors without
    components, give an empty result.
    """
    spark = vectors.sparkSession
    id_type = id_column(vectors, key)
    rows = vectors.where(usable(F.col(vector))).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    dim = _dimension(rows)
    rows = rows.where(F.size("v") == dim)
    n, low, high, totals = _ranges(rows, dim) if dim else (0, None, None, None)
    if not n:
        return spark.createDataFrame([], f"{key} {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    sums = [t - n * a for t, a in zip(totals, low.tolist())]
    values, axes, trace = principal_axes(n, scatter_sums(rows, dim, low, high), sums)
    k = min(components, dim)
    some = int((values[:k] > ZERO * values[0]).sum())
    turn = axes[:, :some] / np.sqrt(values[:some])
    fits = (max(int(b - a) for a, b in zip(low.tolist(), high.tolist())) * n).bit_length() < 62

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), dim)
            if fits:
                away = n * (x - low) - np.array(sums, np.int64)
                square, centred = _square_sums(away), away / n
            else:
                away = [[n * (c - a) - s for c, a, s in zip(row, low.tolist(), sums)] for row in x.tolist()]
                square, centred = [sum(c * c for c in row) for row in away], np.array([[c / n for c in row] for row in away]).reshape(-1, dim)
            w = (centred @ turn).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s if s < 2 ** 63 else None for s in square], pa.int64()),
                                              pa.array([Decimal(s) if s < 10 ** 38 else None for s in square], pa.decimal128(38, 0)),
                                              pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) + 1, some) if some else np.zeros(len(x) + 1), pa.int32()), pa.array(w))],
                                             ["id", "deviation", "deviation_exact", "w"])

    made = rows.select("id", "v").mapInArrow(project, f"id {id_type}, deviation bigint, deviation_exact decimal(38,0), w array<double>")
    made, seen = keep_measured(made, **{f"s{c}": F.sum(F.get("w", F.lit(c))) for c in range(some)})
    error = _identity_error(made, n, np.array([seen[f"s{c}"] for c in range(some)]) / n) if some else None
    shares = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values[:k]])
    each = made.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("component"))
    return each.select(F.col("id").alias(key), "component", F.lit(n).cast("bigint").alias("n"), "deviation", F.get("w", F.col("component") - 1).alias("whitened"),
                       F.element_at(shares, F.col("component")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_exact")


def _identity_error(made: DataFrame, n: int, means: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity."""
    k = len(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy().reshape(-1, k) - means
            total += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "x"])

    got = made.select("w").mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    return max(abs(r["x"] / n - (r["i"] == r["j"])) for r in got)
