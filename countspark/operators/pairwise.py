"""Sample × sample matrices.

Cells are gathered once into feature rows. A task turns its rows into dense blocks and accumulates the statistic of every
pair of sample blocks with matrix products, so no pair is ever emitted per feature: what leaves a task is one partial result
per pair of samples. When the samples do not fit into one task's accumulators they are cut into ranges, and every pair of
ranges has tasks of its own, which get the cells of these two ranges only: a cell is copied once per range, not once per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from countspark.functions.rows import _dense_blocks, feature_rows, fold_partitions, sample_index, sample_names
from countspark.functions.scans import rank_table
from countspark.session import collect_small, keep, small

#: Doubles a task may hold as accumulators (400 MB).
STATE_CELLS = 50_000_000
#: Feature rows per task of a pair of ranges.
SPLIT_ROWS = 8192


def _block_pairs(n: int, width: int) -> list[tuple[slice, slice]]:
    starts = range(0, n, width)
    return [(slice(a, min(a + width, n)), slice(b, min(b + width, n))) for a in starts for b in starts if a <= b]


def range_pairs(n: int, width: int, cells_per_pair: int = 1) -> list[tuple[slice, slice]]:
    """Pairs of sample ranges, each as wide as the accumulators of one task allow (a multiple of ``width``)."""
    blocks = max(1, int((STATE_CELLS / cells_per_pair) ** 0.5) // width)
    return _block_pairs(n, blocks * width)


def deal_ranges(rows: DataFrame, ranges: list[tuple[slice, slice]]) -> DataFrame:
    """``(task, idx, x)``: every feature row once per pair of ranges, with the cells of these ranges only."""
    bounds = F.array(*[F.struct(F.lit(t).alias("t"), *[F.lit(v).alias(c) for c, v in (("a0", a.start), ("a1", a.stop), ("b0", b.start), ("b1", b.stop))]) for t, (a, b) in enumerate(ranges)])
    each = rows.select(F.arrays_zip("idx", "x").alias("cells"), F.xxhash64("idx", "x").alias("h"), F.explode(bounds).alias("r"))
    inside = F.filter("cells", lambda c: ((c["idx"] >= F.col("r.a0")) & (c["idx"] < F.col("r.a1"))) | ((c["idx"] >= F.col("r.b0")) & (c["idx"] < F.col("r.b1"))))
    return each.select(F.col("r.t").alias("task"), "h", inside.alias("c")).select("task", "h", F.col("c.idx").alias("idx"), F.col("c.x").alias("x"))


def pair_states(rows: DataFrame, n: int, *, prepare: Callable[[np.ndarray, np.ndarray], np.ndarray], update: Callable, emit: Callable,
                schema: str, width: int, cells_per_pair: int = 1) -> DataFrame:
    """Fold feature rows into one state per pair of sample blocks and emit the pairs of each partition.

    ``prepare(block, samples)`` gets the dense cells of some samples and their indices; ``update(state, a, b)`` adds two ``features ×
    samples`` blocks to a state (None at first); ``emit(state)`` turns it into a matrix with optional trailing axes. Output: ``a, b``
    (sample indices, a < b) and the columns of ``schema``.
    """
    ranges = range_pairs(n, width, cells_per_pair)
    out = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), *T.StructType.fromDDL(schema).fields])
    target = to_arrow_schema(out)
    if len(ranges) == 1:
        data = fold_partitions(rows.select("idx", "x"), n).withColumn("task", F.lit(0))
    else:
        splits = max(1, rows.count() // SPLIT_ROWS)
        data = deal_ranges(rows, ranges).repartition("task", F.pmod("h", F.lit(splits))).sortWithinPartitions("task").select("task", "idx", "x")

    def blocks_of(task: int) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """Samples of a task, and the pairs of their blocks as places among these samples."""
        a, b = ranges[task]
        if a == b:
            return np.arange(a.start, a.stop), _block_pairs(a.stop - a.start, width)
        size = a.stop - a.start
        cut = lambda s, base: [slice(base + i, base + min(i + width, s.stop - s.start)) for i in range(0, s.stop - s.start, width)]
        return np.concatenate([np.arange(a.start, a.stop), np.arange(b.start, b.stop)]), [(x, y) for x in cut(a, 0) for y in cut(b, size)]

    def flush(task: int, states: dict) -> Iterator[pa.RecordBatch]:
        samples, pairs = blocks_of(task)
        for number, state in states.items():
            left, right = pairs[number]
            values = emit(state)
            ia, ib = np.indices(values.shape[:2])
            ia, ib = samples[ia + left.start], samples[ib + right.start]
            upper = ia < ib
            if not upper.any():
                continue
            chosen = values[upper]
            if chosen.ndim == 1:
                column = pa.array(chosen)
            else:
                offsets = pa.array(np.arange(len(chosen) + 1, dtype=np.int32) * chosen.shape[1])
                column = pa.ListArray.from_arrays(offsets, pa.array(chosen.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(ia[upper].astype(np.int32)), pa.array(ib[upper].astype(np.int32)), column], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, states, samples, pairs = None, {}, None, []
        for batch in batches:
            tasks = batch.column("task").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tasks)) + 1), len(tasks)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if tasks[lo] != current:
                    if current is not None:
                        yield from flush(current, states)
                    current, states = tasks[lo], {}
                    samples, pairs = blocks_of(current)
                for block in _local_blocks(batch.slice(lo, hi - lo), samples):
                    block = prepare(block, samples)
                    for number, (left, right) in enumerate(pairs):
                        states[number] = update(states.get(number), block[:, left], block[:, right])
        if current is not None:
            yield from flush(current, states)

    return data.mapInArrow(run, out)


def _local_blocks(batch: pa.RecordBatch, samples: np.ndarray) -> Iterator[np.ndarray]:
    """Dense blocks of the given samples' columns, in their order."""
    idx, x = batch.column("idx"), batch.column("x")
    start, stop = idx.offsets[0].as_py(), idx.offsets[-1].as_py()
    places = np.searchsorted(samples, idx.values.slice(start, stop - start).to_numpy(zero_copy_only=False)).astype(np.int32)
    offsets = pa.array((idx.offsets.to_numpy() - start).astype(np.int32))
    local = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(places)), x], ["idx", "x"])
    for _, _, block in _dense_blocks(local, len(samples)):
        yield block


def _named(pairs: DataFrame, samples: DataFrame, names: list, value: str) -> DataFrame:
    index = sample_index(samples, names)
    left = index.select(F.col("idx").alias("a"), F.col("sample").alias("sample_a"))
    right = index.select(F.col("idx").alias("b"), F.col("sample").alias("sample_b"))
    return pairs.join(left, "a").join(right, "b").select("sample_a", "sample_b", value)


def _sum_pairs(rows: DataFrame, n: int, prepare, kernel) -> DataFrame:
    """Additive pair statistic: ``kernel(a, b)`` gives the matrix of a block, partial sums are added up per pair."""
    update = lambda state, a, b: kernel(a, b) if state is None else state + kernel(a, b)
    parts = pair_states(rows, n, prepare=prepare, update=update, emit=lambda s: s, schema="value double", width=1024)
    return parts.groupBy("a", "b").agg(F.sum("value").alias("value"))


def _samples_of(df: DataFrame, samples: DataFrame | None) -> DataFrame:
    return keep(df.select("sample").distinct()) if samples is None else samples


def _standardised(rows: DataFrame, cells: DataFrame, col: str, names: list):
    """Function that centres and scales dense blocks per sample; moments come from the sparse cells in closed form."""
    n_rows = rows.count()
    k, m, v = F.count(col), F.avg(col), F.coalesce(F.var_pop(col), F.lit(0.0))
    mean = k * m / n_rows
    ss = k * v + k * F.pow(m - mean, 2) + (n_rows - k) * F.pow(mean, 2)
    stats = {r[0]: (r[1], r[2]) for r in collect_small(cells.groupBy("sample").agg(mean.alias("m"), F.sqrt(ss).alias("s")))}
    centre = np.array([stats.get(s, (0.0, 0.0))[0] for s in names])
    scale = np.array([stats.get(s, (0.0, 0.0))[1] for s in names])
    scale = np.where(scale > 0, scale, np.nan)
    return lambda block, samples: (block - centre[samples]) / scale[samples]


def sample_corr_pearson(df: DataFrame, col: str, samples: DataFrame | None = None) -> DataFrame:
    """``(sample_a, sample_b, corr)`` for a < b over all features with any cell; absent cells are 0. NULL without variance."""
    samples = _samples_of(df, samples)
    names = sample_names(samples)
    rows = feature_rows(df, col, samples, names)
    pairs = _sum_pairs(rows, len(names), _standardised(rows, df, col, names), lambda a, b: a.T @ b)
    named = _named(pairs, samples, names, "value")
    return named.select("sample_a", "sample_b", F.when(~F.isnan("value"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value")))).alias("corr"))


def shifted_ranks(df: DataFrame, col: str, samples: DataFrame) -> DataFrame:
    """Average rank of each cell within its sample minus the rank of an absent cell, so that absent cells stay 0."""
    n = df.select("feature").distinct().count()
    present = samples.select("sample").distinct().join(df.groupBy("sample").agg(F.count(F.lit(1)).alias("_k")), "sample", "left")
    absent = F.lit(n) - F.coalesce("_k", F.lit(0))
    kind = df.schema[col].dataType
    zeros = small(present.select("sample", F.lit(0).cast(kind).alias(col), absent.alias("_times")))
    ranks = keep(rank_table(df, ["sample"], col, "_rank", extra=zeros))
    at_zero = small(ranks.where(F.col(col) == 0).select("sample", F.col("_rank").alias("_zero")))
    shifted = ranks.join(at_zero, "sample", "left").select("sample", col, (F.col("_rank") - F.coalesce("_zero", F.lit(0.0))).alias("rank"))
    return df.select("feature", "sample", col).join(small(shifted), ["sample", col]).select("feature", "sample", "rank")


def sample_corr_spearman(df: DataFrame, col: str, samples: DataFrame | None = None) -> DataFrame:
    """Pearson correlation of average ranks."""
    samples = _samples_of(df, samples)
    return sample_corr_pearson(keep(shifted_ranks(df, col, samples)), "rank", samples)


def corr_distance(df: DataFrame, col: str, *, axis: str = "samples", method: str = "pearson", ids=None) -> DataFrame:
    """1 − correlation between samples, or between a chosen list of features."""
    if axis == "features":
        if ids is None:
            raise ValueError("feature distances need a list of features")
        from countspark.operators.filters import select_feature_list

        picked = select_feature_list(df, ids)
        df = keep(picked.select(F.col("sample").alias("feature"), F.col("feature").alias("sample"), col))
    corr = (sample_corr_pearson if method == "pearson" else sample_corr_spearman)(df, col)
    a, b = ("feature_a", "feature_b") if axis == "features" else ("sample_a", "sample_b")
    return corr.select(F.col("sample_a").alias(a), F.col("sample_b").alias(b), (1 - F.col("corr")).alias("distance"))


def sample_dist_euclid(df: DataFrame, col: str, samples: DataFrame | None = None) -> DataFrame:
    """Euclidean distance over features; the cells of a task are centred per feature, which leaves distances alone and keeps them accurate."""
    samples = _samples_of(df, samples)
    names = sample_names(samples)
    rows = feature_rows(df, col, samples, names)

    def squares(a, b):
        return (a * a).sum(0)[:, None] + (b * b).sum(0)[None, :] - 2 * (a.T @ b)

    pairs = _sum_pairs(rows, len(names), lambda x, _: x - x.mean(axis=1, keepdims=True), squares)
    return _named(pairs.select("a", "b", F.sqrt(F.greatest("value", F.lit(0.0))).alias("distance")), samples, names, "distance")


#: Candidate powers of the transformation.
POWERS = np.linspace(0.05, 1.0, 39)


def _margins(counts: DataFrame, names: list, power: float) -> tuple[np.ndarray, float]:
    """Column totals of the transformed counts, and their sum."""
    got = {r[0]: r[1] for r in collect_small(counts.groupBy("sample").agg(F.sum(F.pow(F.col("raw_count").cast("double"), F.lit(float(power))))))}
    totals = np.array([got.get(s, 0.0) for s in names])
    return totals, float(totals.sum())


def poisson_power(rows: DataFrame, counts: DataFrame, names: list) -> float:
    """The power under which the goodness-of-fit statistic is nearest its expectation (n − 1)(features − 1).

    One pass accumulates Σ (x − e)²/e for all candidate powers at once.
    """
    sums = [F.sum(F.pow(F.col("raw_count").cast("double"), F.lit(float(a)))).alias(f"p{i}") for i, a in enumerate(POWERS)]
    per_sample = {r[0]: np.array(r[1:]) for r in collect_small(counts.groupBy("sample").agg(*sums))}
    columns = np.array([per_sample.get(s, np.zeros(len(POWERS))) for s in names])  # samples × powers
    overall = columns.sum(axis=0)
    n = len(names)

    def run(batches):
        total = np.zeros(len(POWERS))
        count = 0
        for batch in batches:
            for lo, hi, block in _dense_blocks(batch, n):
                count += hi - lo
                for i, a in enumerate(POWERS):
                    x = block ** a
                    x[block == 0] = 0
                    e = x.sum(axis=1, keepdims=True) * columns[:, i] / overall[i]
                    total[i] += np.where(e > 0, (x - e) ** 2 / np.where(e > 0, e, 1), 0).sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([count])], ["stat", "n"])

    parts = rows.select("idx", "x").mapInArrow(run, "stat array<double>, n bigint")
    folded = parts.agg(*[F.sum(F.col("stat")[i]) for i in range(len(POWERS))], F.sum("n")).first()
    gap = np.abs(np.array(folded[:-1]) - (n - 1) * (folded[-1] - 1))
    return float(POWERS[int(np.argmin(gap))])


def sample_dist_poisson(counts: DataFrame, samples: DataFrame | None = None, *, power: float | None = None) -> DataFrame:
    """Poisson dissimilarity: log-likelihood ratio of two samples against equal profiles, on power-transformed counts."""
    samples = _samples_of(counts, samples)
    names = sample_names(samples)
    rows = feature_rows(counts, "raw_count", samples, names)
    power = poisson_power(rows, counts, names) if power is None else power
    totals, _ = _margins(counts, names, power)

    def prepare(block, samples):
        x = np.where(block > 0, np.power(np.where(block > 0, block, 1.0), power), 0.0)
        return np.stack([x, np.broadcast_to(totals[samples], x.shape)], axis=-1)

    def kernel(a, b):
        out = np.empty((a.shape[1], b.shape[1]))
        xb, nb = b[..., 0], b[0, :, 1]
        for i in range(a.shape[1]):
            xa, na = a[:, [i], 0], a[0, i, 1]
            both = xa + xb
            value = 0.0
            for x, share in ((xa, na / (na + nb)), (xb, nb / (na + nb))):
                e = both * share
                r = (x + 1) / (e + 1)
                value = value + e - e * r + x * np.log(r)
            out[i] = value.sum(axis=0)
        return out

    pairs = _sum_pairs(rows, len(names), prepare, kernel)
    return _named(pairs.select("a", "b", F.sqrt(F.greatest("value", F.lit(0.0))).alias("distance")), samples, names, "distance")


def leading_logfc_dist(norm: DataFrame, col: str = "log2cpm", samples: DataFrame | None = None, *, top: int = 500) -> DataFrame:
    """Root mean of the ``top`` largest squared differences of each pair. Every task keeps its own ``top``, then they are merged."""
    samples = _samples_of(norm, samples)
    names = sample_names(samples)
    n = len(names)
    rows = feature_rows(norm, col, samples, names)
    width = 64

    def update(state, a, b):
        step = max(1, 4_000_000 // (a.shape[1] * b.shape[1]))
        for lo in range(0, len(a), step):
            diff = (a[lo:lo + step, :, None] - b[lo:lo + step, None, :]) ** 2
            state = diff if state is None else np.concatenate([state, diff])
            if len(state) > top:
                state = np.partition(state, len(state) - top, axis=0)[-top:]
        return state

    parts = pair_states(rows, n, prepare=lambda x, _: x, update=update, emit=lambda s: np.moveaxis(s, 0, -1),
                        schema="values array<double>", width=width, cells_per_pair=2 * top)
    every = parts.select("a", "b", F.explode("values").alias("v"))
    best = every.withColumn("_i", F.row_number().over(W.partitionBy("a", "b").orderBy(F.col("v").desc()))).where(F.col("_i") <= top)
    dist = best.groupBy("a", "b").agg(F.sqrt(F.avg("v")).alias("distance"))
    return _named(dist, samples, names, "distance")
