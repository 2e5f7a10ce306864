"""Feature rows: one row per feature holding its cells of all samples, the input of per-feature numerics.

Rows stay sparse (``idx``, ``x`` arrays) until a batch reaches numpy, where a slice of features becomes a dense
``features × samples`` block of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from countspark.session import collect_small, keep, local_table, small_local

#: Doubles per dense block (8 MB): large enough for vectorised numpy, small enough for its temporaries.
BLOCK_CELLS = 1_000_000


def sample_names(samples: DataFrame) -> list:
    """Sample ids in their declared (ascending) order; this is the column order of every dense block."""
    return sorted(r[0] for r in collect_small(samples.select("sample").distinct()))


def sample_index(samples: DataFrame, names: list) -> DataFrame:
    """``(sample, idx)`` for a list of names, 0-based."""
    spark = samples.sparkSession
    kind = samples.schema["sample"].dataType
    schema = T.StructType([T.StructField("sample", kind, False), T.StructField("idx", T.IntegerType(), False)])
    return small_local(local_table(spark, [(s, i) for i, s in enumerate(names)], schema), len(names))


def feature_rows(cells: DataFrame, value: str, samples: DataFrame, names: list, *, written: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """``(feature, idx array<int>, x array<double>)``. One shuffle by feature; cells of unknown samples are left out.

    ``more`` names further value columns that become arrays of their own, aligned with ``idx``.
    """
    parts = [F.col(value).cast("double").alias("v"), *[F.col(c).cast("double").alias(f"m_{c}") for c in more]]
    pairs = F.sort_array(F.collect_list(F.struct("idx", *parts)))
    rows = (cells.select("feature", "sample", value, *more).join(sample_index(samples, names), "sample")
            .groupBy("feature").agg(pairs.alias("c"))
            .select("feature", F.col("c.idx").alias("idx"), F.col("c.v").alias("x"), *[F.col(f"c.m_{c}").alias(c) for c in more]))
    return keep(rows) if written else rows


def dense_array(n: int, idx: str = "idx", x: str = "x"):
    """Column with the zero-filled vector of length ``n`` of a feature row, built in order without a lookup per cell."""
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(idx, F.greatest(i, F.lit(1))) + 1)
    gap = lambda upto, i: F.array_repeat(F.lit(0.0), upto - start(i))
    body = F.transform(F.col(x), lambda v, i: F.concat(gap(F.element_at(idx, i + 1), i), F.array(v)))
    tail = F.array_repeat(F.lit(0.0), F.lit(n) - start(F.size(x)))
    empty = F.array_repeat(F.lit(0.0), F.lit(n))
    return F.when(F.coalesce(F.size(x), F.lit(0)) > 0, F.concat(F.flatten(body), tail)).otherwise(empty)


def _dense_blocks(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    idx, x = batch.column("idx"), batch.column("x")
    bounds = idx.offsets.to_numpy()
    cols = idx.values.to_numpy(zero_copy_only=False)
    vals = x.values.to_numpy(zero_copy_only=False)
    vbounds = x.offsets.to_numpy()
    step = max(1, BLOCK_CELLS // max(n, 1))
    for lo in range(0, batch.num_rows, step):
        hi = min(lo + step, batch.num_rows)
        block = np.zeros((hi - lo, n))
        where = np.repeat(np.arange(hi - lo), np.diff(bounds[lo:hi + 1]))
        block[where, cols[bounds[lo]:bounds[hi]]] = vals[vbounds[lo]:vbounds[hi]]
        yield lo, hi, block


def _column(values, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind):
        values = np.asarray(values)
        flat = pa.array(values.reshape(-1), type=kind.value_type, from_pandas=True)
        offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
        return pa.ListArray.from_arrays(offsets, flat)
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values
    return pa.array(values, type=kind, from_pandas=pa.types.is_floating(kind))


def map_blocks(rows: DataFrame, n: int, fn: Callable[[np.ndarray, dict], dict], columns: str, *,
               extra: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``fn(block, extras) -> {column: array}`` to dense blocks of features; NaN results become NULL.

    ``columns`` is the DDL of the results, which follow ``feature``. ``extra`` names scalar or list columns handed to ``fn``.
    """
    schema = T.StructType([rows.schema["feature"], *T.StructType.fromDDL(columns).fields])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for lo, hi, block in _dense_blocks(batch, n):
                given = {}
                for name in extra:
                    part = batch.column(name).slice(lo, hi - lo)
                    given[name] = (np.vstack(part.to_numpy(zero_copy_only=False)) if pa.types.is_list(part.type)
                                   else part.to_numpy(zero_copy_only=False))
                out = fn(block, given)
                arrays = [batch.column("feature").slice(lo, hi - lo)]
                arrays += [_column(out[f.name], f.type) for f in list(target)[1:]]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return enough_partitions(rows.select("feature", "idx", "x", *extra)).mapInArrow(run, schema)


def enough_partitions(rows: DataFrame) -> DataFrame:
    """Written rows over at least as many partitions as there are cores; only a table of few files is ever shuffled here."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def fold_partitions(rows: DataFrame, width: int) -> DataFrame:
    """Feature rows in few enough partitions that the n × ``width`` result a task sends is small next to the rows it reads.

    Written rows are only coalesced, never shuffled, and never to fewer partitions than there are cores; the number of rows comes from
    the file footers.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // max(256, width))
    return rows.coalesce(tasks) if tasks < rows.rdd.getNumPartitions() else rows


def explode_dense(rows: DataFrame, samples: DataFrame, names: list, out: str) -> DataFrame:
    """Long form of feature rows with every sample present, absent cells as 0."""
    cells = rows.select("feature", F.posexplode(dense_array(len(names))).alias("idx", out))
    return cells.join(sample_index(samples, names), "idx").select("feature", "sample", out)
