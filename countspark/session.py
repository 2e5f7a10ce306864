"""Shared-storage tables and checked broadcasts.

Two rules of the whole library live here:

* anything used by more than one pass is written once to the cluster's shared folder (``keep``), so a lost executor costs a
  re-read and not a recomputation, and the file sizes are known to the optimizer;
* a side is broadcast only after its bytes were measured (``small``); above the bound the same join runs as a shuffle join.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of values up to which a measured table is broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows (a few scalar columns each) up to which a table the driver holds is broadcast.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``; a temporary one only in local mode where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is not None:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="countspark-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext.getCheckpointDir()
    return folder


_BELOW: ContextVar[str | None] = ContextVar("countspark_below", default=None)


def new_path(spark: SparkSession) -> str:
    """A fresh path below the shared folder."""
    return f"{_BELOW.get() or shared_folder(spark).rstrip('/') + '/countspark'}/{uuid.uuid4().hex}"


@contextmanager
def written_tables(spark: SparkSession) -> Iterator[str]:
    """Tables that operators write inside the block go below one folder, which is removed behind it. Save or collect results inside."""
    path = new_path(spark)
    before = _BELOW.set(path)
    try:
        yield path
    finally:
        _BELOW.reset(before)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and return the written table."""
    return keep_measured(df)[0]


def as_written(df: DataFrame) -> DataFrame:
    """``df`` itself when it is a plain scan of files, else ``keep(df)``: stored tables are not copied."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return df if plan.nodeName().startswith("LogicalRelation") or "RelationV2" in plan.nodeName() else keep(df)


def keep_measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``keep`` that also returns the number of rows ``n`` and other aggregates, observed during the write."""
    spark = df.sparkSession
    path = new_path(spark)
    seen = Observation()
    aggs = [F.count(F.lit(1)).alias("n"), *[agg.alias(name) for name, agg in measures.items()]]
    df.observe(seen, *aggs).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a value, roughly: fixed widths, the bytes of texts, and the text form of nested values."""
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 8
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(col.cast("string")), F.lit(0)) + 16
    return F.lit(8)


def small(df: DataFrame, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise a reduced table, measure its bytes during the write, and hint a broadcast only when they are within ``limit``."""
    width = F.lit(16)
    for field in df.schema.fields:
        width = width + _width(field.name, field.dataType)
    table, seen = keep_measured(df, bytes=F.sum(width))
    return F.broadcast(table) if (seen["bytes"] or 0) <= limit else table


def small_local(df: DataFrame, n: int, *, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The same check for a table that is known to have at most ``n`` rows, without writing it."""
    return F.broadcast(df) if n <= limit else df


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Rows the driver holds as a local relation with known size (no Python workers are needed to read it)."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    target = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [()] * len(target)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, target)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=target), schema)


def collect_small(df: DataFrame, *, limit: int | None = None) -> list:
    """Rows of a table with one row per sample, contrast or trend bin; with a ``limit`` it raises instead of truncating above it."""
    if limit is None:
        return df.collect()
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows on the driver side of an operator")
    return rows
