"""Readers for delimited count matrices and sample sheets, and for the long Parquet form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

LONG_SCHEMA = "feature string, sample string, raw_count bigint"


def read_wide(spark: SparkSession, path: str, *, sep: str = "\t") -> DataFrame:
    """Wide table as written, all columns as text (one header row), ``NA`` as NULL; no inference pass over the data."""
    return spark.read.csv(path, sep=sep, header=True, nullValue="NA")


def read_wide_counts(spark: SparkSession, path: str, *, sep: str = "\t", id_col: str | None = None,
                     drop: Sequence[str] = (), length_col: str | None = None, kind: str = "bigint") -> DataFrame:
    """Long counts from a features × samples file.

    ``id_col`` defaults to the first column; ``drop`` and ``length_col`` name columns that are not samples.
    """
    wide = read_wide(spark, path, sep=sep)
    return melt_wide(wide, id_col=id_col, skip=[*drop, *([length_col] if length_col else [])], kind=kind)


def melt_wide(wide: DataFrame, *, id_col: str | None = None, skip: Sequence[str] = (), kind: str = "bigint") -> DataFrame:
    """``unpivot`` of all sample columns into ``(feature, sample, raw_count)``."""
    id_col = id_col or wide.columns[0]
    names = [c for c in wide.columns if c != id_col and c not in set(skip)]
    cells = wide.select(F.col(f"`{id_col}`").alias("feature"), *[F.col(f"`{c}`").cast(kind) for c in names])
    return cells.unpivot(["feature"], [f"`{c}`" for c in names], "sample", "raw_count")


def split_length_column(wide: DataFrame, *, id_col: str, length_col: str, drop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(counts, features)`` from one wide table that carries the feature length next to the samples."""
    features = wide.select(F.col(f"`{id_col}`").alias("feature"), F.col(f"`{length_col}`").cast("int").alias("length_bp"))
    return melt_wide(wide, id_col=id_col, skip=[length_col, *drop]), features


def read_sample_sheet(spark: SparkSession, path: str, *, sep: str = ",", sample_col: str | None = None) -> DataFrame:
    """Sample sheet with ``sample`` as its key column."""
    sheet = read_wide(spark, path, sep=sep)
    return sheet.withColumnRenamed(sample_col or sheet.columns[0], "sample")


def read_long_counts(spark: SparkSession, path: str, *, schema: str | T.StructType | None = None) -> DataFrame:
    """Native form: Parquet with one row per cell; filters and column choices reach the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)
