"""Long/wide conversion, zero filling, and assembly of long tables from an experiment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from countspark.functions.rows import explode_dense, feature_rows, sample_names
from countspark.model import Experiment
from countspark.session import small


def melt_counts(wide: DataFrame, id_col: str, samples: Sequence[str], *, value: str = "raw_count") -> DataFrame:
    """Wide → long."""
    return wide.select(F.col(f"`{id_col}`").alias("feature"), *[f"`{s}`" for s in samples]).unpivot(
        ["feature"], [f"`{s}`" for s in samples], "sample", value)


def spread_counts(df: DataFrame, value: str, samples: Sequence, *, fill: float | int | None = None) -> DataFrame:
    """Long → wide with a declared list of samples (no pass to discover them)."""
    wide = df.groupBy("feature").pivot("sample", list(samples)).agg(F.first(value))
    return wide if fill is None else wide.na.fill(fill)


def zero_fill(counts: DataFrame, features: DataFrame | None, samples: DataFrame, *, value: str = "raw_count") -> DataFrame:
    """Every feature × sample cell, absent ones as 0.

    Only the cells that exist are shuffled: they are gathered per feature and the gaps are filled inside the task, so no grid
    is built or joined. ``features`` may add features without any cell.
    """
    names = sample_names(samples)
    rows = feature_rows(counts, value, samples, names, written=False)
    if features is not None:
        rows = features.select("feature").distinct().join(rows, "feature", "left")
    kind = counts.schema[value].dataType
    return explode_dense(rows, samples, names, value).withColumn(value, F.col(value).cast(kind))


def counts_data(exp: Experiment, *, sheet: bool = False, design: bool = False, alignment: bool = False,
                annotations: bool = False) -> DataFrame:
    """Long counts with the requested per-sample and per-feature columns."""
    out = exp.counts
    if sheet:
        out = out.join(small(exp.samples), "sample", "left")
    if design:
        out = out.join(small(wide_design(exp.design)), "sample", "left")
    if alignment:
        out = out.join(small(exp.alignment), "sample", "left")
    if annotations:
        out = out.join(small(exp.features), "feature", "left")
    return out


def wide_design(design: DataFrame) -> DataFrame:
    """One row per sample, one column per coefficient; the design is a table of samples × coefficients and stays small."""
    coefs = sorted(r[0] for r in design.select("coef").distinct().collect())
    return design.groupBy("sample").pivot("coef", coefs).agg(F.first("value"))


def counts_data_norm(exp: Experiment, norm: DataFrame, *, length_col: str | None = None) -> DataFrame:
    """Normalised values next to the raw counts (0 where there is no cell); with a length also ``log2rpkm``."""
    out = norm.join(exp.counts, ["feature", "sample"], "left").withColumn("raw_count", F.coalesce("raw_count", F.lit(0)))
    if length_col:
        lengths = exp.features.select("feature", F.col(length_col).alias("_len"))
        out = (out.join(small(lengths), "feature", "left")
               .withColumn("log2rpkm", F.col("log2cpm") - F.log2(F.col("_len") / 1000)).drop("_len"))
    return out


def counts_replace_zero(df: DataFrame, col: str = "raw_count", zero: float = 0.5,
                        fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Zeros replaced by ``zero`` (for log axes), then an optional DataFrame → DataFrame filter."""
    out = df.withColumn(col, F.when(F.col(col) == 0, F.lit(float(zero))).otherwise(F.col(col).cast("double")))
    return out.transform(fn) if fn else out


def union_transformations(tables: dict[str, DataFrame], value: str = "value") -> DataFrame:
    """Stack differently transformed matrices with a label column."""
    out = None
    for label, df in tables.items():
        part = df.select("feature", "sample", F.col(value).cast("double").alias("value"), F.lit(label).alias("transformation"))
        out = part if out is None else out.unionByName(part)
    return out


def feature_intersect_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every distinct feature of either list with its membership: ``both``, ``left_only`` or ``right_only``.

    Both lists are reduced to distinct ids before they meet, so a repeated id costs nothing in the shuffle.
    """
    left = a.select("feature").distinct().withColumn("_l", F.lit(1))
    right = b.select("feature").distinct().withColumn("_r", F.lit(1))
    where = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_r").isNull(), "left_only")
    return left.join(right, "feature", "full").select("feature", where.otherwise("right_only").alias("membership"))
