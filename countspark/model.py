"""Data model: long tables with fixed column names, and the experiment that ties them together.

``counts(feature, sample, raw_count)`` is sparse (an absent cell is 0) and holds each cell once.
``samples(sample, …)`` has one row per sample, ``features(feature, length_bp, …)`` one per feature.
``de(feature, contrast, avg_log2cpm, avg_log2fc, p_value, adj_p, de, rank, …)`` has one row per feature and contrast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F


def as_counts(df: DataFrame, *, feature: str = "feature", sample: str = "sample", count: str = "raw_count") -> DataFrame:
    """Long counts with the library's column names; repeated cells are added up."""
    return (df.groupBy(F.col(feature).alias("feature"), F.col(sample).alias("sample"))
            .agg(F.sum(F.col(count).cast("bigint")).alias("raw_count")))


def as_samples(df: DataFrame, *, sample: str = "sample") -> DataFrame:
    return df.withColumnRenamed(sample, "sample")


@dataclass(frozen=True)
class Experiment:
    """Lazy tables of one experiment. Every operator returns a new object. The object computes nothing; operators that check or write a table run Spark jobs when called."""

    counts: DataFrame
    samples: DataFrame
    features: DataFrame | None = None
    alignment: DataFrame | None = None
    design: DataFrame | None = None
    contrasts: DataFrame | None = None
    subject: str | None = None
    group: str | None = None

    def but(self, **changes) -> "Experiment":
        return replace(self, **changes)
