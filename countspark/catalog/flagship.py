"""The flagship query: low-count filter → TPM → most variable features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from countspark.catalog import inputs as fx
from countspark.operators import detable, filters, normalize as nz


def top_variable_tpm(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    counts = fx.counts(spark, sf_dir)
    kept = filters.filter_min_cpm(counts, min_cpm=2, min_samples=3)
    values = nz.tpm(kept, fx.features(spark, sf_dir))
    return detable.top_variable_features(nz.row_moments(values, "tpm", fx.samples(spark, sf_dir).count()), k)
