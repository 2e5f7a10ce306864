"""Selection of features and samples, low-count filters, and row classes of result tables.

The filters first reduce the cells to one row per feature (combined on the map side) and then semi-join; the reduced list is
broadcast when its measured size allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from countspark.model import Experiment
from countspark.operators.normalize import library_size, log2cpm_mean_and_hits
from countspark.session import local_table, small


def keep_features(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(small(ids.select("feature")), "feature", "left_semi")


def _ids(df: DataFrame, values: Iterable, col: str) -> DataFrame:
    """Explicit ids as a one-column table of the right type."""
    return local_table(df.sparkSession, [(v,) for v in values], f"{col} {df.schema[col].dataType.simpleString()}").distinct()


def select_feature_list(df: DataFrame, ids: Iterable | DataFrame) -> DataFrame:
    """Rows of the listed features."""
    table = ids if isinstance(ids, DataFrame) else _ids(df, ids, "feature")
    return keep_features(df, table.select("feature").distinct())


def select_features(exp: Experiment, features: DataFrame, *, remove: bool = False) -> Experiment:
    """Keep (or remove) features; the reads that go away move from ``on_feature`` to ``on_removed_features``."""
    ids = small(features.select("feature").distinct())
    kept = exp.counts.join(ids, "feature", "left_anti" if remove else "left_semi")
    lost = exp.counts.join(ids, "feature", "left_semi" if remove else "left_anti")
    alignment = exp.alignment
    if alignment is not None:
        gone = lost.groupBy("sample").agg(F.sum("raw_count").alias("_lost"))
        before = F.col("on_removed_features") if "on_removed_features" in alignment.columns else F.lit(0)
        moved = F.coalesce("_lost", F.lit(0))
        alignment = (alignment.join(small(gone), "sample", "left")
                     .withColumn("on_feature", F.col("on_feature") - moved)
                     .withColumn("on_removed_features", F.coalesce(before, F.lit(0)) + moved).drop("_lost"))
    return exp.but(counts=kept, alignment=alignment)


def filter_features_by_annotation(exp: Experiment, predicate: Callable[[DataFrame], DataFrame]) -> Experiment:
    """``predicate`` filters counts joined to annotations (DataFrame → DataFrame); features it keeps stay."""
    joined = exp.counts.join(small(exp.features), "feature", "left")
    chosen = predicate(joined).select("feature").distinct()
    return exp.but(counts=keep_features(exp.counts, chosen))


def select_samples(exp: Experiment, predicate: Column | Callable[[DataFrame], DataFrame]) -> Experiment:
    """Filter the sheet, then every per-sample table."""
    sheet = predicate(exp.samples) if callable(predicate) and not isinstance(predicate, Column) else exp.samples.where(predicate)
    ids = small(sheet.select("sample").distinct())
    semi = lambda df: None if df is None else df.join(ids, "sample", "left_semi")
    return exp.but(counts=semi(exp.counts), samples=sheet, alignment=semi(exp.alignment), design=semi(exp.design))


def drop_samples(exp: Experiment, ids: Iterable) -> Experiment:
    """Remove named samples from every per-sample table."""
    names = small(_ids(exp.counts, ids, "sample"))
    anti = lambda df: None if df is None else df.join(names, "sample", "left_anti")
    return exp.but(counts=anti(exp.counts), samples=anti(exp.samples), alignment=anti(exp.alignment), design=anti(exp.design))


def filter_min_cpm(counts: DataFrame, *, min_cpm: float = 2, min_samples: int = 3) -> DataFrame:
    """Features with CPM above ``min_cpm`` in at least ``min_samples`` samples; library sizes of the unfiltered counts."""
    lib = small(library_size(counts))
    above = (F.col("raw_count") * 1e6 / F.col("lib_size") > min_cpm).cast("int")
    hits = counts.join(lib, "sample").groupBy("feature").agg(F.sum(above).alias("_k")).where(F.col("_k") >= min_samples)
    return keep_features(counts, hits)


def filter_min_total(counts: DataFrame, *, min_total: float = 10, strict: bool = False, absolute: bool = False) -> DataFrame:
    """Features whose total reaches ``min_total`` (``strict``: exceeds it)."""
    cell = F.abs("raw_count") if absolute else F.col("raw_count")
    total = counts.groupBy("feature").agg(F.sum(cell).alias("_t"))
    return keep_features(counts, total.where(F.col("_t") > min_total if strict else F.col("_t") >= min_total))


def filter_min_mean_log2cpm(counts: DataFrame, samples: DataFrame, factors: DataFrame | None = None, *, min_mean: float = 2,
                            prior: float = 2) -> DataFrame:
    """Features with a mean log2 CPM of at least ``min_mean``; absent cells enter with their closed-form value."""
    stats = log2cpm_mean_and_hits(counts, samples, factors, prior=prior, threshold=0.0)
    return keep_features(counts, stats.where(F.col("mean_log2cpm") >= min_mean))


def filter_min_occ_log2cpm(counts: DataFrame, samples: DataFrame, factors: DataFrame | None = None, *, min_frac: float = 0.25,
                           min_log2cpm: float = 2, prior: float = 2) -> DataFrame:
    """Features with log2 CPM of at least ``min_log2cpm`` in at least ``min_frac`` of the samples."""
    stats = log2cpm_mean_and_hits(counts, samples, factors, prior=prior, threshold=min_log2cpm)
    return keep_features(counts, stats.where(F.col("n_hits") >= F.col("n_samples") * min_frac))


def filter_min_mean(norm: DataFrame, value: str, n_samples: int, *, gt: float = 1) -> DataFrame:
    """Features whose mean over all samples exceeds ``gt``; absent cells count as 0."""
    mean = norm.groupBy("feature").agg((F.sum(value) / n_samples).alias("_m"))
    return keep_features(norm, mean.where(F.col("_m") > gt))


def filter_count_occurrence(counts: DataFrame, *, gt: int = 5, min_samples: int = 2) -> DataFrame:
    """Features with a count above ``gt`` in at least ``min_samples`` samples."""
    hits = counts.groupBy("feature").agg(F.sum((F.col("raw_count") > gt).cast("int")).alias("_k"))
    return keep_features(counts, hits.where(F.col("_k") >= min_samples))


def significant_genes(de: DataFrame, *, max_adj: float = 0.05, min_abs_lfc: float = 1.0) -> DataFrame:
    """Significant rows with their linear fold change."""
    return (de.where((F.col("adj_p") < max_adj) & (F.abs("avg_log2fc") > min_abs_lfc))
            .withColumn("fold_change", F.pow(F.lit(2.0), F.col("avg_log2fc"))))


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(cols) if cols else None)


def _point_class(max_labels: int) -> Column:
    called = F.coalesce(F.col("de") != 0, F.lit(False))
    return F.when(~called, "n.s.").when(F.col("rank") <= max_labels, "labelled").otherwise("DE")


def volcano_data(de: DataFrame, *, max_labels: int = 50) -> DataFrame:
    """−log10 adjusted p against fold change with the class of each point; an adjusted p of 0 becomes +∞."""
    p = F.col("adj_p")
    y = F.when(p == 0, F.lit(float("inf"))).when(p > 0, -F.log10(p))
    return de.select("feature", "contrast", "avg_log2fc", y.alias("neg_log10_adj_p"), _point_class(max_labels).alias("point_class"))


def ma_data(de: DataFrame, *, max_labels: int = 50, select: str | None = None) -> DataFrame:
    """Mean against fold change with the class of each point; confidence limits and a boolean ``select`` column if present."""
    cols = [c for c in ("ci_l", "ci_r") if c in de.columns]
    out = de.select("feature", "contrast", "avg_log2cpm", "avg_log2fc", *cols, *([select] if select else []),
                    _point_class(max_labels).alias("point_class"))
    return out.withColumn("selected", F.coalesce(F.col(select), F.lit(False))).drop(select) if select else out


def add_logical_annotation(annotations: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """Boolean column: is the feature in the list?"""
    marked = small(ids.select("feature").distinct().withColumn("_in", F.lit(True)))
    return annotations.join(marked, "feature", "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")
