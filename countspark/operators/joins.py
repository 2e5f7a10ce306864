"""Annotation joins, result-table joins, range overlaps and sample matching. Keys are always explicit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from countspark.model import Experiment
from countspark.operators.reshape import zero_fill
from countspark.session import keep, small


def merge_props(df: DataFrame, props: DataFrame, *, from_var: str, to_var: str, from_col: str | None = None, to_col: str | None = None) -> DataFrame:
    """Inner join that maps one property table column onto ``df``; names default to those of the table."""
    key = from_col or from_var
    table = props.select(F.col(from_var).alias(key), F.col(to_var).alias(to_col or to_var))
    return df.join(small(table), key)


def first_match(mapping: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order``. An aggregate, so repeated keys are reduced on the map side."""
    rest = [c for c in mapping.columns if c != key]
    lead = [*order, *[c for c in rest if c not in order]]
    return mapping.groupBy(key).agg(F.min(F.struct(*lead)).alias("_m")).select(key, *[F.col("_m")[c].alias(c) for c in rest])


def annotate_features(df: DataFrame, mapping: DataFrame, *, key: str = "feature", col: str, order: Sequence[str]) -> DataFrame:
    """Left join of the first mapped value of each key."""
    table = first_match(mapping.where(F.col(col).isNotNull()), key, order).select(key, col)
    return df.join(small(table), key, "left")


def strip_id_version(counts: DataFrame) -> DataFrame:
    """Drop a trailing ``.<digits>`` from feature ids and add up rows that collide."""
    return (counts.withColumn("feature", F.regexp_replace("feature", r"\.\d+$", ""))
            .groupBy("feature", "sample").agg(F.sum("raw_count").alias("raw_count")))


def rekey_by_annotation(counts: DataFrame, mapping: DataFrame, *, new: str, on_missing: str = "drop", unique: bool = True) -> DataFrame:
    """Use mapped ids as features. Missing ids are dropped or keep the old id; ``unique`` numbers repeats ``x, x.1, x.2 …``.

    Numbering looks at one row per feature, not at the cells; a target id shared by very many features is numbered by a
    distributed scan.
    """
    from countspark.functions.scans import scan

    ids = mapping.where(F.col(new).isNotNull()).select("feature", F.col(new).cast("string").alias("_new"))
    known = counts.select("feature").distinct()
    table = known.join(ids, "feature", "left" if on_missing == "keep" else "inner")
    table = table.withColumn("_new", F.coalesce("_new", F.col("feature").cast("string")))
    if not unique:
        return (counts.join(small(table), "feature").groupBy(F.col("_new").alias("feature"), "sample")
                .agg(F.sum("raw_count").alias("raw_count")))
    numbered = scan(table, ["_new"], [F.col("feature").asc()], number="_i")
    name = F.when(F.col("_i") == 1, F.col("_new")).otherwise(F.concat("_new", F.lit("."), (F.col("_i") - 1).cast("string")))
    return counts.join(small(numbered.select("feature", name.alias("_name"))), "feature").select(F.col("_name").alias("feature"), "sample", "raw_count")


def add_feature_annotations(exp: Experiment, table: DataFrame, *, clean_chromosomes: Sequence[str] | None = None) -> Experiment:
    """Left-join a user table to the experiment's features; chromosome names outside the white list become NULL."""
    base = exp.features if exp.features is not None else exp.counts.select("feature").distinct()
    if clean_chromosomes is not None:
        chrom = F.col("chromosome_name")
        table = table.withColumn("chromosome_name", F.when(chrom.isin(list(clean_chromosomes)), chrom))
    return exp.but(features=base.join(small(table), "feature", "left"))


def choose_id_type(counts: DataFrame, *, pattern: str = "ENSG", min_hits: int = 20, probes: DataFrame | None = None,
                   min_probe_frac: float = 0.2) -> DataFrame:
    """One row: number of ids that contain ``pattern``, overlap with a probe list, and the kind of id that follows."""
    ids = counts.select("feature").distinct()
    hits = ids.agg(F.sum(F.col("feature").cast("string").contains(pattern).cast("bigint")).alias("n_hits"), F.count(F.lit(1)).alias("n_ids"))
    found = F.lit(0).cast("bigint")
    if probes is not None:
        found = ids.join(small(probes.select("feature").distinct()), "feature", "left_semi").agg(F.count(F.lit(1))).scalar()
    kind = F.when(F.col("n_hits") > min_hits, "ensembl").when(F.col("n_probes") > F.col("n_ids") * min_probe_frac, "probe").otherwise("symbol")
    return hits.withColumn("n_probes", found).withColumn("id_type", kind)


def join_de_counts(norm: DataFrame, de: DataFrame, *, average: str | Sequence[str] = "avg_log2cpm", pattern: DataFrame | None = None) -> DataFrame:
    """Values with the distinct averages (and DE pattern) of their feature; averages that differ by contrast give several rows."""
    side = de.select("feature", *([average] if isinstance(average, str) else average)).distinct()
    if pattern is not None:
        side = side.join(pattern.select("feature", "pattern"), "feature", "left")
    return norm.join(small(side), "feature", "left")


def significant_everywhere_tested(de: DataFrame, max_adj: float) -> DataFrame:
    """Features whose smallest adjusted p is within the cut; a feature with any NULL is out."""
    best = de.groupBy("feature").agg(F.min("adj_p").alias("_min"), F.count("adj_p").alias("_k"), F.count(F.lit(1)).alias("_n"))
    return best.where((F.col("_min") <= max_adj) & (F.col("_k") == F.col("_n"))).select("feature")


def semi_significant(norm: DataFrame, de: DataFrame, *, max_adj: float = 0.05) -> DataFrame:
    return norm.join(small(significant_everywhere_tested(de, max_adj)), "feature", "left_semi")


def paired_counts(norm: DataFrame, samples: DataFrame, *, value: str, subject: str, group: str, levels: Sequence[str]) -> DataFrame:
    """Values of both group levels side by side per subject and feature, absent cells as 0.

    Every sample of one level meets every sample of the other of the same subject. The gaps are filled inside the task after the one
    shuffle by feature, which also serves the grouping by feature and subject; a group holds the samples of one subject.
    """
    sheet = small(samples.where(F.col(group).isin(list(levels)) & F.col(subject).isNotNull()).select(
        "sample", F.col(subject).alias("subject"), F.col(group).alias("_level")))
    dense = zero_fill(norm, None, sheet.select("sample"), value=value).join(sheet, "sample")
    of = lambda level: F.sort_array(F.collect_list(F.when(F.col("_level") == level, F.struct(F.col("sample"), F.col(value).alias("v")))))
    both = dense.groupBy("feature", "subject").agg(of(levels[0]).alias("_a"), of(levels[1]).alias("_b"))
    first = both.select("feature", "subject", "_b", F.explode("_a").alias("_x"))
    pairs = first.select("feature", "subject", "_x", F.explode("_b").alias("_y"))
    return pairs.select("feature", "subject", F.col("_x.sample").alias("sample_1"), F.col("_y.sample").alias("sample_2"),
                        F.col("_x.v").alias("value_1"), F.col("_y.v").alias("value_2"))


def de_compare_join(x: DataFrame, y: DataFrame, *, max_rank: int = 30) -> DataFrame:
    """Two result tables side by side, with the class of each row: called and ranked within ``max_rank`` in x, y, both or neither."""
    cols = ("avg_log2fc", "adj_p", "de", "rank")
    side = lambda df, tag: df.select("feature", "contrast", *[F.col(c).alias(f"{c}_{tag}") for c in cols])
    top = lambda tag: F.coalesce((F.col(f"rank_{tag}") <= max_rank) & (F.col(f"de_{tag}") != 0), F.lit(False))
    label = F.when(top("x") & top("y"), "both").when(top("x"), "x").when(top("y"), "y").otherwise("none")
    return side(x, "x").join(side(y, "y"), ["feature", "contrast"]).withColumn("seen_in", label)


def overlap_window(ranges: DataFrame, target: DataFrame, *, pad: int = 1_000_000, bin_size: int = 100_000) -> DataFrame:
    """Ranges that overlap the padded target ranges on the same chromosome, either strand.

    Both sides are cut into (chromosome, bin) keys, joined on them, and the real overlap is checked; a pair is kept only in
    its first common bin, so no distinct is needed. The target side is small, and broadcast when measured so; crowded bins
    are split by the skew handling of the shuffle join otherwise.
    """
    t = target.select(F.col("chrom").alias("chrom"), (F.col("start") - pad).alias("_from"), (F.col("end") + pad).alias("_to"), F.col("feature").alias("target"))
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / bin_size), F.floor(hi / bin_size))).alias("_bin")
    left = ranges.select("*", bins(F.col("start"), F.col("end")))
    right = t.select("*", bins(F.col("_from"), F.col("_to")))
    first = F.floor(F.greatest(F.col("start"), F.col("_from")) / bin_size) == F.col("_bin")
    hit = (F.col("start") <= F.col("_to")) & (F.col("end") >= F.col("_from")) & first
    return left.join(small(right), ["chrom", "_bin"]).where(hit).drop("_bin", "_from", "_to")


def overlap_label(ranges: DataFrame) -> DataFrame:
    """Label by symbol; the feature id where the symbol is missing or not its first occurrence. Flag: adjusted p below 0.1."""
    first = ranges.where(F.col("symbol").isNotNull()).groupBy("symbol").agg(F.min("feature").alias("_first"))
    named = F.col("symbol").isNotNull() & (F.col("feature") == F.col("_first"))
    return (ranges.join(first, "symbol", "left")
            .withColumn("label", F.when(named, F.col("symbol")).otherwise(F.col("feature").cast("string")))
            .withColumn("flag", F.coalesce(F.col("adj_p") < 0.1, F.lit(False))).drop("_first"))


def contrast_sample_match(design: DataFrame, contrasts: DataFrame, *, rule: str = "nonzero") -> DataFrame:
    """``(contrast, sample)`` pairs that matter to a contrast.

    ``nonzero``: samples with a non-zero coefficient that has weight in the contrast. ``index``: only contrasts whose weights
    do not sum to 0; samples are grouped by their values on the other such contrasts, and the groups with the most distinct
    values of the contrast itself are taken.
    """
    joined = design.join(small(contrasts), "coef")
    if rule == "nonzero":
        return joined.where((F.col("value") != 0) & (F.col("weight") != 0)).select("contrast", "sample").distinct()
    if rule != "index":
        raise ValueError(f"unknown rule {rule!r}")
    open_ = small(contrasts.groupBy("contrast").agg(F.round(F.sum("weight"), 9).alias("_w")).where(F.col("_w") != 0).select("contrast"))
    score = joined.join(open_, "contrast", "left_semi").groupBy("contrast", "sample").agg(F.round(F.sum(F.col("value") * F.col("weight")), 9).alias("v"))
    profile = score.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("contrast", "v"))).alias("_all"))
    own = score.join(profile, "sample").withColumn("_rest", F.filter("_all", lambda s: s["contrast"] != F.col("contrast")))
    groups = own.groupBy("contrast", "_rest").agg(F.countDistinct("v").alias("_k"))
    most = groups.groupBy("contrast").agg(F.max("_k").alias("_k"))
    picked = groups.join(most, ["contrast", "_k"]).select("contrast", "_rest")
    return own.join(picked, ["contrast", "_rest"], "left_semi").select("contrast", "sample")
