"""Normalisations. All take sparse long counts; the ones whose value of an absent cell is not 0 say so and return dense rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from countspark.functions.rows import explode_dense, feature_rows, sample_names
from countspark.functions.scans import quantiles, rank_table, scan, value_counts
from countspark.session import collect_small, keep, keep_measured, small, small_local


def library_size(counts: DataFrame, *, value: str = "raw_count") -> DataFrame:
    """Column sums; partial sums are combined before the shuffle, so a heavy sample does not matter."""
    return counts.groupBy("sample").agg(F.sum(value).alias("lib_size"))


def lib_norm_factor(counts: DataFrame) -> DataFrame:
    """Mean library size over the sample's own."""
    return _with_mean(library_size(counts)).select("sample", "lib_size", (F.col("_mean") / F.col("lib_size")).alias("norm_factor"))


def _with_mean(lib: DataFrame, col: str = "lib_size") -> DataFrame:
    """Per-sample table (one row per sample, already reduced) with the mean of ``col`` over all samples as ``_mean``."""
    return lib.withColumn("_mean", F.avg(col).over(W.partitionBy()))


def cpm(counts: DataFrame) -> DataFrame:
    lib = small(library_size(counts))
    return counts.join(lib, "sample").select("feature", "sample", (F.col("raw_count") * 1e6 / F.col("lib_size")).alias("cpm"))


def effective_library(counts: DataFrame, samples: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """``(sample, lib_size, _mean)`` for every sample of the sheet, library sizes multiplied by norm factors if given."""
    lib = samples.select("sample").distinct().join(library_size(counts), "sample", "left")
    lib = lib.withColumn("lib_size", F.coalesce("lib_size", F.lit(0)).cast("double"))
    if factors is not None:
        lib = lib.join(factors.select("sample", "norm_factor"), "sample").withColumn("lib_size", F.col("lib_size") * F.col("norm_factor"))
    return small(_with_mean(lib.select("sample", "lib_size")))


def _log2cpm(count, prior: float) -> Column:
    """Needs ``lib_size`` and ``_mean``; the prior is scaled to the library."""
    scaled = F.lit(float(prior)) * F.col("lib_size") / F.col("_mean")
    return F.log2((count + scaled) / (F.col("lib_size") + 2 * scaled) * 1e6)


def log2cpm(counts: DataFrame, samples: DataFrame, factors: DataFrame | None = None, *, prior: float = 2) -> DataFrame:
    """Dense log2 counts per million; absent cells get the value of a zero count."""
    lib = effective_library(counts, samples, factors)
    names = sample_names(samples)
    dense = explode_dense(feature_rows(counts, "raw_count", samples, names, written=False), samples, names, "raw_count")
    return dense.join(lib, "sample").select("feature", "sample", _log2cpm(F.col("raw_count"), prior).alias("log2cpm"))


def log2cpm_mean_and_hits(counts: DataFrame, samples: DataFrame, factors: DataFrame | None, *, prior: float, threshold: float) -> DataFrame:
    """Per feature: mean log2 CPM and number of samples at or above ``threshold``, without building the dense matrix.

    A feature starts from the sum (and hits) of the all-zero feature; each cell that exists adds its difference to that.
    """
    lib = effective_library(counts, samples, factors)
    zero = lib.withColumn("_z", _log2cpm(F.lit(0.0), prior))
    base = zero.agg(F.sum("_z"), F.sum((F.col("_z") >= threshold).cast("int")), F.count(F.lit(1))).first()
    cells = counts.join(zero, "sample").withColumn("_v", _log2cpm(F.col("raw_count"), prior))
    sums = cells.groupBy("feature").agg(
        F.sum(F.col("_v") - F.col("_z")).alias("_d"),
        F.sum((F.col("_v") >= threshold).cast("int") - (F.col("_z") >= threshold).cast("int")).alias("_h"))
    z_sum, z_hits, n = (F.lit(v) for v in base)
    return sums.select("feature", ((z_sum + F.col("_d")) / n).alias("mean_log2cpm"), (z_hits + F.col("_h")).alias("n_hits"),
                       n.alias("n_samples"))


def _with_length(counts: DataFrame, features: DataFrame) -> DataFrame:
    return counts.join(small(features.select("feature", "length_bp")), "feature")


def rpkm(counts: DataFrame, features: DataFrame) -> DataFrame:
    """CPM per kilobase; library sizes of the counts given (after filtering)."""
    lib = small(library_size(counts))
    value = F.col("raw_count") * 1e6 / F.col("lib_size") / (F.col("length_bp") / 1000)
    return _with_length(counts, features).join(lib, "sample").select("feature", "sample", value.alias("rpkm"))


def log2rpkm(norm: DataFrame, features: DataFrame) -> DataFrame:
    """log2 CPM minus log2 of the length in kilobases."""
    return _with_length(norm, features).select("feature", "sample", (F.col("log2cpm") - F.log2(F.col("length_bp") / 1000)).alias("log2rpkm"))


def average_log2rpkm(de: DataFrame, features: DataFrame) -> DataFrame:
    """Result table with ``avg_log2rpkm``: the average log2 CPM minus log2 of the length in kilobases; NULL without a length."""
    lengths = small(features.select("feature", F.col("length_bp").alias("_len")))
    return de.join(lengths, "feature", "left").withColumn("avg_log2rpkm", F.col("avg_log2cpm") - F.log2(F.col("_len") / 1000)).drop("_len")


def _scope_total(df: DataFrame, value: Column | str, scope: str) -> DataFrame:
    """Attach the sum of ``value`` over the sample or over the whole matrix as ``_total``; both sums are combined map-side."""
    value = F.col(value) if isinstance(value, str) else value
    if scope == "sample":
        return df.join(small(df.groupBy("sample").agg(F.sum(value).alias("_total"))), "sample")
    if scope == "matrix":
        return df.withColumn("_total", df.agg(F.sum(value)).scalar())
    raise ValueError(f"scope must be 'sample' or 'matrix', not {scope!r}")


def fpkm(counts: DataFrame, features: DataFrame, *, scope: str = "sample") -> DataFrame:
    """Fragments per kilobase and million; ``scope='matrix'`` sums the total over all samples."""
    cells = _scope_total(_with_length(counts, features), "raw_count", scope)
    value = F.col("raw_count") * 1e9 / (F.col("length_bp").cast("double") * F.col("_total"))
    return cells.select("feature", "sample", value.alias("fpkm"))


def tpm(counts: DataFrame, features: DataFrame, *, scope: str = "sample") -> DataFrame:
    """Transcripts per million: share of the length-scaled counts, without logarithms."""
    rate = F.col("raw_count") / F.col("length_bp")
    cells = _scope_total(_with_length(counts, features), rate, scope)
    return cells.select("feature", "sample", (rate / F.col("_total") * 1e6).alias("tpm"))


def fpkm_to_tpm(values: DataFrame) -> DataFrame:
    return _scope_total(values, "fpkm", "sample").select("feature", "sample", (F.col("fpkm") / F.col("_total") * 1e6).alias("tpm"))


def effective_counts(counts: DataFrame, features: DataFrame, *, mean_fragment: float = 203.7) -> DataFrame:
    """Counts scaled to the effective length (length − mean fragment + 1)."""
    effective = F.col("length_bp") - F.lit(mean_fragment) + 1
    return _with_length(counts, features).select("feature", "sample", (F.col("raw_count") * F.col("length_bp") / effective).alias("effective_count"))


def fraction_log10(counts: DataFrame, samples: DataFrame, *, pseudo: float = 0.1) -> DataFrame:
    """Dense log10 share of the sample after adding ``pseudo`` to every cell; the total needs no zero-filling."""
    names = sample_names(samples)
    rows = feature_rows(counts, "raw_count", samples, names)
    n_features = rows.count()
    lib = small(samples.select("sample").distinct().join(library_size(counts), "sample", "left")
                .select("sample", (F.coalesce("lib_size", F.lit(0)) + pseudo * n_features).alias("_total")))
    dense = explode_dense(rows, samples, names, "raw_count")
    return dense.join(lib, "sample").select("feature", "sample", F.log10((F.col("raw_count") + pseudo) / F.col("_total")).alias("fraction"))


def size_factors(counts: DataFrame, n_samples: int, *, positive: bool = False) -> DataFrame:
    """Median ratio to the geometric mean over features that are positive in every sample.

    With ``positive`` the geometric means run over the positive counts (their logarithms over all samples), for tables in which no feature is positive
    everywhere; without it such a table is an error.
    """
    logs = counts.where("raw_count > 0").groupBy("feature").agg(F.count(F.lit(1)).alias("_k"), F.sum(F.ln("raw_count")).alias("_sum"))
    logs = logs if positive else logs.where(F.col("_k") == n_samples)
    table, seen = keep_measured(logs.select("feature", (F.col("_sum") / n_samples).alias("_geo")))
    if seen["n"] == 0:
        raise ValueError("no feature is positive in all samples; size_factors(positive=True) works with positive counts only")
    ratios = counts.where("raw_count > 0").join(small_local(table, seen["n"]), "feature").select("sample", (F.ln("raw_count") - F.col("_geo")).alias("_ratio"))
    return quantiles(ratios, ["sample"], "_ratio", {"_median": 0.5}).select("sample", F.exp("_median").alias("size_factor"))


def normalized_counts(counts: DataFrame, factors: DataFrame, *, transform: str | None = None) -> DataFrame:
    """Counts over size factors, optionally ``log2p1`` or ``log2`` (−∞ at zero); cells that do not exist stay absent."""
    x = F.col("raw_count") / F.col("size_factor")
    if transform == "log2p1":
        x = F.log2(x + 1)
    elif transform == "log2":
        x = F.when(F.col("raw_count") == 0, F.lit(float("-inf"))).otherwise(F.log2(x))
    elif transform is not None:
        raise ValueError(f"unknown transform {transform!r}")
    return counts.join(small(factors), "sample").select("feature", "sample", x.alias("norm_count"))


def fpkm_robust(counts: DataFrame, features: DataFrame, n_samples: int) -> DataFrame:
    """FPKM with size factor × geometric mean of the library sizes in place of the library size."""
    lib = small(library_size(counts))
    geo = lib.agg(F.exp(F.avg(F.ln("lib_size")))).scalar()
    scale = small(size_factors(counts, n_samples).select("sample", (F.col("size_factor") * geo).alias("_lib")))
    value = F.col("raw_count") * 1e9 / (F.col("length_bp") * F.col("_lib"))
    return _with_length(counts, features).join(scale, "sample").select("feature", "sample", value.alias("fpkm"))


def sample_totals(counts: DataFrame) -> DataFrame:
    """Measured per-sample table ``(sample, lib_size, n_cells)``."""
    return small(counts.groupBy("sample").agg(F.sum("raw_count").alias("lib_size"), F.count(F.lit(1)).alias("n_cells")))


def upper_quartile_scale(counts: DataFrame, n_features: int, totals: DataFrame, *, p: float = 0.75) -> DataFrame:
    """Exact quantile of each sample's counts over ``n_features`` features, absent cells as zeros."""
    zeros = totals.select("sample", F.lit(0).cast("bigint").alias("raw_count"), (F.lit(n_features) - F.col("n_cells")).alias("_times"))
    weighted = value_counts(counts, ["sample"], "raw_count").unionByName(zeros)
    return quantiles(weighted, ["sample"], "raw_count", {"upper": p}, weight="_times")


def upper_quartile_norm(counts: DataFrame, *, p: float = 0.75) -> DataFrame:
    """Between-sample scaling by the upper quartile over the features present in the table: value / quartile × mean quartile."""
    n_features = counts.select("feature").distinct().count()
    scale = _with_mean(upper_quartile_scale(counts, n_features, sample_totals(counts), p=p), "upper")
    value = F.try_divide(F.col("raw_count") * F.col("_mean"), F.col("upper"))
    return counts.join(small(scale), "sample").select("feature", "sample", value.alias("norm_count"))


def tmm_reference(counts: DataFrame, n_features: int, totals: DataFrame) -> Row:
    """The sample whose upper quartile over library size is nearest the mean (first in order on ties), with its totals."""
    upper = upper_quartile_scale(counts, n_features, totals)
    rows = collect_small(upper.join(totals, "sample").orderBy("sample"))
    share = [r["upper"] / r["lib_size"] for r in rows]
    mean = sum(share) / len(share)
    return min(zip(share, rows), key=lambda pair: (round(abs(pair[0] - mean), 14), pair[1]["sample"]))[1]


def _ranks_in_pieces(df: DataFrame, value: str, out: str, size: str) -> DataFrame:
    """Average rank of ``value`` within each sample. Range partitions by (sample, value) keep equal values together, so the ranks are
    made inside the pieces and nothing is joined back on values."""
    numbered = scan(df, ["sample"], [F.col(value).asc()], number="_n", size=size)
    ties = W.partitionBy("sample", value)
    return numbered.withColumn(out, F.avg("_n").over(ties)).drop("_n")


def tmm_factors(counts: DataFrame, *, trim_m: float = 0.3, trim_a: float = 0.05) -> DataFrame:
    """Trimmed mean of M-values against one reference sample, scaled to a geometric mean of 1.

    M and A are ranked with the distributed average ranks, so a sample never has to fit into one task.
    """
    totals = sample_totals(counts)
    n_features = counts.select("feature").distinct().count()
    ref = tmm_reference(counts, n_features, totals)
    cells = counts.where("raw_count > 0")
    ref_cells = small_local(cells.where(F.col("sample") == ref["sample"]).select("feature", F.col("raw_count").alias("_r")), ref["n_cells"])
    lib, ref_lib = F.col("lib_size"), F.lit(ref["lib_size"])
    rate, ref_rate = F.col("raw_count") / lib, F.col("_r") / ref_lib
    pairs = keep(cells.join(ref_cells, "feature").join(totals, "sample").select(
        "feature", "sample",
        F.round(F.log2(rate / ref_rate), 10).alias("_m"),
        F.round((F.log2(rate) + F.log2(ref_rate)) / 2, 10).alias("_a"),
        ((lib - F.col("raw_count")) / (lib * F.col("raw_count").cast("double")) + (ref_lib - F.col("_r")) / (ref_lib * F.col("_r").cast("double"))).alias("_v")))
    ranked = _ranks_in_pieces(pairs, "_m", "_rm", "_k")
    ranked = _ranks_in_pieces(ranked, "_a", "_ra", "_ka")
    low_m, low_a = F.floor(F.col("_k") * trim_m) + 1, F.floor(F.col("_k") * trim_a) + 1
    inside = F.col("_rm").between(low_m, F.col("_k") + 1 - low_m) & F.col("_ra").between(low_a, F.col("_k") + 1 - low_a)
    raw = ranked.where(inside).groupBy("sample").agg((F.sum(F.col("_m") / F.col("_v")) / F.sum(1 / F.col("_v"))).alias("_log2f"))
    raw = totals.select("sample").join(raw, "sample", "left").select("sample", F.coalesce("_log2f", F.lit(0.0)).alias("_log2f"))
    return _with_mean(raw, "_log2f").select("sample", F.pow(F.lit(2.0), F.col("_log2f") - F.col("_mean")).alias("norm_factor"))


def quantile_norm(counts: DataFrame, samples: DataFrame, *, value: str = "raw_count") -> DataFrame:
    """Dense quantile normalisation: the mean over samples at each rank; tied cells get the mean of their ranks' values.

    Ranks come from distinct values with multiplicities. The mean at rank r is a step function of r that only changes where
    some sample's value changes, so it is built from those change points instead of from all cells.
    """
    names = sample_names(samples)
    n = counts.select("feature").distinct().count()
    present = samples.select("sample").distinct().join(counts.groupBy("sample").agg(F.count(F.lit(1)).alias("_k")), "sample", "left")
    kind = counts.schema[value].dataType
    zeros = small(present.select("sample", F.lit(0).cast(kind).alias(value), (F.lit(n) - F.coalesce("_k", F.lit(0))).alias("_times")))
    ranks = keep(rank_table(counts, ["sample"], value, "_rank", extra=zeros)
                 .withColumn("_last", (F.col("_rank") + (F.col("_times") - 1) / 2).cast("bigint"))
                 .withColumn("_first", F.col("_last") - F.col("_times") + 1))
    # value at rank r, summed over samples = running sum of the jumps that happen at or before r
    jumps = ranks.select(F.col("_first").alias("_r"), F.col(value).cast("double").alias("_up")).unionByName(
        ranks.where(F.col("_last") < n).select((F.col("_last") + 1).alias("_r"), (-F.col(value).cast("double")).alias("_up")))
    steps = scan(jumps.groupBy("_r").agg(F.sum("_up").alias("_up")), [], [F.col("_r").asc()], sums={"_level": "_up"}, number="_i")
    # integral of the step function, so that the mean over the ranks first..last is one difference
    spans = next_step(keep(steps), n).withColumn("_area", F.col("_level") * (F.col("_next") - F.col("_r")))
    area = small(scan(spans, [], [F.col("_r").asc()], sums={"_upto": "_area"}))
    first = ranks.join(area.select(F.col("_r").alias("_first"), (F.col("_upto") - F.col("_area")).alias("_from")), "_first")
    last = area.select((F.col("_next") - 1).alias("_last"), F.col("_upto").alias("_to"))
    means = keep(first.join(last, "_last").select("sample", value, ((F.col("_to") - F.col("_from")) / F.col("_times") / len(names)).alias("_mean")))
    # cells carry the difference from an absent cell, so that the join meets only cells that exist
    absent = small(present.select("sample").join(means.where(F.col(value) == 0), "sample", "left").select("sample", F.coalesce("_mean", F.lit(0.0)).alias("_zero")))
    shifted = means.join(absent, "sample").select("sample", value, (F.col("_mean") - F.col("_zero")).alias("_shift"))
    cells = counts.join(small(shifted), ["sample", value]).select("feature", "sample", "_shift")
    dense = explode_dense(feature_rows(cells, "_shift", samples, names, written=False), samples, names, "_shift")
    return dense.join(absent, "sample").select("feature", "sample", (F.col("_shift") + F.col("_zero")).alias("quantile_norm"))


def next_step(steps: DataFrame, n: int) -> DataFrame:
    """Each numbered step with the rank where the next one begins; the one after the last rank is ``n + 1``."""
    following = steps.select((F.col("_i") - 1).alias("_i"), F.col("_r").alias("_next"))
    return steps.join(following, "_i", "left").withColumn("_next", F.coalesce("_next", F.lit(n + 1))).drop("_i")


def row_moments(norm: DataFrame, value: str, n_samples: int) -> DataFrame:
    """Mean and sample standard deviation per feature, absent cells as 0, from Σ and centred squares in one aggregate."""
    n = F.lit(n_samples)
    k, m, v = F.count(value), F.avg(value), F.coalesce(F.var_pop(value), F.lit(0.0))
    mean = k * m / n
    ss = k * v + k * F.pow(m - mean, 2) + (n - k) * F.pow(mean, 2)
    return norm.groupBy("feature").agg(mean.alias("mean"), F.sqrt(ss / (n - 1)).alias("sd"), (ss / (n - 1)).alias("variance"))


def center_rows(norm: DataFrame, value: str) -> DataFrame:
    """Dense input: value minus the mean of its feature."""
    means = norm.groupBy("feature").agg(F.avg(value).alias("_mean"))
    return norm.join(small(means), "feature").select("feature", "sample", (F.col(value) - F.col("_mean")).alias("centered"))


def zscore_rows(norm: DataFrame, value: str) -> DataFrame:
    """Dense input: (value − mean) / sd of its feature; NULL where the sd is 0."""
    stats = norm.groupBy("feature").agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    z = F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))
    return norm.join(small(stats), "feature").select("feature", "sample", z.alias("z"))


row_center_scale = zscore_rows


def vst_column(x: Column, alpha: float) -> Column:
    """Variance stabilisation of a size-factor-scaled count under one dispersion."""
    a = F.lit(float(alpha))
    return (2 * F.asinh(F.sqrt(a * x)) - F.ln(a) - F.ln(F.lit(4.0))) / F.ln(F.lit(2.0))


def vst_parametric_column(q: Column, a0: float, a1: float) -> Column:
    """Variance stabilisation under the trend a0 + a1/q."""
    a0, a1 = F.lit(float(a0)), F.lit(float(a1))
    root = F.sqrt(a0 * q * (1 + a1 + a0 * q))
    return F.log2((1 + a1 + 2 * a0 * q + 2 * root) / (4 * a0))


def vst(counts: DataFrame, samples: DataFrame, *, alpha: float | None = None, trend: tuple[float, float] | None = None) -> DataFrame:
    """Dense variance-stabilised values. Without a dispersion the moment estimate of the data is used."""
    names = sample_names(samples)
    factors = small(size_factors(counts, len(names)))
    rows = feature_rows(counts, "raw_count", samples, names)
    if alpha is None and trend is None:
        from countspark.operators.negbin import moment_dispersion

        alpha = moment_dispersion(counts, factors, len(names))
    q = F.col("raw_count") / F.col("size_factor")
    value = vst_parametric_column(q, *trend) if trend else vst_column(q, alpha)
    return explode_dense(rows, samples, names, "raw_count").join(factors, "sample").select("feature", "sample", value.alias("vst"))
