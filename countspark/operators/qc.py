"""Aggregations and quality summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from countspark.functions.scans import quantiles, scan, value_counts
from countspark.model import Experiment
from countspark.operators.normalize import library_size
from countspark.operators.reshape import zero_fill
from countspark.session import collect_small, keep, small

PSEUDO = "__"


def _is_pseudo(prefix: str = PSEUDO):
    return F.col("feature").startswith(prefix)


def alignment_summary(counts: DataFrame, samples: DataFrame | None = None, *, prefix: str = PSEUDO) -> DataFrame:
    """One row per sample: all reads, reads on features, and one column per pseudo row (name without prefix)."""
    names = [r[0] for r in collect_small(counts.where(_is_pseudo(prefix)).select("feature").distinct().orderBy("feature"))]
    cols = [F.sum(F.when(F.col("feature") == n, F.col("raw_count"))).alias(n[len(prefix):]) for n in names]
    out = counts.groupBy("sample").agg(
        F.sum("raw_count").alias("total_count"),
        F.sum(F.when(~_is_pseudo(prefix), F.col("raw_count")).otherwise(0)).alias("on_feature"), *cols)
    return out if samples is None else samples.select("sample").distinct().join(small(out), "sample", "left")


def alignment_summary_long(alignment: DataFrame, samples: DataFrame, *, fractions: bool = False) -> DataFrame:
    """Read groups as rows, joined to the sheet; ``fractions`` adds the share of the sample's listed reads."""
    groups = [c for c in alignment.columns if c not in ("sample", "total_count")]
    table = small(alignment.select("sample", "total_count", *[F.col(g).cast("bigint").alias(g) for g in groups]))
    long = table.unpivot(["sample", "total_count"], groups, "read_group", "read_count").join(small(samples), "sample", "left")
    if not fractions:
        return long
    whole = F.sum("read_count").over(W.partitionBy("sample"))  # one row per read group: a handful per sample
    return long.withColumn("fraction", F.try_divide(F.col("read_count"), whole))


def validate_sample_match(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples of the sheet that have no counts."""
    return samples.select("sample").distinct().join(small(counts.select("sample").distinct()), "sample", "left_anti")


def validate_empty_level(samples: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cells of the sheet whose level is empty or blank."""
    long = samples.select("sample", *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(["sample"], list(cols), "variable", "level")
    return long.where(F.trim("level") == "").select("sample", "variable")


def validate_duplicate_features(counts: DataFrame) -> DataFrame:
    """Cells that occur more than once."""
    return counts.groupBy("feature", "sample").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def experiment_from_counts(counts: DataFrame, samples: DataFrame | None = None, *, pseudo_prefix: str = PSEUDO,
                           min_abs_sum: int = 1, merge_by: Sequence[str] | None = None, **tables) -> Experiment:
    """Check the sheet, merge replicates if asked, split pseudo rows off into the alignment summary, drop empty features."""
    if samples is None:
        samples = counts.select("sample").distinct()
    if merge_by:
        counts, samples = merge_technical_replicates(counts, samples, merge_by)
    samples = keep(samples)
    missing = [r[0] for r in validate_sample_match(counts, samples).collect()]
    if missing:
        raise ValueError(f"sample sheet names {len(missing)} samples without counts: {missing}")
    counts = counts.join(small(samples.select("sample").distinct()), "sample", "left_semi").select("feature", "sample", "raw_count")
    alignment = keep(alignment_summary(counts, samples, prefix=pseudo_prefix))
    real = counts.where(~_is_pseudo(pseudo_prefix))
    full = real.groupBy("feature").agg(F.sum(F.abs("raw_count")).alias("_t")).where(F.col("_t") > min_abs_sum).select("feature")
    return Experiment(counts=real.join(small(full), "feature", "left_semi"), samples=samples, alignment=alignment, **tables)


def merge_technical_replicates(counts: DataFrame, samples: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Sum the samples that share all ``by`` variables; the new name is the pasted values without spaces."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in by]
    names = samples.select(F.col("sample").alias("_old"), F.regexp_replace(F.concat_ws(".", *parts), " ", "").alias("sample"), *by)
    merged = (counts.withColumnRenamed("sample", "_old").join(small(names.select("_old", "sample")), "_old")
              .groupBy("feature", "sample").agg(F.sum("raw_count").alias("raw_count")))
    return merged, names.drop("_old").distinct()


def tag_counts_summary(counts: DataFrame, samples: DataFrame, n_features: int) -> DataFrame:
    """Per sample: min, median, max, sum, number of missing and of zero cells; absent cells are zeros."""
    stats = counts.groupBy("sample").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("raw_count").alias("_min"), F.max("raw_count").alias("_max"), F.sum("raw_count").alias("sum"),
        F.sum(F.col("raw_count").isNull().cast("bigint")).alias("n_na"), F.sum((F.col("raw_count") == 0).cast("bigint")).alias("_zero"))
    stats = small(samples.select("sample").distinct().join(stats, "sample", "left").na.fill(0, ["_rows", "sum", "n_na", "_zero"]))
    absent = F.lit(n_features) - F.col("_rows")
    zeros = stats.select("sample", F.lit(0).cast("bigint").alias("raw_count"), absent.alias("_times"))
    median = small(quantiles(value_counts(counts, ["sample"], "raw_count").unionByName(zeros), ["sample"], "raw_count", {"median": 0.5}, weight="_times"))
    zero_if_absent = lambda c: F.when(absent > 0, F.lit(0).cast("bigint"))
    return stats.join(median, "sample", "left").select(
        "sample", F.least("_min", zero_if_absent("_min")).alias("min"), "median", F.greatest("_max", zero_if_absent("_max")).alias("max"),
        "sum", "n_na", (F.col("_zero") + absent).alias("n_zero"))


def counts_box_data(counts: DataFrame, samples: DataFrame, n_features: int) -> DataFrame:
    """Count summary of each sample with its covariates."""
    return tag_counts_summary(counts, samples, n_features).join(small(samples), "sample", "left")


def counts_dim(counts: DataFrame) -> DataFrame:
    """Number of samples and features; each list is made distinct before it is counted."""
    return counts.agg(F.countDistinct("sample").alias("n_samples"), F.countDistinct("feature").alias("n_features"))


def features_per_chromosome(features: DataFrame) -> DataFrame:
    return features.groupBy("chromosome_name").agg(F.count(F.lit(1)).alias("n_features"))


def group_levels(samples: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct levels of every covariate with their sizes; only covariates with more than one level are usable as groups."""
    cols = list(cols or [c for c in samples.columns if c != "sample"])
    long = samples.select("sample", *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(["sample"], cols, "variable", "level")
    levels = long.groupBy("variable", "level").agg(F.count(F.lit(1)).alias("n_samples"))
    n = F.count(F.lit(1)).over(W.partitionBy("variable"))  # one row per level
    return levels.withColumn("usable", n > 1)


def default_covariate(samples: DataFrame, n: int = 1, *, terms: Sequence[str] | None = None) -> str | None:
    """Name of the default grouping: the ``n``-th formula term that is a covariate, else the ``n``-th covariate with more than one level."""
    covariates = [c for c in samples.columns if c != "sample"]
    if terms is not None:
        names = [t for t in terms if t in covariates]
    else:
        levels = samples.agg(*[F.countDistinct(c).alias(c) for c in covariates]).first() if covariates else {}
        names = [c for c in covariates if levels[c] > 1]
    return names[n - 1] if n <= len(names) else None


def refflat_annotation(refflat: DataFrame, features: DataFrame) -> DataFrame:
    """Per feature: mean exon count and length, outer bounds; of several loci the first by (chr, strand) is taken."""
    loci = refflat.groupBy("gene", "chr", "strand").agg(
        F.avg("exons_num").alias("mean_exons_num"), F.avg("sum_exon_lengths").alias("mean_sum_exons_lengths"),
        F.min("gene_start").alias("gene_start"), F.max("gene_end").alias("gene_end"))
    cols = [c for c in loci.columns if c != "gene"]
    first = loci.groupBy("gene").agg(F.min(F.struct(*cols)).alias("l")).select(F.col("gene").alias("feature"), "l.*")
    return features.select("feature").distinct().join(first, "feature", "left")


def gtf_transcript_summary(gtf: DataFrame, *, chromosomes: Sequence[str] | None = None) -> DataFrame:
    """Exons → transcripts: bounds, number of exons and summed exon length. Ids come from the attribute text."""
    def attribute(name):
        return F.regexp_extract("attributes", rf'{name} "([^"]*)"', 1)

    exons = gtf.where(F.col("type") == "exon")
    if chromosomes is not None:
        exons = exons.where(F.col("seqname").isin(list(chromosomes)))
    exons = exons.select(attribute("gene_id").alias("gene_id"), attribute("transcript_id").alias("transcript_id"), "seqname", "strand", "start", "end")
    return exons.groupBy("gene_id", "transcript_id", "seqname", "strand").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_exons"),
        F.sum(F.col("end") - F.col("start") + 1).alias("sum_exon_lengths"))


def predicted_sex(counts: DataFrame, samples: DataFrame, features: DataFrame, *, y: Sequence[str] = ("Y", "chrY"),
                  exclude: Sequence[str] = ("MT", "chrMT"), min_median: float = 10) -> DataFrame:
    """Sex per sample from the 5 % quantile of the other chromosomes and the median of Y; NULL where coverage is too low.

    Every chromosome that is neither Y nor excluded counts as "other" (X included), as in the method this follows.
    """
    chrom = F.col("chromosome_name")
    kind = F.when(chrom.isin(list(y)), "y").when(chrom.isNotNull() & ~chrom.isin(list(exclude)), "other")
    kinds = features.select("feature", kind.alias("_kind")).where("_kind IS NOT NULL")
    present = keep(counts.select("feature").distinct().join(small(kinds), "feature"))
    sizes = {r["_kind"]: r["n"] for r in present.groupBy("_kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = keep(value_counts(counts.join(small(present), "feature"), ["sample", "_kind"], "raw_count"))
    size = F.when(F.col("_kind") == "y", F.lit(sizes.get("y", 0))).otherwise(F.lit(sizes.get("other", 0)))
    grid = samples.select("sample").distinct().select("sample", F.explode(F.array(F.lit("y"), F.lit("other"))).alias("_kind"))
    seen = cells.groupBy("sample", "_kind").agg(F.sum("_times").alias("_n"))
    zeros = small(grid.join(seen, ["sample", "_kind"], "left").select(
        "sample", "_kind", F.lit(0).cast("bigint").alias("raw_count"), (size - F.coalesce("_n", F.lit(0))).cast("bigint").alias("_times")))
    q = quantiles(cells.unionByName(zeros), ["sample", "_kind"], "raw_count", {"q05": 0.05, "q50": 0.5}, weight="_times")
    per = q.groupBy("sample").agg(F.max(F.when(F.col("_kind") == "other", F.col("q05"))).alias("other_q05"),
                                  F.max(F.when(F.col("_kind") == "y", F.col("q50"))).alias("y_median"))
    sex = F.when(F.col("other_q05") >= min_median, F.when(F.col("y_median") < min_median, "female").when(F.col("y_median") >= min_median, "male"))
    return per.withColumn("predicted_sex", sex)


#: Marker genes of the Y chromosome.
Y_MARKERS = ("NRY", "AZF1", "BPY2", "DAZ1", "DAZ2", "PRKY", "RBMY1A1", "SRY", "TSPY", "USP9Y", "UTY", "ZFY")


def sex_marker_counts(counts: DataFrame, samples: DataFrame, features: DataFrame, *, genes: Sequence[str] = Y_MARKERS, sex: str = "sex") -> DataFrame:
    """Counts of the marker genes in all samples, absent cells as 0, with the declared sex of the sample."""
    markers = small(features.where(F.col("symbol").isin(list(genes))).select("feature", "symbol"))
    dense = zero_fill(counts.join(markers.select("feature"), "feature", "left_semi"), None, samples)
    return dense.join(markers, "feature").join(small(samples.select("sample", F.col(sex).alias("declared_sex"))), "sample", "left")


def gene_group_stats(norm: DataFrame, samples: DataFrame, de: DataFrame, *, value: str, group: str, k: int = 100) -> DataFrame:
    """Five-number summary of the ``k`` best features of a result table per group of samples (dense input)."""
    best = de.where(F.col("p_value").isNotNull()).orderBy("p_value", "feature").limit(k).select("feature")
    cells = norm.join(small(best), "feature", "left_semi").join(small(samples.select("sample", F.col(group).alias("group"))), "sample")
    five = F.percentile(F.col(value), F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ("min", "q25", "median", "q75", "max")
    return (cells.groupBy("feature", "group").agg(five.alias("_q"), F.count(F.lit(1)).alias("n"))
            .select("feature", "group", "n", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]))


def de_counts(de: DataFrame) -> DataFrame:
    """Contrast × call contingency table."""
    return de.groupBy("contrast").agg(
        F.sum((F.col("de") == -1).cast("bigint")).alias("down"), F.sum((F.col("de") == 0).cast("bigint")).alias("unchanged"),
        F.sum((F.col("de") == 1).cast("bigint")).alias("up"))


def de_status_counts(de: DataFrame, *, alpha: float = 0.05, lfc: float = 1.0) -> DataFrame:
    """Numbers of small p, tested, significant, and strongly changed features per contrast."""
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))
    return de.groupBy("contrast").agg(
        count(F.col("p_value") < alpha).alias("n_p"), F.count("p_value").alias("n_tested"),
        count(F.col("adj_p") < alpha).alias("n_adj_p"), count(F.abs("avg_log2fc") > lfc).alias("n_lfc"))


def chr_de_counts(de: DataFrame, features: DataFrame) -> DataFrame:
    """Called and total features per contrast and chromosome; chromosomes without a call are left out."""
    chrom = F.coalesce("chromosome_name", F.lit("NA")).alias("chromosome_name")
    joined = de.join(small(features.select("feature", "chromosome_name")), "feature", "left")
    return joined.groupBy("contrast", chrom).agg(
        F.sum(F.col("de").isin(-1, 1).cast("bigint")).alias("de_num"), F.count(F.lit(1)).alias("all_num")).where("de_num > 0")


def pvalue_histogram(de: DataFrame, *, bins: int = 20, min_mean: float = 1, mean: str = "avg_log2cpm") -> DataFrame:
    """Right-closed bins of p over [0, 1], 0 in the first, of features with a mean above ``min_mean``."""
    bin_ = F.greatest(F.lit(1), F.ceil(F.col("p_value") * bins)).cast("int")
    return (de.where(F.col("p_value").isNotNull() & (F.col(mean) > min_mean))
            .groupBy("contrast", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def independent_filter_bins(de: DataFrame, *, bins: int = 6, alpha: float = 0.05, mean: str = "avg_log2cpm") -> DataFrame:
    """Share of small p-values per quantile bin of the mean (right-closed bins over distinct quantiles, minimum excluded)."""
    probs = {f"_q{i}": i / bins for i in range(bins + 1)}
    positive = de.where(F.col(mean) > 0)
    cuts = small(quantiles(positive, ["contrast"], mean, probs).select("contrast", F.array_distinct(F.array(*probs)).alias("_cuts")))
    bin_ = F.size(F.filter("_cuts", lambda c: c < F.col(mean)))
    return (positive.join(cuts, "contrast").withColumn("bin", bin_).where((F.col("bin") > 0) & F.col("p_value").isNotNull())
            .groupBy("contrast", "bin").agg(F.avg((F.col("p_value") < alpha).cast("double")).alias("share"), F.count(F.lit(1)).alias("n")))


def value_histogram(df: DataFrame, col: str, *, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts of values in equal right-closed bins, the lower end in the first bin.

    The range is that of the data unless given. With a given range, values below or above it are counted in bins 0 and ``bins + 1``.
    """
    values = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    if low is None or high is None:
        seen = values.agg(F.min("v"), F.max("v")).first()
        low, high = (seen[0] if low is None else low), (seen[1] if high is None else high)
    if low is None:
        return values.select(F.lit(1).alias("bin"), F.lit(0).cast("bigint").alias("n")).where(F.lit(False))
    step = (high - low) / bins if high > low else 1.0
    inside = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col("v") - low) / step)))
    bin_ = F.when(F.col("v") < low, 0).when(F.col("v") > high, bins + 1).otherwise(inside).cast("int")
    return values.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def count_density(norm: DataFrame, col: str, *, by: str = "sample", grid: int = 512, log10: bool = False, zero: float | None = None) -> DataFrame:
    """Rectangular-kernel density per group on an even grid over the range of all values.

    The density at a grid point needs only the number of values within half a width, so each distinct value adds its multiplicity where
    it enters and takes it away where it leaves; both are combined on the map side and summed along the grid. ``zero`` puts the cells
    that do not exist (and zeros) at that value, as one weighted value per group: every group then has a value for every feature.
    """
    cells = norm.select(F.col(by).alias("group"), "feature" if zero is not None else F.lit(None).alias("feature"), F.col(col).cast("double").alias("v"))
    if zero is not None:
        cells = cells.withColumn("v", F.when(F.col("v") == 0, F.lit(float(zero))).otherwise(F.col("v")))
    counted = keep(cells.where("v IS NOT NULL").groupBy("group", "v").agg(F.count(F.lit(1)).alias("_w")))
    if zero is not None:
        n_features = norm.select("feature").distinct().count()
        absent = counted.groupBy("group").agg((F.lit(n_features) - F.sum("_w")).alias("_w")).where("_w > 0")
        counted = counted.unionByName(absent.withColumn("v", F.lit(float(zero))))
    value = F.log10(F.when(F.col("v") > 0, F.col("v"))) if log10 else F.col("v")
    data = keep(counted.withColumn("v", value).where("v IS NOT NULL"))
    quart = quantiles(data, ["group"], "v", {"_q1": 0.25, "_q3": 0.75}, weight="_w")
    middle = small(data.groupBy("group").agg(F.sum("_w").alias("_n"), (F.sum(F.col("v") * F.col("_w")) / F.sum("_w")).alias("_m")))
    squares = data.join(middle, "group").groupBy("group", "_n").agg(F.sum(F.col("_w") * F.pow(F.col("v") - F.col("_m"), F.lit(2.0))).alias("_ss"))
    spread_ = squares.select("group", "_n", F.sqrt(F.col("_ss") / F.when(F.col("_n") > 1, F.col("_n") - 1)).alias("_sd"))
    iqr = (F.col("_q3") - F.col("_q1")) / 1.34
    robust = F.when(iqr > 0, F.least("_sd", iqr)).otherwise(F.col("_sd"))
    half = 0.9 * robust * F.pow(F.col("_n"), F.lit(-0.2)) * 3 ** 0.5
    low, high = data.agg(F.min("v"), F.max("v")).first()
    if low is None:
        low, high = 0.0, 0.0
    step = (high - low) / (grid - 1) if high > low else 1.0
    widths = small(spread_.join(quart, "group").select("group", "_n", half.alias("_h")).where("_h > 0"))
    enters = F.greatest(F.lit(0), F.ceil((F.col("v") - F.col("_h") - low) / step))
    leaves = F.floor((F.col("v") + F.col("_h") - low) / step) + 1
    marks = F.explode(F.array(F.struct(enters.alias("i"), F.col("_w").alias("d")), F.struct(F.least(leaves, F.lit(grid)).alias("i"), (-F.col("_w")).alias("d"))))
    deltas = data.join(widths, "group").select("group", marks.alias("m")).groupBy("group", F.col("m.i").alias("i")).agg(F.sum("m.d").alias("d"))
    points = widths.select("group", "_n", "_h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(grid - 1).cast("bigint"))).alias("i"))
    inside = F.sum(F.coalesce("d", F.lit(0))).over(W.partitionBy("group").orderBy("i"))  # ``grid`` rows per group
    return (points.join(deltas, ["group", "i"], "left").withColumn("_in", inside)
            .select("group", (F.lit(low) + F.col("i") * step).alias("x"), (F.col("_in") / (F.col("_n") * 2 * F.col("_h"))).alias("density")))


def hex_bins(df: DataFrame, x: str, y: str, *, by: str, bins: int = 80) -> DataFrame:
    """Hexagonal 2-D counts: each point goes to the nearer centre of two interleaved rectangular lattices."""
    box = small(df.groupBy(by).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")))
    pts = df.join(box, by)
    dx = F.greatest((F.col("_x1") - F.col("_x0")) / bins, F.lit(1e-12))
    dy = F.greatest((F.col("_y1") - F.col("_y0")) / bins, F.lit(1e-12)) * 3 ** 0.5
    sx, sy = (F.col(x) - F.col("_x0")) / dx, (F.col(y) - F.col("_y0")) / dy
    pts = pts.withColumn("_sx", sx).withColumn("_sy", sy)
    d1 = F.pow(F.col("_sx") - F.floor(F.col("_sx") + 0.5), F.lit(2)) + 3 * F.pow(F.col("_sy") - F.floor(F.col("_sy") + 0.5), F.lit(2))
    d2 = F.pow(F.col("_sx") - F.floor("_sx") - 0.5, F.lit(2)) + 3 * F.pow(F.col("_sy") - F.floor("_sy") - 0.5, F.lit(2))
    even = d1 <= d2
    return pts.select(by, F.when(even, 2 * F.floor(F.col("_sx") + 0.5)).otherwise(2 * F.floor("_sx") + 1).alias("hex_x"),
                      F.when(even, 2 * F.floor(F.col("_sy") + 0.5)).otherwise(2 * F.floor("_sy") + 1).alias("hex_y")
                      ).groupBy(by, "hex_x", "hex_y").agg(F.count(F.lit(1)).alias("n"))


def paired_lm(pairs: DataFrame, *, by: str) -> DataFrame:
    """Least-squares line of level 2 on level 1 per group."""
    return pairs.groupBy(by).agg(F.regr_slope("value_2", "value_1").alias("slope"), F.regr_intercept("value_2", "value_1").alias("intercept"),
                                 F.count(F.lit(1)).alias("n"))


def complexity_curve(counts: DataFrame, *, max_rank: int | None = 1000) -> DataFrame:
    """Cumulative share of the reads by rank of the feature, largest first, ties by feature; features without reads in a sample rank last.

    With ``max_rank`` only the first rows per sample leave the map side (a group-limited window), and a sample with fewer features is
    filled up with its first features without reads. Without it the curve is a distributed scan of the cells with reads; behind them it
    is constant at 1, which adds no information to samples × features rows, so it ends there.
    """
    order = [F.col("raw_count").desc(), F.col("feature").asc()]
    lib = small(library_size(counts))
    present = counts.where("raw_count > 0")
    if max_rank is None:
        ranked = scan(present, ["sample"], order, number="rank", sums={"_cum": "raw_count"})
        return ranked.join(lib, "sample").select("sample", "feature", "raw_count", "rank", (F.col("_cum") / F.col("lib_size")).alias("fraction"))
    w = W.partitionBy("sample").orderBy(*order)
    top = keep(present.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_rank))
    curve = top.withColumn("_cum", F.sum("raw_count").over(W.partitionBy("sample").orderBy("rank"))).join(lib, "sample").select(
        "sample", "feature", "raw_count", "rank", (F.col("_cum") / F.col("lib_size")).alias("fraction"))
    short = lib.join(top.groupBy("sample").agg(F.max("rank").alias("_k")), "sample", "left").select("sample", F.coalesce("_k", F.lit(0)).alias("_k")).where(F.col("_k") < max_rank)
    # a short sample has fewer than ``max_rank`` features, so its first ones without reads are among the first ``max_rank`` of all
    first = small(counts.select("feature").distinct().orderBy("feature").limit(max_rank))
    short = small(short)
    some = zero_fill(present.join(first, "feature", "left_semi"), first, short)
    absent = some.where("raw_count = 0").join(short, "sample")
    filled = absent.withColumn("rank", (F.col("_k") + F.row_number().over(W.partitionBy("sample").orderBy("feature"))).cast("int")).where(F.col("rank") <= max_rank)
    return curve.unionByName(filled.select("sample", "feature", F.lit(0).cast(counts.schema["raw_count"].dataType).alias("raw_count"), "rank", F.lit(1.0).alias("fraction")))


def frequent_tags(counts: DataFrame, *, min_fraction: float = 0.01, in_all_samples: bool = True) -> DataFrame:
    """Features with at least ``min_fraction`` of a sample's reads, with rank and share; optionally their cells in all samples.

    A feature ranks behind those with more reads in the sample; equal ones share the rank. Only distinct values with their multiplicities
    are ranked, and at most 1 / ``min_fraction`` features per sample are kept, so no table of all cells is sorted. Kept features that a
    sample has no reads of get a row with 0.
    """
    lib = small(library_size(counts))
    present = counts.where("raw_count > 0")
    shares = present.join(lib, "sample").withColumn("fraction", F.col("raw_count") / F.col("lib_size"))
    often = F.col("fraction") >= min_fraction
    if in_all_samples:
        wanted = small(shares.where(often).select("feature").distinct())
        cells = zero_fill(present.join(wanted, "feature", "left_semi"), None, lib.select("sample"))
    else:
        cells = shares.where(often).select("sample", "feature", "raw_count")
    values = value_counts(present, ["sample"], "raw_count")
    ranked = scan(values, ["sample"], [F.col("raw_count").desc()], sums={"_upto": "_times"}, totals={"_all": "_times"})
    ranks = small(ranked.select("sample", "raw_count", (F.col("_upto") - F.col("_times") + 1).alias("rank")))
    sizes = small(values.groupBy("sample").agg(F.sum("_times").alias("_all")))
    out = cells.join(ranks, ["sample", "raw_count"], "left").join(sizes, "sample").join(lib, "sample")
    return out.select("sample", "feature", "raw_count", F.coalesce("rank", F.col("_all") + 1).alias("rank"), (F.col("raw_count") / F.col("lib_size")).alias("fraction"))
