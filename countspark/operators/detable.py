"""Result tables: calls, ranks, top features, patterns over contrasts, and their comparison across methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from countspark.functions.adjust import bh_adjust
from countspark.functions.scans import scan
from countspark.operators.joins import significant_everywhere_tested
from countspark.operators.reshape import zero_fill
from countspark.session import keep, small


def de_call(de: DataFrame, *, threshold: float = 0.05) -> DataFrame:
    """−1, 0 or 1: direction of change where the adjusted p is within the threshold; NULL where untested."""
    call = F.when(F.col("adj_p") <= threshold, F.signum("avg_log2fc").cast("int")).when(F.col("adj_p").isNotNull(), F.lit(0))
    return de.withColumn("de", call)


def de_rank(de: DataFrame) -> DataFrame:
    """Unique rank by adjusted p, then p, then feature; untested features last."""
    order = [F.col("adj_p").asc_nulls_last(), F.col("p_value").asc_nulls_last(), F.col("feature").asc()]
    return scan(de, ["contrast"], order, number="rank")


def de_table(tested: DataFrame, *, threshold: float = 0.05) -> DataFrame:
    """Adjust, call and rank a table of p-values: the common last step of all methods."""
    return de_call(bh_adjust(tested, "p_value", by=["contrast"], rank="rank"), threshold=threshold)


def top_tags(de: DataFrame, *, max_rank: int = 50, contrasts: Sequence[str] | None = None, des: Sequence[int] = (1, -1)) -> DataFrame:
    """Called features within ``max_rank``, ordered by contrast and rank."""
    out = de.where((F.col("rank") <= max_rank) & F.col("de").isin(list(des)))
    if contrasts is not None:
        out = out.where(F.col("contrast").isin(list(contrasts)))
    return out.orderBy("contrast", "rank")


def top_tags_counts(de: DataFrame, norm: DataFrame, match: DataFrame, *, value: str, max_rank: int = 50, contrasts: Sequence[str] | None = None) -> DataFrame:
    """Top features of each contrast with the values of the samples that matter to it (``match``: contrast, sample); absent cells are 0."""
    top = small(top_tags(de, max_rank=max_rank, contrasts=contrasts))
    wanted = top.select("feature").distinct()
    dense = zero_fill(norm.join(wanted, "feature", "left_semi"), wanted, match.select("sample").distinct(), value=value)
    return dense.join(top, "feature").join(small(match.select("contrast", "sample").distinct()), ["contrast", "sample"])


def top_tags_pairs(de: DataFrame, pairs: DataFrame, *, max_rank: int = 50, contrasts: Sequence[str] | None = None) -> DataFrame:
    """Top features of each contrast with the pairs of values of ``paired_counts``."""
    return pairs.join(small(top_tags(de, max_rank=max_rank, contrasts=contrasts)), "feature")


def top_variable_features(variances: DataFrame, k: int) -> DataFrame:
    """The ``k`` features with the largest variance (a top-k, no full sort)."""
    return variances.orderBy(F.col("variance").desc_nulls_last(), "feature").limit(k)


def strongest_regulation(de: DataFrame, k: int = 6, *, up: bool) -> DataFrame:
    """The ``k`` significant rows with the largest (or smallest) fold change."""
    change = F.col("avg_log2fc")
    return de.where(F.col("adj_p") < 0.05).orderBy(change.desc() if up else change.asc(), "feature", "contrast").limit(k)


def best_gene_counts(de: DataFrame, norm: DataFrame, samples: DataFrame, *, value: str, group: str) -> DataFrame:
    """Normalised values of the feature with the smallest adjusted p, with the group of each sample; an absent cell is 0."""
    best = de.where(F.col("adj_p").isNotNull()).orderBy("adj_p", "p_value", "feature").select("feature").first()
    feature = F.lit(best["feature"] if best else None).cast(norm.schema["feature"].dataType)
    sheet = samples.select("sample", F.col(group).alias("group"))
    cells = norm.where(F.col("feature") == feature).select("sample", value)
    out = sheet.join(cells, "sample", "left").select(feature.alias("feature"), "sample", "group", F.coalesce(F.col(value), F.lit(0)).alias(value))
    return out.where("feature IS NOT NULL")


def top_n_rows(df: DataFrame, n: int = 150, *, by: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in by]).limit(n)


def fdr_curve(de: DataFrame) -> DataFrame:
    """Sorted adjusted p per contrast against the line i/n."""
    order = [F.col("adj_p").asc(), F.col("p_value").asc(), F.col("feature").asc()]
    ranked = scan(de.where(F.col("adj_p").isNotNull()), ["contrast"], order, number="i", size="_n")
    return ranked.select("contrast", "feature", "i", "adj_p", (F.col("i") / F.col("_n")).alias("line"))


def heatmap_data(norm: DataFrame, de: DataFrame, *, value: str, average: str = "avg_log2cpm", max_adj: float = 0.05) -> DataFrame:
    """Difference of each value from the feature's average, for features significant in some contrast (NULL-free)."""
    hits = de.join(small(significant_everywhere_tested(de, max_adj)), "feature", "left_semi").select("feature", average).distinct()
    return norm.join(small(hits), "feature").select("feature", "sample", (F.col(value) - F.col(average)).alias("diff"))


def _call_letter(col: Column) -> Column:
    return F.coalesce(F.when(col == 0, "0").when(col == 1, "u").when(col == -1, "d"), F.lit("NA"))


def _by_contrast(de: DataFrame, contrasts: Sequence[str]) -> DataFrame:
    """One row per feature with the call of each contrast; one shuffle, no pivot discovery."""
    at = lambda c: F.max(F.when(F.col("contrast") == c, F.col("de"))).alias(c)
    return de.where(F.col("contrast").isin(list(contrasts))).groupBy("feature").agg(*[at(c) for c in contrasts])


def de_pattern(de: DataFrame, contrasts: Sequence[str]) -> DataFrame:
    """``0.u.d``-style pattern of each feature over the contrasts."""
    wide = _by_contrast(de, contrasts)
    return wide.select("feature", F.concat_ws(".", *[_call_letter(F.col(f"`{c}`")) for c in contrasts]).alias("pattern"))


def contrasts_de(de: DataFrame, contrasts: Sequence[str], *, remove_non_de: bool = True) -> DataFrame:
    """Feature × contrast calls with a ``0:u:d`` pattern; features without any call are dropped on request.

    A contrast a feature has no row for counts as 0; an untested one stays NULL, shown as ``NA`` in the pattern.
    """
    rows = de.where(F.col("contrast").isin(list(contrasts)))
    at = lambda c: F.when(F.count(F.when(F.col("contrast") == c, 1)) == 0, F.lit(0)).otherwise(F.max(F.when(F.col("contrast") == c, F.col("de"))))
    wide = rows.groupBy("feature").agg(*[at(c).alias(c) for c in contrasts],
                                       F.sum(F.coalesce((F.col("de") != 0).cast("int"), F.lit(0))).alias("_calls"),
                                       F.count(F.when(F.col("de").isNull(), 1)).alias("_na"))
    if remove_non_de:
        wide = wide.where((F.col("_calls") > 0) & (F.col("_na") == 0))
    return wide.withColumn("pattern", F.concat_ws(":", *[_call_letter(F.col(f"`{c}`")) for c in contrasts])).drop("_calls", "_na")


def _frequencies(wide: DataFrame, cols: Sequence[str], rank: str) -> DataFrame:
    """Rows per combination of ``cols``, ranked by frequency; the combinations are few (3^contrasts at most)."""
    counts = small(wide.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("count")))
    order = [F.col("count").desc(), *[F.col(f"`{c}`").asc_nulls_last() for c in cols]]
    return scan(counts, [], order, number=rank)


def diff_tags(de: DataFrame, contrasts: Sequence[str]) -> DataFrame:
    """Frequency of each combination of calls, with its rank."""
    return _frequencies(_by_contrast(de, contrasts), contrasts, "rank")


def contrasts_de_counts(de: DataFrame, contrasts: Sequence[str], *, remove_non_de: bool = True) -> DataFrame:
    """Frequencies of the combinations, one row per combination and contrast."""
    freq = _frequencies(contrasts_de(de, contrasts, remove_non_de=remove_non_de), contrasts, "group")
    return freq.unpivot(["group", "count"], [f"`{c}`" for c in contrasts], "contrast", "de")


def compare_des(tables: dict[str, DataFrame], contrasts: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(wide, by_method, by_consistency)`` of several result tables.

    ``wide``: calls per feature, one column per method and contrast. ``by_method``: numbers of calls per contrast and method.
    ``by_consistency``: frequency of each row of ``wide``.
    """
    stacked = None
    for method, de in tables.items():
        part = de.where(F.col("contrast").isin(list(contrasts))).select("feature", "contrast", "de", F.lit(method).alias("method"))
        stacked = part if stacked is None else stacked.unionByName(part)
    stacked = keep(stacked)
    cols = [(m, c) for m in tables for c in contrasts]
    at = lambda m, c: F.max(F.when((F.col("method") == m) & (F.col("contrast") == c), F.col("de"))).alias(f"{m}_{c}")
    wide = stacked.groupBy("feature").agg(*[at(m, c) for m, c in cols])
    count = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))
    by_method = stacked.groupBy("contrast", "method").agg(
        count(F.col("de") == -1).alias("down"), count(F.col("de") == 0).alias("unchanged"), count(F.col("de") == 1).alias("up"),
        count(F.col("de").isNull()).alias("untested"))
    names = [f"{m}_{c}" for m, c in cols]
    return wide, by_method, wide.groupBy(*names).agg(F.count(F.lit(1)).alias("count"))


def venn_counts(wide: DataFrame, *, direction: int) -> DataFrame:
    """Region sizes of the features called only upwards (1) or only downwards (−1); features with both signs are an error."""
    cols = [c for c in wide.columns if c != "feature"]
    calls = [F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in cols]
    highest, lowest = (F.greatest(*calls), F.least(*calls)) if len(calls) > 1 else (calls[0], calls[0])
    if direction not in (1, -1):
        raise ValueError("direction must be 1 or -1")
    if wide.where((highest > 0) & (lowest < 0)).limit(1).count():
        raise ValueError("some features are called in both directions")
    rows = wide.where((lowest >= 0) & (highest > 0) if direction == 1 else (highest <= 0) & (lowest < 0))
    return rows.select(*[(call != 0).alias(c) for c, call in zip(cols, calls)]).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
