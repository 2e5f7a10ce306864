"""Literal tests of the semantics that differ from Spark defaults, and of the reference fixture of the property join."""

import pytest
from pyspark.sql import functions as F

from countspark.functions.rows import dense_array, feature_rows
from countspark.model import Experiment
from countspark.operators import detable, filters, joins, linear, normalize as nz, qc, reshape
from countspark.sources import delimited, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture()
def tiny(spark):
    counts = spark.createDataFrame([("a", "s1", 10), ("a", "s2", 30), ("b", "s1", 5), ("c", "s2", 70), ("c", "s3", 1)],
                                   "feature string, sample string, raw_count bigint")
    samples = spark.createDataFrame([("s1", "x"), ("s2", "y"), ("s3", "y")], "sample string, grp string")
    return counts, samples


def test_merge_props_literal(spark):
    d = spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "SampleId string")
    props = spark.createDataFrame([("b", "r", 1), ("a", "g", 2), ("c", "b", 3)], "sampleId string, color string, shape int")
    out = joins.merge_props(d, props, from_col="SampleId", from_var="sampleId", to_var="color", to_col="Color")
    assert rows(out, "SampleId", "Color") == [("a", "g"), ("b", "r"), ("b", "r"), ("c", "b")]


def test_zero_fill_and_dense_array(spark, tiny):
    counts, samples = tiny
    dense = reshape.zero_fill(counts, spark.createDataFrame([("a",), ("z",), ("b",), ("c",)], "feature string"), samples)
    got = {(r["feature"], r["sample"]): r["raw_count"] for r in dense.collect()}
    assert len(got) == 12 and got[("z", "s2")] == 0 and got[("c", "s2")] == 70 and got[("c", "s1")] == 0
    names = ["s1", "s2", "s3"]
    arrays = {r["feature"]: r["d"] for r in feature_rows(counts, "raw_count", samples, names).select("feature", dense_array(3).alias("d")).collect()}
    assert arrays == {"a": [10.0, 30.0, 0.0], "b": [5.0, 0.0, 0.0], "c": [0.0, 70.0, 1.0]}


def test_log_of_zero_is_minus_infinity(spark):
    counts = spark.createDataFrame([("a", "s1", 0), ("a", "s2", 8)], "feature string, sample string, raw_count bigint")
    factors = spark.createDataFrame([("s1", 1.0), ("s2", 2.0)], "sample string, size_factor double")
    assert rows(nz.normalized_counts(counts, factors, transform="log2"), "sample", "norm_count") == [("s1", float("-inf")), ("s2", 2.0)]


def test_zscore_of_constant_row_is_null(spark):
    df = spark.createDataFrame([("a", "s1", 2.0), ("a", "s2", 2.0)], "feature string, sample string, v double")
    assert [r["z"] for r in nz.zscore_rows(df, "v").collect()] == [None, None]


def test_ranks_put_missing_last_and_break_ties_by_feature(spark):
    de = spark.createDataFrame([("b", "k", 0.5, None), ("a", "k", 0.01, 0.02), ("d", "k", 0.01, 0.02), ("c", "k", None, None)],
                               "feature string, contrast string, p_value double, adj_p double")
    assert rows(detable.de_rank(de), "rank", "feature") == [(1, "a"), (2, "d"), (3, "b"), (4, "c")]


def test_a_missing_adjusted_p_drops_the_feature(spark):
    de = spark.createDataFrame([("a", 0.01), ("a", None), ("b", 0.01), ("b", 0.9)], "feature string, adj_p double")
    assert rows(joins.significant_everywhere_tested(de, 0.05), "feature") == [("b",)]


def test_pattern_prints_missing_calls(spark):
    de = spark.createDataFrame([("a", "x", 1), ("a", "y", None), ("b", "x", -1), ("b", "y", 0)], "feature string, contrast string, de int")
    assert rows(detable.de_pattern(de, ["x", "y"]), "feature", "pattern") == [("a", "u.NA"), ("b", "d.0")]
    assert rows(detable.contrasts_de(de, ["x", "y"]), "feature", "pattern") == [("b", "d:0")]
    assert rows(detable.contrasts_de(de.where("feature = 'b' AND contrast = 'x'"), ["x", "y"]), "pattern", "y") == [("d:0", 0)]


def test_histogram_bins_are_right_closed(spark):
    de = spark.createDataFrame([(p, "k", 2.0) for p in (0.0, 0.05, 0.050001, 1.0)], "p_value double, contrast string, avg_log2cpm double")
    assert rows(qc.pvalue_histogram(de), "bin", "n") == [(1, 2), (2, 1), (20, 1)]


def test_first_match_wins(spark):
    df = spark.createDataFrame([("a",), ("b",)], "feature string")
    mapping = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("a", 3, None)], "feature string, pos int, symbol string")
    assert rows(joins.annotate_features(df, mapping, col="symbol", order=["pos"]), "feature", "symbol")[0] == ("a", "early")


def test_venn_rejects_mixed_signs(spark):
    wide = spark.createDataFrame([("a", 1, -1)], "feature string, x int, y int")
    with pytest.raises(ValueError):
        detable.venn_counts(wide, direction=1)


def test_ingest_checks_and_summary(spark):
    counts = spark.createDataFrame([("g1", "s1", 5), ("g2", "s1", 1), ("__ambiguous", "s1", 4), ("g1", "s2", 6)],
                                   "feature string, sample string, raw_count bigint")
    sheet = spark.createDataFrame([("s1",), ("s2",)], "sample string")
    exp = qc.experiment_from_counts(counts, sheet)
    assert rows(exp.counts, "feature", "sample") == [("g1", "s1"), ("g1", "s2")]  # a total of 1 is not enough
    assert {r["sample"]: (r["total_count"], r["on_feature"], r["ambiguous"]) for r in exp.alignment.collect()} == {"s1": (10, 6, 4), "s2": (6, 6, None)}
    with pytest.raises(ValueError):
        qc.experiment_from_counts(counts, spark.createDataFrame([("nobody",)], "sample string"))


def test_moving_reads_when_features_are_removed(spark, tiny):
    counts, samples = tiny
    exp = Experiment(counts=counts, samples=samples, alignment=qc.alignment_summary(counts))
    out = filters.select_features(exp, spark.createDataFrame([("c",)], "feature string"), remove=True)
    assert {r["sample"]: (r["on_feature"], r["on_removed_features"]) for r in out.alignment.collect()} == {"s1": (15, 0), "s2": (30, 70), "s3": (0, 1)}


def test_contrast_must_match_design(spark, tiny):
    design = linear.design_matrix(tiny[1], ["grp"], intercept=False)
    with pytest.raises(ValueError):
        linear.make_contrasts(design, {"k": "grpx-grpq"})
    with pytest.raises(ValueError):
        linear.design_matrix(tiny[1].withColumn("same", F.col("grp")), ["grp", "same"], intercept=False)


def test_contrast_matching_by_index(spark):
    design = spark.createDataFrame([("s1", "a", 1.0), ("s1", "b", 0.0), ("s2", "a", 0.0), ("s2", "b", 0.0), ("s3", "a", 0.0), ("s3", "b", 1.0)],
                                   "sample string, coef string, value double")
    contrasts = spark.createDataFrame([("A", "a", 1.0), ("B", "b", 1.0)], "contrast string, coef string, weight double")
    assert rows(joins.contrast_sample_match(design, contrasts, rule="index"), "contrast", "sample") == [("A", "s1"), ("A", "s2"), ("B", "s2"), ("B", "s3")]


def test_overlaps_equal_a_theta_join(spark):
    ranges = spark.range(400).select(F.col("id").alias("feature"), (F.col("id") % 3).cast("string").alias("chrom"),
                                     ((F.col("id") * 7919) % 5000).alias("start"), ((F.col("id") * 7919) % 5000 + F.col("id") % 90).alias("end"))
    target = ranges.where("feature IN (5, 6, 30)")
    got = rows(joins.overlap_window(ranges, target, pad=300, bin_size=70), "feature", "target")
    every = [r.asDict() for r in ranges.collect()]
    want = sorted((r["feature"], t["feature"]) for t in every if t["feature"] in (5, 6, 30) for r in every
                  if r["chrom"] == t["chrom"] and r["start"] <= t["end"] + 300 and r["end"] >= t["start"] - 300)
    assert got == want


def test_files_round_trip(spark, tiny, tmp_path):
    counts, _ = tiny
    sinks.write_wide_matrix(counts, str(tmp_path / "m"), "raw_count", samples=["s1", "s2", "s3"], fmt="tab.gz")
    back = delimited.read_wide_counts(spark, str(tmp_path / "m"), id_col="feature")
    assert back.where("raw_count IS NULL").count() == 0 and back.where("raw_count = 0").count() == 4  # absent cells are written as zeros
    assert rows(back.where("raw_count <> 0"), "feature", "sample", "raw_count") == rows(counts, "feature", "sample", "raw_count")
    with pytest.raises(ValueError):
        sinks.write_table(counts, str(tmp_path / "x"), fmt="xls")


def test_tpm_sums_and_factor_products(spark, cohort):
    counts, sheet, raw = cohort
    lengths = counts.select("feature").distinct().withColumn("length_bp", F.length("feature") * 100 + F.substring("feature", 2, 3).cast("int"))
    sums = nz.tpm(counts, lengths).groupBy("sample").agg(F.sum("tpm").alias("t")).collect()
    assert all(abs(r["t"] - 1e6) < 1e-3 for r in sums)
    import numpy as np

    tmm = [r["norm_factor"] for r in nz.tmm_factors(counts).collect()]
    assert abs(np.log(tmm).sum()) < 1e-9
    sf = {r["sample"]: r["size_factor"] for r in nz.size_factors(counts, 8).collect()}
    full = raw[(raw > 0).all(axis=1)]
    want = np.exp(np.median(np.log(full) - np.log(full).mean(axis=1, keepdims=True), axis=0))
    assert np.allclose([sf[f"s{j}"] for j in range(8)], want)


# --- absent cells are zeros --------------------------------------------------------------------------------------------

def test_pairs_keep_zero_cells_and_meet_m_to_n(spark):
    counts = spark.createDataFrame([("a", "p1", 4), ("b", "q2", 7)], "feature string, sample string, raw_count bigint")
    sheet = spark.createDataFrame([("p1", "x", "u"), ("p2", "x", "u"), ("q1", "y", "u"), ("q2", "y", "u"), ("r1", "x", "v"), ("r2", "z", "v")], "sample string, grp string, subj string")
    out = joins.paired_counts(counts, sheet, value="raw_count", subject="subj", group="grp", levels=["x", "y"])
    assert rows(out, "feature", "subject", "sample_1", "sample_2", "value_1", "value_2") == [
        ("a", "u", "p1", "q1", 4, 0), ("a", "u", "p1", "q2", 4, 0), ("a", "u", "p2", "q1", 0, 0), ("a", "u", "p2", "q2", 0, 0),
        ("b", "u", "p1", "q1", 0, 0), ("b", "u", "p1", "q2", 0, 7), ("b", "u", "p2", "q1", 0, 0), ("b", "u", "p2", "q2", 0, 7)]


def test_chosen_features_have_all_samples(spark, tiny):
    counts, samples = tiny
    de = spark.createDataFrame([("b", "k", 0.01, 0.02), ("a", "k", 0.1, 0.2)], "feature string, contrast string, p_value double, adj_p double")
    assert rows(detable.best_gene_counts(de, counts, samples, value="raw_count", group="grp"), "sample", "raw_count") == [("s1", 5), ("s2", 0), ("s3", 0)]
    marked = spark.createDataFrame([("b", "SRY")], "feature string, symbol string")
    assert rows(qc.sex_marker_counts(counts, samples, marked, sex="grp"), "sample", "raw_count", "declared_sex") == [("s1", 5, "x"), ("s2", 0, "y"), ("s3", 0, "y")]
    often = qc.frequent_tags(counts, min_fraction=0.65)
    assert rows(often, "sample", "feature", "raw_count", "rank") == [("s1", "a", 10, 1), ("s1", "c", 0, 3), ("s2", "a", 30, 2), ("s2", "c", 70, 1), ("s3", "a", 0, 2), ("s3", "c", 1, 1)]
    curve = qc.complexity_curve(counts, max_rank=3)
    assert [r[2] for r in rows(curve, "sample", "rank", "feature")] == ["a", "b", "c", "c", "a", "b", "c", "a", "b"]
    wide = sinks.wide_matrix(counts, "raw_count", ["s1", "s2", "s3"])
    assert rows(wide, "feature", "s1", "s2", "s3") == [("a", 10, 30, 0), ("b", 5, 0, 0), ("c", 0, 70, 1)]


def test_wide_matrix_in_blocks(spark, tiny, tmp_path):
    counts, _ = tiny
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        sinks.write_wide_matrix(counts, f"file://{tmp_path}/m", "raw_count", samples=["s1", "s2", "s3"], fmt="parquet")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")
    assert rows(spark.read.parquet(f"file://{tmp_path}/m/block_00001"), "feature", "s3") == [("a", 0), ("b", 0), ("c", 1)]


def test_density_counts_the_zeros(spark):
    counts = spark.createDataFrame([("a", "s1", 10), ("b", "s1", 100), ("c", "s2", 5), ("a", "s2", 50), ("b", "s2", 9), ("d", "s2", 3)], "feature string, sample string, raw_count bigint")
    points = {}
    for r in qc.count_density(counts, "raw_count", grid=64, log10=True, zero=0.5).collect():
        points.setdefault(r["group"], []).append((r["x"], r["density"]))
    assert min(x for x, _ in points["s1"]) < -0.3 + 1e-9  # log10 of a half
    assert all(d > 0 for x, d in points["s1"] if x < -0.29)


def test_histogram_loses_no_value(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 5, 9, 10)], "v double")
    assert rows(qc.value_histogram(df, "v", bins=5), "bin", "n") == [(1, 3), (3, 1), (5, 2)]
    assert rows(qc.value_histogram(df, "v", bins=2, low=1, high=5), "bin", "n") == [(0, 1), (1, 2), (2, 1), (3, 2)]
    assert qc.value_histogram(df.limit(0), "v", bins=3).count() == 0


def test_size_factors_need_a_common_feature(spark):
    counts = spark.createDataFrame([("a", "s1", 4), ("b", "s2", 8)], "feature string, sample string, raw_count bigint")
    with pytest.raises(ValueError):
        nz.size_factors(counts, 2)
    assert rows(nz.size_factors(counts, 2, positive=True), "sample", "size_factor") == [("s1", pytest.approx(2.0)), ("s2", pytest.approx(8 ** 0.5))]


def test_copied_cells_follow_the_ranges(spark):
    """A cell goes once to every pair of ranges it belongs to, not to every group of pairs."""
    from countspark.operators import pairwise as pw

    cells = spark.createDataFrame([(list(range(i % 3, 40, 2)),) for i in range(30)], "idx array<int>").withColumn("x", F.transform("idx", lambda i: i.cast("double")))
    for width in (20, 10, 5):
        ranges = pw._block_pairs(40, width)
        dealt = pw.deal_ranges(cells, ranges)
        total = cells.agg(F.sum(F.size("idx"))).first()[0]
        assert dealt.agg(F.sum(F.size("idx"))).first()[0] == total * (40 // width)


def test_written_tables_are_removed(spark, tiny):
    from countspark.session import keep, new_path, written_tables

    counts, _ = tiny
    with written_tables(spark) as folder:
        table = keep(counts)
        assert table.inputFiles()[0].split("://")[-1].lstrip("/").startswith(folder.split("://")[-1].lstrip("/"))
        assert table.count() == 5
    assert folder not in new_path(spark)
    with pytest.raises(Exception):
        spark.read.parquet(folder)
