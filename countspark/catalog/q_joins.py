"""Queries for annotation joins, result-table joins, range overlaps, patterns and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from countspark.catalog import inputs as fx
from countspark.catalog.q_tables import de_table
from countspark.catalog.registry import VIEWS, query, r6
from countspark.model import Experiment
from countspark.operators import detable, joins, normalize as nz
from countspark.session import keep, small

PAT = fx.CONTRASTS


@query("merge_props", """
SELECT c.feature, c.sample, c.raw_count, s.grade AS "Grade" FROM fx_counts c JOIN fx_samples s ON s.sample = c.sample""")
def _(spark, sf):
    props = fx.samples(spark, sf).withColumnRenamed("sample", "sample_id")
    return joins.merge_props(fx.counts_plan(spark, sf), props, from_col="sample", from_var="sample_id", to_var="grade", to_col="Grade")


@query("annotate_features", """
SELECT c.feature, c.n, m.supplier FROM (SELECT feature, COUNT(*) AS n FROM fx_counts GROUP BY feature) c
LEFT JOIN (SELECT l_partkey AS feature, MIN(l_suppkey) AS supplier FROM lineitem WHERE l_quantity > 40 GROUP BY l_partkey) m ON m.feature = c.feature""")
def _(spark, sf):
    mapping = fx.table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("feature"), F.col("l_suppkey").alias("supplier"))
    table = fx.counts_plan(spark, sf).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return joins.annotate_features(table, mapping, col="supplier", order=["supplier"])


@query("strip_id_version", """
SELECT CONCAT('G', CAST(feature % 500 AS VARCHAR)) AS feature, sample, CAST(SUM(raw_count) AS BIGINT) AS raw_count FROM fx_counts GROUP BY 1, 2""")
def _(spark, sf):
    f = F.col("feature")
    versioned = fx.counts_plan(spark, sf).withColumn("feature", F.concat(F.lit("G"), (f % 500).cast("string"), F.lit("."), F.floor(f / 500).cast("string")))
    return joins.strip_id_version(versioned)


@query("rekey_by_annotation", """
SELECT n.name AS feature, c.sample, c.raw_count FROM fx_counts c JOIN (
  SELECT feature, CASE WHEN i = 1 THEN k ELSE CONCAT(k, '.', CAST(i - 1 AS VARCHAR)) END AS name
  FROM (SELECT feature, k, ROW_NUMBER() OVER (PARTITION BY k ORDER BY feature) AS i
        FROM (SELECT f.feature, COALESCE(CASE WHEN x.chromosome_name <> 'MT' THEN x.symbol END, CAST(f.feature AS VARCHAR)) AS k
              FROM (SELECT DISTINCT feature FROM fx_counts) f LEFT JOIN fx_features x ON x.feature = f.feature) q) r) n ON n.feature = c.feature""")
def _(spark, sf):
    mapping = fx.features(spark, sf).where("chromosome_name <> 'MT'").select("feature", "symbol")
    return joins.rekey_by_annotation(fx.counts(spark, sf), mapping, new="symbol", on_missing="keep")


@query("add_feature_annotations", """
SELECT c.feature, f.symbol, f.length_bp, CASE WHEN f.chromosome_name IN ('4', '5', '6', 'X', 'Y', 'MT') THEN f.chromosome_name END AS chromosome_name
FROM (SELECT DISTINCT feature FROM fx_counts) c LEFT JOIN fx_features f ON f.feature = c.feature""")
def _(spark, sf):
    exp = Experiment(counts=fx.counts_plan(spark, sf), samples=fx.samples(spark, sf))
    exp = joins.add_feature_annotations(exp, fx.features(spark, sf), clean_chromosomes=["4", "5", "6", "X", "Y", "MT"])
    return exp.features.select("feature", "symbol", "length_bp", "chromosome_name")


@query("choose_id_type", """
SELECT COUNT(*) FILTER (CAST(feature AS VARCHAR) LIKE '%99%') AS n_hits, COUNT(*) AS n_ids,
       COUNT(*) FILTER (feature IN (SELECT feature FROM fx_features WHERE chromosome_name IN ('X', 'Y'))) AS n_probes,
       CASE WHEN COUNT(*) FILTER (CAST(feature AS VARCHAR) LIKE '%99%') > 2000 THEN 'ensembl'
            WHEN COUNT(*) FILTER (feature IN (SELECT feature FROM fx_features WHERE chromosome_name IN ('X', 'Y'))) > COUNT(*) * 0.2e0 THEN 'probe' ELSE 'symbol' END AS id_type
FROM (SELECT DISTINCT feature FROM fx_counts) q""")
def _(spark, sf):
    probes = fx.features(spark, sf).where("chromosome_name IN ('X', 'Y')")
    return joins.choose_id_type(fx.counts(spark, sf), pattern="99", min_hits=2000, probes=probes)


@query("join_de_counts", """
SELECT c.feature, c.sample, c.raw_count, d.avg_log2cpm, p.pattern FROM fx_counts c
LEFT JOIN (SELECT DISTINCT feature, avg_log2cpm FROM fx_det) d ON d.feature = c.feature LEFT JOIN fx_pattern p ON p.feature = c.feature""")
def _(spark, sf):
    de = de_table(spark, sf)
    return joins.join_de_counts(fx.counts_plan(spark, sf), de, pattern=detable.de_pattern(de, PAT))


VIEWS["fx_hits"] = "SELECT feature FROM fx_det GROUP BY feature HAVING MIN(adj_p) <= 0.05 AND COUNT(adj_p) = COUNT(*)"


@query("semi_significant", "SELECT feature, sample, raw_count FROM fx_counts WHERE feature IN (SELECT feature FROM fx_hits)")
def _(spark, sf):
    return joins.semi_significant(fx.counts_plan(spark, sf), de_table(spark, sf))


VIEWS["fx_pairs"] = """
SELECT a.feature, sa.subject, a.sample AS sample_1, b.sample AS sample_2, a.raw_count AS value_1, b.raw_count AS value_2
FROM fx_dense a JOIN fx_samples sa ON sa.sample = a.sample AND sa.cond = 'ctrl'
JOIN fx_samples sb ON sb.subject = sa.subject AND sb.cond = 'case' JOIN fx_dense b ON b.sample = sb.sample AND b.feature = a.feature"""


def pairs(spark, sf):
    return joins.paired_counts(fx.counts_plan(spark, sf), fx.samples(spark, sf), value="raw_count", subject="subject", group="cond", levels=["ctrl", "case"])


@query("paired_counts", "SELECT * FROM fx_pairs")
def _(spark, sf):
    return pairs(spark, sf)


@query("paired_counts_grade", VIEWS["fx_pairs"].replace("sa.cond = 'ctrl'", "sa.grade = 'g0'").replace("sb.cond = 'case'", "sb.grade = 'g1'").replace("sa.subject", "sa.cond").replace("sb.subject", "sb.cond").replace("sa.cond, a.sample", "sa.cond AS subject, a.sample"))
def _(spark, sf):
    """Several samples per subject and level: all pairs of them."""
    return joins.paired_counts(fx.counts_plan(spark, sf), fx.samples(spark, sf), value="raw_count", subject="cond", group="grade", levels=["g0", "g1"])


@query("paired_lm", """
SELECT subject, ROUND(REGR_SLOPE(value_2, value_1), 6) + 0e0 AS slope, ROUND(REGR_INTERCEPT(value_2, value_1), 6) + 0e0 AS intercept, COUNT(*) AS n
FROM fx_pairs GROUP BY subject""")
def _(spark, sf):
    from countspark.operators.qc import paired_lm

    return paired_lm(pairs(spark, sf), by="subject").select("subject", r6("slope").alias("slope"), r6("intercept").alias("intercept"), "n")


@query("de_compare_join", """
SELECT a.feature, a.contrast, a.de AS de_x, b.de AS de_y, a.rank AS rank_x, b.rank AS rank_y, ROUND(a.adj_p, 9) AS adj_p_x, ROUND(b.adj_p, 9) AS adj_p_y,
  CASE WHEN COALESCE(a.rank <= 30 AND a.de <> 0, FALSE) AND COALESCE(b.rank <= 30 AND b.de <> 0, FALSE) THEN 'both'
       WHEN COALESCE(a.rank <= 30 AND a.de <> 0, FALSE) THEN 'x' WHEN COALESCE(b.rank <= 30 AND b.de <> 0, FALSE) THEN 'y' ELSE 'none' END AS seen_in
FROM fx_det a JOIN fx_det2 b ON b.feature = a.feature AND b.contrast = a.contrast""")
def _(spark, sf):
    out = joins.de_compare_join(de_table(spark, sf), de_table(spark, sf, 211))
    return out.select("feature", "contrast", "de_x", "de_y", "rank_x", "rank_y", F.round("adj_p_x", 9).alias("adj_p_x"), F.round("adj_p_y", 9).alias("adj_p_y"), "seen_in")


@query("overlap_window", """
SELECT r.feature, r.chromosome_name AS chrom, r.start_position AS start, r.end_position AS "end", t.feature AS target
FROM fx_features r JOIN fx_features t ON t.chromosome_name = r.chromosome_name AND t.feature % 100 = 1
  AND r.start_position <= t.end_position + 5000 AND r.end_position >= t.start_position - 5000""")
def _(spark, sf):
    ranges = fx.features(spark, sf).select("feature", F.col("chromosome_name").alias("chrom"), F.col("start_position").alias("start"), F.col("end_position").alias("end"))
    return joins.overlap_window(ranges, ranges.where("feature % 100 = 1"), pad=5000, bin_size=2000)


@query("overlap_label", """
SELECT d.feature, d.contrast, CASE WHEN f.symbol IS NOT NULL AND f.first_feature = d.feature THEN f.symbol ELSE CAST(d.feature AS VARCHAR) END AS label,
       COALESCE(d.adj_p < 0.1, FALSE) AS flag
FROM fx_det d JOIN (SELECT feature, symbol, MIN(feature) OVER (PARTITION BY symbol) AS first_feature FROM fx_features) f ON f.feature = d.feature""")
def _(spark, sf):
    rows = de_table(spark, sf).join(small(fx.features(spark, sf).select("feature", "symbol")), "feature")
    return joins.overlap_label(rows).select("feature", "contrast", "label", "flag")


VIEWS["fx_design"] = """
SELECT sample, 'g0' AS coef, CASE WHEN grade = 'g0' THEN 1e0 ELSE 0e0 END AS value FROM fx_samples
UNION ALL SELECT sample, 'g1', CASE WHEN grade = 'g1' THEN 1e0 ELSE 0e0 END FROM fx_samples
UNION ALL SELECT sample, 'g2', CASE WHEN grade = 'g2' THEN 1e0 ELSE 0e0 END FROM fx_samples"""


@query("contrast_sample_match", """
SELECT DISTINCT k.contrast, d.sample FROM fx_design d JOIN (
  SELECT 'g1_vs_g0' AS contrast, 'g1' AS coef, 1e0 AS weight UNION ALL SELECT 'g1_vs_g0', 'g0', -1e0
  UNION ALL SELECT 'g2_vs_g0', 'g2', 1e0 UNION ALL SELECT 'g2_vs_g0', 'g0', -1e0) k ON k.coef = d.coef WHERE d.value <> 0""")
def _(spark, sf):
    from countspark.operators.linear import design_matrix, make_contrasts

    design = design_matrix(fx.samples(spark, sf), ["grade"], intercept=False)
    contrasts = make_contrasts(design, {"g1_vs_g0": "g1-g0", "g2_vs_g0": "g2-g0"}, prefix="grade")
    return joins.contrast_sample_match(design, contrasts)


# --- patterns and comparisons -----------------------------------------------------------------------------------------

LETTER = "CASE WHEN {c} = 0 THEN '0' WHEN {c} = 1 THEN 'u' WHEN {c} = -1 THEN 'd' ELSE 'NA' END"
VIEWS["fx_calls"] = "SELECT feature, MAX(de) FILTER (contrast = 'g1_vs_g0') AS g1_vs_g0, MAX(de) FILTER (contrast = 'g2_vs_g0') AS g2_vs_g0 FROM fx_det GROUP BY feature"
VIEWS["fx_calls2"] = VIEWS["fx_calls"].replace("fx_det", "fx_det2")
VIEWS["fx_both_calls"] = """
SELECT a.feature, CONCAT(COALESCE(CAST(a.g1_vs_g0 AS VARCHAR), 'NA'), '|', COALESCE(CAST(a.g2_vs_g0 AS VARCHAR), 'NA'), '|',
  COALESCE(CAST(b.g1_vs_g0 AS VARCHAR), 'NA'), '|', COALESCE(CAST(b.g2_vs_g0 AS VARCHAR), 'NA')) AS calls FROM fx_calls a JOIN fx_calls2 b ON b.feature = a.feature"""
VIEWS["fx_pattern"] = f"SELECT feature, CONCAT({LETTER.format(c='g1_vs_g0')}, '.', {LETTER.format(c='g2_vs_g0')}) AS pattern FROM fx_calls"
VIEWS["fx_changed"] = f"""
SELECT feature, g1_vs_g0, g2_vs_g0, CONCAT({LETTER.format(c='g1_vs_g0')}, ':', {LETTER.format(c='g2_vs_g0')}) AS pattern FROM fx_calls
WHERE g1_vs_g0 IS NOT NULL AND g2_vs_g0 IS NOT NULL AND (g1_vs_g0 <> 0 OR g2_vs_g0 <> 0)"""


@query("de_pattern", "SELECT feature, pattern FROM fx_pattern")
def _(spark, sf):
    return detable.de_pattern(de_table(spark, sf), PAT)


@query("contrasts_de", "SELECT * FROM fx_changed")
def _(spark, sf):
    return detable.contrasts_de(de_table(spark, sf), PAT)


@query("diff_tags", """
SELECT g1_vs_g0, g2_vs_g0, COUNT(*) AS count, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, g1_vs_g0 NULLS LAST, g2_vs_g0 NULLS LAST) AS rank
FROM fx_calls GROUP BY g1_vs_g0, g2_vs_g0""")
def _(spark, sf):
    return detable.diff_tags(de_table(spark, sf), PAT)


VIEWS["fx_combos"] = """
SELECT g1_vs_g0, g2_vs_g0, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, g1_vs_g0 NULLS LAST, g2_vs_g0 NULLS LAST) AS grp
FROM fx_changed GROUP BY g1_vs_g0, g2_vs_g0"""


@query("contrasts_de_counts", """
SELECT grp AS "group", n AS count, 'g1_vs_g0' AS contrast, g1_vs_g0 AS de FROM fx_combos
UNION ALL SELECT grp AS "group", n AS count, 'g2_vs_g0' AS contrast, g2_vs_g0 AS de FROM fx_combos""")
def _(spark, sf):
    return detable.contrasts_de_counts(de_table(spark, sf), PAT)


@query("compare_des", """
SELECT a.g1_vs_g0 AS a_g1_vs_g0, a.g2_vs_g0 AS a_g2_vs_g0, b.g1_vs_g0 AS b_g1_vs_g0, b.g2_vs_g0 AS b_g2_vs_g0, COUNT(*) AS count
FROM fx_calls a JOIN fx_calls2 b ON b.feature = a.feature GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return detable.compare_des({"a": de_table(spark, sf), "b": de_table(spark, sf, 211)}, PAT)[2]


@query("compare_des_by_method", """
SELECT contrast, method, COUNT(*) FILTER (de = -1) AS down, COUNT(*) FILTER (de = 0) AS unchanged, COUNT(*) FILTER (de = 1) AS up, COUNT(*) FILTER (de IS NULL) AS untested
FROM (SELECT *, 'a' AS method FROM fx_det UNION ALL SELECT *, 'b' AS method FROM fx_det2) q GROUP BY contrast, method""")
def _(spark, sf):
    return detable.compare_des({"a": de_table(spark, sf), "b": de_table(spark, sf, 211)}, PAT)[1]


@query("compare_des_wide", """
SELECT a.feature, a.g1_vs_g0 AS a_g1_vs_g0, a.g2_vs_g0 AS a_g2_vs_g0, b.g1_vs_g0 AS b_g1_vs_g0, b.g2_vs_g0 AS b_g2_vs_g0
FROM fx_calls a JOIN fx_calls2 b ON b.feature = a.feature""")
def _(spark, sf):
    return detable.compare_des({"a": de_table(spark, sf), "b": de_table(spark, sf, 211)}, PAT)[0]


@query("venn_counts", """
SELECT a_g1, b_g1, COUNT(*) AS n FROM (
  SELECT a.feature, COALESCE(a.g1_vs_g0, 0) = 1 AS a_g1, COALESCE(b.g1_vs_g0, 0) = 1 AS b_g1, a.g1_vs_g0 AS x, b.g1_vs_g0 AS y
  FROM fx_calls a JOIN fx_calls2 b ON b.feature = a.feature) q
WHERE GREATEST(COALESCE(x, 0), COALESCE(y, 0)) > 0 AND LEAST(COALESCE(x, 0), COALESCE(y, 0)) >= 0 GROUP BY a_g1, b_g1""")
def _(spark, sf):
    wide = detable.compare_des({"a": de_table(spark, sf), "b": de_table(spark, sf, 211)}, ["g1_vs_g0"])[0]
    return detable.venn_counts(wide.toDF("feature", "a_g1", "b_g1"), direction=1)


VIEWS["fx_match"] = """
SELECT DISTINCT k.contrast, d.sample FROM fx_design d JOIN (
  SELECT 'g1_vs_g0' AS contrast, 'g1' AS coef UNION ALL SELECT 'g1_vs_g0', 'g0' UNION ALL SELECT 'g2_vs_g0', 'g2' UNION ALL SELECT 'g2_vs_g0', 'g0') k ON k.coef = d.coef WHERE d.value <> 0"""


@query("top_tags_counts", """
SELECT t.feature, t.contrast, t.rank, t.de, d.sample, d.raw_count FROM fx_det t JOIN fx_match m ON m.contrast = t.contrast
JOIN fx_dense d ON d.feature = t.feature AND d.sample = m.sample WHERE t.rank <= 50 AND t.de IN (1, -1)""")
def _(spark, sf):
    from countspark.operators.linear import design_matrix, make_contrasts

    design = design_matrix(fx.samples(spark, sf), ["grade"], intercept=False)
    match = joins.contrast_sample_match(design, make_contrasts(design, {"g1_vs_g0": "g1-g0", "g2_vs_g0": "g2-g0"}, prefix="grade"))
    out = detable.top_tags_counts(de_table(spark, sf), fx.counts(spark, sf), keep(match), value="raw_count")
    return out.select("feature", "contrast", "rank", "de", "sample", "raw_count")


@query("top_tags_pairs", """
SELECT t.feature, t.contrast, t.rank, p.subject, p.value_1, p.value_2 FROM fx_det t JOIN fx_pairs p ON p.feature = t.feature WHERE t.rank <= 50 AND t.de IN (1, -1)""")
def _(spark, sf):
    return detable.top_tags_pairs(de_table(spark, sf), pairs(spark, sf)).select("feature", "contrast", "rank", "subject", "value_1", "value_2")


@query("average_log2rpkm", """
SELECT c.feature, c.sample, c.raw_count, d.avg_log2cpm, ROUND(d.avg_log2cpm - LOG2(f.length_bp / 1000e0), 6) + 0e0 AS avg_log2rpkm FROM fx_counts c
LEFT JOIN (SELECT DISTINCT feature, avg_log2cpm FROM fx_det) d ON d.feature = c.feature LEFT JOIN fx_features f ON f.feature = c.feature""")
def _(spark, sf):
    """Both averages next to the counts."""
    de = nz.average_log2rpkm(de_table(spark, sf), fx.features(spark, sf)).withColumn("avg_log2rpkm", r6("avg_log2rpkm"))
    return joins.join_de_counts(fx.counts_plan(spark, sf), de, average=["avg_log2cpm", "avg_log2rpkm"])
