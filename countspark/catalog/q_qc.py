"""Queries for aggregations, quality summaries, ranks and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from countspark.catalog import inputs as fx
from countspark.catalog.q_tables import DE_COLS, de_table
from countspark.catalog.registry import VIEWS, query, r6
from countspark.functions.adjust import bh_adjust, holm_filter
from countspark.operators import detable, normalize as nz, qc, reshape
from countspark.session import keep, local_table, small


def token_samples(tokens):
    return tokens.select("sample").distinct()


@query("library_size", "SELECT sample, lib_size FROM fx_lib")
def _(spark, sf):
    return nz.library_size(fx.counts_plan(spark, sf))


@query("lib_norm_factor", "SELECT sample, lib_size, ROUND((SELECT AVG(lib_size) FROM fx_lib) / lib_size, 6) AS norm_factor FROM fx_lib")
def _(spark, sf):
    return nz.lib_norm_factor(fx.counts_plan(spark, sf)).withColumn("norm_factor", r6("norm_factor"))


PSEUDO = ["click", "purchase", "signup", "view"]
VIEWS["fx_alignment"] = """
SELECT sample, CAST(SUM(raw_count) AS BIGINT) AS total_count,
       CAST(SUM(CASE WHEN feature NOT LIKE '\\_\\_%' ESCAPE '\\' THEN raw_count ELSE 0 END) AS BIGINT) AS on_feature FROM fx_library GROUP BY sample"""


@query("alignment_summary", """
SELECT a.sample, a.total_count, a.on_feature, p.n_groups, p.reads FROM fx_alignment a
JOIN (SELECT sample, COUNT(*) AS n_groups, CAST(SUM(raw_count) AS BIGINT) AS reads FROM fx_pseudo GROUP BY sample) p ON p.sample = a.sample
WHERE a.sample IN (SELECT sample FROM fx_samples)""")
def _(spark, sf):
    out = qc.alignment_summary(fx.library_counts(spark, sf), fx.samples(spark, sf))
    groups = [c for c in out.columns if c not in ("sample", "total_count", "on_feature")]
    n = sum((F.col(g).isNotNull().cast("bigint") for g in groups), F.lit(0).cast("bigint"))
    reads = sum((F.coalesce(F.col(g), F.lit(0)) for g in groups), F.lit(0).cast("bigint"))
    return out.select("sample", "total_count", "on_feature", n.alias("n_groups"), reads.alias("reads"))


@query("alignment_summary_long", """
SELECT q.sample, q.total_count, q.read_group, q.read_count, ROUND(q.read_count / SUM(q.read_count) OVER (PARTITION BY q.sample), 6) AS fraction, s.cond, s.grade, s.subject
FROM (SELECT sample, total_count, 'on_feature' AS read_group, CAST(on_feature AS DOUBLE) AS read_count FROM fx_alignment
      UNION ALL SELECT p.sample, a.total_count, SUBSTR(p.feature, 3), CAST(p.raw_count AS DOUBLE) FROM fx_pseudo p JOIN fx_alignment a ON a.sample = p.sample) q
LEFT JOIN fx_samples s ON s.sample = q.sample""")
def _(spark, sf):
    sheet = fx.samples(spark, sf)
    long = qc.alignment_summary_long(qc.alignment_summary(fx.library_counts(spark, sf)), sheet, fractions=True)
    return long.withColumn("read_count", F.col("read_count").cast("double")).withColumn("fraction", F.round("fraction", 6))


@query("merge_technical_replicates", """
SELECT c.feature, CONCAT(s.cond, '.', s.grade) AS sample, CAST(SUM(c.raw_count) AS BIGINT) AS raw_count
FROM fx_counts c JOIN fx_samples s ON s.sample = c.sample GROUP BY 1, 2""")
def _(spark, sf):
    return qc.merge_technical_replicates(fx.counts_plan(spark, sf), fx.samples(spark, sf), ["cond", "grade"])[0]


VIEWS["fx_tag_summary"] = """
SELECT sample, CAST(MIN(raw_count) AS BIGINT) AS min, QUANTILE_CONT(raw_count, 0.5) AS median, CAST(MAX(raw_count) AS BIGINT) AS max,
       CAST(SUM(raw_count) AS BIGINT) AS sum, COUNT(*) - COUNT(raw_count) AS n_na, COUNT(*) FILTER (raw_count = 0) AS n_zero
FROM fx_dense GROUP BY sample"""


@query("tag_counts_summary", "SELECT sample, min, CAST(median AS DOUBLE) AS median, max, sum, n_na, n_zero FROM fx_tag_summary")
def _(spark, sf):
    counts = fx.counts(spark, sf)
    return qc.tag_counts_summary(counts, fx.samples(spark, sf), counts.select("feature").distinct().count())


@query("counts_box_data", "SELECT t.sample, t.min, CAST(t.median AS DOUBLE) AS median, t.max, t.sum, t.n_na, t.n_zero, s.cond, s.grade, s.subject FROM fx_tag_summary t JOIN fx_samples s ON s.sample = t.sample")
def _(spark, sf):
    counts = fx.counts(spark, sf)
    return qc.counts_box_data(counts, fx.samples(spark, sf), counts.select("feature").distinct().count())


@query("counts_dim", "SELECT COUNT(DISTINCT sample) AS n_samples, COUNT(DISTINCT feature) AS n_features FROM fx_tokens")
def _(spark, sf):
    return qc.counts_dim(fx.tokens_plan(spark, sf))


@query("features_per_chromosome", "SELECT CASE WHEN chromosome_name <> 'scaffold_1' THEN chromosome_name END AS chromosome_name, COUNT(*) AS n_features FROM fx_features GROUP BY 1")
def _(spark, sf):
    clean = fx.features(spark, sf).withColumn("chromosome_name", F.when(F.col("chromosome_name") != "scaffold_1", F.col("chromosome_name")))
    return qc.features_per_chromosome(clean)


@query("group_levels", """
SELECT variable, level, n_samples, COUNT(*) OVER (PARTITION BY variable) > 1 AS usable FROM (
  SELECT 'cond' AS variable, cond AS level, COUNT(*) AS n_samples FROM fx_samples GROUP BY cond
  UNION ALL SELECT 'grade', grade, COUNT(*) FROM fx_samples GROUP BY grade
  UNION ALL SELECT 'subject', CAST(subject AS VARCHAR), COUNT(*) FROM fx_samples GROUP BY subject) q""")
def _(spark, sf):
    return qc.group_levels(fx.samples(spark, sf))


@query("default_covariate", """
SELECT 1 AS n, 'grade' AS by_formula, CASE WHEN COUNT(DISTINCT cond) > 1 THEN 'cond' WHEN COUNT(DISTINCT grade) > 1 THEN 'grade' END AS by_levels FROM fx_samples
UNION ALL SELECT 2, 'cond', CASE WHEN COUNT(DISTINCT cond) > 1 AND COUNT(DISTINCT grade) > 1 THEN 'grade' END FROM fx_samples UNION ALL SELECT 4, NULL, NULL""")
def _(spark, sf):
    sheet = fx.samples(spark, sf)
    rows = [(n, qc.default_covariate(sheet, n, terms=["batch", "grade", "cond"]), qc.default_covariate(sheet, n)) for n in (1, 2, 4)]
    return local_table(spark, rows, "n int, by_formula string, by_levels string")


@query("refflat_annotation", """
SELECT f.feature, l.chr, l.strand, ROUND(l.mean_exons_num, 6) AS mean_exons_num, ROUND(l.mean_sum_exons_lengths, 6) AS mean_sum_exons_lengths, l.gene_start, l.gene_end
FROM fx_features f LEFT JOIN (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY gene ORDER BY chr, strand) AS i FROM (
    SELECT gene, chr, strand, AVG(exons_num) AS mean_exons_num, AVG(sum_exon_lengths) AS mean_sum_exons_lengths, MIN(gene_start) AS gene_start, MAX(gene_end) AS gene_end
    FROM fx_refflat GROUP BY gene, chr, strand) a) l ON l.gene = f.feature AND l.i = 1""")
def _(spark, sf):
    out = qc.refflat_annotation(fx.refflat(spark, sf), fx.features(spark, sf))
    return out.withColumn("mean_exons_num", F.round("mean_exons_num", 6)).withColumn("mean_sum_exons_lengths", F.round("mean_sum_exons_lengths", 6))


@query("gtf_transcript_summary", """
SELECT CONCAT('G', CAST(l_partkey % 300 AS VARCHAR)) AS gene_id, CONCAT('T', CAST(l_partkey AS VARCHAR)) AS transcript_id,
       CONCAT('chr', CAST(l_partkey % 5 AS VARCHAR)) AS seqname, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
       MIN(l_orderkey * 10) AS start, MAX(l_orderkey * 10 + CAST(l_quantity AS BIGINT)) AS "end", COUNT(*) AS n_exons,
       CAST(SUM(CAST(l_quantity AS BIGINT) + 1) AS BIGINT) AS sum_exon_lengths
FROM lineitem WHERE l_linenumber % 4 <> 0 AND l_partkey % 5 < 4 GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    k, start = F.col("l_partkey"), F.col("l_orderkey") * 10
    gtf = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("chr"), (k % 5).cast("string")).alias("seqname"), F.when(F.col("l_linenumber") % 4 == 0, "CDS").otherwise("exon").alias("type"),
        start.alias("start"), (start + F.col("l_quantity").cast("bigint")).alias("end"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"),
        F.format_string('gene_id "G%d"; transcript_id "T%d"; level 2;', k % 300, k).alias("attributes"))
    return qc.gtf_transcript_summary(gtf, chromosomes=[f"chr{i}" for i in range(4)])


@query("predicted_sex", """
SELECT sample, ROUND(o, 6) AS other_q05, ROUND(y, 6) AS y_median, CASE WHEN o >= 3 THEN CASE WHEN y < 3 THEN 'female' ELSE 'male' END END AS predicted_sex FROM (
  SELECT sample, QUANTILE_CONT(n, 0.05) FILTER (chromosome_name NOT IN ('Y', 'MT')) AS o, QUANTILE_CONT(n, 0.5) FILTER (chromosome_name = 'Y') AS y
  FROM (SELECT d.sample, f.chromosome_name, CASE WHEN f.chromosome_name = 'Y' AND d.sample % 2 = 1 THEN CAST(FLOOR(d.raw_count / 30e0) AS BIGINT) ELSE d.raw_count END AS n
        FROM fx_dense d JOIN fx_features f ON f.feature = d.feature) c GROUP BY sample) q""")
def _(spark, sf):
    features = fx.features(spark, sf)
    on_y = small(features.select("feature", (F.col("chromosome_name") == "Y").alias("on_y")))
    low = F.floor(F.col("raw_count") / 30).cast("bigint")
    counts = keep(fx.counts_plan(spark, sf).join(on_y, "feature").select(
        "feature", "sample", F.when(F.col("on_y") & (F.col("sample") % 2 == 1), low).otherwise(F.col("raw_count")).alias("raw_count")))
    out = qc.predicted_sex(counts, fx.samples(spark, sf), features, min_median=3)
    return out.select("sample", r6("other_q05").alias("other_q05"), r6("y_median").alias("y_median"), "predicted_sex")


@query("sex_marker_counts", """
SELECT c.feature, c.sample, c.raw_count, f.symbol, s.cond AS declared_sex FROM fx_dense c JOIN fx_features f ON f.feature = c.feature
JOIN fx_samples s ON s.sample = c.sample WHERE f.symbol IN ('Brand#11', 'Brand#23')""")
def _(spark, sf):
    out = qc.sex_marker_counts(fx.counts_plan(spark, sf), fx.samples(spark, sf), fx.features(spark, sf), genes=["Brand#11", "Brand#23"], sex="cond")
    return out.select("feature", "sample", "raw_count", "symbol", "declared_sex")


@query("gene_mean_var", "SELECT feature, ROUND(AVG(raw_count), 6) AS mean, ROUND(VAR_SAMP(raw_count), 6) AS variance FROM fx_dense GROUP BY feature")
def _(spark, sf):
    out = nz.row_moments(fx.counts_plan(spark, sf), "raw_count", fx.samples(spark, sf).count())
    return out.select("feature", r6("mean").alias("mean"), r6("variance").alias("variance"))


@query("gene_group_stats", """
SELECT feature, grade AS "group", COUNT(*) AS n, ROUND(MIN(log2cpm), 6) + 0e0 AS min, ROUND(QUANTILE_CONT(log2cpm, 0.25), 6) + 0e0 AS q25, ROUND(QUANTILE_CONT(log2cpm, 0.5), 6) + 0e0 AS median,
       ROUND(QUANTILE_CONT(log2cpm, 0.75), 6) + 0e0 AS q75, ROUND(MAX(log2cpm), 6) + 0e0 AS max
FROM fx_log2cpm JOIN fx_samples USING (sample)
WHERE feature IN (SELECT feature FROM fx_det WHERE p_value IS NOT NULL AND contrast = 'g1_vs_g0' ORDER BY p_value, feature LIMIT 100) GROUP BY feature, grade""")
def _(spark, sf):
    sheet = fx.samples(spark, sf)
    norm = nz.log2cpm(fx.counts(spark, sf), sheet)
    out = qc.gene_group_stats(norm, sheet, de_table(spark, sf).where("contrast = 'g1_vs_g0'"), value="log2cpm", group="grade")
    return out.select("feature", "group", "n", *[r6(c).alias(c) for c in ("min", "q25", "median", "q75", "max")])


@query("de_counts", "SELECT contrast, COUNT(*) FILTER (de = -1) AS down, COUNT(*) FILTER (de = 0) AS unchanged, COUNT(*) FILTER (de = 1) AS up FROM fx_det GROUP BY contrast")
def _(spark, sf):
    return qc.de_counts(de_table(spark, sf))


@query("de_status_counts", """
SELECT contrast, COUNT(*) FILTER (p_value < 0.05) AS n_p, COUNT(p_value) AS n_tested, COUNT(*) FILTER (adj_p < 0.05) AS n_adj_p,
       COUNT(*) FILTER (ABS(avg_log2fc) > 1) AS n_lfc FROM fx_det GROUP BY contrast""")
def _(spark, sf):
    return qc.de_status_counts(de_table(spark, sf))


@query("chr_de_counts", """
SELECT d.contrast, COALESCE(f.chromosome_name, 'NA') AS chromosome_name, COUNT(*) FILTER (d.de IN (-1, 1)) AS de_num, COUNT(*) AS all_num
FROM fx_det d LEFT JOIN fx_features f ON f.feature = d.feature GROUP BY 1, 2 HAVING COUNT(*) FILTER (d.de IN (-1, 1)) > 0""")
def _(spark, sf):
    return qc.chr_de_counts(de_table(spark, sf), fx.features(spark, sf))


@query("pvalue_histogram", """
SELECT contrast, CAST(GREATEST(1, CEIL(p_value * 20)) AS INT) AS bin, COUNT(*) AS n FROM fx_de WHERE p_value IS NOT NULL AND avg_log2cpm > 1 GROUP BY 1, 2""")
def _(spark, sf):
    return qc.pvalue_histogram(fx.de_raw(spark, sf))


@query("independent_filter_bins", """
SELECT q.contrast, q.bin, ROUND(AVG(CASE WHEN q.p_value < 0.05 THEN 1e0 ELSE 0e0 END), 6) AS share, COUNT(*) AS n FROM (
  SELECT d.contrast, d.p_value, LEN(LIST_FILTER(c.cuts, lambda x: x < d.avg_log2cpm)) AS bin
  FROM fx_de d JOIN (SELECT contrast, LIST_DISTINCT(QUANTILE_CONT(avg_log2cpm, [0, 1/6, 2/6, 3/6, 4/6, 5/6, 1])) AS cuts FROM fx_de GROUP BY contrast) c ON c.contrast = d.contrast) q
WHERE q.bin > 0 AND q.p_value IS NOT NULL GROUP BY q.contrast, q.bin""")
def _(spark, sf):
    out = qc.independent_filter_bins(fx.de_raw(spark, sf))
    return out.select("contrast", F.col("bin").cast("bigint").alias("bin"), r6("share").alias("share"), "n")


@query("value_histogram", """
SELECT CAST(LEAST(40, GREATEST(1, CEIL((raw_count - low) / ((high - low) / 40e0)))) AS INT) AS bin, COUNT(*) AS n
FROM fx_counts CROSS JOIN (SELECT CAST(MIN(raw_count) AS DOUBLE) AS low, CAST(MAX(raw_count) AS DOUBLE) AS high FROM fx_counts) r GROUP BY 1""")
def _(spark, sf):
    return qc.value_histogram(fx.counts(spark, sf), "raw_count", bins=40)


@query("value_histogram_range", """
SELECT CASE WHEN raw_count < 20 THEN 0 WHEN raw_count > 60 THEN 9 ELSE CAST(GREATEST(1, CEIL((raw_count - 20) / 5e0)) AS INT) END AS bin, COUNT(*) AS n FROM fx_counts GROUP BY 1""")
def _(spark, sf):
    return qc.value_histogram(fx.counts_plan(spark, sf), "raw_count", bins=8, low=20, high=60)


VIEWS["fx_token_values"] = """
SELECT sample, LOG10(raw_count) AS v, COUNT(*) AS times FROM fx_tokens GROUP BY sample, raw_count
UNION ALL SELECT sample, LOG10(0.5e0), (SELECT COUNT(DISTINCT feature) FROM fx_tokens) - COUNT(*) FROM fx_tokens GROUP BY sample"""
VIEWS["fx_token_quart"] = """
SELECT sample, MAX(v) FILTER (lo1) + (MAX(n) - 1) * 0.25e0 % 1 * (MAX(v) FILTER (hi1) - MAX(v) FILTER (lo1)) AS q1,
       MAX(v) FILTER (lo3) + (MAX(n) - 1) * 0.75e0 % 1 * (MAX(v) FILTER (hi3) - MAX(v) FILTER (lo3)) AS q3 FROM (
  SELECT sample, v, n, upto - times <= FLOOR((n - 1) * 0.25e0) AND FLOOR((n - 1) * 0.25e0) < upto AS lo1, upto - times <= CEIL((n - 1) * 0.25e0) AND CEIL((n - 1) * 0.25e0) < upto AS hi1,
         upto - times <= FLOOR((n - 1) * 0.75e0) AND FLOOR((n - 1) * 0.75e0) < upto AS lo3, upto - times <= CEIL((n - 1) * 0.75e0) AND CEIL((n - 1) * 0.75e0) < upto AS hi3
  FROM (SELECT *, SUM(times) OVER (PARTITION BY sample ORDER BY v) AS upto, SUM(times) OVER (PARTITION BY sample) AS n FROM fx_token_values WHERE times > 0) a) b GROUP BY sample"""
VIEWS["fx_bandwidth"] = """
SELECT s.sample, s.n, 0.9e0 * CASE WHEN q3 > q1 THEN LEAST(sd, (q3 - q1) / 1.34e0) ELSE sd END * POWER(n, -0.2e0) * SQRT(3e0) AS h FROM (
  SELECT sample, SUM(times) AS n, SQRT((SUM(times * v * v) - SUM(times * v) * SUM(times * v) / SUM(times)) / (SUM(times) - 1)) AS sd FROM fx_token_values GROUP BY sample) s
JOIN fx_token_quart q ON q.sample = s.sample"""


@query("count_density", """
SELECT b.sample AS "group", ROUND(g.lo + g.i * (g.hi - g.lo) / 511, 5) AS x, ROUND(COALESCE(SUM(v.times), 0) / (MAX(b.n) * 2 * MAX(b.h)), 4) AS density
FROM fx_bandwidth b CROSS JOIN (SELECT lo, hi, UNNEST(RANGE(0, 512)) AS i FROM (SELECT MIN(v) AS lo, MAX(v) AS hi FROM fx_token_values WHERE times > 0) r) g
LEFT JOIN fx_token_values v ON v.sample = b.sample AND v.v BETWEEN g.lo + g.i * (g.hi - g.lo) / 511 - b.h AND g.lo + g.i * (g.hi - g.lo) / 511 + b.h
GROUP BY b.sample, g.i, g.lo, g.hi""")
def _(spark, sf):
    out = qc.count_density(fx.tokens(spark, sf), "raw_count", log10=True, zero=0.5)
    return out.select("group", r6("x", 5).alias("x"), r6("density", 4).alias("density"))


VIEWS["fx_hex_points"] = """
SELECT feature, 'raw' AS transformation, MAX(CASE WHEN sample = 0 THEN CAST(raw_count AS DOUBLE) ELSE 0e0 END) AS x, MAX(CASE WHEN sample = 1 THEN CAST(raw_count AS DOUBLE) ELSE 0e0 END) AS y
FROM fx_counts WHERE sample IN (0, 1) GROUP BY feature
UNION ALL SELECT feature, 'log2cpm', MAX(log2cpm) FILTER (sample = 0), MAX(log2cpm) FILTER (sample = 1) FROM fx_log2cpm GROUP BY feature"""
VIEWS["fx_hex_scaled"] = """
SELECT transformation, (x - MIN(x) OVER w) / GREATEST((MAX(x) OVER w - MIN(x) OVER w) / 80, 1e-12) AS sx,
       (y - MIN(y) OVER w) / (GREATEST((MAX(y) OVER w - MIN(y) OVER w) / 80, 1e-12) * SQRT(3e0)) AS sy FROM fx_hex_points WINDOW w AS (PARTITION BY transformation)"""


@query("hex_bins", """
SELECT transformation, CAST(CASE WHEN even THEN 2 * FLOOR(sx + 0.5e0) ELSE 2 * FLOOR(sx) + 1 END AS BIGINT) AS hex_x,
       CAST(CASE WHEN even THEN 2 * FLOOR(sy + 0.5e0) ELSE 2 * FLOOR(sy) + 1 END AS BIGINT) AS hex_y, COUNT(*) AS n
FROM (SELECT *, POWER(sx - FLOOR(sx + 0.5e0), 2) + 3 * POWER(sy - FLOOR(sy + 0.5e0), 2) <= POWER(sx - FLOOR(sx) - 0.5e0, 2) + 3 * POWER(sy - FLOOR(sy) - 0.5e0, 2) AS even
      FROM fx_hex_scaled) q GROUP BY 1, 2, 3""")
def _(spark, sf):
    sheet = fx.samples(spark, sf)
    counts = fx.counts(spark, sf)
    wide = lambda df, v, label: reshape.spread_counts(df.where("sample IN (0, 1)"), v, [0, 1], fill=0.0).select(
        "feature", F.col("`0`").cast("double").alias("x"), F.col("`1`").cast("double").alias("y"), F.lit(label).alias("transformation"))
    both = wide(counts, "raw_count", "raw").unionByName(wide(nz.log2cpm(counts, sheet), "log2cpm", "log2cpm"))
    return qc.hex_bins(keep(both), "x", "y", by="transformation")


# --- windows, ranks and top-k -----------------------------------------------------------------------------------------

@query("complexity_curve", """
SELECT sample, feature, raw_count, rank, ROUND(c / n, 6) AS fraction FROM (
  SELECT *, ROW_NUMBER() OVER w AS rank, SUM(raw_count) OVER (w ROWS UNBOUNDED PRECEDING) AS c, SUM(raw_count) OVER (PARTITION BY sample) AS n
  FROM (SELECT f.feature, s.sample, COALESCE(t.raw_count, 0) AS raw_count FROM (SELECT DISTINCT feature FROM fx_tokens) f CROSS JOIN fx_token_samples s
        LEFT JOIN fx_tokens t ON t.feature = f.feature AND t.sample = s.sample) d WINDOW w AS (PARTITION BY sample ORDER BY raw_count DESC, feature)) q WHERE rank <= 1000""")
def _(spark, sf):
    return qc.complexity_curve(fx.tokens(spark, sf)).withColumn("fraction", r6("fraction"))


@query("complexity_curve_short", """
SELECT sample, feature, raw_count, rank, ROUND(c / n, 6) AS fraction FROM (
  SELECT *, ROW_NUMBER() OVER w AS rank, SUM(raw_count) OVER (w ROWS UNBOUNDED PRECEDING) AS c, SUM(raw_count) OVER (PARTITION BY sample) AS n
  FROM fx_dense WINDOW w AS (PARTITION BY sample ORDER BY raw_count DESC, feature)) q WHERE rank <= 1500""")
def _(spark, sf):
    """More ranks than a sample has features with reads."""
    return qc.complexity_curve(fx.counts(spark, sf), max_rank=1500).withColumn("fraction", r6("fraction"))


@query("complexity_curve_full", """
SELECT sample, feature, raw_count, rank, ROUND(c / n, 6) AS fraction FROM (
  SELECT *, ROW_NUMBER() OVER w AS rank, SUM(raw_count) OVER (w ROWS UNBOUNDED PRECEDING) AS c, SUM(raw_count) OVER (PARTITION BY sample) AS n
  FROM fx_counts WINDOW w AS (PARTITION BY sample ORDER BY raw_count DESC, feature)) q""")
def _(spark, sf):
    return qc.complexity_curve(fx.counts(spark, sf), max_rank=None).withColumn("fraction", r6("fraction"))


@query("frequent_tags", """
WITH held AS (SELECT feature, sample, raw_count, RANK() OVER (PARTITION BY sample ORDER BY raw_count DESC) AS rank, raw_count / SUM(raw_count) OVER (PARTITION BY sample) AS share
    FROM fx_tokens WHERE raw_count > 0),
  chosen AS (SELECT DISTINCT feature FROM held WHERE share >= 0.01),
  totals AS (SELECT s.sample, COUNT(h.feature) AS met FROM fx_token_samples s LEFT JOIN held h ON h.sample = s.sample GROUP BY s.sample)
SELECT t.sample, c.feature, COALESCE(h.raw_count, 0) AS raw_count, COALESCE(h.rank, t.met + 1) AS rank, CASE WHEN t.met > 0 THEN ROUND(COALESCE(h.share, 0), 6) END AS fraction
FROM chosen c CROSS JOIN totals t LEFT JOIN held h ON h.feature = c.feature AND h.sample = t.sample""")
def _(spark, sf):
    return qc.frequent_tags(fx.tokens(spark, sf)).withColumn("fraction", r6("fraction"))


@query("de_rank", "SELECT feature, contrast, rank FROM fx_det")
def _(spark, sf):
    return detable.de_rank(bh_adjust(fx.de_raw(spark, sf))).select("feature", "contrast", "rank")


@query("bh_adjust", "SELECT feature, contrast, ROUND(adj_p, 9) AS adj_p FROM fx_det")
def _(spark, sf):
    return bh_adjust(fx.de_raw(spark, sf)).select("feature", "contrast", F.round("adj_p", 9).alias("adj_p"))


VIEWS["fx_set_p"] = "SELECT s.set_id, d.contrast, MIN(d.p_value) AS p_value FROM fx_det d JOIN fx_sets s ON s.feature = d.feature GROUP BY s.set_id, d.contrast"


@query("holm_filter", """
SELECT set_id, contrast, ROUND(adj, 9) AS adj_p FROM (
  SELECT *, LEAST(1e0, MAX(p_value * (n - rk + 1)) OVER (PARTITION BY contrast ORDER BY p_value, set_id)) AS adj FROM (
    SELECT *, COUNT(*) OVER (PARTITION BY contrast) AS n, ROW_NUMBER() OVER (PARTITION BY contrast ORDER BY p_value, set_id) AS rk FROM fx_set_p) a) b
WHERE adj <= 0.05""")
def _(spark, sf):
    best = de_table(spark, sf).join(small(fx.gene_sets(spark, sf)), "feature").groupBy("set_id", "contrast").agg(F.min("p_value").alias("p_value"))
    return holm_filter(best).select("set_id", "contrast", F.round("adj_p", 9).alias("adj_p"))


@query("top_tags", f"SELECT {DE_COLS}, de, rank FROM fx_det WHERE rank <= 50 AND de IN (1, -1)")
def _(spark, sf):
    out = detable.top_tags(de_table(spark, sf), contrasts=fx.CONTRASTS)
    return out.select("feature", "contrast", r6("avg_log2fc").alias("avg_log2fc"), F.round("adj_p", 9).alias("adj_p"), "de", "rank")


@query("top_variable_features", "SELECT feature, ROUND(VAR_SAMP(raw_count), 6) AS variance FROM fx_dense GROUP BY feature ORDER BY VAR_SAMP(raw_count) DESC, feature LIMIT 50")
def _(spark, sf):
    top = detable.top_variable_features(nz.row_moments(fx.counts_plan(spark, sf), "raw_count", fx.samples(spark, sf).count()), 50)
    return top.select("feature", r6("variance").alias("variance"))


@query("strongest_regulation", """
SELECT * FROM (SELECT feature, contrast, ROUND(avg_log2fc, 6) + 0e0 AS avg_log2fc, 'up' AS side FROM fx_det WHERE adj_p < 0.05 ORDER BY fx_det.avg_log2fc DESC, feature, contrast LIMIT 6) a
UNION ALL SELECT * FROM (SELECT feature, contrast, ROUND(avg_log2fc, 6) + 0e0 AS avg_log2fc, 'down' AS side FROM fx_det WHERE adj_p < 0.05 ORDER BY fx_det.avg_log2fc, feature, contrast LIMIT 6) b""")
def _(spark, sf):
    de = de_table(spark, sf)
    side = lambda up: detable.strongest_regulation(de, up=up).select("feature", "contrast", r6("avg_log2fc").alias("avg_log2fc"), F.lit("up" if up else "down").alias("side"))
    return side(True).unionByName(side(False))


@query("best_gene_counts", """
SELECT c.feature, c.sample, s.grade AS "group", ROUND(c.raw_count / f.size_factor, 6) AS norm_count FROM fx_dense c JOIN fx_samples s ON s.sample = c.sample
JOIN fx_size_factors f ON f.sample = c.sample
WHERE c.feature = (SELECT feature FROM fx_det WHERE adj_p IS NOT NULL ORDER BY adj_p, p_value, feature LIMIT 1)""")
def _(spark, sf):
    counts, sheet = fx.counts(spark, sf), fx.samples(spark, sf)
    norm = nz.normalized_counts(counts, keep(nz.size_factors(counts, sheet.count())))
    out = detable.best_gene_counts(de_table(spark, sf), norm, sheet, value="norm_count", group="grade")
    return out.withColumn("norm_count", r6("norm_count"))


@query("top_n_rows", "SELECT feature, contrast, ROUND(p_value, 9) AS p_value FROM fx_de ORDER BY fx_de.p_value NULLS LAST, feature, contrast LIMIT 150")
def _(spark, sf):
    return detable.top_n_rows(fx.de_raw(spark, sf), 150, by=["p_value", "feature", "contrast"]).select("feature", "contrast", F.round("p_value", 9).alias("p_value"))


@query("fdr_curve", """
SELECT contrast, feature, i, ROUND(adj_p, 9) AS adj_p, ROUND(i / n, 9) AS line FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY contrast ORDER BY adj_p, p_value, feature) AS i, COUNT(*) OVER (PARTITION BY contrast) AS n FROM fx_det WHERE adj_p IS NOT NULL) q""")
def _(spark, sf):
    return detable.fdr_curve(de_table(spark, sf)).withColumn("adj_p", F.round("adj_p", 9)).withColumn("line", F.round("line", 9))


@query("center_rows", "SELECT feature, sample, ROUND(log2cpm - AVG(log2cpm) OVER (PARTITION BY feature), 6) + 0e0 AS centered FROM fx_log2cpm")
def _(spark, sf):
    norm = keep(nz.log2cpm(fx.counts(spark, sf), fx.samples(spark, sf)))
    return nz.center_rows(norm, "log2cpm").withColumn("centered", r6("centered"))


VIEWS["fx_zscores"] = """
SELECT feature, sample, CASE WHEN STDDEV_SAMP(raw_count) OVER w > 0 THEN (raw_count - AVG(raw_count) OVER w) / STDDEV_SAMP(raw_count) OVER w END AS z
FROM fx_dense WINDOW w AS (PARTITION BY feature)"""


@query("zscore_rows", "SELECT feature, sample, ROUND(z, 6) + 0e0 AS z FROM fx_zscores")
def _(spark, sf):
    dense = keep(reshape.zero_fill(fx.counts_plan(spark, sf), None, fx.samples(spark, sf)))
    return nz.zscore_rows(dense, "raw_count").withColumn("z", r6("z"))


@query("heatmap_data", """
SELECT n.feature, n.sample, ROUND(n.log2cpm - d.avg_log2cpm, 6) + 0e0 AS diff FROM fx_log2cpm n
JOIN (SELECT DISTINCT feature, avg_log2cpm FROM fx_det WHERE feature IN (SELECT feature FROM fx_hits)) d ON d.feature = n.feature""")
def _(spark, sf):
    norm = nz.log2cpm(fx.counts(spark, sf), fx.samples(spark, sf))
    return detable.heatmap_data(norm, de_table(spark, sf), value="log2cpm").withColumn("diff", r6("diff"))


@query("de_call", "SELECT feature, contrast, de FROM fx_det")
def _(spark, sf):
    return detable.de_call(bh_adjust(fx.de_raw(spark, sf))).select("feature", "contrast", "de")
