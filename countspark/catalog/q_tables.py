"""Queries for sources, sinks, reshaping, selection and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from countspark.catalog import inputs as fx
from countspark.catalog.registry import VIEWS, query, r6
from countspark.functions.rows import sample_names
from countspark.model import Experiment
from countspark.operators import detable, filters, normalize as nz, qc, reshape
from countspark.session import keep, new_path, small
from countspark.sources import delimited, sinks

def de_table(spark, sf, shift=0):
    """Adjusted, called and ranked synthetic result table."""
    return keep(detable.de_table(fx.de_raw(spark, sf, shift)))


def experiment(spark, sf):
    return Experiment(counts=fx.counts(spark, sf), samples=fx.samples(spark, sf), features=fx.features(spark, sf))


def wide_counts(spark, sf):
    """Wide matrix with lengths: ``feature``, ``length_bp`` and one column per sample."""
    cells = reshape.spread_counts(fx.counts_plan(spark, sf), "raw_count", sample_names(fx.samples(spark, sf)), fill=0)
    return cells.join(small(fx.features(spark, sf).select("feature", "length_bp")), "feature")


DENSE_TEXT = "SELECT CAST(feature AS VARCHAR) AS feature, CAST(sample AS VARCHAR) AS sample, raw_count FROM fx_dense"


@query("read_wide_counts", DENSE_TEXT)
def _(spark, sf):
    path = new_path(spark)
    sinks.write_table(wide_counts(spark, sf), path, fmt="tab.gz")
    return delimited.read_wide_counts(spark, path, id_col="feature", length_col="length_bp")


@query("read_sample_sheet", "SELECT CAST(sample AS VARCHAR) AS sample, cond, grade, CAST(subject AS VARCHAR) AS subject FROM fx_samples")
def _(spark, sf):
    path = new_path(spark)
    fx.samples(spark, sf).write.csv(path, sep=";", header=True)
    return delimited.read_sample_sheet(spark, path, sep=";")


@query("read_long_counts", "SELECT feature, sample, raw_count FROM fx_counts WHERE sample = 3 AND raw_count > 50")
def _(spark, sf):
    path = new_path(spark)
    sinks.write_table(fx.counts_plan(spark, sf), path, fmt="parquet")
    cells = delimited.read_long_counts(spark, path, schema="feature bigint, sample int, raw_count bigint")
    return cells.where("sample = 3 AND raw_count > 50")


@query("split_length_column", """
SELECT CAST(d.feature AS VARCHAR) AS feature, CAST(d.sample AS VARCHAR) AS sample, d.raw_count, CAST(f.length_bp AS INT) AS length_bp
FROM fx_dense d JOIN fx_features f ON f.feature = d.feature""")
def _(spark, sf):
    path = new_path(spark)
    sinks.write_table(wide_counts(spark, sf), path, fmt="tab")
    counts, features = delimited.split_length_column(delimited.read_wide(spark, path), id_col="feature", length_col="length_bp")
    return counts.join(features, "feature")


VIEWS["fx_big"] = "SELECT feature FROM fx_library WHERE feature NOT LIKE '\\_\\_%' ESCAPE '\\' GROUP BY feature HAVING SUM(ABS(raw_count)) > 1"


@query("experiment_from_counts", """
SELECT l.feature, l.sample, l.raw_count, a.total_count, a.on_feature, a.on_feature - k.kept AS dropped_reads
FROM fx_library l JOIN fx_big b ON b.feature = l.feature
JOIN (SELECT sample, CAST(SUM(raw_count) AS BIGINT) AS total_count,
             CAST(SUM(CASE WHEN feature NOT LIKE '\\_\\_%' ESCAPE '\\' THEN raw_count ELSE 0 END) AS BIGINT) AS on_feature
      FROM fx_library GROUP BY sample) a ON a.sample = l.sample
JOIN (SELECT sample, CAST(SUM(raw_count) AS BIGINT) AS kept FROM fx_library WHERE feature IN (SELECT feature FROM fx_big) GROUP BY sample) k
  ON k.sample = l.sample""")
def _(spark, sf):
    exp = qc.experiment_from_counts(fx.library_counts(spark, sf), fx.samples(spark, sf))
    kept = exp.counts.groupBy("sample").agg(F.sum("raw_count").alias("kept"))
    per = small(exp.alignment.join(small(kept), "sample").select("sample", "total_count", "on_feature", (F.col("on_feature") - F.col("kept")).alias("dropped_reads")))
    return exp.counts.join(per, "sample").select("feature", "sample", "raw_count", "total_count", "on_feature", "dropped_reads")


@query("validate_sample_match", "SELECT sample FROM fx_samples WHERE sample NOT IN (SELECT sample FROM fx_counts WHERE raw_count > 240)")
def _(spark, sf):
    return qc.validate_sample_match(fx.counts_plan(spark, sf).where("raw_count > 240"), fx.samples(spark, sf))


@query("validate_empty_level", "SELECT sample, 'grade' AS variable FROM fx_samples WHERE grade = 'g1'")
def _(spark, sf):
    sheet = fx.samples(spark, sf).withColumn("grade", F.when(F.col("grade") == "g1", " ").otherwise(F.col("grade")))
    return qc.validate_empty_level(sheet, ["cond", "grade"])


@query("validate_duplicate_features", """
SELECT l_partkey AS feature, CAST(l_suppkey % 12 AS INT) AS sample, COUNT(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def _(spark, sf):
    raw = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("feature"), (F.col("l_suppkey") % 12).cast("int").alias("sample"))
    return qc.validate_duplicate_features(raw)


@query("write_table", "SELECT CAST(feature AS VARCHAR) AS feature, CAST(sample AS VARCHAR) AS sample, CAST(raw_count AS VARCHAR) AS raw_count FROM fx_counts")
def _(spark, sf):
    path = new_path(spark)
    sinks.write_table(fx.counts_plan(spark, sf), path, fmt="tab.gz")
    return delimited.read_wide(spark, path)


def _cells(wide, ids=("feature",)):
    """A wide table as rows, whatever samples it has; empty cells stay."""
    names = [c for c in wide.columns if c not in ids]
    return wide.unpivot(list(ids), [f"`{c}`" for c in names], "sample", "value")


@query("write_wide_matrix", "SELECT CAST(feature AS VARCHAR) AS feature, CAST(sample AS VARCHAR) AS sample, CAST(raw_count AS VARCHAR) AS value FROM fx_dense")
def _(spark, sf):
    path = new_path(spark)
    sinks.write_wide_matrix(fx.counts_plan(spark, sf), path, "raw_count", samples=sample_names(fx.samples(spark, sf)), fmt="tab")
    return _cells(spark.read.csv(path, sep="\t", header=True, nullValue="NA"))


@query("write_de_report", """
SELECT CAST(d.feature AS VARCHAR) AS feature, d.contrast, CAST(d.rank AS VARCHAR) AS rank, COUNT(*) AS n_cells, ROUND(SUM(cpm), 4) AS sum_cpm
FROM fx_det d JOIN fx_cpm c ON c.feature = d.feature GROUP BY d.feature, d.contrast, d.rank""")
def _(spark, sf):
    path = new_path(spark)
    sinks.write_de_report(de_table(spark, sf), nz.cpm(fx.counts(spark, sf)), path, fmt="tab.gz")
    de, norm = delimited.read_wide(spark, f"{path}/de"), delimited.read_wide(spark, f"{path}/normalised")
    sums = norm.groupBy("feature").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum(F.col("cpm").cast("double")), 4).alias("sum_cpm"))
    return de.join(sums, "feature").select("feature", "contrast", "rank", "n_cells", "sum_cpm")


@query("write_comparison_report", """
SELECT 'by_method' AS part, CONCAT(contrast, '|', method, '|', COUNT(*) FILTER (de = -1), '|', COUNT(*) FILTER (de = 0), '|', COUNT(*) FILTER (de = 1), '|', COUNT(*) FILTER (de IS NULL)) AS line
FROM (SELECT *, 'a' AS method FROM fx_det UNION ALL SELECT *, 'b' AS method FROM fx_det2) q GROUP BY contrast, method
UNION ALL SELECT 'de a', CONCAT(feature, '|', contrast, '|', rank, '|', COALESCE(CAST(de AS VARCHAR), 'NA')) FROM fx_det
UNION ALL SELECT 'de b', CONCAT(feature, '|', contrast, '|', rank, '|', COALESCE(CAST(de AS VARCHAR), 'NA')) FROM fx_det2
UNION ALL SELECT 'calls', CONCAT(feature, '|', calls) FROM fx_both_calls
UNION ALL SELECT 'by_consistency', CONCAT(calls, '|', COUNT(*)) FROM fx_both_calls GROUP BY calls""")
def _(spark, sf):
    tables = {"a": de_table(spark, sf), "b": de_table(spark, sf, 211)}
    path = new_path(spark)
    sinks.write_comparison_report(tables, detable.compare_des(tables, fx.CONTRASTS), path, fmt="tab")
    back = lambda name: delimited.read_wide(spark, f"{path}/{name}")
    out = back("by_method").select(F.lit("by_method").alias("part"), F.concat_ws("|", "contrast", "method", "down", "unchanged", "up", "untested").alias("line"))
    for method in tables:
        rows = back(f"{method}/de").select("feature", "contrast", "rank", F.coalesce("de", F.lit("NA")).alias("de"))
        out = out.unionByName(rows.select(F.lit(f"de {method}").alias("part"), F.concat_ws("|", "feature", "contrast", "rank", "de").alias("line")))
    for name in ("calls", "by_consistency"):
        rows = back(name)
        out = out.unionByName(rows.select(F.lit(name).alias("part"), F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`"), F.lit("NA")) for c in rows.columns]).alias("line")))
    return out


@query("gsea_export", """
SELECT CAST(d.feature AS VARCHAR) AS feature, UPPER(f.symbol) AS symbol, CAST(d.sample AS VARCHAR) AS sample, ROUND(d.raw_count * 1e6 / l.lib_size, 2) AS value
FROM fx_dense d JOIN fx_lib l ON l.sample = d.sample JOIN fx_features f ON f.feature = d.feature
WHERE d.feature IN (SELECT feature FROM fx_det WHERE adj_p < 0.05 AND ABS(avg_log2fc) > 1) AND f.symbol IS NOT NULL""")
def _(spark, sf):
    path = new_path(spark)
    sinks.gsea_export(nz.cpm(fx.counts(spark, sf)), "cpm", de_table(spark, sf), fx.features(spark, sf), path, samples=sample_names(fx.samples(spark, sf)))
    back = _cells(spark.read.csv(path, sep="\t", header=True, nullValue="NA"), ("feature", "symbol"))
    return back.withColumn("value", F.col("value").cast("double"))


# --- reshape and predicates -------------------------------------------------------------------------------------------

VIEWS["fx_lib"] = "SELECT sample, CAST(SUM(raw_count) AS BIGINT) AS lib_size FROM fx_counts GROUP BY sample"
VIEWS["fx_cpm"] = "SELECT c.feature, c.sample, c.raw_count * 1e6 / l.lib_size AS cpm FROM fx_counts c JOIN fx_lib l ON l.sample = c.sample"
VIEWS["fx_log2cpm"] = """
SELECT d.feature, d.sample, LOG2((d.raw_count + 2e0 * l.lib_size / m.mean_lib) / (l.lib_size + 4e0 * l.lib_size / m.mean_lib) * 1e6) AS log2cpm
FROM fx_dense d JOIN fx_lib l ON l.sample = d.sample CROSS JOIN (SELECT AVG(lib_size) AS mean_lib FROM fx_lib) m"""


@query("melt_counts", "SELECT feature, CAST(sample AS VARCHAR) AS sample, raw_count FROM fx_dense")
def _(spark, sf):
    wide = wide_counts(spark, sf)
    return reshape.melt_counts(wide, "feature", [c for c in wide.columns if c not in ("feature", "length_bp")])


@query("spread_counts", """
SELECT d.feature, CAST(d.sample AS VARCHAR) AS sample, c.raw_count AS value FROM fx_dense d LEFT JOIN fx_counts c ON c.feature = d.feature AND c.sample = d.sample""")
def _(spark, sf):
    return _cells(reshape.spread_counts(fx.counts_plan(spark, sf), "raw_count", sample_names(fx.samples(spark, sf))))


@query("zero_fill", "SELECT feature, sample, raw_count FROM fx_dense")
def _(spark, sf):
    return reshape.zero_fill(fx.counts_plan(spark, sf), None, fx.samples(spark, sf))


@query("counts_data", """
SELECT c.feature, c.sample, c.raw_count, s.cond, s.grade, s.subject, CASE WHEN s.cond = 'case' THEN 1 ELSE 0 END AS x_case, 1 AS x_all,
       CAST(a.total_count AS BIGINT) AS total_count, f.symbol, f.length_bp
FROM fx_counts c JOIN fx_samples s ON s.sample = c.sample JOIN fx_features f ON f.feature = c.feature
JOIN (SELECT sample, SUM(raw_count) AS total_count FROM fx_library GROUP BY sample) a ON a.sample = c.sample""")
def _(spark, sf):
    sheet = fx.samples(spark, sf)
    design = sheet.select("sample", F.explode(F.array(
        F.struct(F.lit("x_all").alias("coef"), F.lit(1).alias("value")),
        F.struct(F.lit("x_case").alias("coef"), F.when(F.col("cond") == "case", 1).otherwise(0).alias("value")))).alias("d")).select("sample", "d.*")
    exp = Experiment(counts=fx.counts_plan(spark, sf), samples=sheet, design=design,
                     features=fx.features(spark, sf).select("feature", "symbol", "length_bp"),
                     alignment=qc.alignment_summary(fx.library_counts(spark, sf)).select("sample", "total_count"))
    return reshape.counts_data(exp, sheet=True, design=True, alignment=True, annotations=True)


@query("counts_data_norm", """
SELECT d.feature, d.sample, d.raw_count, ROUND(n.log2cpm, 6) + 0e0 AS log2cpm, ROUND(n.log2cpm - LOG2(f.length_bp / 1000e0), 6) + 0e0 AS log2rpkm
FROM fx_dense d JOIN fx_log2cpm n ON n.feature = d.feature AND n.sample = d.sample JOIN fx_features f ON f.feature = d.feature""")
def _(spark, sf):
    exp = experiment(spark, sf)
    out = reshape.counts_data_norm(exp, nz.log2cpm(exp.counts, exp.samples), length_col="length_bp")
    return out.select("feature", "sample", "raw_count", r6("log2cpm").alias("log2cpm"), r6("log2rpkm").alias("log2rpkm"))


@query("counts_replace_zero", "SELECT feature, sample, CASE WHEN raw_count = 0 THEN 0.5e0 ELSE CAST(raw_count AS DOUBLE) END AS raw_count FROM fx_dense WHERE feature % 3 = 0 OR raw_count < 5")
def _(spark, sf):
    dense = reshape.zero_fill(fx.counts_plan(spark, sf), None, fx.samples(spark, sf))
    return reshape.counts_replace_zero(dense, fn=lambda d: d.where("feature % 3 = 0 OR raw_count < 5"))


@query("select_features", """
SELECT a.sample, CAST(a.on_feature - COALESCE(r.lost, 0) AS BIGINT) AS on_feature, CAST(COALESCE(r.lost, 0) AS BIGINT) AS on_removed_features, k.n AS n_cells
FROM (SELECT sample, SUM(raw_count) AS on_feature FROM fx_counts GROUP BY sample) a
LEFT JOIN (SELECT sample, SUM(raw_count) AS lost FROM fx_counts WHERE feature IN (SELECT feature FROM fx_features WHERE chromosome_name = 'MT') GROUP BY sample) r ON r.sample = a.sample
JOIN (SELECT sample, COUNT(*) AS n FROM fx_counts WHERE feature NOT IN (SELECT feature FROM fx_features WHERE chromosome_name = 'MT') GROUP BY sample) k ON k.sample = a.sample""")
def _(spark, sf):
    exp = experiment(spark, sf)
    exp = exp.but(alignment=keep(qc.alignment_summary(exp.counts.withColumn("feature", F.col("feature").cast("string")))))
    out = filters.select_features(exp, exp.features.where("chromosome_name = 'MT'"), remove=True)
    cells = out.counts.groupBy("sample").agg(F.count(F.lit(1)).alias("n_cells"))
    return out.alignment.join(small(cells), "sample").select("sample", "on_feature", "on_removed_features", "n_cells")


@query("select_feature_list", "SELECT feature, sample, raw_count FROM fx_counts WHERE feature IN (3, 14, 15, 92, 653)")
def _(spark, sf):
    return filters.select_feature_list(fx.counts_plan(spark, sf), [3, 14, 15, 92, 653])


@query("filter_features_by_annotation", """
SELECT feature, sample, raw_count FROM fx_counts WHERE feature IN
  (SELECT c.feature FROM fx_counts c JOIN fx_features f ON f.feature = c.feature WHERE f.chromosome_name = 'X' AND c.raw_count > 150)""")
def _(spark, sf):
    return filters.filter_features_by_annotation(experiment(spark, sf), lambda d: d.where("chromosome_name = 'X' AND raw_count > 150")).counts


@query("select_samples", "SELECT feature, sample, raw_count FROM fx_counts WHERE sample IN (SELECT sample FROM fx_samples WHERE grade = 'g1')")
def _(spark, sf):
    exp = Experiment(counts=fx.counts_plan(spark, sf), samples=fx.samples(spark, sf))
    return filters.select_samples(exp, F.col("grade") == "g1").counts


@query("drop_samples", "SELECT feature, sample, raw_count FROM fx_counts WHERE sample NOT IN (2, 7)")
def _(spark, sf):
    return filters.drop_samples(Experiment(counts=fx.counts_plan(spark, sf), samples=fx.samples(spark, sf)), [2, 7]).counts


@query("filter_min_cpm", """
SELECT feature, sample, raw_count FROM fx_tokens WHERE feature IN (
  SELECT t.feature FROM fx_tokens t JOIN (SELECT sample, SUM(raw_count) AS n FROM fx_tokens GROUP BY sample) l ON l.sample = t.sample
  WHERE t.raw_count * 1e6 / l.n > 200 GROUP BY t.feature HAVING COUNT(*) >= 3)""")
def _(spark, sf):
    return filters.filter_min_cpm(fx.tokens(spark, sf), min_cpm=200, min_samples=3)


@query("filter_min_total", "SELECT feature, sample, raw_count FROM fx_tokens WHERE feature IN (SELECT feature FROM fx_tokens GROUP BY feature HAVING SUM(raw_count) >= 10)")
def _(spark, sf):
    return filters.filter_min_total(fx.tokens(spark, sf))


VIEWS["fx_token_log2cpm"] = """
SELECT f.feature, l.sample, LOG2((COALESCE(t.raw_count, 0) + 2e0 * l.n / m.mean_n) / (l.n + 4e0 * l.n / m.mean_n) * 1e6) AS log2cpm
FROM (SELECT DISTINCT feature FROM fx_tokens) f CROSS JOIN (SELECT sample, SUM(raw_count) AS n FROM fx_tokens GROUP BY sample) l
CROSS JOIN (SELECT AVG(n) AS mean_n FROM (SELECT SUM(raw_count) AS n FROM fx_tokens GROUP BY sample) q) m
LEFT JOIN fx_tokens t ON t.feature = f.feature AND t.sample = l.sample"""


@query("filter_min_mean_log2cpm", """
SELECT feature, sample, raw_count FROM fx_tokens
WHERE feature IN (SELECT feature FROM fx_token_log2cpm GROUP BY feature HAVING AVG(log2cpm) >= 6.123)""")
def _(spark, sf):
    tokens = fx.tokens(spark, sf)
    return filters.filter_min_mean_log2cpm(tokens, tokens.select("sample").distinct(), min_mean=6.123)


@query("filter_min_occ_log2cpm", """
SELECT feature, sample, raw_count FROM fx_tokens
WHERE feature IN (SELECT feature FROM fx_token_log2cpm GROUP BY feature HAVING SUM(CASE WHEN log2cpm >= 8.2 THEN 1 ELSE 0 END) >= 0.25 * COUNT(*))""")
def _(spark, sf):
    tokens = fx.tokens(spark, sf)
    return filters.filter_min_occ_log2cpm(tokens, tokens.select("sample").distinct(), min_log2cpm=8.2)


@query("filter_min_mean", "SELECT feature, sample, raw_count FROM fx_tokens WHERE feature IN (SELECT feature FROM fx_tokens GROUP BY feature HAVING SUM(raw_count) / CAST((SELECT COUNT(DISTINCT sample) FROM fx_tokens) AS DOUBLE) > 1)")
def _(spark, sf):
    counts = fx.tokens(spark, sf)
    return filters.filter_min_mean(counts, "raw_count", counts.select("sample").distinct().count(), gt=1)


@query("filter_count_occurrence", "SELECT feature, sample, raw_count FROM fx_tokens WHERE feature IN (SELECT feature FROM fx_tokens WHERE raw_count > 5 GROUP BY feature HAVING COUNT(*) >= 2)")
def _(spark, sf):
    return filters.filter_count_occurrence(fx.tokens(spark, sf))


DE_COLS = "feature, contrast, ROUND(avg_log2fc, 6) + 0e0 AS avg_log2fc, ROUND(adj_p, 9) AS adj_p"


@query("significant_genes", f"SELECT {DE_COLS}, ROUND(POWER(2e0, avg_log2fc), 6) AS fold_change FROM fx_det WHERE adj_p < 0.05 AND ABS(avg_log2fc) > 1")
def _(spark, sf):
    out = filters.significant_genes(de_table(spark, sf))
    return out.select("feature", "contrast", r6("avg_log2fc").alias("avg_log2fc"), F.round("adj_p", 9).alias("adj_p"), r6("fold_change").alias("fold_change"))


@query("drop_missing", f"SELECT {DE_COLS} FROM fx_det WHERE adj_p IS NOT NULL AND p_value IS NOT NULL")
def _(spark, sf):
    return filters.drop_missing(de_table(spark, sf)).select("feature", "contrast", r6("avg_log2fc").alias("avg_log2fc"), F.round("adj_p", 9).alias("adj_p"))


CLASS_SQL = "CASE WHEN COALESCE(de, 0) = 0 THEN 'n.s.' WHEN rank <= 50 THEN 'labelled' ELSE 'DE' END AS point_class"


@query("volcano_data", f"""
SELECT feature, contrast, ROUND(avg_log2fc, 6) + 0e0 AS avg_log2fc,
       CASE WHEN adj_p = 0 THEN CAST('inf' AS DOUBLE) WHEN adj_p > 0 THEN ROUND(-LOG10(adj_p), 6) + 0e0 END AS neg_log10_adj_p, {CLASS_SQL} FROM fx_det""")
def _(spark, sf):
    out = filters.volcano_data(de_table(spark, sf))
    y = F.col("neg_log10_adj_p")
    return out.withColumn("avg_log2fc", r6("avg_log2fc")).withColumn("neg_log10_adj_p", F.when(y == float("inf"), y).otherwise(r6(y)))


@query("ma_data", f"""
SELECT d.feature, d.contrast, d.avg_log2cpm, ROUND(d.avg_log2fc, 6) + 0e0 AS avg_log2fc, {CLASS_SQL}, f.chromosome_name = 'X' AS selected
FROM fx_det d JOIN fx_features f ON f.feature = d.feature""")
def _(spark, sf):
    flags = fx.features(spark, sf).select("feature", (F.col("chromosome_name") == "X").alias("on_x"))
    out = filters.ma_data(de_table(spark, sf).join(small(flags), "feature", "left"), select="on_x")
    return out.withColumn("avg_log2fc", r6("avg_log2fc"))


@query("add_logical_annotation", """
SELECT feature, symbol, feature IN (SELECT feature FROM fx_counts WHERE raw_count > 200) AS is_high FROM fx_features""")
def _(spark, sf):
    listed = fx.counts_plan(spark, sf).where("raw_count > 200")
    return filters.add_logical_annotation(fx.features(spark, sf).select("feature", "symbol"), "is_high", listed)


@query("union_transformations", """
SELECT feature, sample, ROUND(cpm, 6) AS value, 'cpm' AS transformation FROM fx_cpm
UNION ALL SELECT feature, sample, ROUND(LOG2(cpm + 1), 6) AS value, 'log2' AS transformation FROM fx_cpm""")
def _(spark, sf):
    values = nz.cpm(fx.counts(spark, sf)).withColumnRenamed("cpm", "value")
    out = reshape.union_transformations({"cpm": values, "log2": values.withColumn("value", F.log2(F.col("value") + 1))})
    return out.withColumn("value", r6("value"))


@query("feature_intersect_except", """
SELECT COALESCE(a.feature, b.feature) AS feature, CASE WHEN a.feature IS NOT NULL AND b.feature IS NOT NULL THEN 'both' WHEN b.feature IS NULL THEN 'left_only' ELSE 'right_only' END AS membership
FROM (SELECT DISTINCT feature FROM fx_counts WHERE raw_count > 100) a
FULL JOIN (SELECT feature FROM fx_features WHERE chromosome_name = 'X') b ON a.feature = b.feature""")
def _(spark, sf):
    return reshape.feature_intersect_except(fx.counts_plan(spark, sf).where("raw_count > 100"), fx.features(spark, sf).where("chromosome_name = 'X'"))
