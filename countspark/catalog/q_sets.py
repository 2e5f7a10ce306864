"""Queries for marker scores, deconvolution, classification and gene-set tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from countspark.catalog import inputs as fx
from countspark.catalog.q_models import case_control, design, experiment, planted_log2cpm
from countspark.catalog.registry import VIEWS, query, r6
from countspark.functions.rows import sample_names
from countspark.operators import linear, normalize as nz, sets
from countspark.plans import pipelines
from countspark.session import keep, small


def _r(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, r6(c, digits))
    return df


VIEWS["fx_tpm"] = """
SELECT c.feature, c.sample, c.raw_count / CAST(f.length_bp AS DOUBLE) / SUM(c.raw_count / CAST(f.length_bp AS DOUBLE)) OVER (PARTITION BY c.sample) * 1e6 AS tpm
FROM fx_counts c JOIN fx_features f ON f.feature = c.feature"""


def tpm(spark, sf):
    return keep(nz.tpm(fx.counts(spark, sf), fx.features(spark, sf)))


@query("marker_scores", """
SELECT t.sample, s.set_id, ROUND(SUM(LOG2(t.tpm + 1)) / MAX(k.n), 6) AS score FROM fx_tpm t JOIN fx_sets s ON s.feature = t.feature
JOIN (SELECT set_id, COUNT(*) AS n FROM fx_sets WHERE feature IN (SELECT feature FROM fx_counts) GROUP BY set_id) k ON k.set_id = s.set_id GROUP BY t.sample, s.set_id""")
def _(spark, sf):
    return _r(sets.marker_scores(tpm(spark, sf), fx.gene_sets(spark, sf), value="tpm"), "score")


def profile(spark, sf):
    """Reference profile of four cell types over every fifth feature, from the feature table."""
    f = F.col("feature")
    types = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"type{i}").alias("t"), F.lit(0.5 + 0.25 * i).alias("m")) for i in range(4)]))
    return fx.features(spark, sf).where(f % 5 == 0).select("feature", "length_bp", types.alias("k")).select(
        F.col("k.t").alias("cell_type"), "feature", (F.lit(1.0) + (f * 31 + F.col("k.i") * 17) % 23 + F.when((f / 5) % 4 == F.col("k.i"), 60).otherwise(0)).alias("value"),
        (F.lit(1000.0) / F.col("length_bp")).alias("weight"), F.col("k.m").alias("mrna"))


VIEWS["fx_two_types"] = """
SELECT feature, 1000e0 / length_bp AS w, v0 / SUM(v0) OVER () AS r0, v1 / SUM(v1) OVER () AS r1 FROM (
  SELECT feature, length_bp, 1e0 + (feature * 31) % 23 + CASE WHEN (feature // 5) % 4 = 0 THEN 60 ELSE 0 END AS v0,
         1e0 + (feature * 31 + 17) % 23 + CASE WHEN (feature // 5) % 4 = 1 THEN 60 ELSE 0 END AS v1 FROM fx_features WHERE feature % 5 = 0)"""
VIEWS["fx_two_sides"] = """
SELECT t.sample, g.*, SUM(s.w * s.r0 * t.tpm) / SUM(t.tpm) AS t0, SUM(s.w * s.r1 * t.tpm) / SUM(t.tpm) AS t1 FROM fx_tpm t JOIN fx_two_types s ON s.feature = t.feature
CROSS JOIN (SELECT SUM(w * r0 * r0) AS a, SUM(w * r0 * r1) AS b, SUM(w * r1 * r1) AS c FROM fx_two_types) g GROUP BY ALL"""


@query("deconvolve_fractions", """
SELECT sample, cell_type, ROUND(part / SUM(part) OVER (PARTITION BY sample), 5) + 0e0 AS fraction, 1 AS optimal FROM (
  SELECT sample, UNNEST(['type0', 'type1', 'other']) AS cell_type, UNNEST([best.p / 0.5, best.q / 0.75, GREATEST(1 - best.p - best.q, 0)]) AS part FROM (
    SELECT sample, ARG_MIN({'p': p, 'q': q}, a * p * p + 2 * b * p * q + c * q * q - 2 * (p * t0 + q * t1)) AS best FROM (
      SELECT *, (t0 * c - t1 * b) / (a * c - b * b) AS p, (t1 * a - t0 * b) / (a * c - b * b) AS q FROM fx_two_sides
      UNION ALL SELECT *, 0e0, LEAST(GREATEST(t1 / c, 0), 1) FROM fx_two_sides
      UNION ALL SELECT *, LEAST(GREATEST(t0 / a, 0), 1), 0e0 FROM fx_two_sides
      UNION ALL SELECT *, e, 1 - e FROM (SELECT *, LEAST(GREATEST((t0 - t1 + c - b) / (a + c - 2 * b), 0), 1) AS e FROM fx_two_sides) BY NAME_) u
    WHERE p >= 0 AND q >= 0 AND p + q <= 1 + 1e-12 GROUP BY sample))""".replace("SELECT *, e, 1 - e FROM (", "SELECT * EXCLUDE (e), e, 1 - e FROM (").replace(" BY NAME_", ""))
def _(spark, sf):
    """Two cell types, where the best shares are the best of the inner solution and three edges."""
    out = sets.deconvolve_fractions(tpm(spark, sf), profile(spark, sf).where("cell_type IN ('type0', 'type1')"))
    return _r(out.select("sample", "cell_type", "fraction", (F.col("residual") < 1e-9).cast("int").alias("optimal")), "fraction", digits=5)


@query("deconvolve_fractions_four")
def _(spark, sf):
    out = sets.deconvolve_fractions(tpm(spark, sf), profile(spark, sf))
    return _r(out, "fraction", "residual", digits=5)


@query("fraction_long", "SELECT s.set_id AS cell_type, CAST(c.sample AS VARCHAR) AS sample, CAST(SUM(c.raw_count) AS DOUBLE) AS fraction FROM fx_counts c JOIN fx_sets s ON s.feature = c.feature GROUP BY s.set_id, c.sample")
def _(spark, sf):
    sums = fx.counts_plan(spark, sf).join(small(fx.gene_sets(spark, sf)), "feature")
    wide = sums.groupBy(F.col("set_id").alias("cell_type")).pivot("sample", sample_names(fx.samples(spark, sf))).agg(F.sum("raw_count"))
    return sets.fraction_long(wide)


VIEWS["fx_z"] = """
SELECT feature, sample, (log2cpm - AVG(log2cpm) OVER w) / STDDEV_SAMP(log2cpm) OVER w AS z FROM fx_log2cpm WINDOW w AS (PARTITION BY feature)"""
VIEWS["fx_templates"] = "SELECT CONCAT('c', CAST(feature % 4 AS VARCHAR)) AS class, feature FROM fx_features WHERE feature % 40 < 4 AND feature IN (SELECT feature FROM fx_counts)"


def zscores(spark, sf):
    norm = keep(nz.log2cpm(fx.counts(spark, sf), fx.samples(spark, sf)))
    return keep(nz.zscore_rows(norm, "log2cpm").where("z IS NOT NULL"))


def templates(spark, sf):
    f = F.col("feature")
    ids = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("feature")).distinct()
    return keep(ids.where(f % 40 < 4).select(F.concat(F.lit("c"), (f % 4).cast("string")).alias("class"), "feature"))


VIEWS["fx_template_distance"] = """
SELECT z.sample, t.class, SQRT((1 - SUM(z.z) / (SQRT(MAX(k.m)) * MAX(x.len))) / 2) AS distance
FROM fx_z z JOIN fx_templates t ON t.feature = z.feature JOIN (SELECT class, COUNT(*) AS m FROM fx_templates GROUP BY class) k ON k.class = t.class
JOIN (SELECT sample, SQRT(SUM(z * z)) AS len FROM fx_z WHERE feature IN (SELECT feature FROM fx_templates) GROUP BY sample) x ON x.sample = z.sample GROUP BY z.sample, t.class"""


@query("template_distances", "SELECT sample, class, ROUND(distance, 6) AS distance FROM fx_template_distance")
def _(spark, sf):
    return _r(sets.template_distances(zscores(spark, sf), templates(spark, sf), value="z"), "distance")


@query("nearest_template", "SELECT sample, MIN_BY(class, distance) AS prediction, ROUND(MIN(distance), 6) AS distance FROM fx_template_distance GROUP BY sample")
def _(spark, sf):
    out = sets.nearest_template(zscores(spark, sf), templates(spark, sf), value="z")
    return _r(out.select("sample", "prediction", "distance"), "distance")


@query("nearest_template_fdr")
def _(spark, sf):
    return _r(sets.nearest_template(zscores(spark, sf), templates(spark, sf), value="z"), "distance", "p_value", "fdr")


@query("nearest_centroid", """
SELECT sample, MAX_BY(class, corr) AS prediction, ROUND(MAX(corr), 6) AS corr FROM (
  SELECT v.sample, c.class, CORR(v.value, c.value) AS corr FROM fx_vectors v
  JOIN (SELECT label AS class, feature, AVG(value) AS value FROM fx_vectors GROUP BY label, feature) c ON c.feature = v.feature GROUP BY v.sample, c.class) q GROUP BY sample""")
def _(spark, sf):
    v = keep(fx.vectors(spark, sf))
    norm = v.select("feature", "sample", "value")
    centroids = sets.class_centroids(norm, v.select("sample", F.col("label").alias("class")).distinct(), value="value")
    return _r(sets.nearest_centroid(norm, centroids, value="value"), "corr")


@query("rf_classify")
def _(spark, sf):
    v = keep(fx.vectors(spark, sf))
    norm, classes = v.select("feature", "sample", "value"), keep(v.select("sample", F.col("label").alias("class")).distinct())
    split = small(sets.train_split(classes))
    side = lambda flag: norm.join(split.where(F.col("in_train") == flag), "sample", "left_semi")
    return _r(sets.rf_classify(side(True), side(False), classes, value="value"), "probability")


@query("train_split", """
SELECT n AS n_samples, n AS n_distinct, CAST(FLOOR(n / 2e0) AS BIGINT) AS n_train FROM (SELECT COUNT(*) AS n FROM embeddings) q""")
def _(spark, sf):
    """Which samples are drawn is a matter of the hash; their number is not."""
    split = keep(sets.train_split(fx.vectors(spark, sf).select("sample")))
    return split.agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("sample").alias("n_distinct"), F.count(F.when(F.col("in_train"), 1)).alias("n_train"))


@query("make_templates", """
SELECT contrast AS class, feature, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY contrast ORDER BY p_value, feature) AS rank FROM fx_de WHERE avg_log2fc > 0 AND p_value IS NOT NULL) q WHERE rank <= 50""")
def _(spark, sf):
    return sets.make_templates(fx.de_raw(spark, sf))


@query("make_templates_trained")
def _(spark, sf):
    """From a model of the training half; the half is drawn per grade, so that every grade is in it."""
    exp = experiment(spark, sf)
    parts = [sets.train_split(exp.samples.where(F.col("grade") == g)).where("in_train").select("sample") for g in ("g0", "g1", "g2")]
    half = keep(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    sheet = keep(exp.samples.join(half, "sample", "left_semi"))
    d = linear.design_matrix(sheet, ["grade"], intercept=False)
    exp = exp.but(samples=sheet, counts=keep(exp.counts.join(half, "sample", "left_semi")), design=d, contrasts=sets.one_vs_rest(d, ["gradeg0", "gradeg1", "gradeg2"]))
    return sets.make_templates(pipelines.voom_analysis(exp))


def sets_table(spark, sf):
    """Brands as sets, plus one set of every planted feature."""
    planted = fx.table(spark, sf, "lineitem").select(F.lit("planted").alias("set_id"), F.col("l_partkey").alias("feature")).distinct().where("feature % 50 = 0")
    return keep(fx.gene_sets(spark, sf).unionByName(planted))


@query("camera_test")
def _(spark, sf):
    counts, d, contrasts = case_control(spark, sf)
    fit = linear.lm_fit(planted_log2cpm(spark, sf), "log2cpm", d)
    return _r(sets.camera_test(fit, contrasts, sets_table(spark, sf)), "correlation", "stat", digits=5)


def _treatment(spark, sf):
    d = design(spark, sf, intercept=True, levels={"cond": ["ctrl", "case"]})
    return d, keep(d.where("coef = 'Intercept'"))


VIEWS["fx_planted_log2cpm"] = """
SELECT d.feature, d.sample, LOG2((d.raw_count + 2e0 * l.n / m.mean_n) / (l.n + 4e0 * l.n / m.mean_n) * 1e6) AS log2cpm
FROM fx_planted d JOIN fx_planted_lib l ON l.sample = d.sample CROSS JOIN (SELECT AVG(n) AS mean_n FROM fx_planted_lib) m"""
VIEWS["fx_contribution"] = """
SELECT feature, POWER(SUM(z * (CASE WHEN s.cond = 'case' THEN 1e0 ELSE 0e0 END - (SELECT AVG(CASE WHEN cond = 'case' THEN 1e0 ELSE 0e0 END) FROM fx_samples))), 2) AS contribution
FROM (SELECT feature, sample, (log2cpm - AVG(log2cpm) OVER w) / STDDEV_SAMP(log2cpm) OVER w AS z FROM fx_planted_log2cpm WINDOW w AS (PARTITION BY feature)) q
JOIN fx_samples s ON s.sample = q.sample GROUP BY feature"""
VIEWS["fx_all_sets"] = "SELECT set_id, feature FROM fx_sets UNION ALL SELECT 'planted', feature FROM fx_features WHERE feature % 50 = 0"


@query("set_score_test", """
SELECT s.set_id, 'condcase' AS contrast, COUNT(*) AS n_features, ROUND(SUM(c.contribution), 4) AS stat FROM fx_contribution c JOIN fx_all_sets s ON s.feature = c.feature GROUP BY s.set_id""")
def _(spark, sf):
    d, null = _treatment(spark, sf)
    out = sets.set_score_test(planted_log2cpm(spark, sf), d, null, sets_table(spark, sf), value="log2cpm", coef="condcase", n_perm=999)
    return _r(out.select("set_id", "contrast", "n_features", "stat"), "stat", digits=4)


@query("set_score_test_p")
def _(spark, sf):
    d, null = _treatment(spark, sf)
    out = sets.set_score_test(planted_log2cpm(spark, sf), d, null, sets_table(spark, sf), value="log2cpm", coef="condcase")
    return _r(out, "stat", "p_value", digits=4)


@query("set_gene_ranks", """
SELECT s.set_id, c.feature, 'condcase' AS contrast, ROUND(c.contribution, 5) AS contribution,
       ROW_NUMBER() OVER (PARTITION BY s.set_id ORDER BY ROUND(c.contribution, 9) DESC, c.feature) AS set_rank, d.de
FROM fx_contribution c JOIN fx_all_sets s ON s.feature = c.feature JOIN fx_det d ON d.feature = c.feature AND d.contrast = 'g1_vs_g0'""")
def _(spark, sf):
    from countspark.catalog.q_tables import de_table

    d, null = _treatment(spark, sf)
    scores = sets.set_contributions(planted_log2cpm(spark, sf), d, null, value="log2cpm", coef="condcase").withColumn("contribution", F.round("contribution", 9))
    de = de_table(spark, sf).where("contrast = 'g1_vs_g0'").select("feature", F.lit("condcase").alias("contrast"), "de")
    out = sets.set_gene_ranks(keep(scores), sets_table(spark, sf), de)
    return _r(out.select("set_id", "feature", "contrast", "contribution", "set_rank", "de"), "contribution", digits=5)


@query("selected_set_ranks", """
WITH p AS (SELECT s.set_id, MIN(d.p_value) AS p_value FROM fx_det d JOIN fx_sets s ON s.feature = d.feature WHERE d.contrast = 'g1_vs_g0' GROUP BY s.set_id HAVING MIN(d.p_value) IS NOT NULL),
  h AS (SELECT set_id, LEAST(1e0, MAX(p_value * (n - rk + 1)) OVER (ORDER BY p_value, set_id)) AS adj, p_value FROM (SELECT *, COUNT(*) OVER () AS n, ROW_NUMBER() OVER (ORDER BY p_value, set_id) AS rk FROM p) a),
  k AS (SELECT set_id, ROW_NUMBER() OVER (ORDER BY adj, p_value, set_id) AS set_order FROM h WHERE adj <= 0.05)
SELECT s.set_id, c.feature, k.set_order, ROW_NUMBER() OVER (PARTITION BY s.set_id ORDER BY ROUND(c.contribution, 9) DESC, c.feature) AS set_rank, d.de
FROM fx_contribution c JOIN fx_sets s ON s.feature = c.feature JOIN k ON k.set_id = s.set_id JOIN fx_det d ON d.feature = c.feature AND d.contrast = 'g1_vs_g0'""")
def _(spark, sf):
    from countspark.catalog.q_tables import de_table

    d, null = _treatment(spark, sf)
    scores = sets.set_contributions(planted_log2cpm(spark, sf), d, null, value="log2cpm", coef="condcase").withColumn("contribution", F.round("contribution", 9))
    de = de_table(spark, sf).where("contrast = 'g1_vs_g0'").withColumn("contrast", F.lit("condcase"))
    members = fx.gene_sets(spark, sf)
    best = de.join(small(members), "feature").groupBy("set_id", "contrast").agg(F.min("p_value").alias("p_value")).where("p_value IS NOT NULL")
    return sets.selected_set_ranks(keep(best), keep(scores), members, de.select("feature", "contrast", "de")).select("set_id", "feature", "set_order", "set_rank", "de")


@query("nearest_template_cut")
def _(spark, sf):
    """No prediction above a false-discovery rate of 0.05."""
    return _r(sets.nearest_template(zscores(spark, sf), templates(spark, sf), value="z", max_fdr=0.05), "distance", "p_value", "fdr")
