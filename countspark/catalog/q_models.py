"""Queries for designs, linear and negative-binomial models, and hidden factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from countspark.catalog import inputs as fx
from countspark.catalog.registry import VIEWS, query, r6
from countspark.model import Experiment
from countspark.operators import factors as hidden, filters, linear, negbin, normalize as nz
from countspark.plans import pipelines
from countspark.session import keep, small

CASE = {"case_vs_ctrl": "case-ctrl"}


def _r(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, r6(c, digits))
    return df


def design(spark, sf, terms=("cond",), **kw):
    return linear.design_matrix(fx.samples(spark, sf), list(terms), intercept=kw.pop("intercept", False), **kw)


def case_control(spark, sf):
    """Planted counts with a two-group design and its contrast."""
    d = design(spark, sf)
    return fx.planted(spark, sf), d, linear.make_contrasts(d, CASE, prefix="cond")


def experiment(spark, sf):
    counts, d, contrasts = case_control(spark, sf)
    return Experiment(counts=counts, samples=fx.samples(spark, sf), design=d, contrasts=contrasts, group="cond", subject="subject")


@query("design_matrix", """
SELECT sample, 'condcase' AS coef, CASE WHEN cond = 'case' THEN 1e0 ELSE 0e0 END AS value FROM fx_samples
UNION ALL SELECT sample, 'condctrl', CASE WHEN cond = 'ctrl' THEN 1e0 ELSE 0e0 END FROM fx_samples
UNION ALL SELECT sample, 'gradeg1', CASE WHEN grade = 'g1' THEN 1e0 ELSE 0e0 END FROM fx_samples
UNION ALL SELECT sample, 'gradeg2', CASE WHEN grade = 'g2' THEN 1e0 ELSE 0e0 END FROM fx_samples""")
def _(spark, sf):
    return design(spark, sf, ("cond", "grade"))


@query("make_contrasts", """
SELECT s.sample, k.contrast, SUM(k.weight) AS value FROM fx_samples s JOIN (
  SELECT 'g1_vs_g0' AS contrast, 'g1' AS grade, 1e0 AS weight UNION ALL SELECT 'g1_vs_g0', 'g0', -1e0
  UNION ALL SELECT 'g2_vs_rest', 'g2', 1e0 UNION ALL SELECT 'g2_vs_rest', 'g0', -0.5e0 UNION ALL SELECT 'g2_vs_rest', 'g1', -0.5e0) k ON k.grade = s.grade
GROUP BY s.sample, k.contrast""")
def _(spark, sf):
    d = design(spark, sf, ("grade",))
    contrasts = linear.make_contrasts(d, {"g1_vs_g0": "g1-g0", "g2_vs_rest": "g2-0.5*g0-0.5*g1"}, prefix="grade")
    return d.join(small(contrasts), "coef").where("value <> 0").groupBy("sample", "contrast").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def planted_log2cpm(spark, sf):
    return keep(nz.log2cpm(fx.planted(spark, sf), fx.samples(spark, sf)))


@query("lm_fit", """
SELECT feature, ROUND(AVG(log2cpm) FILTER (grade = 'g0'), 6) + 0e0 AS g0, ROUND(AVG(log2cpm) FILTER (grade = 'g1'), 6) + 0e0 AS g1, ROUND(AVG(log2cpm) FILTER (grade = 'g2'), 6) + 0e0 AS g2,
  ROUND((VAR_POP(log2cpm) FILTER (grade = 'g0') * COUNT(*) FILTER (grade = 'g0') + VAR_POP(log2cpm) FILTER (grade = 'g1') * COUNT(*) FILTER (grade = 'g1')
       + VAR_POP(log2cpm) FILTER (grade = 'g2') * COUNT(*) FILTER (grade = 'g2')) / (COUNT(*) - 3), 6) AS sigma2
FROM fx_log2cpm JOIN fx_samples USING (sample) GROUP BY feature""")
def _(spark, sf):
    norm = nz.log2cpm(fx.counts(spark, sf), fx.samples(spark, sf))
    fit = linear.lm_fit(norm, "log2cpm", design(spark, sf, ("grade",)))
    return fit.table.select("feature", *[r6(F.col("coef")[i]).alias(g) for i, g in enumerate(("g0", "g1", "g2"))], r6("sigma2").alias("sigma2"))


@query("lm_fit_weighted", """
SELECT feature, ROUND(SUM(w * log2cpm) FILTER (cond = 'case') / SUM(w) FILTER (cond = 'case'), 6) + 0e0 AS b_case,
       ROUND(SUM(w * log2cpm) FILTER (cond = 'ctrl') / SUM(w) FILTER (cond = 'ctrl'), 6) + 0e0 AS b_ctrl
FROM (SELECT *, 1e0 + (feature + sample) % 5 AS w FROM fx_log2cpm) JOIN fx_samples USING (sample) GROUP BY feature""")
def _(spark, sf):
    norm = nz.log2cpm(fx.counts(spark, sf), fx.samples(spark, sf)).withColumn("w", (F.col("feature") + F.col("sample")) % 5 + F.lit(1.0))
    fit = linear.lm_fit(norm, "log2cpm", design(spark, sf), weights="w")
    return fit.table.select("feature", r6(F.col("coef")[0]).alias("b_case"), r6(F.col("coef")[1]).alias("b_ctrl"))


#: First and second derivative of ln Γ at X: twenty steps up, then the asymptotic series.
DIGAMMA = """(LN(X + 20) - 1 / (2 * (X + 20)) - 1 / (12 * POWER(X + 20, 2)) + 1 / (120 * POWER(X + 20, 4)) - LIST_SUM(LIST_TRANSFORM(RANGE(20), lambda k: 1 / (X + k))))"""
TRIGAMMA = """(1 / (X + 20) + 1 / (2 * POWER(X + 20, 2)) + 1 / (6 * POWER(X + 20, 3)) - 1 / (30 * POWER(X + 20, 5)) + LIST_SUM(LIST_TRANSFORM(RANGE(20), lambda k: 1 / POWER(X + k, 2))))"""
#: Integral of the density of a t statistic's angle, cos^(df - 1), from 0 to TO, by Simpson's rule on 1000 pieces.
ANGLE = """TO / 3000 * LIST_SUM(LIST_TRANSFORM(RANGE(1000), lambda k:
  POWER(COS(TO * k / 1000), total - 1) / 2 + 2 * POWER(COS(TO * (k + 0.5e0) / 1000), total - 1) + POWER(GREATEST(COS(TO * (k + 1) / 1000), 0), total - 1) / 2))"""


@query("ebayes_moderate", f"""
WITH RECURSIVE two_means AS MATERIALIZED (
  SELECT feature, AVG(log2cpm) AS avg_log2cpm, AVG(log2cpm) FILTER (cond = 'case') - AVG(log2cpm) FILTER (cond = 'ctrl') AS change, COUNT(*) - 2 AS df,
         (VAR_POP(log2cpm) FILTER (cond = 'case') * COUNT(*) FILTER (cond = 'case') + VAR_POP(log2cpm) FILTER (cond = 'ctrl') * COUNT(*) FILTER (cond = 'ctrl')) / (COUNT(*) - 2) AS sigma2,
         1e0 / COUNT(*) FILTER (cond = 'case') + 1e0 / COUNT(*) FILTER (cond = 'ctrl') AS v
  FROM fx_planted_log2cpm JOIN fx_samples USING (sample) GROUP BY feature),
logs AS MATERIALIZED (
  SELECT AVG(LN(sigma2)) FILTER (sigma2 > 0) - {DIGAMMA.replace("X", "(MAX(df) / 2e0)")} + LN(MAX(df) / 2e0) AS e_mean,
         VAR_SAMP(LN(sigma2)) FILTER (sigma2 > 0) - {TRIGAMMA.replace("X", "(MAX(df) / 2e0)")} AS excess, MAX(df) AS df, COUNT(*) AS n FROM two_means),
halving AS (
  SELECT 0 AS i, LN(1e-6) AS lo, LN(1e9) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT i, lo, hi, {TRIGAMMA.replace("X", "x")} > excess AS up FROM (SELECT i, lo, hi, EXP((lo + hi) / 2) AS x, excess FROM halving CROSS JOIN logs WHERE i < 70) h) q),
prior AS MATERIALIZED (
  SELECT *, LEAST(PI() / 2, 12 / SQRT(total)) AS last FROM (
    SELECT CASE WHEN excess > 0 THEN 2 * x END AS d0, CASE WHEN excess > 0 THEN EXP(e_mean + {DIGAMMA.replace("X", "x")} - LN(x)) ELSE EXP(e_mean) END AS s02,
           CASE WHEN excess > 0 THEN LEAST(2 * x + df, df * n) ELSE df * n END AS total
    FROM (SELECT EXP((lo + hi) / 2) AS x, logs.* FROM halving CROSS JOIN logs WHERE i = 70) r) q),
tested AS (
  SELECT f.*, p.total, p.last, change / SQRT(v * CASE WHEN d0 IS NULL THEN s02 ELSE (d0 * s02 + df * sigma2) / (d0 + df) END) AS t FROM two_means f CROSS JOIN prior p)
SELECT feature, 'case_vs_ctrl' AS contrast, ROUND(avg_log2cpm, 5) + 0e0 AS avg_log2cpm, ROUND(change, 5) + 0e0 AS avg_log2fc, ROUND(t, 4) + 0e0 AS t,
       ROUND(GREATEST(1 - {ANGLE.replace("TO", "upto")} / whole, 0), 6) + 0e0 AS p_value, 0 AS off_centre
FROM (SELECT *, LEAST(ATAN(ABS(t) / SQRT(total)), last) AS upto FROM tested) q CROSS JOIN (SELECT {ANGLE.replace("TO", "last")} AS whole FROM prior) w""")
def _(spark, sf):
    """Everything but the log odds has a closed form or an integral; the limits lie evenly around the change."""
    d = design(spark, sf)
    out = linear.ebayes_moderate(linear.lm_fit(planted_log2cpm(spark, sf), "log2cpm", d), linear.make_contrasts(d, CASE, prefix="cond"))
    off = F.abs((F.col("ci_l") + F.col("ci_r")) / 2 - F.col("avg_log2fc")) > 1e-9
    out = out.select("feature", "contrast", "avg_log2cpm", "avg_log2fc", "t", "p_value", off.cast("int").alias("off_centre"))
    return _r(_r(_r(out, "avg_log2cpm", "avg_log2fc", digits=5), "t", digits=4), "p_value", digits=6)


@query("ebayes_moderate_full")
def _(spark, sf):
    d = design(spark, sf)
    fit = linear.lm_fit(planted_log2cpm(spark, sf), "log2cpm", d)
    return _r(linear.ebayes_moderate(fit, linear.make_contrasts(d, CASE, prefix="cond")), "avg_log2cpm", "avg_log2fc", "t", "ci_l", "ci_r", "b", digits=5)


VIEWS["fx_planted_lib"] = "SELECT sample, SUM(raw_count) AS n FROM fx_planted GROUP BY sample"


@query("voom_weights", """
SELECT d.feature, d.sample, ROUND(LOG2((d.raw_count + 0.5e0) / (l.n + 1) * 1e6), 6) + 0e0 AS e FROM fx_planted d JOIN fx_planted_lib l ON l.sample = d.sample""")
def _(spark, sf):
    counts, d, _ = case_control(spark, sf)
    return _r(linear.voom_weights(counts, d).long(fx.samples(spark, sf)).select("feature", "sample", "e"), "e")


@query("voom_weights_trend")
def _(spark, sf):
    counts, d, _ = case_control(spark, sf)
    voom = linear.voom_weights(counts, d, factors=keep(nz.tmm_factors(counts)))
    return _r(voom.long(fx.samples(spark, sf)), "e", "weight", digits=4)


def _result(df):
    return df.select("feature", "contrast", r6("avg_log2cpm", 4).alias("avg_log2cpm"), r6("avg_log2fc", 4).alias("avg_log2fc"), F.round("p_value", 8).alias("p_value"),
                     F.round("adj_p", 8).alias("adj_p"), "de", "rank")


@query("voom_analysis")
def _(spark, sf):
    return _result(pipelines.voom_analysis(experiment(spark, sf)))


@query("edger_analysis")
def _(spark, sf):
    return _result(pipelines.edger_analysis(experiment(spark, sf)))


@query("deseq2_analysis")
def _(spark, sf):
    return _result(pipelines.deseq2_analysis(experiment(spark, sf)))


def edger_input(spark, sf):
    counts, d, contrasts = case_control(spark, sf)
    return negbin.nb_input(counts, d), contrasts


def edger_fit(spark, sf):
    data, contrasts = edger_input(spark, sf)
    return negbin.nb_glm_fit(data, keep(negbin.nb_dispersion_edger(data))), contrasts


def deseq_input(spark, sf):
    sheet = fx.samples(spark, sf)
    counts, d = fx.planted(spark, sf), linear.design_matrix(sheet, ["cond"], intercept=False)
    data = negbin.nb_input(counts, d, size_factors=nz.size_factors(counts, sheet.count()))
    return data, linear.make_contrasts(d, CASE, prefix="cond"), d


def deseq_fit(spark, sf):
    data, contrasts, d = deseq_input(spark, sf)
    return negbin.nb_glm_fit(data, keep(negbin.nb_dispersion_deseq(data))), contrasts, d


@query("nb_dispersion_edger")
def _(spark, sf):
    return _r(negbin.nb_dispersion_edger(edger_input(spark, sf)[0]), "avg_log2cpm", "common", "trended", "dispersion", "prior_df", digits=5)


VIEWS["fx_dispersions"] = """
SELECT feature, feature % 13 + 0.5e0 AS avg_log2cpm, (feature % 40) * 1e0 AS base_mean, 0.04e0 AS common, 0.01e0 + (feature % 13) / 100e0 AS trended,
       0.01e0 + (feature % 29) / 50e0 AS dispersion, 0.02e0 + (feature % 31) / 50e0 AS disp_gene, 0.03e0 + (feature % 7) / 50e0 AS disp_fit, feature % 17 = 0 AS outlier
FROM (SELECT DISTINCT feature FROM fx_counts) q"""


def plain_dispersions(spark, sf):
    """Dispersions by a rule, for what is done with dispersions."""
    f = F.col("feature")
    ids = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("feature")).distinct()
    return ids.select("feature", (f % 13 + F.lit(0.5)).alias("avg_log2cpm"), (f % 40).cast("double").alias("base_mean"), F.lit(0.04).alias("common"), (F.lit(0.01) + f % 13 / F.lit(100.0)).alias("trended"),
                      (F.lit(0.01) + f % 29 / F.lit(50.0)).alias("dispersion"), (F.lit(0.02) + f % 31 / F.lit(50.0)).alias("disp_gene"), (F.lit(0.03) + f % 7 / F.lit(50.0)).alias("disp_fit"), (f % 17 == 0).alias("outlier"))


@query("bcv_data", """
SELECT feature, avg_log2cpm, ROUND(SQRT(common), 6) AS bcv_common, ROUND(SQRT(trended), 6) AS bcv_trended, ROUND(SQRT(dispersion), 6) AS bcv_tagwise FROM fx_dispersions""")
def _(spark, sf):
    return _r(negbin.bcv_data(plain_dispersions(spark, sf)), "bcv_common", "bcv_trended", "bcv_tagwise")


@query("disp_plot_data", """
SELECT feature, base_mean, ROUND(disp_gene, 6) AS disp_gene, ROUND(disp_fit, 6) AS disp_fit, ROUND(dispersion, 6) AS dispersion, outlier FROM fx_dispersions WHERE base_mean > 0""")
def _(spark, sf):
    return _r(negbin.disp_plot_data(plain_dispersions(spark, sf)), "disp_gene", "disp_fit", "dispersion")


@query("bcv_data_estimated")
def _(spark, sf):
    return _r(negbin.bcv_data(negbin.nb_dispersion_edger(edger_input(spark, sf)[0])), "avg_log2cpm", "bcv_common", "bcv_trended", "bcv_tagwise", digits=5)


@query("nb_dispersion_deseq")
def _(spark, sf):
    return _r(negbin.nb_dispersion_deseq(deseq_input(spark, sf)[0]), "base_mean", "disp_gene", "disp_fit", "dispersion", digits=5)


@query("nb_dispersion_deseq_parametric")
def _(spark, sf):
    return _r(negbin.nb_dispersion_deseq(deseq_input(spark, sf)[0], fit="parametric"), "base_mean", "disp_gene", "disp_fit", "dispersion", digits=5)


@query("disp_plot_data_estimated")
def _(spark, sf):
    return _r(negbin.disp_plot_data(negbin.nb_dispersion_deseq(deseq_input(spark, sf)[0])), "base_mean", "disp_gene", "disp_fit", "dispersion", digits=5)


@query("nb_glm_fit_dispersions")
def _(spark, sf):
    fit, _ = edger_fit(spark, sf)
    return fit.table.select("feature", r6(F.col("coef")[0], 5).alias("b_case"), r6(F.col("coef")[1], 5).alias("b_ctrl"), r6("loglik", 4).alias("loglik"), r6("avg_log2cpm", 5).alias("avg_log2cpm"))


VIEWS["fx_tested"] = "SELECT feature FROM fx_planted GROUP BY feature HAVING SUM(raw_count) > 0"


@query("nb_glm_fit", """
SELECT d.feature, ROUND(LN(SUM(d.raw_count) FILTER (s.cond = 'case') / CAST(SUM(l.n) FILTER (s.cond = 'case') AS DOUBLE)), 3) + 0e0 AS b_case,
       ROUND(LN(SUM(d.raw_count) FILTER (s.cond = 'ctrl') / CAST(SUM(l.n) FILTER (s.cond = 'ctrl') AS DOUBLE)), 3) + 0e0 AS b_ctrl
FROM fx_planted d JOIN fx_samples s ON s.sample = d.sample JOIN fx_planted_lib l ON l.sample = d.sample GROUP BY d.feature
HAVING SUM(d.raw_count) FILTER (s.cond = 'case') > 0 AND SUM(d.raw_count) FILTER (s.cond = 'ctrl') > 0""")
def _(spark, sf):
    counts, d, _ = case_control(spark, sf)
    fit = negbin.nb_glm_fit(negbin.nb_input(counts, d), counts.select("feature").distinct().withColumn("dispersion", F.lit(1e-9)))
    return fit.table.select("feature", r6(F.col("coef")[0], 3).alias("b_case"), r6(F.col("coef")[1], 3).alias("b_ctrl"))


VIEWS["fx_two_groups"] = """
SELECT d.feature, CAST(SUM(d.raw_count) FILTER (s.cond = 'case') AS DOUBLE) AS s1, CAST(SUM(d.raw_count) FILTER (s.cond = 'ctrl') AS DOUBLE) AS s2,
       CAST(SUM(l.n) FILTER (s.cond = 'case') AS DOUBLE) AS n1, CAST(SUM(l.n) FILTER (s.cond = 'ctrl') AS DOUBLE) AS n2
FROM fx_planted d JOIN fx_samples s ON s.sample = d.sample JOIN fx_planted_lib l ON l.sample = d.sample GROUP BY d.feature
HAVING SUM(d.raw_count) FILTER (s.cond = 'case') > 0 AND SUM(d.raw_count) FILTER (s.cond = 'ctrl') > 0"""
POISSON = """SELECT feature, 'NAME' AS contrast, ROUND(LN(s1 / n1 * n2 / s2) / LN(2e0), 2) + 0e0 AS avg_log2fc, ROUND(SQRT(1 / s1 + 1 / s2) / LN(2e0), 2) + 0e0 AS lfc_se,
  ROUND(STAT, 2) + 0e0 AS stat FROM fx_two_groups"""
WALD = "LN(s1 / n1 * n2 / s2) / SQRT(1 / s1 + 1 / s2)"


#: Two-sided normal tail of ``Z`` >= 0: one minus the density between -Z and Z, by 400 midpoints (absolute error below 1e-6).
TAIL = "1 - SQRT(2 / PI()) * LEAST(Z, 9) * LIST_SUM(LIST_TRANSFORM(RANGE(400), lambda k: EXP(-POWER(LEAST(Z, 9) * (k + 0.5e0) / 400, 2) / 2))) / 400"


def _with_tail(body: str, z: str, digits: int = 3) -> str:
    """``body`` over the view ``fx_two_groups`` with the tail of ``z`` as ``p_value``."""
    return body.replace(" FROM fx_two_groups", f", ROUND(GREATEST({TAIL.replace('Z', 'z')}, 0), {digits}) + 0e0 AS p_value FROM (SELECT *, ABS({z}) AS z FROM fx_two_groups)")


def both_groups(spark, sf, counts):
    sides = counts.join(small(fx.samples(spark, sf).select("sample", "cond")), "sample").where("raw_count > 0").groupBy("feature").agg(F.countDistinct("cond").alias("n"))
    return keep(sides.where("n = 2").select("feature", F.lit(1e-9).alias("dispersion")))


def poisson_fit(spark, sf):
    """Two groups without overdispersion, where the estimates have a closed form; features without counts in a group are left out."""
    counts, d, contrasts = case_control(spark, sf)
    return negbin.nb_glm_fit(negbin.nb_input(counts, d), both_groups(spark, sf, counts)), contrasts, d


def _statistics(df):
    return _r(_r(df.select("feature", "contrast", "avg_log2fc", "lfc_se", "stat", "p_value"), "avg_log2fc", "lfc_se", "stat", digits=2), "p_value", digits=3)


LR = "2 * (s1 * LN(s1 / ((s1 + s2) * n1 / (n1 + n2))) + s2 * LN(s2 / ((s1 + s2) * n2 / (n1 + n2))))"


@query("glm_lrt", _with_tail(f"""
SELECT feature, 'case_vs_ctrl' AS contrast, ROUND(LN(s1 / n1 * n2 / s2) / LN(2e0), 2) + 0e0 AS avg_log2fc, ROUND({LR}, 1) + 0e0 AS stat FROM fx_two_groups""",
                             f"SQRT(GREATEST({LR}, 0))", 2))
def _(spark, sf):
    fit, contrasts, _ = poisson_fit(spark, sf)
    out = negbin.glm_lrt(fit, contrasts)
    return out.select("feature", "contrast", r6("avg_log2fc", 2).alias("avg_log2fc"), r6("stat", 1).alias("stat"), r6("p_value", 2).alias("p_value"))


@query("nb_wald", _with_tail(POISSON.replace("NAME", "case_vs_ctrl").replace("STAT", WALD), WALD))
def _(spark, sf):
    fit, contrasts, _ = poisson_fit(spark, sf)
    return _statistics(negbin.nb_wald(fit, contrasts, cooks=False))


BEYOND = "(ABS(LN(s1 / n1 * n2 / s2)) - LN(2e0)) / SQRT(1 / s1 + 1 / s2)"


@query("wald_lfc_threshold", _with_tail(POISSON.replace("NAME", "case_vs_ctrl").replace("STAT", BEYOND), f"GREATEST({BEYOND}, 0)"))
def _(spark, sf):
    fit, contrasts, _ = poisson_fit(spark, sf)
    return _statistics(negbin.wald_lfc_threshold(fit, contrasts, cooks=False))


@query("results_contrast", _with_tail(POISSON.replace("NAME", "cond_case_vs_ctrl").replace("STAT", WALD), WALD))
def _(spark, sf):
    fit, _, d = poisson_fit(spark, sf)
    return _statistics(negbin.results_contrast(fit, d, ("cond", "case", "ctrl"), cooks=False))


@query("glm_lrt_dispersions")
def _(spark, sf):
    fit, contrasts = edger_fit(spark, sf)
    return _r(negbin.glm_lrt(fit, contrasts), "avg_log2cpm", "avg_log2fc", "stat", digits=4)


@query("nb_wald_dispersions")
def _(spark, sf):
    fit, contrasts, _ = deseq_fit(spark, sf)
    return _r(negbin.nb_wald(fit, contrasts), "base_mean", "avg_log2cpm", "avg_log2fc", "lfc_se", "stat", digits=4)


@query("wald_lfc_threshold_dispersions")
def _(spark, sf):
    fit, contrasts, _ = deseq_fit(spark, sf)
    return _r(negbin.wald_lfc_threshold(fit, contrasts), "base_mean", "avg_log2cpm", "avg_log2fc", "lfc_se", "stat", digits=4)


@query("results_contrast_dispersions")
def _(spark, sf):
    fit, _, d = deseq_fit(spark, sf)
    return _r(negbin.results_contrast(fit, d, ("cond", "case", "ctrl")), "base_mean", "avg_log2cpm", "avg_log2fc", "lfc_se", "stat", digits=4)


@query("independent_filtering")
def _(spark, sf):
    fit, contrasts, _ = deseq_fit(spark, sf)
    out = negbin.independent_filtering(negbin.nb_wald(fit, contrasts))
    return out.select("feature", "contrast", r6("base_mean", 4).alias("base_mean"), F.round("p_value", 8).alias("p_value"), F.round("adj_p", 8).alias("adj_p"), r6("mean_cut", 4).alias("mean_cut"))



@query("filter_rejections", """
SELECT contrast, i, MAX(rk) AS n_rejected FROM (
  SELECT q.*, ROW_NUMBER() OVER (PARTITION BY contrast, i ORDER BY p_value, feature) AS rk, COUNT(*) OVER (PARTITION BY contrast, i) AS m FROM (
    SELECT d.contrast, d.feature, d.p_value, UNNEST(RANGE(1, 51)) AS i, c.cuts, d.avg_log2cpm FROM fx_de d
    JOIN (SELECT contrast, QUANTILE_CONT(avg_log2cpm, [""" + ", ".join(f"{i} * 0.95e0 / 49" for i in range(50)) + """]) AS cuts FROM fx_de GROUP BY contrast) c
      ON c.contrast = d.contrast WHERE d.p_value IS NOT NULL) q WHERE avg_log2cpm >= cuts[i]) r
WHERE p_value <= 0.1e0 * rk / m AND p_value <= 0.1 GROUP BY contrast, i""")
def _(spark, sf):
    counts = negbin.rejections_by_cut(keep(fx.de_raw(spark, sf)), "avg_log2cpm", alpha=0.1, cuts=50)[1]
    return counts.select("contrast", F.col("i").cast("bigint").alias("i"), "n_rejected")


def shrink_fit(spark, sf):
    counts, sheet = fx.planted(spark, sf), fx.samples(spark, sf)
    d = linear.design_matrix(sheet, ["cond"], intercept=True, levels={"cond": ["ctrl", "case"]})
    data = negbin.nb_input(counts, d, size_factors=nz.size_factors(counts, sheet.count()))
    return negbin.nb_glm_fit(data, keep(negbin.nb_dispersion_deseq(data)))


@query("lfc_shrink")
def _(spark, sf):
    return _r(negbin.s_values(keep(negbin.lfc_shrink(shrink_fit(spark, sf), "condcase"))), "lfc_mle", "lfc_shrunk", "lfc_sd", "sign_error", "s_value", digits=4)


@query("lfc_prior_scale", """
WITH RECURSIVE est AS MATERIALIZED (SELECT LN(s1 / n1 * n2 / s2) AS b, 1 / s1 + 1 / s2 AS v FROM fx_two_groups),
halving AS (
  SELECT 0 AS i, LN(1e-6) AS lo, LN(400e0) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT i, lo, hi, SUM((b * b - EXP((lo + hi) / 2) - v) / POWER(EXP((lo + hi) / 2) + v, 2)) > 0 AS up FROM halving CROSS JOIN est WHERE i < 50 GROUP BY i, lo, hi) q)
SELECT ROUND(LEAST(EXP((lo + hi) / 4), 1), 4) + 0e0 AS prior_scale, n AS n_features FROM halving CROSS JOIN (SELECT COUNT(*) AS n FROM est) c WHERE i = 50""")
def _(spark, sf):
    """The scale of the prior where the estimates and their variances have a closed form."""
    counts, sheet = fx.planted(spark, sf), fx.samples(spark, sf)
    d = linear.design_matrix(sheet, ["cond"], intercept=True, levels={"cond": ["ctrl", "case"]})
    fit = negbin.nb_glm_fit(negbin.nb_input(counts, d), both_groups(spark, sf, counts))
    return fit.table.agg(F.round(F.lit(negbin.prior_scale(fit, "condcase")), 4).alias("prior_scale"), F.count(F.lit(1)).alias("n_features"))


VIEWS["fx_scaled_sums"] = """
SELECT d.feature, SUM(d.raw_count * c.common / l.n) FILTER (s.cond = 'ctrl') AS s1, SUM(d.raw_count * c.common / l.n) FILTER (s.cond = 'case') AS s2,
       COUNT(*) FILTER (s.cond = 'ctrl') AS n1, COUNT(*) FILTER (s.cond = 'case') AS n2
FROM fx_planted d JOIN fx_samples s ON s.sample = d.sample JOIN fx_planted_lib l ON l.sample = d.sample CROSS JOIN (SELECT EXP(AVG(LN(n))) AS common FROM fx_planted_lib) c
GROUP BY d.feature HAVING SUM(d.raw_count) > 0"""
VIEWS["fx_splits"] = """
SELECT feature, a, k, LGAMMA(k + 20e0 * n1) - LGAMMA(k + 1e0) + LGAMMA(t - k + 20e0 * n2) - LGAMMA(t - k + 1e0) AS w FROM (
  SELECT feature, n1, n2, CAST(ROUND(s1) AS BIGINT) AS a, CAST(ROUND(s1) + ROUND(s2) AS BIGINT) AS t, UNNEST(RANGE(CAST(ROUND(s1) + ROUND(s2) AS BIGINT) + 1)) AS k FROM fx_scaled_sums) q"""


@query("exact_test", """
SELECT f.feature, 'case_vs_ctrl' AS contrast, ROUND(LOG2((f.s2 / f.n2 + 0.125e0) / (f.s1 / f.n1 + 0.125e0)), 4) + 0e0 AS avg_log2fc, ROUND(p.p_value, 6) + 0e0 AS p_value
FROM fx_scaled_sums f JOIN (
  SELECT feature, LEAST(1, 2 * LEAST(SUM(EXP(w - m)) FILTER (k <= a), SUM(EXP(w - m)) FILTER (k >= a)) / SUM(EXP(w - m))) AS p_value
  FROM fx_splits JOIN (SELECT feature, MAX(w) AS m FROM fx_splits GROUP BY feature) USING (feature) GROUP BY feature) p ON p.feature = f.feature""")
def _(spark, sf):
    """A dispersion of 0.05; in SQL the tails are sums over all splits of a total."""
    counts, _, _ = case_control(spark, sf)
    dispersion = counts.select("feature").distinct().withColumn("dispersion", F.lit(0.05))
    out = negbin.exact_test(counts, fx.samples(spark, sf), dispersion, group="cond", pair=("ctrl", "case"))
    return _r(_r(out.select("feature", "contrast", "avg_log2fc", "p_value"), "avg_log2fc", digits=4), "p_value", digits=6)


@query("exact_test_dispersions")
def _(spark, sf):
    counts, d, _ = case_control(spark, sf)
    dispersion = negbin.nb_dispersion_edger(negbin.nb_input(counts, d))
    return _r(negbin.exact_test(counts, fx.samples(spark, sf), dispersion, group="cond", pair=("ctrl", "case")), "avg_log2fc", "avg_log2cpm", digits=4)


@query("rlog")
def _(spark, sf):
    return _r(hidden.rlog(fx.counts(spark, sf), fx.samples(spark, sf)), "rlog", digits=4)


def normalised_planted(spark, sf):
    counts, sheet = fx.planted(spark, sf), fx.samples(spark, sf)
    norm = nz.normalized_counts(counts, keep(nz.size_factors(counts, sheet.count())))
    return keep(filters.filter_min_mean(norm, "norm_count", sheet.count(), gt=1))


def hidden_factors(spark, sf):
    d, null = design(spark, sf, ("cond",), intercept=True), keep(fx.samples(spark, sf).select("sample", F.lit("Intercept").alias("coef"), F.lit(1.0).alias("value")))
    return hidden.sva_factors(normalised_planted(spark, sf), d, null, value="norm_count")


@query("sva_factors")
def _(spark, sf):
    return _r(hidden_factors(spark, sf), "value", digits=5)


@query("sva_refit")
def _(spark, sf):
    """The model fitted again with the hidden factors in its design."""
    exp = experiment(spark, sf)
    return _result(pipelines.deseq2_analysis(exp.but(design=hidden.add_factors(exp.design, hidden_factors(spark, sf), prefix="SV"))))


@query("ruv_factors")
def _(spark, sf):
    kept = keep(nz.upper_quartile_norm(keep(filters.filter_count_occurrence(fx.planted(spark, sf)))))
    controls = pipelines.voom_analysis(experiment(spark, sf)).where("p_value > 0.1")
    return _r(hidden.ruv_factors(kept, fx.samples(spark, sf), controls, value="norm_count"), "value", digits=5)
