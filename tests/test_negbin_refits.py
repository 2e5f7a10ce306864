"""Outlier replacement with a second fit, and shrinkage by marginal likelihood, against plain numpy and planted values."""

import math

import numpy as np
import pytest

from countspark.model import Experiment
from countspark.operators import linear, negbin, normalize as nz
from countspark.plans import pipelines
from countspark.session import keep


def _tables(spark, counts, groups):
    rows = [(f"f{i:03d}", f"s{j:02d}", int(counts[i, j])) for i in range(counts.shape[0]) for j in range(counts.shape[1]) if counts[i, j] > 0]
    sheet = spark.createDataFrame([(f"s{j:02d}", g) for j, g in enumerate(groups)], "sample string, grp string")
    return keep(spark.createDataFrame(rows, "feature string, sample string, raw_count bigint")), sheet


def _experiment(spark, counts, groups):
    table, sheet = _tables(spark, counts, groups)
    design = linear.design_matrix(sheet, ["grp"], intercept=False)
    return Experiment(counts=table, samples=sheet, design=design, contrasts=linear.make_contrasts(design, {"b_vs_a": "b-a"}, prefix="grp"))


def _counts(n, g=200, seed=3):
    rng = np.random.default_rng(seed)
    mean = rng.lognormal(5, 0.7, g)[:, None] * np.ones(n)
    return rng.negative_binomial(10, 10 / (10 + mean))


@pytest.fixture(scope="module")
def outliers(spark):
    """Seven and seven replicates; f005 and f150 hold one huge count each, f160 nothing but one."""
    counts = _counts(14)
    counts[5, 2], counts[150, 9] = 60_000, 80_000
    counts[160] = 0
    counts[160, 4] = 9_000
    exp = _experiment(spark, counts, "a" * 7 + "b" * 7)
    return counts, exp, _fit(exp)


def _fit(exp):
    factors = keep(nz.size_factors(exp.counts, exp.samples.count()))
    data = negbin.nb_input(exp.counts, exp.design, size_factors=factors)
    dispersion, trend = negbin.dispersions_and_trend(data)
    return data, negbin.nb_glm_fit(data, keep(dispersion)), trend


def test_replaced_cells_are_trimmed_means(outliers):
    counts, exp, (data, fit, _) = outliers
    got = {r["feature"]: r for r in negbin.replaced_outliers(fit).collect()}
    assert {"f005", "f150", "f160"} <= set(got) and len(got) < 20
    scale = np.exp(data.offset)
    for f, j in (("f005", 2), ("f150", 9), ("f160", 4)):
        old = counts[int(f[1:])]
        want = math.floor(np.sort(old / scale)[2:12].mean() * scale[j] + 1e-9)
        assert got[f]["x"][j] == want and got[f]["n_replaced"] >= 1 and got[f]["max_cooks"] is None
        assert got[f]["n_replaced"] == (np.array(got[f]["x"]) != old).sum()


def test_outliers_get_finite_p_and_other_rows_stay(outliers):
    _, exp, (_, fit, _) = outliers
    plain = {r["feature"]: r for r in pipelines.deseq2_analysis(exp, replace_from=None).collect()}
    replaced = {r["feature"]: r for r in pipelines.deseq2_analysis(exp).collect()}
    touched = {r["feature"] for r in negbin.replaced_outliers(fit).collect()}
    assert plain["f005"]["p_value"] is None and plain["f150"]["p_value"] is None
    assert len(replaced) == len(plain) and all(r["p_value"] is not None for r in replaced.values())
    assert abs(replaced["f005"]["avg_log2fc"]) < 1 < abs(plain["f005"]["avg_log2fc"])
    assert replaced["f160"]["avg_log2fc"] == 0 and abs(replaced["f160"]["p_value"] - 1) < 1e-9
    same = [f for f in plain if f not in touched]
    assert len(same) > 180
    assert all(plain[f]["p_value"] == replaced[f]["p_value"] and plain[f]["avg_log2fc"] == replaced[f]["avg_log2fc"] for f in same)


def test_second_fit_is_that_of_the_replaced_counts(outliers):
    _, _, (data, fit, trend) = outliers
    again = {r["feature"]: r for r in negbin.refit_outliers(data, fit, trend).table.collect()}
    changed = {r["feature"]: np.array(r["x"]) for r in negbin.replaced_outliers(fit).collect()}
    for f in ("f005", "f150"):
        mean = [np.exp(again[f]["coef"][k]) for k in range(2)]
        q = changed[f] / np.exp(data.offset)
        assert np.allclose(mean, [q[:7].mean(), q[7:].mean()], rtol=0.05)
        assert abs(again[f]["base_mean"] - q.mean()) < 1e-9


def test_few_replicates_are_not_replaced(spark):
    counts = _counts(12, g=120)
    counts[5, 2] = 60_000
    exp = _experiment(spark, counts, "a" * 6 + "b" * 6)
    de = {r["feature"]: r["p_value"] for r in pipelines.deseq2_analysis(exp).collect()}
    assert de["f005"] is None and negbin.replaced_outliers(_fit(exp)[1]).count() == 0
    mixed = _experiment(spark, np.hstack([counts, _counts(2, g=120, seed=8)]), "a" * 6 + "b" * 8)
    assert negbin.replaced_outliers(_fit(mixed)[1]).where("feature = 'f005'").count() == 0  # the cell lies in the smaller group


@pytest.fixture(scope="module")
def shrinkage(spark):
    rng = np.random.default_rng(11)
    g, n, planted = 1500, 10, 0.4
    effect = rng.normal(0, planted, g)
    mean = rng.lognormal(5, 1, g)[:, None] * np.exp(effect[:, None] * (np.arange(n) >= n // 2))
    counts = rng.negative_binomial(20, 20 / (20 + mean))
    table, sheet = _tables(spark, counts, "a" * 5 + "b" * 5)
    design = linear.design_matrix(sheet, ["grp"], intercept=True)
    factors = spark.createDataFrame([(f"s{j:02d}", 1.0) for j in range(n)], "sample string, size_factor double")
    data = negbin.nb_input(table, design, size_factors=factors)
    fit = negbin.nb_glm_fit(data, table.select("feature").distinct().selectExpr("feature", "0.05D AS dispersion"))
    return counts, effect, planted, fit


def test_prior_scale_is_recovered(shrinkage):
    _, _, planted, fit = shrinkage
    got = negbin.prior_scale(fit, "grpb")
    assert abs(got - planted) < 0.1 * planted
    rows = fit.table.collect()
    b, v = np.array([r["coef"][1] for r in rows]), np.array([r["cov"][3] for r in rows])
    a = np.geomspace(1e-3, 2, 20001)
    best = a[np.argmax([-(np.log(s + v) + b * b / (s + v)).sum() for s in a])]
    assert abs(got ** 2 - best) < 1e-3 * best


def test_sign_error_against_plain_integration(shrinkage):
    counts, _, _, fit = shrinkage
    out = {r["feature"]: r for r in negbin.lfc_shrink(fit, "grpb", scale=0.3).collect()}
    picked = sorted(out, key=lambda f: abs(out[f]["sign_error"] - 0.2))[:4] + sorted(out, key=lambda f: abs(out[f]["sign_error"] - 0.01))[:3]
    base, change = np.linspace(-1.5, 1.5, 601), np.linspace(-4, 4, 1601)
    for f in picked:
        y = counts[int(f[1:])]
        level = math.log(max(y[:5].mean(), 0.5))
        one = lambda part, log_mu: (negbin.nb_loglik(np.tile(part, (log_mu.size, 1)).astype(float), np.exp(log_mu.reshape(-1, 1)), np.full((log_mu.size, 1), 0.05))).reshape(log_mu.shape)
        logs = one(y[:5], level + base)[:, None] + one(y[5:], (level + base)[:, None] + change) - np.log1p((change / 0.3) ** 2)
        density = np.exp(logs - logs.max()).sum(axis=0)
        wrong = density[change < 0] if out[f]["lfc_shrunk"] >= 0 else density[change > 0]
        want = (wrong.sum() + density[change == 0].sum() / 2) / density.sum()
        assert abs(out[f]["sign_error"] - want) < 0.02 * want + 1e-4, (f, out[f], want)
        mode = change[np.argmax(density)]
        assert abs(out[f]["lfc_shrunk"] * math.log(2) - mode) < 0.02


def test_sign_errors_are_calibrated(shrinkage):
    _, effect, _, fit = shrinkage
    rows = negbin.s_values(keep(negbin.lfc_shrink(fit, "grpb"))).collect()
    assert all(0 <= r["sign_error"] <= 1 for r in rows)
    false = [r["lfc_shrunk"] * effect[int(r["feature"][1:])] < 0 for r in rows]
    expected = np.mean([r["sign_error"] for r in rows])
    assert abs(np.mean(false) - expected) < 0.03
    ordered = sorted(rows, key=lambda r: (r["sign_error"], r["feature"]))
    running = np.cumsum([r["sign_error"] for r in ordered]) / np.arange(1, len(ordered) + 1)
    assert np.allclose([r["s_value"] for r in ordered], running)


def test_scale_of_effects_without_scatter(spark):
    """Effects no wider than their errors leave the least scale."""
    counts = np.random.default_rng(5).poisson(200, (300, 6))
    table, sheet = _tables(spark, counts, "aaabbb")
    design = linear.design_matrix(sheet, ["grp"], intercept=True)
    data = negbin.nb_input(table, design, size_factors=spark.createDataFrame([(f"s{j:02d}", 1.0) for j in range(6)], "sample string, size_factor double"))
    fit = negbin.nb_glm_fit(data, table.select("feature").distinct().selectExpr("feature", "0.2D AS dispersion"))
    assert negbin.prior_scale(fit, "grpb") < 0.01
