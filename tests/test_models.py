"""Models without a SQL form against plain numpy, planted signals, and invariances."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countspark.functions import rows as rows_module, special
from countspark.model import Experiment
from countspark.operators import factors, linear, multivariate as mv, negbin, normalize as nz, pairwise as pw, sets
from countspark.plans import pipelines
from countspark.session import keep


def test_special_functions():
    x = np.array([0.3, 1.0, 2.5, 7.9, 8.0, 50.0, 1e5])
    assert np.allclose(special.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12)
    assert abs(special.digamma(1.0) + 0.5772156649015329) < 1e-10
    assert abs(special.trigamma(1.0) - math.pi ** 2 / 6) < 1e-9
    assert abs(special.trigamma(special.trigamma_inverse(0.37)) - 0.37) < 1e-9
    assert abs(special.t_two_sided(2.0, 1.0) - (1 - 2 * math.atan(2.0) / math.pi)) < 1e-12  # Cauchy
    assert abs(special.t_two_sided(1.96, np.inf) - 0.04999579) < 1e-7
    assert abs(special.f_quantile(0.95, 1, 10) - special.t_quantile(0.975, 10) ** 2) < 1e-6
    assert abs(special.t_quantile(0.975, 10) - 2.2281388519649385) < 1e-8


def test_nb_fit_matches_one_way_means():
    rng = np.random.default_rng(1)
    y = rng.poisson(20, (40, 6)).astype(float)
    y[0, :3] = 0
    x = np.array([[1, 0]] * 3 + [[0, 1]] * 3, dtype=float)
    alpha = np.full((40, 1), 0.2)
    beta, mu, info = negbin.irls(y, x, np.zeros(6), alpha)
    assert np.allclose(np.exp(beta[1:, 0]), y[1:, :3].mean(axis=1), rtol=1e-4)
    assert np.allclose(np.exp(beta[:, 1]), y[:, 3:].mean(axis=1), rtol=1e-4)
    assert np.isfinite(beta).all() and np.exp(beta[0, 0]) < 1e-3
    score = ((y - mu) / (1 + alpha * mu)) @ x
    assert np.abs(score[1:]).max() < 1e-2


def test_exact_split_tail_by_enumeration():
    def pmf(k, r):
        return math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1))

    s1, total, n1, n2, alpha = 3, 17, 3, 4, 0.4
    w = np.array([pmf(k, n1 / alpha) * pmf(total - k, n2 / alpha) for k in range(total + 1)])
    want = min(1, 2 * min(w[:s1 + 1].sum(), w[s1:].sum()) / w.sum())
    tails = lambda *v: negbin.split_tails(np.array([v[0]]), np.array([v[1]]), v[2], v[3], np.array([v[4]]))[0]
    assert abs(tails(s1, total, n1, n2, alpha) - want) < 1e-12
    both = negbin.split_tails(np.array([3, 0, 17, 5]), np.array([17, 0, 17, 40]), n1, n2, np.full(4, alpha))
    assert abs(both[0] - want) < 1e-12 and both[1] == 1


def test_exact_split_tail_is_one_method_for_any_total():
    """Against the sum over all splits, for totals on both sides of any size that a switch might choose."""
    for s1, total, alpha in ((39_000, 99_000, 0.05), (101_000, 250_000, 0.02), (120_500, 250_000, 1e-6), (0, 5_000, 0.3)):
        k = np.arange(total + 1, dtype=float)
        log_w = special.lgamma(k + 3 / alpha) - special.lgamma(k + 1) + special.lgamma(total - k + 3 / alpha) - special.lgamma(total - k + 1)
        w = np.exp(log_w - log_w.max())
        want = min(1, 2 * min(w[:s1 + 1].sum(), w[s1:].sum()) / w.sum())
        got = negbin.split_tails(np.array([s1]), np.array([total]), 3, 3, np.array([alpha]))[0]
        assert abs(got - want) < 1e-6 * want


def test_dispersion_is_recovered():
    rng = np.random.default_rng(2)
    y = rng.negative_binomial(5, 5 / (5 + 200.0), (400, 10)).astype(float)  # dispersion 0.2
    x = np.array([[1, 0]] * 5 + [[0, 1]] * 5, dtype=float)
    total = negbin.adjusted_profile(y, x, np.zeros(10), negbin.GRID).sum(axis=0)
    assert abs(negbin.grid_peak(total[None, :], negbin.GRID)[0] - 0.2) < 0.03


@pytest.fixture(scope="module")
def experiment(spark, cohort):
    counts, sheet, _ = cohort
    design = linear.design_matrix(sheet, ["grp"], intercept=False)
    return Experiment(counts=keep(counts), samples=sheet, design=design, contrasts=linear.make_contrasts(design, {"b_vs_a": "b-a"}, prefix="grp"))


@pytest.mark.parametrize("analysis", [pipelines.voom_analysis, pipelines.edger_analysis, pipelines.deseq2_analysis])
def test_planted_features_come_first(experiment, analysis):
    de = analysis(experiment).collect()
    assert len(de) == 300 and sorted(r["rank"] for r in de) == list(range(1, 301))
    planted = {f"f{i:03d}" for i in range(0, 300, 10)}
    top = [r["feature"] for r in sorted(de, key=lambda r: r["rank"])[:25]]
    assert sum(f in planted for f in top) >= 23
    change = np.median([r["avg_log2fc"] for r in de if r["feature"] in planted])
    assert 1.5 < change < 2.5
    null = [r["p_value"] for r in de if r["feature"] not in planted and r["p_value"] is not None]
    assert 0.35 < np.mean(null) < 0.65
    assert all(r["adj_p"] >= r["p_value"] - 1e-12 for r in de if r["p_value"] is not None)


def test_ebayes_against_numpy(spark, experiment, cohort):
    counts, sheet, raw = cohort
    norm = keep(nz.log2cpm(counts, sheet))
    got = {r["feature"]: r for r in linear.ebayes_moderate(linear.lm_fit(norm, "log2cpm", experiment.design), experiment.contrasts).collect()}
    lib = raw.sum(axis=0)
    scaled = 2 * lib / lib.mean()
    y = np.log2((raw + scaled) / (lib + 2 * scaled) * 1e6)
    a, b = y[:, :4], y[:, 4:]
    s2 = (a.var(axis=1, ddof=1) + b.var(axis=1, ddof=1)) / 2
    e = np.log(s2) - special.digamma(3) + math.log(3)
    assert e.var(ddof=1) < special.trigamma(3)  # variances no more uneven than chance: one common value for all features
    t = (b.mean(axis=1) - a.mean(axis=1)) / np.sqrt(math.exp(e.mean()) * 0.5)
    assert np.allclose([got[f"f{i:03d}"]["t"] for i in range(300)], t, rtol=1e-8)
    assert np.allclose([got[f"f{i:03d}"]["p_value"] for i in range(300)], special.t_two_sided(t, 6 * 300), rtol=1e-8)


def test_finite_variance_prior(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(size=(200, 6)) * rng.lognormal(0, 0.8, (200, 1))
    norm = keep(spark.createDataFrame([(i, j, float(y[i, j])) for i in range(200) for j in range(6)], "feature int, sample int, v double"))
    sheet = spark.createDataFrame([(j, "a" if j < 3 else "b") for j in range(6)], "sample int, grp string")
    design = linear.design_matrix(sheet, ["grp"], intercept=False)
    contrasts = linear.make_contrasts(design, {"k": "b-a"}, prefix="grp")
    got = {r["feature"]: r for r in linear.ebayes_moderate(linear.lm_fit(norm, "v", design), contrasts).collect()}
    s2 = (y[:, :3].var(axis=1, ddof=1) + y[:, 3:].var(axis=1, ddof=1)) / 2
    e = np.log(s2) - special.digamma(2) + math.log(2)
    d0 = 2 * special.trigamma_inverse(e.var(ddof=1) - special.trigamma(2))
    s02 = math.exp(e.mean() + special.digamma(d0 / 2) - math.log(d0 / 2))
    t = (y[:, 3:].mean(axis=1) - y[:, :3].mean(axis=1)) / np.sqrt((d0 * s02 + 4 * s2) / (d0 + 4) * 2 / 3)
    assert np.allclose([got[i]["t"] for i in range(200)], t, rtol=1e-6)
    assert np.allclose([got[i]["p_value"] for i in range(200)], special.t_two_sided(t, d0 + 4), rtol=1e-6)
    half = np.array([(got[i]["ci_r"] - got[i]["ci_l"]) / 2 for i in range(200)])
    assert np.allclose(half, special.t_quantile(0.975, d0 + 4) * np.abs((y[:, 3:].mean(axis=1) - y[:, :3].mean(axis=1)) / t), rtol=1e-6)


def test_threshold_and_filter(experiment):
    data = negbin.nb_input(experiment.counts, experiment.design, size_factors=nz.size_factors(experiment.counts, 8))
    fit = negbin.nb_glm_fit(data, keep(negbin.nb_dispersion_deseq(data)))
    plain = keep(negbin.nb_wald(fit, experiment.contrasts))
    strict = negbin.wald_lfc_threshold(fit, experiment.contrasts).select("feature", F.col("p_value").alias("strict"))
    assert plain.join(strict, "feature").where("strict < p_value - 1e-9").count() == 0
    kept = negbin.independent_filtering(plain).collect()
    assert all((r["adj_p"] is None) == (r["p_value"] is None or r["base_mean"] < r["mean_cut"]) for r in kept)
    named = negbin.results_contrast(fit, experiment.design, ("grp", "b", "a")).select("feature", F.col("stat").alias("s2"))
    assert plain.join(named, "feature").where("abs(stat - s2) > 1e-9").count() == 0
    lrt = keep(negbin.glm_lrt(fit, experiment.contrasts).select("feature", "stat"))
    wald = {r["feature"]: r["stat"] ** 2 for r in plain.collect()}
    pairs = np.array([(r["stat"], wald[r["feature"]]) for r in lrt.collect()])
    assert np.corrcoef(pairs.T)[0, 1] > 0.95


def test_shrinkage_pulls_towards_zero(spark, cohort):
    counts, sheet, _ = cohort
    design = linear.design_matrix(sheet, ["grp"], intercept=True)
    data = negbin.nb_input(counts, design, size_factors=nz.size_factors(counts, 8))
    out = negbin.lfc_shrink(negbin.nb_glm_fit(data, keep(negbin.nb_dispersion_deseq(data))), "grpb").collect()
    assert all(abs(r["lfc_shrunk"]) <= abs(r["lfc_mle"]) + 1e-4 for r in out)
    assert np.mean([r["lfc_shrunk"] for r in out if r["feature"][-1] == "0"]) > 1.2


def test_blocks_do_not_matter(experiment, monkeypatch):
    data = negbin.nb_input(experiment.counts, experiment.design)
    big = {r["feature"]: r["avg_log2cpm"] for r in negbin.profile_table(data).collect()}
    monkeypatch.setattr(rows_module, "BLOCK_CELLS", 24)
    tiny = {r["feature"]: r["avg_log2cpm"] for r in negbin.profile_table(data).collect()}
    assert big == tiny


def _dense(df, col, names):
    at = {s: i for i, s in enumerate(names)}
    out = {}
    for r in df.collect():
        out.setdefault(r["feature"], np.zeros(len(names)))[at[r["sample"]]] = r[col]
    return np.array([out[f] for f in sorted(out)])


def test_pca_against_numpy(spark, cohort):
    counts, sheet, _ = cohort
    norm = keep(nz.log2cpm(counts, sheet))
    names = [f"s{j}" for j in range(8)]
    x = _dense(norm, "log2cpm", names)
    x = x - x.mean(axis=1, keepdims=True)
    s = np.linalg.svd(x, compute_uv=False)
    full = mv.pca_samples(norm, "log2cpm", sheet, n_top=None, k=7)
    got = [r["eigenvalue"] for r in full.variance.orderBy("dim").collect()]
    assert np.allclose(got, s[:7] ** 2 / 7)
    scores = np.zeros((8, 7))
    for r in full.scores.collect():
        scores[names.index(r["sample"]), r["dim"] - 1] = r["score"]
    assert np.allclose(scores @ scores.T, x.T @ x)  # scores reproduce centred distances
    load = np.array([[v for _, v in sorted((r["dim"], r["loading"]) for r in g)] for g in _groups(full.loadings, "feature")])
    assert np.allclose(load.T @ load, np.eye(7), atol=1e-8)


def _groups(df, key):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return [out[k] for k in sorted(out)]


def test_components_for_few_and_many_samples(spark, cohort):
    """The same block iteration for any number of samples, against a dense decomposition."""
    counts, sheet, _ = cohort
    norm = keep(nz.log2cpm(counts, sheet))
    names = sorted(r["sample"] for r in sheet.collect())
    cells = {(r["feature"], r["sample"]): r["log2cpm"] for r in norm.collect()}
    x = np.array([[cells[f, s] for s in names] for f in sorted({f for f, _ in cells})])
    x -= x.mean(1, keepdims=True)
    got = {(r["sample"], r["dim"]): r["score"] for r in mv.pca_samples(norm, "log2cpm", sheet, n_top=None, k=3).scores.collect()}
    values, vectors = np.linalg.eigh(x.T @ x)
    for d in range(3):
        want = mv._fix_signs(vectors[:, [-1 - d]])[:, 0] * np.sqrt(values[-1 - d])
        assert np.allclose([got[s, d + 1] for s in names], want, atol=1e-6)
    rng = np.random.default_rng(3)
    for n, rank in ((40, 40), (600, 64), (600, 2)):
        a = rng.normal(size=(n, rank))
        gram = a @ a.T
        vectors, values = mv.krylov(lambda q: gram @ q, n, min(5, rank))
        assert np.allclose(values, np.linalg.eigvalsh(gram)[::-1][:min(5, rank)], rtol=1e-8)
        assert np.linalg.norm(gram @ vectors - vectors * values) < 1e-6 * values[0]


def test_mds_recovers_distances(spark, cohort):
    counts, sheet, _ = cohort
    pairs = keep(pw.sample_dist_euclid(nz.log2cpm(counts, sheet), "log2cpm", sheet))
    coords = {}
    for r in mv.mds(pairs, k=7).collect():
        coords.setdefault(r["sample"], {})[r["dim"]] = r["score"]
    for r in pairs.collect():
        a, b = coords[r["sample_a"]], coords[r["sample_b"]]
        assert abs(math.sqrt(sum((a[k] - b[k]) ** 2 for k in a)) - r["distance"]) < 1e-6


def test_many_sample_blocks(spark, monkeypatch):
    """Pairs computed in several groups of sample blocks equal those of one block."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(30, 150))
    df = keep(spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i in range(30) for j in range(150)], "feature int, sample int, v double"))
    monkeypatch.setattr(pw, "STATE_CELLS", 64 * 64 * 2 * 5 * 2)
    got = {(r["sample_a"], r["sample_b"]): r["distance"] for r in pw.leading_logfc_dist(df, "v", top=5).collect()}
    assert len(got) == 150 * 149 // 2
    for a, b in ((0, 1), (3, 149), (64, 65), (63, 64), (10, 140)):
        assert abs(got[(a, b)] - math.sqrt(np.sort((x[:, a] - x[:, b]) ** 2)[-5:].mean())) < 1e-9


def test_poisson_distance_by_hand(spark, cohort):
    counts, sheet, raw = cohort
    got = {(r["sample_a"], r["sample_b"]): r["distance"] for r in pw.sample_dist_poisson(counts, sheet, power=1.0).collect()}
    x = raw[raw.sum(axis=1) > 0].astype(float)
    a, b = x[:, 0], x[:, 5]
    na, nb = a.sum(), b.sum()
    total = 0.0
    for v, n in ((a, na), (b, nb)):
        e = (a + b) * n / (na + nb)
        r = (v + 1) / (e + 1)
        total += (e - e * r + v * np.log(r)).sum()
    assert abs(got[("s0", "s5")] - math.sqrt(total)) < 1e-8


def test_rlog_shrinks_and_orders(spark, cohort):
    counts, sheet, raw = cohort
    got = _dense(factors.rlog(counts, sheet), "rlog", [f"s{j}" for j in range(8)])
    sf = np.array([r["size_factor"] for r in nz.size_factors(counts, 8).orderBy("sample").collect()])
    plain = np.log2(raw[raw.sum(axis=1) > 0] / sf + 0.5)
    assert got.shape == plain.shape
    assert np.mean(got.std(axis=1) <= plain.std(axis=1) + 0.05) > 0.95
    assert np.corrcoef(got.ravel(), plain.ravel())[0, 1] > 0.98


def test_hidden_factors_find_a_batch(spark):
    rng = np.random.default_rng(4)
    batch = np.array([0, 1] * 6)
    mean = rng.lognormal(5, 0.5, 400)[:, None] * np.exp(0.7 * rng.choice([0, 1], (400, 1)) * batch)
    y = rng.poisson(mean)
    counts = keep(spark.createDataFrame([(int(i), int(j), int(y[i, j])) for i in range(400) for j in range(12)], "feature int, sample int, raw_count long"))
    sheet = spark.createDataFrame([(j, "a" if j < 6 else "b") for j in range(12)], "sample int, grp string")
    full = linear.design_matrix(sheet, ["grp"], intercept=True)
    for table in (factors.sva_factors(counts, full, full.where("coef = 'Intercept'"), n_sv=1), factors.ruv_factors(counts, sheet, counts, k=1)):
        values = np.array([r["value"] for r in table.where("factor = 1").orderBy("sample").collect()])
        assert abs(np.corrcoef(values, batch)[0, 1]) > 0.95
    assert linear.design_arrays(factors.add_factors(full, table)).matrix.shape == (12, 3)


def test_deconvolution_recovers_shares(spark):
    rng = np.random.default_rng(6)
    ref = rng.lognormal(2, 1, (60, 3))
    share = np.array([[0.6, 0.3, 0.1], [0.2, 0.2, 0.6]])
    mixed = share @ (ref / ref.sum(axis=0)).T
    profile = spark.createDataFrame([(f"t{k}", int(g), float(ref[g, k])) for g in range(60) for k in range(3)], "cell_type string, feature int, value double")
    tpm = spark.createDataFrame([(int(g), f"s{j}", float(mixed[j, g] * 1e6)) for g in range(60) for j in range(2)], "feature int, sample string, tpm double")
    got = {(r["sample"], r["cell_type"]): r["fraction"] for r in sets.deconvolve_fractions(tpm, profile).collect()}
    for j in range(2):
        assert np.allclose([got[(f"s{j}", f"t{k}")] for k in range(3)], share[j], atol=1e-3)
        assert got[(f"s{j}", "other")] < 1e-3


def test_set_tests_find_the_planted_set(spark, experiment, cohort):
    counts, sheet, _ = cohort
    norm = keep(nz.log2cpm(counts, sheet))
    members = spark.createDataFrame([("planted" if i % 10 == 0 else f"set{i % 7}", f"f{i:03d}") for i in range(300)], "set_id string, feature string")
    camera = {r["set_id"]: r["p_value"] for r in sets.camera_test(linear.lm_fit(norm, "log2cpm", experiment.design), experiment.contrasts, members).collect()}
    assert min(camera, key=camera.get) == "planted" and camera["planted"] < 0.01
    full = linear.design_matrix(sheet, ["grp"], intercept=True)
    out = {r["set_id"]: r for r in sets.set_score_test(norm, full, full.where("coef = 'Intercept'"), members, value="log2cpm", coef="grpb", n_perm=199).collect()}
    assert max(out, key=lambda k: out[k]["stat"] / out[k]["n_features"]) == "planted" and out["planted"]["n_features"] == 30
    assert out["planted"]["p_value"] < 0.08  # 2 of the 70 splits of eight samples are as good as the true one


def test_split_is_repeatable(spark, cohort):
    sheet = cohort[1]
    one = sets.train_split(sheet.repartition(1)).orderBy("sample").collect()
    assert one == sets.train_split(sheet.repartition(5)).orderBy("sample").collect()
    assert sum(r["in_train"] for r in one) == 4


def test_special_functions_vectorised():
    x = np.array([-6.0, -1.5, 0.0, 1e-9, 0.3, 1.0, 1.999, 2.0, 2.5, 5.0, 12.0, 26.0, 40.0])
    want = np.array([math.erfc(v) for v in x])
    assert np.allclose(special.erfc(x), want, rtol=1e-12, atol=0)
    assert np.isnan(special.erfc(np.array([np.nan]))[0])
    p = np.array([0.5, 0.3, 1e-3, 1e-12, 1e-200])
    from statistics import NormalDist
    assert np.allclose(special.normal_upper_quantile(p), [-NormalDist().inv_cdf(v) for v in p], atol=1e-8)
    q = special.t_quantiles(np.array([0.6, 0.975, 0.9999]), 7.0)
    assert np.allclose(1 - special.t_two_sided(q, 7.0) / 2, [0.6, 0.975, 0.9999], atol=1e-12)


@pytest.mark.parametrize("planted", [6.0, 20.0])
def test_prior_degrees_are_recovered(spark, planted):
    """Dispersions scattered around a trend like variances with so many degrees of freedom."""
    import numpy as np

    from countspark.operators import linear, negbin

    rng = np.random.default_rng(11)
    g, n = 16_000, 10
    mean = rng.lognormal(10, 0.6, g)  # counts so high that the Poisson part of the variance does not dilute the scatter
    alpha = (0.01 + 40 / mean) * planted / rng.chisquare(planted, g)
    counts = rng.negative_binomial(1 / alpha[:, None], 1 / (1 + alpha * mean)[:, None], (g, n))
    table = spark.createDataFrame([(f"f{i}", f"s{j}", int(counts[i, j])) for i in range(g) for j in range(n)], "feature string, sample string, raw_count bigint")
    sheet = spark.createDataFrame([(f"s{j}", "ab"[j % 2]) for j in range(n)], "sample string, grp string")
    data = negbin.nb_input(table, linear.design_matrix(sheet, ["grp"], intercept=False))
    got = negbin.nb_dispersion_edger(data).toPandas()
    prior = got["prior_df"].iloc[0]
    assert abs(prior / planted - 1) < 0.1, prior
    own = got.set_index("feature").loc[[f"f{i}" for i in range(g)], "dispersion"].to_numpy()
    assert own.min() > negbin.GRID[0] and own.max() < negbin.GRID[-1]
    assert np.corrcoef(np.log(own), np.log(alpha))[0, 1] > 0.6


def test_prior_degrees_without_scatter(spark, cohort):
    """Degrees that are given are used; equal dispersions leave nearly nothing to a feature of its own."""
    import numpy as np

    from countspark.operators import linear, negbin

    df, sheet, _ = cohort
    data = negbin.nb_input(df, linear.design_matrix(sheet, ["grp"], intercept=False))
    given = negbin.nb_dispersion_edger(data, prior_df=10).toPandas()
    assert (given["prior_df"] == 10).all()
    found = negbin.nb_dispersion_edger(data).toPandas()
    assert found["prior_df"].iloc[0] > 20
    spread = lambda t: np.log(t["dispersion"] / t["trended"]).std()
    assert spread(found) < spread(given)
