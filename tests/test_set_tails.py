"""Tails of quadratic forms against closed forms and simulation; set tests against permutations; sums of sets over many tasks."""

import numpy as np
import pytest

from countspark.functions.special import betainc, quadratic_ratio_tail
from countspark.operators import linear, sets


@pytest.mark.parametrize("n", [3, 10, 40])
def test_one_direction_is_a_beta(n):
    """A single weight: the share of one squared normal in all of them."""
    for share in (0.001, 0.1, 0.5, 0.9, 0.99, 0.9999):
        want = float(betainc(np.array([(n - 1) / 2]), np.array([0.5]), np.array([1 - share]))[0])
        got = quadratic_ratio_tail(np.append(5.0, np.zeros(n - 1)), 5.0 * share)
        assert abs(got / want - 1) < 1e-6, (n, share)


def test_mixed_weights_against_simulation():
    rng = np.random.default_rng(3)
    weights = rng.gamma(1, 2, 12)
    z = rng.normal(size=(400_000, 12)) ** 2
    share = (z @ weights) / z.sum(1)
    for q in (0.1, 0.5, 0.9, 0.99, 0.999):
        at = np.quantile(share, q)
        assert abs(quadratic_ratio_tail(weights, at) - (1 - q)) < 4 * np.sqrt(q * (1 - q) / len(z)) + 1e-6
    assert quadratic_ratio_tail(weights, weights.max() * 1.01) == 0 and quadratic_ratio_tail(weights, 0.0) == 1 and np.isnan(quadratic_ratio_tail(np.zeros(3), 0.0))


@pytest.fixture(scope="module")
def many_sets(spark):
    """1,000 sets of 20 features; the features of one follow the tested column a little, each alone would not show."""
    rng = np.random.default_rng(6)
    g, n = 4000, 24
    tested = rng.normal(size=n)
    y = rng.normal(size=(g, n))
    members = {f"set{k:04d}": rng.choice(np.arange(20, g), 20, replace=False) for k in range(999)} | {"planted": np.arange(20)}
    y[:20] += 0.9 * tested
    norm = spark.createDataFrame([(f"f{i}", f"s{j:02d}", float(y[i, j])) for i in range(g) for j in range(n)], "feature string, sample string, v double")
    design = spark.createDataFrame([(f"s{j:02d}", c, float(v)) for j in range(n) for c, v in (("one", 1.0), ("tested", tested[j]))], "sample string, coef string, value double")
    table = spark.createDataFrame([(s, f"f{i}") for s, m in members.items() for i in m], "set_id string, feature string")
    return norm, design, design.where("coef = 'one'"), table, y, tested, members


def test_planted_set_passes_holm_among_a_thousand(spark, many_sets):
    norm, design, null, table, y, tested, members = many_sets
    got = sets.set_score_test(norm, design, null, table, value="v", coef="tested").toPandas().set_index("set_id")
    assert len(got) == 1000 and (got["n_features"] == 20).all()
    assert got["p_value"].idxmin() == "planted" and got.loc["planted", "p_value"] * 1000 < 0.01
    others = got["p_value"].drop("planted")
    assert abs(others.mean() - 0.5) < 0.03 and abs((others < 0.05).mean() - 0.05) < 0.03
    r = tested - tested.mean()
    z = (y - y.mean(1, keepdims=True)) / y.std(1, ddof=1, keepdims=True)
    for s in list(members)[::97]:
        assert abs(got.loc[s, "stat"] / ((z[members[s]] @ r) ** 2).sum() - 1) < 1e-9


def test_tail_agrees_with_a_million_permutations(spark, many_sets):
    norm, design, null, table, y, tested, members = many_sets
    some = ["planted", "set0001", "set0002", "set0003", "set0004"]
    got = sets.set_score_test(norm, design, null, table.where(table["set_id"].isin(some)), value="v", coef="tested").toPandas().set_index("set_id")["p_value"]
    rng = np.random.default_rng(8)
    r = tested - tested.mean()
    z = (y - y.mean(1, keepdims=True)) / y.std(1, ddof=1, keepdims=True)
    above, stat = dict.fromkeys(some, 0), {s: ((z[members[s]] @ r) ** 2).sum() for s in some}
    for _ in range(20):
        moved = rng.permuted(np.tile(r, (50_000, 1)), axis=1).T
        for s in some:
            above[s] += int((((z[members[s]] @ moved) ** 2).sum(0) >= stat[s]).sum())
    for s in some:
        p = above[s] / 1e6
        assert abs(got[s] - p) < 0.02 * p + 0.01 if p > 1e-3 else got[s] < 3e-3, (s, got[s], p)


def test_sums_of_sets_over_many_tasks(spark, many_pieces):
    """Integer and text ids, sets spread over all tasks, more numbers than a row holds."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 9, (300, 5)).astype(float)
    rows = [(i % 3, [0, 1, 2, 3, 4], y[i].tolist()) for i in range(300)]
    for kind, name in (("int", lambda s: s), ("string", str)):
        table = spark.createDataFrame([(name(s), i, x) for s, i, x in rows], f"set_id {kind}, idx array<int>, x array<double>").repartition(9)
        got = sets._fold_sets(table, 5, 25, lambda b: (b.T @ b).ravel(), table.schema["set_id"].dataType).collect()
        assert {r["set_id"]: r["m"] for r in got} == {name(s): 100 for s in range(3)}
        for r in got:
            part = y[int(r["set_id"])::3]
            assert np.abs(np.array(r["v"]) - (part.T @ part).ravel()).max() < 1e-9


def test_camera_and_permutations_still_agree(spark, many_sets):
    norm, design, null, table, *_ = many_sets
    some = table.where("set_id in ('planted', 'set0001')")
    exact = sets.set_score_test(norm, design, null, some, value="v", coef="tested").toPandas().set_index("set_id")
    shuffled = sets.set_score_test(norm, design, null, some, value="v", coef="tested", n_perm=999).toPandas().set_index("set_id")
    assert (exact["stat"] / shuffled["stat"] - 1).abs().max() < 1e-9 and shuffled.loc["planted", "p_value"] <= 0.002
    assert abs(exact.loc["set0001", "p_value"] - shuffled.loc["set0001", "p_value"]) < 0.06
    fit = linear.lm_fit(norm, "v", design)
    got = sets.camera_test(fit, linear.make_contrasts(design, {"t": "tested"}), some).toPandas().set_index("set_id")
    assert got.loc["planted", "p_value"] < 1e-4
