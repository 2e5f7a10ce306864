"""Shares by active sets, rising regression and curves of null probabilities against plain versions."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from countspark.functions.monotone import pool_neighbours
from countspark.operators import factors, linear, sets
from countspark.session import keep


def _best_face(gram, t):
    """The best point over all faces of the simplex with a share left over."""
    k = len(t)
    best, value = np.zeros(k), 0.0
    for size in range(1, k + 1):
        for face in itertools.combinations(range(k), size):
            f = list(face)
            inner = np.linalg.solve(gram[np.ix_(f, f)], t[f])
            kkt = np.block([[gram[np.ix_(f, f)], np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            edge = np.linalg.solve(kkt, np.append(t[f], 1.0))[:size]
            for part in (inner, edge):
                if part.min() < -1e-12 or part.sum() > 1 + 1e-9:
                    continue
                p = np.zeros(k)
                p[f] = part
                at = p @ gram @ p - 2 * p @ t
                if at < value - 1e-14:
                    best, value = p, at
    return best


@pytest.mark.parametrize("seed", range(4))
def test_shares_are_the_best_of_all_faces(seed):
    rng = np.random.default_rng(seed)
    ref = rng.lognormal(0, 1, (30, 4))
    gram = ref.T @ ref
    targets = rng.normal(size=(60, 4)) * np.diag(gram) * rng.choice([0.1, 1, 5], (60, 1))
    p, residual = sets.simplex_fit(gram, targets)
    assert residual.max() < 1e-9 and p.min() >= 0 and p.sum(axis=1).max() <= 1 + 1e-12
    assert np.allclose(p, [_best_face(gram, t) for t in targets], atol=1e-9)
    assert len({tuple(r) for r in (p > 0)}) > 5  # many different active sets


def test_many_types_alike_and_repeated():
    rng = np.random.default_rng(1)
    ref = rng.lognormal(0, 1, (40, 1)) * np.exp(0.05 * rng.normal(size=(40, 12)))  # ill-conditioned
    targets = np.vstack([rng.dirichlet(np.ones(12), 200) @ ref.T, rng.lognormal(0, 1, (50, 40))]) @ ref
    assert sets.simplex_fit(ref.T @ ref, targets)[1].max() < 1e-9
    twice = np.hstack([ref[:, :3], ref[:, :1]])  # a repeated type has no unique share, but an optimal one
    assert sets.simplex_fit(twice.T @ twice, rng.lognormal(0, 1, (20, 40)) @ twice)[1].max() < 1e-9
    assert sets.simplex_fit(ref.T @ ref, np.zeros((3, 12)))[0].sum() == 0


def test_residual_is_returned(spark):
    profile = spark.createDataFrame([(f"t{k}", g, float(1 + (g * 7 + k * 3) % 11 + 20 * (g % 3 == k))) for g in range(30) for k in range(3)], "cell_type string, feature int, value double")
    tpm = spark.createDataFrame([(g, f"s{j}", float((g * 13 + j * 5) % 17)) for g in range(30) for j in range(6)], "feature int, sample string, tpm double")
    rows = sets.deconvolve_fractions(tpm, profile).collect()
    assert len(rows) == 24 and all(r["residual"] < 1e-9 for r in rows)
    for j in range(6):
        assert abs(sum(r["fraction"] for r in rows if r["sample"] == f"s{j}") - 1) < 1e-12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 5), st.floats(0.1, 9)), min_size=1, max_size=25))
def test_rising_regression(pairs):
    """Against the formula: the largest over starts of the smallest over ends of the weighted mean between."""
    v, w = np.array(pairs).T
    mean = lambda a, b: (v[a:b + 1] * w[a:b + 1]).sum() / w[a:b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
    assert np.allclose(pool_neighbours(v, w), want, atol=1e-9)


def test_null_curve_against_all_values():
    rng = np.random.default_rng(2)
    z = np.concatenate([rng.normal(size=6000), rng.normal(-3, 0.8, 2000)])
    p = np.array([math.erfc(-v / math.sqrt(2)) / 2 for v in z])
    counts = factors._count_scores(p)
    assert counts.sum() == len(p) and factors._count_scores(np.array([0.0, 1.0, 1e-300])).sum() == 3
    curve = factors.null_curve(counts)
    assert (np.diff(curve) >= 0).all() and curve.max() <= 1
    sd, spread = z.std(ddof=1), np.subtract(*np.quantile(z, [0.75, 0.25])) / 1.34
    width = 1.5 * 0.9 * min(sd, spread) * len(z) ** -0.2
    pi0 = min(1, (p >= 0.8).mean() / 0.2)
    for at in (-4.0, -3.0, -2.0, -1.5):
        f = np.exp(-((at - z) / width) ** 2 / 2).mean() / (width * math.sqrt(2 * math.pi))
        want = min(1, pi0 * math.exp(-at * at / 2) / math.sqrt(2 * math.pi) / f)
        got = curve[factors._score_bin(np.array([math.erfc(-at / math.sqrt(2)) / 2]))[0]]
        assert abs(got - want) < 0.03 * want + 0.005, (at, got, want)
    assert curve[-1] > 0.9 and curve[0] < 0.01
    assert (factors.null_curve(np.zeros_like(counts)) == 1).all()


def test_weak_batch_beside_a_strong_effect(spark):
    """A factor that a tenth of the features carry, while others carry the groups."""
    rng = np.random.default_rng(14)
    batch, group = np.array([0, 1] * 8), np.array([0] * 8 + [1] * 8)
    mean = rng.lognormal(5, 0.5, 600)[:, None] * np.exp(0.8 * (np.arange(600) % 10 == 0)[:, None] * batch + 1.0 * (np.arange(600) % 5 == 1)[:, None] * group)
    y = rng.poisson(mean)
    counts = keep(spark.createDataFrame([(int(i), int(j), int(y[i, j])) for i in range(600) for j in range(16)], "feature int, sample int, raw_count long"))
    sheet = spark.createDataFrame([(j, "ab"[group[j]]) for j in range(16)], "sample int, grp string")
    full = linear.design_matrix(sheet, ["grp"], intercept=True)
    out = factors.sva_factors(counts, full, full.where("coef = 'Intercept'"), n_sv=1).orderBy("sample").collect()
    values = np.array([r["value"] for r in out])
    assert abs(np.corrcoef(values, batch)[0, 1]) > 0.95
    assert abs(np.corrcoef(values, group)[0, 1]) < 0.2
