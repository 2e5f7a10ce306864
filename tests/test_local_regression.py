"""The distributed curve against a plain one on one machine, exact ranks, and the weights that follow from it."""

import numpy as np
import pytest

from countspark.functions import local_regression as lr
from countspark.operators import linear


def plain_curve(x, y, span, robust, delta):
    """Anchor by anchor over all points."""
    n, reach = len(x), x.max() - x.min()
    cells = np.floor((x - x.min()) / (delta * reach)) if reach else np.zeros(n)
    anchors = np.unique([v for c in np.unique(cells) for v in (x[cells == c].min(), x[cells == c].max())])
    k = max(min(int(span * n + 1e-7), n), min(2, n))
    rw, fitted = np.ones(n), None
    for turn in range(robust + 1):
        if turn:
            r = np.abs(y - np.interp(x, anchors, fitted))
            s = 6 * np.median(r)
            if s <= 1e-7 * np.abs(fitted).mean():
                break
            rw = np.where(r <= 0.001 * s, 1, np.where(r <= 0.999 * s, (1 - (r / s) ** 2) ** 2, 0))
        out = []
        for a in anchors:
            d = np.abs(x - a)
            h = np.sort(d)[k - 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                w = rw * np.where(d <= 0.001 * h, 1, np.where(d <= 0.999 * h, (1 - (d / h) ** 3) ** 3, 0))
            mx, my = np.average(x, weights=w), np.average(y, weights=w)
            v = np.average((x - mx) ** 2, weights=w)
            out.append(my + (a - mx) * np.average((x - mx) * y, weights=w) / v if reach and np.sqrt(v) > 0.001 * reach else my)
        fitted = np.array(out)
    return anchors, fitted


@pytest.mark.parametrize("n, span, kind", [(3000, 0.5, "smooth"), (500, 0.2, "ties"), (40, 0.5, "smooth"), (1, 0.5, "smooth"), (2000, 0.3, "outliers"), (64, 0.5, "same")])
def test_curve(spark, monkeypatch, n, span, kind):
    monkeypatch.setattr(lr, "BLOCK", 700)
    monkeypatch.setattr(lr, "LEFT", 500)
    rng = np.random.default_rng(n)
    x = rng.gamma(2, 3, n)
    if kind == "ties":
        x = np.round(x)
    if kind == "same":
        x = np.full(n, 2.5)
    y = np.sin(x) + 2 + rng.normal(0, 0.2, n)
    if kind == "outliers":
        y[::17] += 40
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, None), (float("nan"), 2.0)]
    curve = lr.local_regression(spark.createDataFrame(rows, "a double, b double").repartition(5), "a", "b", span=span)
    at, want = plain_curve(x, y, span, 3, 0.01)
    assert len(curve.x) <= 204 and (curve.x == at).all() and np.abs(curve.y - want).max() < 1e-6


def test_kth_smallest(spark, monkeypatch):
    monkeypatch.setattr(lr, "LEFT", 10)
    rng = np.random.default_rng(1)
    x = np.append(np.round(rng.exponential(5, 900), 2), np.zeros(100))
    points = spark.createDataFrame([(float(v), 0.0) for v in x], "x double, y double").repartition(4)
    ks = np.array([1, 100, 101, 500, 1000])
    got = lr.kth_smallest(points, lambda px, _: np.repeat(px[:, None], 5, axis=1), ks, np.full(5, x.max()))
    assert (got == np.sort(x)[ks - 1]).all()


def test_no_points(spark):
    with pytest.raises(ValueError):
        lr.local_regression(spark.createDataFrame([], "a double, b double"), "a", "b")


def test_voom_weights_are_those_of_the_plain_curve(spark, cohort):
    df, sheet, counts = cohort
    design = linear.design_matrix(sheet, ["grp"], intercept=False)
    got = linear.voom_weights(df, design).long(sheet).toPandas()
    counts = counts[counts.any(axis=1)]
    size = counts.sum(0) + 1.0
    e = np.log2((counts + 0.5) / size * 1e6)
    x = np.repeat(np.eye(2), 4, axis=0)
    coef = e @ x @ np.linalg.inv(x.T @ x)
    sd = np.sqrt(((e - coef @ x.T) ** 2).sum(1) / 6)
    shift = np.log2(size) - np.log2(1e6)
    at, fitted = plain_curve(e.mean(1) + shift.mean(), np.sqrt(sd), 0.5, 3, 0.01)
    want = 1 / np.interp(coef @ x.T + shift, at, fitted) ** 4
    table = got.pivot(index="feature", columns="sample", values="weight").to_numpy()
    assert np.abs(table / want - 1).max() < 1e-6
