"""Distributed ranks, running sums, quantiles and corrections against brute force, with groups split over many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from countspark.functions.adjust import bh_adjust, holm_adjust
from countspark.functions.scans import PIECE, average_ranks, quantiles, scan, spread


def _skewed(spark, n=4000):
    """One group holds most rows; values repeat often."""
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 10 else f"g{i % 30}", i, int(v)) for i, v in enumerate(rng.integers(0, 60, n))]
    return spark.createDataFrame(rows, "grp string, id long, v long"), rows


def test_hot_group_is_split(many_pieces):
    df, _ = _skewed(many_pieces)
    rows, single = spread(df, ["grp"], [F.col("v").asc(), F.col("id").asc()])
    assert not single
    pieces = rows.groupBy("grp").agg(F.countDistinct(PIECE).alias("k"), F.count("*").alias("n")).where("grp = 'hot'").first()
    assert pieces["k"] >= 4


@pytest.mark.parametrize("split", [True, False])
def test_scan(spark, request, split):
    if split:
        request.getfixturevalue("many_pieces")
    df, rows = _skewed(spark)
    out = scan(df, ["grp"], [F.col("v").desc(), F.col("id").asc()], number="i", sums={"c": "v"}, totals={"t": "v"}, size="n").collect()
    want = {}
    for grp in {r[0] for r in rows}:
        part = sorted([r for r in rows if r[0] == grp], key=lambda r: (-r[2], r[1]))
        run = 0
        for k, (_, ident, v) in enumerate(part, 1):
            run += v
            want[ident] = (k, run, sum(r[2] for r in part), len(part))
    assert {r["id"]: (r["i"], r["c"], r["t"], r["n"]) for r in out} == want


@pytest.mark.parametrize("split", [True, False])
def test_quantiles_and_ranks(spark, request, split):
    if split:
        request.getfixturevalue("many_pieces")
    df, rows = _skewed(spark)
    got = {r["grp"]: r for r in quantiles(df, ["grp"], "v", {"a": 0.05, "b": 0.5, "c": 0.731}).collect()}
    for grp in {r[0] for r in rows}:
        v = [r[2] for r in rows if r[0] == grp]
        assert np.allclose([got[grp][k] for k in "abc"], np.quantile(v, [0.05, 0.5, 0.731]))
    ranks = {r["id"]: r["r"] for r in average_ranks(df, ["grp"], "v", "r").collect()}
    for grp, ident, v in rows[:200]:
        values = [r[2] for r in rows if r[0] == grp]
        assert ranks[ident] == sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2


def _bh(p):
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


@pytest.mark.parametrize("split", [True, False])
def test_adjustments(spark, request, split):
    if split:
        request.getfixturevalue("many_pieces")
    rng = np.random.default_rng(5)
    p = np.round(rng.uniform(size=1500) ** 4, 3)
    rows = [("k", int(i), None if i % 11 == 0 else float(p[i])) for i in range(len(p))]
    df = spark.createDataFrame(rows, "contrast string, feature long, p_value double")
    tested = [i for i in range(len(p)) if i % 11]
    want = dict(zip(tested, _bh(p[tested])))
    got = {r["feature"]: (r["adj_p"], r["rank"]) for r in bh_adjust(df, rank="rank").collect()}
    assert len(got) == len(p)
    assert all(got[i][0] is None for i in range(len(p)) if i % 11 == 0)
    assert all(abs(got[i][0] - want[i]) < 1e-12 for i in tested)
    assert sorted(v[1] for v in got.values()) == list(range(1, len(p) + 1))
    holm = {r["feature"]: r["adj_p"] for r in holm_adjust(df, key="feature").collect()}
    order = sorted(tested, key=lambda i: (p[i], i))
    run = 0.0
    for k, i in enumerate(order):
        run = max(run, p[i] * (len(order) - k))
        assert abs(holm[i] - min(run, 1)) < 1e-9


def test_partitioning_does_not_matter(many_pieces):
    df, _ = _skewed(many_pieces)
    order = [F.col("v").asc(), F.col("id").asc()]
    one = scan(df.repartition(1), ["grp"], order, number="i").orderBy("id").collect()
    many = scan(df.repartition(17), ["grp"], order, number="i").orderBy("id").collect()
    assert one == many
