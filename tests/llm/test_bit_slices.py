"""Scatter from bit planes against plain integers, whitening against numpy, odd vectors."""

import numpy as np
import pytest

from countspark.llm import bit_slices as bs


@pytest.mark.parametrize("rows, bits", [(1, 1), (64, 3), (1000, 9), (130, 40)])
def test_scatter(rows, bits):
    x = np.random.default_rng(rows).integers(0, 2 ** bits, (rows, 5))
    x[:, 2] = 0
    scatter = bs.Scatter(np.array([int(c.max()).bit_length() for c in x.T]))
    for at in range(0, rows, 300):
        scatter.add(x[at:at + 300].astype(np.uint64))
    plain = x.astype(object)
    assert {(i, j): s for i, j, s in scatter.sums()} == {(i, j): int((plain[:, i] * plain[:, j]).sum()) for i in range(5) for j in range(i, 5)}


def brute(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, total)) for row in x]
    away = x - total / n
    values, axes = np.linalg.eigh(away.T @ away / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, deviation, away @ axes / np.sqrt(values), values / np.trace(away.T @ away / n)


def test_whiten(spark):
    rng = np.random.default_rng(4)
    data = (rng.normal(size=(700, 40)) @ rng.normal(size=(40, 40)) / 10).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(700, data[0].tolist()), (None, data[1].tolist())]
    odd = [(800, None), (801, [None] + [0.5] * 39), (802, [float("nan")] + [0.5] * 39), (803, [float("inf")] + [0.5] * 39), (804, [0.1, 0.2]), (805, [])]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + odd], "vec_id bigint, embedding array<float>, component int, w double").repartition(5)
    got = bs.whiten(table).collect()
    assert len(got) == 702 * 32 and {r["vec_id"] for r in got} == {None, *range(701)}
    n, deviation, white, shares = brute([v for _, v in rows], 32)
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    at = {i: p for p, (i, _) in enumerate(rows)}
    mine = np.empty((n, 32))
    for r in got:
        mine[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[at[r["vec_id"]]] == int(r["deviation_exact"])
        assert abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-9
    sign = np.sign((mine * white).sum(0))
    assert np.abs(mine * sign - white).max() < 1e-7


def test_no_variance_and_wide_integers(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25, -3.0])], "vec_id bigint, embedding array<double>")
    got = bs.whiten(one).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(c, 1, 0, None, None, None) for c in (1, 2, 3)]
    flat = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(10)], "vec_id bigint, embedding array<double>")
    got = bs.whiten(flat).collect()
    assert {(r["component"], r["whitened"]) for r in got} <= {(1, 1.0), (1, -1.0), (2, None)} and {round(r["explained"], 12) for r in got} == {0.0, 1.0}
    wide = spark.createDataFrame([(i, [1e15 * i, 3.0 * i * i]) for i in range(4)], "vec_id bigint, embedding array<double>")
    x = [[64 * 10 ** 15 * i + 1_000_000, 192 * i * i + 1_000_000] for i in range(4)]
    total = [sum(c) for c in zip(*x)]
    want = [sum((4 * c - s) ** 2 for c, s in zip(row, total)) for row in x]
    got = {r["vec_id"]: r for r in bs.whiten(wide).collect()}
    assert [int(got[i]["deviation_exact"]) for i in range(4)] == want
    assert [got[i]["deviation"] for i in range(4)] == [w if w < 2 ** 63 else None for w in want]
    huge = spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert bs.whiten(huge).count() == 4


def test_empty(spark):
    assert bs.whiten(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert bs.whiten(spark.createDataFrame([(1, []), (2, None)], "vec_id bigint, embedding array<float>")).count() == 0
