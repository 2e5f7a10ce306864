"""Recall and scores against brute force, estimates within their bound, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from countspark.llm import rotated_codes as rc


def brute(ids, vectors, asked, k):
    out = {}
    for i in asked:
        at = ids.index(i)
        d = [(float(np.sqrt(((v - vectors[at]) ** 2).sum())), j) for j, v in zip(ids, vectors) if j != i]
        out[i] = sorted(d)[:k]
    return out


@pytest.mark.parametrize("block", [8192, 64])
def test_recall(spark, block):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {}
    for r in rc.nearest(table, F.col("vec_id") % 20 == 0, block=block, query_block=7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.collect()]
    want = brute([r[0] for r in rows], [r[1] for r in rows], sorted(got), 10)
    assert len(got) == sum(i % 20 == 0 for i, _ in rows)
    hits = sum(len({j for _, j in want[i]} & {j for _, j in got[i].values()}) for i in want)
    assert hits >= 0.99 * 10 * len(want)
    for i in want:
        assert sorted(got[i]) == list(range(1, 11)) and [got[i][r][0] for r in range(1, 11)] == sorted(s for s, _ in got[i].values())
        exact = dict((j, d) for d, j in want[i])
        assert all(abs(s - exact[j]) < 1e-12 for s, j in got[i].values() if j in exact)


def test_estimates_keep_their_bound():
    rng = np.random.default_rng(5)
    v, q = rng.normal(size=(2000, 64)), rng.normal(size=64)
    turn = rc.rotations(64)
    bits, length, inner = rc.encode(v, np.zeros(64), turn)
    signs = np.unpackbits(bits, axis=1, count=turn.shape[1], bitorder="little") * 2.0 - 1
    estimate = signs @ (q / np.linalg.norm(q) @ turn) / 8 / rc.ROTATIONS / inner
    exact = v @ q / np.linalg.norm(q) / length
    spread = np.sqrt(1 - inner ** 2) / inner / np.sqrt(63 * rc.ROTATIONS)
    assert (np.abs(estimate - exact) <= 3 * spread).mean() > 0.99 and abs((estimate - exact).mean()) < 0.005


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]),
            (200, [0.0, 0.0]), (300, None), (400, [1.0, 2.0, 2.0]), (None, [2.0, 0.0]), (2, [1.0, 1.0]), (100, [0.0, 1.0])]
    table = spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id bigint, embedding array<double>, rank string")
    got = {}
    for r in sorted(rc.nearest(table, F.col("vec_id") % 100 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 6)))
    assert got == {0: [(None, 1.0), (1, 1.0), (2, 1.0), (2, 1.0), (100, 1.414214), (100, 1.414214)], 100: [(1, 1.0), (2, 1.0), (2, 1.0), (0, 1.414214), (None, 2.236068)], 400: [(9, 1.0)]}
    for none in (table.limit(0), table.where("vec_id = 3"), table.where("vec_id = 1")):
        assert rc.nearest(none, F.col("vec_id") % 100 == 0).count() == 0
