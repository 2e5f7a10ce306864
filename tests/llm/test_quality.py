"""Features, updates, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest

from countspark.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_dot_product_is_that_of_the_sparse_rows():
    texts = [b"One two, THREE!! 44 ##", b"", b"x " * 700000, "Été où".encode()]
    weights = np.random.default_rng(1).normal(size=1 << q.BITS)
    dots = q.dot_products(texts, weights)
    assert np.allclose(dots, [v @ weights[a] for a, v in q.sparse_rows(texts)], rtol=1e-9)
    assert dots[1] == 0


def test_updates_separate():
    rng = np.random.default_rng(2)
    rows = [(np.array([i % 2, 2 + rng.integers(0, 50)]), np.ones(2)) for i in range(400)]
    weights, bias = q.ftrl(rows, np.array([i % 2 for i in range(400)], float), bits=6)
    assert weights[0] + bias < -1 and weights[1] + bias > 1


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.classify(docs, labels).join(labels, "doc_id").where("quality is not null").collect()
    tested = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in tested]) > 0.9
    good = sum(r["quality"] for r in tested)
    assert sum(r["predicted"] for r in tested if r["quality"]) > 0.95 * good


def test_odd_rows(spark):
    text = "plain words of a text. "
    rows = [(i, (text if i % 2 else "@@ ## $$ !! ") * (1 + i % 5)) for i in range(60)] + [(7, text), (None, text), (61, None), (62, ""), (63, "long " * 300000)]
    docs = spark.createDataFrame([(i, t, 0.1, "z") for i, t in rows], "doc_id bigint, text string, score double, id string")
    labels = spark.createDataFrame([(i, i % 2, 5) for i in range(60)] + [(7, 0, 5), (8, None, 1), (None, 1, 1)], "doc_id bigint, quality int, score int")
    got = q.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["score"], r["predicted"]))
    assert by[61] == by[62] and by[None][0][1] == 1 and by[2][0][1] == 0
    kept = q.good_rows(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 2").count() == 0 and kept.where("doc_id = 7").count() == 2
    assert q.classify(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in q.classify(docs, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("n", [0, 1])
def test_training_bound(spark, n):
    docs = spark.createDataFrame([(i, "a b") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    assert not q.train(docs, labels, rows=n)[0].any()
