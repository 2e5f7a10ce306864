"""Classification of samples: planted classes, null tails against plain permutations, features that one side lacks."""

import numpy as np
from pyspark.sql import functions as F

from countspark.operators import sets
from countspark.session import keep

CLASSES = {"a": range(0, 12), "b": range(12, 24), "c": range(24, 32)}


def table(spark, x):
    rows = [(f"f{j:02d}", f"s{i:03d}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    return keep(spark.createDataFrame(rows, "feature string, sample string, z double"))


def test_template_tails_against_plain_permutations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 40))
    for i in range(30):
        x[i, list(CLASSES["abc"[i % 3]])] += 2.5
    templates = keep(spark.createDataFrame([(c, f"f{j:02d}") for c, at in CLASSES.items() for j in at], "class string, feature string"))
    got = {r["sample"]: r for r in sets.nearest_template(table(spark, x), templates, value="z", n_perm=500).collect()}
    assert len(got) == 60
    union = x[:, :32]
    unit = union / np.linalg.norm(union, axis=1, keepdims=True)
    for i in range(60):
        cosines = {c: unit[i, list(at)].sum() / np.sqrt(len(at)) for c, at in CLASSES.items()}
        best = max(cosines, key=cosines.get)
        row, m = got[f"s{i:03d}"], len(CLASSES[best])
        assert row["prediction"] == best and abs(row["distance"] - np.sqrt((1 - cosines[best]) / 2)) < 1e-12
        null = unit[i][rng.permuted(np.tile(np.arange(32), (20_000, 1)), axis=1)[:, :m]].sum(1) / np.sqrt(m)
        tail = (null >= cosines[best]).mean()
        assert abs(row["p_value"] - tail) < 5 * np.sqrt(tail * (1 - tail) / 500) + 0.005
        if i < 30:
            assert best == "abc"[i % 3] and row["p_value"] < 0.01 and row["fdr"] < 0.05


def test_template_sets_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(3).normal(size=(50, 32))
    templates = keep(spark.createDataFrame([(c, f"f{j:02d}") for c, at in CLASSES.items() for j in at], "class string, feature string"))
    cells = table(spark, x)
    one, two = [sorted(map(tuple, sets.nearest_template(c, templates, value="z").select("sample", "prediction", "p_value").collect()))
                for c in (cells.coalesce(1), cells.repartition(9))]
    assert one == two and len(one) == 50


def test_forest_with_features_that_one_side_lacks(spark):
    """The first features are only in the training table and others only in the samples to classify; places must not shift."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 12))
    labels = np.arange(80) % 2
    x[:, 5] += 6 * labels
    cells = table(spark, x)
    train, test = cells.where("sample < 's060'"), cells.where("sample >= 's060'").where("feature not in ('f00', 'f01', 'f02')")
    extra = test.select("sample").distinct().select(F.lit("a_new_one").alias("feature"), "sample", F.lit(50.0).alias("z"))
    classes = keep(spark.createDataFrame([(f"s{i:03d}", int(c)) for i, c in enumerate(labels)], "sample string, class int"))
    got = {r["sample"]: r["prediction"] for r in sets.rf_classify(train, test.unionByName(extra), classes, value="z").collect()}
    assert got == {f"s{i:03d}": int(labels[i]) for i in range(60, 80)}


def test_places(spark):
    cells = spark.createDataFrame([("b", 1), ("a", 1), ("b", 2), ("d", 2)], "feature string, sample int")
    places, n = sets.feature_places(cells)
    assert n == 3 and {tuple(r) for r in places.collect()} == {("a", 0), ("b", 1), ("d", 2)}
