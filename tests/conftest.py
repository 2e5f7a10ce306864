import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def many_pieces(spark):
    """Keep every range partition, so that groups really are split over several tasks."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


@pytest.fixture(scope="session")
def cohort(spark):
    """300 features × 8 samples of negative-binomial counts; every 10th feature is raised fourfold in the second group."""
    import numpy as np

    rng = np.random.default_rng(7)
    n, g = 8, 300
    depth = rng.uniform(0.6, 1.6, n)
    mean = rng.lognormal(4.5, 1.0, g)[:, None] * depth
    mean[::10, n // 2:] *= 4
    counts = rng.negative_binomial(10, 10 / (10 + mean))
    rows = [(f"f{i:03d}", f"s{j}", int(counts[i, j])) for i in range(g) for j in range(n) if counts[i, j] > 0]
    df = spark.createDataFrame(rows, "feature string, sample string, raw_count bigint")
    sheet = spark.createDataFrame([(f"s{j}", "b" if j >= n // 2 else "a") for j in range(n)], "sample string, grp string")
    return df, sheet, counts
