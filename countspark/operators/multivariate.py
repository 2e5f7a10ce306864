"""Principal components, classical scaling and clustering of samples.

Spark reduces the features to samples × (k + 10) matrices, one per step; only these reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window as W, functions as F

from countspark.functions.rows import _dense_blocks, feature_rows, fold_partitions, map_blocks, sample_index, sample_names
from countspark.operators.detable import top_variable_features
from countspark.operators.normalize import row_moments
from countspark.session import keep, local_table, small

#: A component is accepted when the residual of its eigen equation is below this share of the largest eigenvalue.
TOLERANCE = 1e-9
#: Blocks of a Krylov space before it is restarted from the best vectors found, and restarts before an error.
KRYLOV_BLOCKS = 12
RESTARTS = 60


@dataclass(frozen=True)
class Pca:
    """``scores(sample, dim, score)``, ``variance(dim, eigenvalue, percent, cumulative)``, ``loadings(feature, dim, loading)``."""

    scores: DataFrame
    variance: DataFrame
    loadings: DataFrame


def _fold_matrix(rows: DataFrame, n: int, width: int, fn) -> np.ndarray:
    """Σ over blocks of ``fn(block)`` (n × width). Each task sends one row per sample; the sums come back as n rows."""

    def run(batches):
        total = np.zeros((n, width))
        for batch in batches:
            for _, _, block in _dense_blocks(batch, n):
                total += fn(block)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(total.reshape(-1)))], ["i", "v"])

    parts = fold_partitions(rows.select("idx", "x"), width).mapInArrow(run, "i int, v array<double>")
    sums = parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width)])
    got = sums.orderBy("i").toArrow()  # n rows of width doubles: what the driver holds of the samples
    return np.column_stack([got.column(f"v{j}").to_numpy() for j in range(width)])


def _prepared(scale: bool):
    def prepare(block: np.ndarray) -> np.ndarray:
        x = block - block.mean(axis=1, keepdims=True)
        if scale:
            sd = x.std(axis=1, ddof=1, keepdims=True)
            x = np.divide(x, sd, out=np.zeros_like(x), where=sd > 0)
        return x

    return prepare


def krylov(apply, n: int, k: int, *, seed: int = 1, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` leading eigenvectors (n × k) and eigenvalues of a symmetric matrix known by ``apply(vectors)`` only.

    Block Krylov with full orthogonalisation, restarted from the best vectors, until every residual ``|A v - t v|`` is below
    ``tolerance`` times the largest eigenvalue in magnitude. The same steps are taken for any ``n``; with few samples the space is exhausted soon.
    """
    width = min(n, k + 10)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    for _ in range(RESTARTS):
        basis, images = np.zeros((n, 0)), np.zeros((n, 0))
        for _ in range(KRYLOV_BLOCKS):
            image = apply(block)
            basis, images = np.hstack([basis, block]), np.hstack([images, image])
            inner = basis.T @ images
            values, inner = np.linalg.eigh((inner + inner.T) / 2)
            order = np.argsort(values)[::-1]
            best = inner[:, order[:k]]
            vectors, values = basis @ best, values[order[:k]]
            scale = max(np.abs(values).max(initial=0.0), 1e-300)
            if np.linalg.norm(images @ best - vectors * values, axis=0).max(initial=0.0) <= tolerance * scale or basis.shape[1] >= n:
                return _fix_signs(vectors), values
            fresh = images[:, -block.shape[1]:]
            for _ in range(2):  # twice, for orthogonality to working precision
                fresh = fresh - basis @ (basis.T @ fresh)
            left, size, _ = np.linalg.svd(fresh, full_matrices=False)
            block = left[:, (size > 1e-13 * scale)][:, :n - basis.shape[1]]
            if block.shape[1] == 0:  # the space holds its images, so its vectors are exact
                return _fix_signs(vectors), values
        block = np.linalg.qr(basis @ inner[:, order[:width]])[0]
    raise RuntimeError(f"components have not converged to {tolerance} in {RESTARTS} restarts")


def sample_components(rows: DataFrame, n: int, k: int, prepare, *, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """Right singular vectors (n × k), squared singular values and total squared norm of the prepared feature rows.

    A step is one pass over the features, folded to n × (k + 10) numbers per task; nothing of the size n × n is formed.
    """
    apply = lambda q: _fold_matrix(rows, n, q.shape[1], lambda x: (lambda z: z.T @ (z @ q))(prepare(x)))
    vectors, values = krylov(apply, n, k, seed=seed)
    return vectors, np.maximum(values, 0), _total_norm(rows, n, prepare)


def _total_norm(rows: DataFrame, n: int, prepare) -> float:
    def run(batches):
        total = 0.0
        for batch in batches:
            for _, _, block in _dense_blocks(batch, n):
                total += float((prepare(block) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["v"])

    return rows.select("idx", "x").mapInArrow(run, "v double").agg(F.sum("v")).first()[0]


def _fix_signs(vectors: np.ndarray) -> np.ndarray:
    """The entry of largest magnitude of every vector is positive."""
    lead = vectors[np.abs(np.round(vectors, 9)).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(lead < 0, -1.0, 1.0)


def pca_samples(norm: DataFrame, col: str, samples: DataFrame, *, n_top: int | None = 500, scale: bool = False, k: int = 5) -> Pca:
    """Principal components of the samples over the ``n_top`` most variable features (all with None), centred per feature."""
    spark = norm.sparkSession
    names = sample_names(samples)
    n = len(names)
    k = min(k, n - 1)
    if n_top is not None:
        best = top_variable_features(row_moments(norm, col, n), n_top).select("feature")
        norm = norm.join(small(best), "feature", "left_semi")
    rows = feature_rows(norm, col, samples, names)
    prepare = _prepared(scale)
    vectors, squares, total = sample_components(rows, n, k, prepare)
    root = np.sqrt(squares)
    kind = samples.schema["sample"].dataType.simpleString()
    scores = local_table(spark, [(s, d + 1, float(vectors[i, d] * root[d])) for i, s in enumerate(names) for d in range(k)],
                                   f"sample {kind}, dim int, score double")
    share = squares / total * 100 if total > 0 else squares * 0
    variance = local_table(spark, [(d + 1, float(squares[d] / (n - 1)), float(share[d]), float(share[:d + 1].sum())) for d in range(k)],
                                     "dim int, eigenvalue double, percent double, cumulative double")
    inverse = vectors * np.where(root > 0, 1 / np.where(root > 0, root, 1), 0)
    wide = map_blocks(rows, n, lambda x, _: {"l": prepare(x) @ inverse}, "l array<double>")
    loadings = wide.select("feature", F.posexplode("l").alias("p", "loading")).select("feature", (F.col("p") + 1).alias("dim"), "loading")
    return Pca(scores, variance, loadings)


def pca_variance(pca: Pca) -> DataFrame:
    return pca.variance


def pca_dim_pairs(pca: Pca, samples: DataFrame, dims: Sequence[int] | None = None) -> DataFrame:
    """Every pair of dimensions side by side per sample (dimensions are few), with the sheet."""
    scores = pca.scores if dims is None else pca.scores.where(F.col("dim").isin(list(dims)))
    per = scores.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("dim", "score"))).alias("d"))
    first = per.select("sample", "d", F.explode("d").alias("a"))
    both = first.select("sample", "a", F.explode(F.filter("d", lambda s: s["dim"] > F.col("a.dim"))).alias("b"))
    return both.select("sample", F.col("a.dim").alias("dim_a"), F.col("b.dim").alias("dim_b"), F.col("a.score").alias("score_a"),
                       F.col("b.score").alias("score_b")).join(small(samples), "sample", "left")


def pca_by_group(pca: Pca, samples: DataFrame, groups: Sequence[str] | None = None) -> DataFrame:
    """Scores × usable categorical covariates (text or boolean unless named): those with more than one level and fewer than n − 1."""
    kinds = {f.name: f.dataType.typeName() for f in samples.schema.fields}
    groups = list(groups or [c for c in samples.columns if c != "sample" and kinds[c] in ("string", "boolean")])
    long = samples.select("sample", *[F.col(g).cast("string").alias(g) for g in groups]).unpivot(["sample"], groups, "variable", "level")
    n = samples.count()
    usable = long.groupBy("variable").agg(F.countDistinct("level").alias("_k")).where((F.col("_k") > 1) & (F.col("_k") < n - 1))
    kept = small(long.join(small(usable.select("variable")), "variable", "left_semi"))
    return pca.scores.join(kept, "sample").select("sample", "dim", "score", "variable", "level")


def pca_loadings_top(pca: Pca, n: int = 6) -> DataFrame:
    """The ``n`` features with the largest absolute loading on each dimension (group-limited window: few rows are shuffled)."""
    w = W.partitionBy("dim").orderBy(F.abs("loading").desc(), "feature")
    return pca.loadings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mds(pairs: DataFrame, *, k: int = 2, value: str = "distance") -> DataFrame:
    """Classical scaling of a distance table (one row per pair): coordinates ``(sample, dim, score)``.

    The doubly centred matrix is applied to a few vectors at a time by aggregates over the pair table, which stays where it is; the
    driver holds one row of k + 10 numbers per sample.
    """
    names = [r[0] for r in pairs.select(F.explode(F.array("sample_a", "sample_b")).alias("s")).distinct().orderBy("s").collect()]
    n = len(names)
    index = sample_index(pairs.select(F.col("sample_a").alias("sample")), names)
    at = lambda side: index.select(F.col("sample").alias(f"sample_{side}"), F.col("idx").alias(side))
    squares = keep(pairs.join(at("a"), "sample_a").join(at("b"), "sample_b").select("a", "b", F.pow(F.col(value).cast("double"), F.lit(2.0)).alias("d2")))

    def apply(q: np.ndarray) -> np.ndarray:
        q = q - q.mean(0)

        def run(batches):
            total = np.zeros((n, q.shape[1]))
            for batch in batches:
                a, b, d2 = (batch.column(c).to_numpy() for c in range(3))
                for lo in range(0, len(a), 65536):
                    s = slice(lo, lo + 65536)
                    np.add.at(total, a[s], d2[s, None] * q[b[s]])
                    np.add.at(total, b[s], d2[s, None] * q[a[s]])
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * q.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(total.reshape(-1)))], ["i", "v"])

        parts = squares.mapInArrow(run, "i int, v array<double>")
        got = parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(q.shape[1])]).orderBy("i").toArrow()
        out = -0.5 * np.column_stack([got.column(f"v{j}").to_numpy() for j in range(q.shape[1])])
        return out - out.mean(0)

    if n == 0:
        return pairs.select(F.col("sample_a").alias("sample"), F.lit(1).alias("dim"), F.lit(0.0).alias("score")).where(F.lit(False))
    vectors, values = krylov(apply, n, min(k, n))
    coords = vectors * np.sqrt(np.maximum(values, 0))
    kind = pairs.schema["sample_a"].dataType.simpleString()
    return local_table(pairs.sparkSession, [(s, d + 1, float(coords[i, d])) for i, s in enumerate(names) for d in range(coords.shape[1])],
                       f"sample {kind}, dim int, score double")


def cluster_samples(pca: Pca, *, k: int, seed: int = 1) -> DataFrame:
    """Cluster ids from bisecting k-means on the scores: a top-down stand-in for agglomerative trees, not the same algorithm."""
    points = pca.scores.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("dim", "score"))).alias("d"))
    points = points.select("sample", array_to_vector(F.transform("d", lambda s: s["score"])).alias("features"))
    model = BisectingKMeans(k=k, seed=seed).fit(points)
    return model.transform(points).select("sample", F.col("prediction").alias("cluster"))
