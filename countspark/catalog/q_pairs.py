"""Queries for sample × sample tables, components and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from countspark.catalog import inputs as fx
from countspark.catalog.registry import VIEWS, query, r6
from countspark.operators import multivariate as mv, normalize as nz, pairwise as pw
from countspark.session import keep


def _r(df, col, digits=6):
    return df.withColumn(col, r6(col, digits))


def log2cpm(spark, sf):
    return keep(nz.log2cpm(fx.counts(spark, sf), fx.samples(spark, sf)))


def vectors(spark, sf):
    return keep(fx.vectors(spark, sf).select("feature", "sample", "value"))


PAIR = "FROM {t} a JOIN {t} b ON b.feature = a.feature AND b.sample > a.sample GROUP BY a.sample, b.sample"


@query("sample_corr_pearson", "SELECT a.sample AS sample_a, b.sample AS sample_b, ROUND(CORR(a.raw_count, b.raw_count), 6) + 0e0 AS corr " + PAIR.format(t="fx_dense"))
def _(spark, sf):
    return _r(pw.sample_corr_pearson(fx.counts(spark, sf), "raw_count", fx.samples(spark, sf)), "corr")


VIEWS["fx_ranks"] = """
SELECT feature, sample, RANK() OVER (PARTITION BY sample ORDER BY raw_count) + (COUNT(*) OVER (PARTITION BY sample, raw_count) - 1) / 2e0 AS r FROM fx_dense"""


@query("sample_corr_spearman", "SELECT a.sample AS sample_a, b.sample AS sample_b, ROUND(CORR(a.r, b.r), 6) + 0e0 AS corr " + PAIR.format(t="fx_ranks"))
def _(spark, sf):
    return _r(pw.sample_corr_spearman(fx.counts(spark, sf), "raw_count", fx.samples(spark, sf)), "corr")


VIEWS["fx_label_vectors"] = "SELECT label AS sample, feature, AVG(value) AS value FROM fx_vectors GROUP BY label, feature"


@query("corr_distance", "SELECT a.sample AS sample_a, b.sample AS sample_b, ROUND(1 - CORR(a.value, b.value), 6) + 0e0 AS distance " + PAIR.format(t="fx_label_vectors"))
def _(spark, sf):
    """Distances between classes: their pairs do not grow with the vectors."""
    means = fx.vectors(spark, sf).groupBy(F.col("label").alias("sample"), "feature").agg(F.avg("value").alias("value"))
    return _r(pw.corr_distance(keep(means), "value"), "distance")


VIEWS["fx_feature_ranks"] = """
SELECT feature, sample, RANK() OVER (PARTITION BY feature ORDER BY raw_count) + (COUNT(*) OVER (PARTITION BY feature, raw_count) - 1) / 2e0 AS r
FROM fx_dense WHERE feature <= 60"""


@query("corr_distance_features", """
SELECT a.feature AS feature_a, b.feature AS feature_b, ROUND(1 - CORR(a.r, b.r), 6) + 0e0 AS distance
FROM fx_feature_ranks a JOIN fx_feature_ranks b ON b.sample = a.sample AND b.feature > a.feature GROUP BY a.feature, b.feature""")
def _(spark, sf):
    counts = fx.counts(spark, sf)
    chosen = counts.where("feature <= 60").select("feature").distinct()
    return _r(pw.corr_distance(counts, "raw_count", axis="features", method="spearman", ids=chosen), "distance")


@query("sample_dist_euclid", "SELECT a.sample AS sample_a, b.sample AS sample_b, ROUND(SQRT(SUM((a.log2cpm - b.log2cpm) ** 2)), 6) AS distance " + PAIR.format(t="fx_log2cpm"))
def _(spark, sf):
    return _r(pw.sample_dist_euclid(log2cpm(spark, sf), "log2cpm"), "distance")


@query("sample_dist_poisson_fitted")
def _(spark, sf):
    """With the power that fits the data best."""
    return _r(pw.sample_dist_poisson(fx.counts(spark, sf), fx.samples(spark, sf)), "distance")


VIEWS["fx_dense_half"] = "SELECT feature, sample, SQRT(raw_count) AS x, SUM(SQRT(raw_count)) OVER (PARTITION BY sample) AS n FROM fx_dense"


@query("sample_dist_poisson", """
SELECT sample_a, sample_b, ROUND(SQRT(SUM(ea - ea * (xa + 1) / (ea + 1) + xa * LN((xa + 1) / (ea + 1)) + eb - eb * (xb + 1) / (eb + 1) + xb * LN((xb + 1) / (eb + 1)))), 6) AS distance
FROM (SELECT a.sample AS sample_a, b.sample AS sample_b, a.x AS xa, b.x AS xb, (a.x + b.x) * a.n / (a.n + b.n) AS ea, (a.x + b.x) * b.n / (a.n + b.n) AS eb
      FROM fx_dense_half a JOIN fx_dense_half b ON b.feature = a.feature AND b.sample > a.sample) q GROUP BY sample_a, sample_b""")
def _(spark, sf):
    return _r(pw.sample_dist_poisson(fx.counts(spark, sf), fx.samples(spark, sf), power=0.5), "distance")


@query("leading_logfc_dist", """
SELECT sample_a, sample_b, ROUND(SQRT(AVG(d)), 6) AS distance FROM (
  SELECT a.sample AS sample_a, b.sample AS sample_b, (a.log2cpm - b.log2cpm) ** 2 AS d, ROW_NUMBER() OVER (PARTITION BY a.sample, b.sample ORDER BY (a.log2cpm - b.log2cpm) ** 2 DESC) AS i
  FROM fx_log2cpm a JOIN fx_log2cpm b ON b.feature = a.feature AND b.sample > a.sample) q WHERE i <= 500 GROUP BY sample_a, sample_b""")
def _(spark, sf):
    return _r(pw.leading_logfc_dist(log2cpm(spark, sf)), "distance")


def pca(spark, sf, **kw):
    return mv.pca_samples(log2cpm(spark, sf), "log2cpm", fx.samples(spark, sf), **kw)


def _coordinate_distances(scores):
    """Distance of each pair of samples in the given coordinates."""
    other = scores.select(F.col("sample").alias("sample_b"), "dim", F.col("score").alias("score_b"))
    both = scores.withColumnRenamed("sample", "sample_a").join(other, "dim").where("sample_a < sample_b")
    return _r(both.groupBy("sample_a", "sample_b").agg(F.sqrt(F.sum(F.pow(F.col("score") - F.col("score_b"), F.lit(2.0)))).alias("distance")), "distance", 5)


EUCLID = "SELECT a.sample AS sample_a, b.sample AS sample_b, ROUND(SQRT(SUM((a.log2cpm - b.log2cpm) ** 2)), 5) AS distance " + PAIR.format(t="fx_log2cpm")


@query("mds", EUCLID)
def _(spark, sf):
    """All dimensions of a Euclidean table reproduce its distances."""
    return _coordinate_distances(keep(mv.mds(pw.sample_dist_euclid(log2cpm(spark, sf), "log2cpm"), k=fx.samples(spark, sf).count())))


@query("mds_leading")
def _(spark, sf):
    return _r(mv.mds(pw.leading_logfc_dist(log2cpm(spark, sf))), "score")


@query("pca_samples", EUCLID)
def _(spark, sf):
    """All components of all features reproduce the distances."""
    return _coordinate_distances(keep(pca(spark, sf, n_top=None, k=11).scores))


@query("pca_scores")
def _(spark, sf):
    return _r(pca(spark, sf).scores, "score")


@query("pca_variance_scaled")
def _(spark, sf):
    out = mv.pca_variance(pca(spark, sf, n_top=None, scale=True))
    return out.select("dim", *[r6(c).alias(c) for c in ("eigenvalue", "percent", "cumulative")])


VIEWS["fx_centered"] = "SELECT feature, sample, log2cpm - AVG(log2cpm) OVER (PARTITION BY feature) AS x FROM fx_log2cpm"


@query("pca_variance", "SELECT ROUND(SUM(x * x) / ((SELECT COUNT(*) FROM fx_samples) - 1), 4) AS total_variance FROM fx_centered")
def _(spark, sf):
    out = mv.pca_variance(pca(spark, sf, n_top=None, k=11))
    return out.agg(F.round(F.sum("eigenvalue"), 4).alias("total_variance"))


VIEWS["fx_scores"] = "SELECT sample, CAST(UNNEST(RANGE(1, 5)) AS INT) AS dim, (sample * 7 + UNNEST(RANGE(1, 5)) * 3) % 11 - 4.5e0 AS score FROM fx_samples"


def plain_scores(spark, sf):
    """Scores by a rule, for what is done with scores."""
    dims = F.explode(F.sequence(F.lit(1), F.lit(4)))
    scores = fx.samples(spark, sf).select("sample", dims.alias("dim")).withColumn("score", (F.col("sample") * 7 + F.col("dim") * 3) % 11 - F.lit(4.5))
    return mv.Pca(scores=scores, variance=None, loadings=None)


@query("pca_dim_pairs", """
SELECT a.sample, a.dim AS dim_a, b.dim AS dim_b, a.score AS score_a, b.score AS score_b, s.cond, s.grade, s.subject FROM fx_scores a
JOIN fx_scores b ON b.sample = a.sample AND b.dim > a.dim JOIN fx_samples s ON s.sample = a.sample WHERE a.dim <= 3 AND b.dim <= 3""")
def _(spark, sf):
    return mv.pca_dim_pairs(plain_scores(spark, sf), fx.samples(spark, sf), [1, 2, 3])


@query("pca_by_group", """
SELECT p.sample, p.dim, p.score, 'cond' AS variable, s.cond AS level FROM fx_scores p JOIN fx_samples s ON s.sample = p.sample
UNION ALL SELECT p.sample, p.dim, p.score, 'grade', s.grade FROM fx_scores p JOIN fx_samples s ON s.sample = p.sample""")
def _(spark, sf):
    """The numeric covariate stays out."""
    return mv.pca_by_group(plain_scores(spark, sf), fx.samples(spark, sf))


@query("pca_loadings_top")
def _(spark, sf):
    return _r(mv.pca_loadings_top(pca(spark, sf)), "loading")


@query("cluster_samples")
def _(spark, sf):
    sheet = fx.vectors(spark, sf).select("sample").distinct()
    return mv.cluster_samples(mv.pca_samples(vectors(spark, sf), "value", keep(sheet), n_top=None, k=5), k=10)
