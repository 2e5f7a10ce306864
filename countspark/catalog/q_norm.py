"""Queries for normalisations."""

from __future__ import annotations

from pyspark.sql import functions as F

from countspark.catalog import inputs as fx
from countspark.catalog.registry import VIEWS, query, r6
from countspark.operators import normalize as nz
from countspark.session import keep


def _r(df, col, digits=6):
    return df.withColumn(col, r6(col, digits))


def _n_samples(spark, sf):
    return fx.samples(spark, sf).count()


@query("cpm", "SELECT feature, sample, ROUND(cpm, 6) AS cpm FROM fx_cpm")
def _(spark, sf):
    return _r(nz.cpm(fx.counts(spark, sf)), "cpm")


@query("log2cpm", "SELECT feature, sample, ROUND(log2cpm, 6) + 0e0 AS log2cpm FROM fx_log2cpm")
def _(spark, sf):
    return _r(nz.log2cpm(fx.counts(spark, sf), fx.samples(spark, sf)), "log2cpm")


@query("rpkm", "SELECT c.feature, c.sample, ROUND(c.cpm / (f.length_bp / 1000e0), 6) AS rpkm FROM fx_cpm c JOIN fx_features f ON f.feature = c.feature")
def _(spark, sf):
    return _r(nz.rpkm(fx.counts(spark, sf), fx.features(spark, sf)), "rpkm")


@query("log2rpkm", "SELECT n.feature, n.sample, ROUND(n.log2cpm - LOG2(f.length_bp / 1000e0), 6) + 0e0 AS log2rpkm FROM fx_log2cpm n JOIN fx_features f ON f.feature = n.feature")
def _(spark, sf):
    return _r(nz.log2rpkm(nz.log2cpm(fx.counts(spark, sf), fx.samples(spark, sf)), fx.features(spark, sf)), "log2rpkm")


VIEWS["fx_fpkm"] = """
SELECT c.feature, c.sample, c.raw_count * 1e9 / (f.length_bp * SUM(c.raw_count) OVER (PARTITION BY c.sample)) AS fpkm
FROM fx_counts c JOIN fx_features f ON f.feature = c.feature"""


@query("fpkm", "SELECT feature, sample, ROUND(fpkm, 4) AS fpkm FROM fx_fpkm")
def _(spark, sf):
    return _r(nz.fpkm(fx.counts(spark, sf), fx.features(spark, sf)), "fpkm", 4)


@query("fpkm_matrix", "SELECT c.feature, c.sample, ROUND(c.raw_count * 1e9 / (f.length_bp * SUM(c.raw_count) OVER ()), 4) AS fpkm FROM fx_counts c JOIN fx_features f ON f.feature = c.feature")
def _(spark, sf):
    return _r(nz.fpkm(fx.counts(spark, sf), fx.features(spark, sf), scope="matrix"), "fpkm", 4)


TPM_SQL = """
SELECT c.feature, c.sample, ROUND(c.raw_count / CAST(f.length_bp AS DOUBLE) / SUM(c.raw_count / CAST(f.length_bp AS DOUBLE)) OVER ({w}) * 1e6, 5) AS tpm
FROM fx_counts c JOIN fx_features f ON f.feature = c.feature"""


@query("tpm", TPM_SQL.format(w="PARTITION BY c.sample"))
def _(spark, sf):
    return _r(nz.tpm(fx.counts(spark, sf), fx.features(spark, sf)), "tpm", 5)


@query("tpm_matrix", TPM_SQL.format(w=""))
def _(spark, sf):
    return _r(nz.tpm(fx.counts(spark, sf), fx.features(spark, sf), scope="matrix"), "tpm", 5)


@query("fpkm_to_tpm", "SELECT feature, sample, ROUND(fpkm / SUM(fpkm) OVER (PARTITION BY sample) * 1e6, 5) AS tpm FROM fx_fpkm")
def _(spark, sf):
    return _r(nz.fpkm_to_tpm(nz.fpkm(fx.counts(spark, sf), fx.features(spark, sf))), "tpm", 5)


@query("effective_counts", """
SELECT c.feature, c.sample, ROUND(c.raw_count * f.length_bp / (f.length_bp - 103.7e0 + 1), 6) AS effective_count FROM fx_counts c JOIN fx_features f ON f.feature = c.feature""")
def _(spark, sf):
    return _r(nz.effective_counts(fx.counts_plan(spark, sf), fx.features(spark, sf), mean_fragment=103.7), "effective_count")


VIEWS["fx_size_factors"] = """
SELECT c.sample, EXP(QUANTILE_CONT(LN(c.raw_count) - g.m, 0.5)) AS size_factor
FROM fx_counts c JOIN (SELECT feature, AVG(LN(raw_count)) AS m FROM fx_counts WHERE raw_count > 0 GROUP BY feature
                       HAVING COUNT(*) = (SELECT COUNT(*) FROM fx_samples)) g ON g.feature = c.feature GROUP BY c.sample"""


@query("size_factors", "SELECT sample, ROUND(size_factor, 9) AS size_factor FROM fx_size_factors")
def _(spark, sf):
    return _r(nz.size_factors(fx.counts(spark, sf), _n_samples(spark, sf)), "size_factor", 9)


@query("normalized_counts", """
SELECT d.feature, d.sample, ROUND(d.raw_count / s.size_factor, 6) AS norm_count, ROUND(LOG2(d.raw_count / s.size_factor + 1), 6) AS log2p1,
       CASE WHEN d.raw_count = 0 THEN CAST('-inf' AS DOUBLE) ELSE ROUND(LOG2(d.raw_count / s.size_factor), 6) + 0e0 END AS log2
FROM fx_dense d JOIN fx_size_factors s ON s.sample = d.sample""")
def _(spark, sf):
    from countspark.operators.reshape import zero_fill

    counts, sheet = fx.counts(spark, sf), fx.samples(spark, sf)
    factors = keep(nz.size_factors(counts, sheet.count()))
    dense = keep(zero_fill(counts, None, sheet))
    out = _r(nz.normalized_counts(dense, factors), "norm_count")
    for how in ("log2p1", "log2"):
        other = nz.normalized_counts(dense, factors, transform=how)
        v = F.col("norm_count")
        out = out.join(other.select("feature", "sample", F.when(v == float("-inf"), v).otherwise(r6(v)).alias(how)), ["feature", "sample"])
    return out


@query("fpkm_robust", """
SELECT c.feature, c.sample, ROUND(c.raw_count * 1e9 / (f.length_bp * s.size_factor * (SELECT EXP(AVG(LN(lib_size))) FROM fx_lib)), 4) AS fpkm
FROM fx_counts c JOIN fx_features f ON f.feature = c.feature JOIN fx_size_factors s ON s.sample = c.sample""")
def _(spark, sf):
    return _r(nz.fpkm_robust(fx.counts(spark, sf), fx.features(spark, sf), _n_samples(spark, sf)), "fpkm", 4)


@query("fraction_log10", """
SELECT d.feature, d.sample, ROUND(LOG10((d.raw_count + 0.1e0) / SUM(d.raw_count + 0.1e0) OVER (PARTITION BY d.sample)), 6) + 0e0 AS fraction FROM fx_dense d""")
def _(spark, sf):
    return _r(nz.fraction_log10(fx.counts(spark, sf), fx.samples(spark, sf)), "fraction")


VIEWS["fx_upper"] = "SELECT sample, QUANTILE_CONT(raw_count, 0.75) AS upper FROM fx_dense GROUP BY sample"


@query("upper_quartile_norm", """
SELECT c.feature, c.sample, ROUND(c.raw_count * (SELECT AVG(upper) FROM fx_upper) / u.upper, 6) AS norm_count FROM fx_counts c JOIN fx_upper u ON u.sample = c.sample""")
def _(spark, sf):
    return _r(nz.upper_quartile_norm(fx.counts(spark, sf)), "norm_count")


VIEWS["fx_tmm_ref"] = """
SELECT u.sample AS ref, l.lib_size AS nr FROM fx_upper u JOIN fx_lib l ON l.sample = u.sample
ORDER BY ROUND(ABS(u.upper / l.lib_size - (SELECT AVG(x.upper / y.lib_size) FROM fx_upper x JOIN fx_lib y ON y.sample = x.sample)), 14), u.sample LIMIT 1"""
VIEWS["fx_tmm_pairs"] = """
SELECT c.feature, c.sample, ROUND(LOG2((c.raw_count / CAST(l.lib_size AS DOUBLE)) / (r.raw_count / CAST(t.nr AS DOUBLE))), 10) AS m,
       ROUND((LOG2(c.raw_count / CAST(l.lib_size AS DOUBLE)) + LOG2(r.raw_count / CAST(t.nr AS DOUBLE))) / 2, 10) AS a,
       (l.lib_size - c.raw_count) / (l.lib_size * CAST(c.raw_count AS DOUBLE)) + (t.nr - r.raw_count) / (t.nr * CAST(r.raw_count AS DOUBLE)) AS v
FROM fx_counts c JOIN fx_lib l ON l.sample = c.sample CROSS JOIN fx_tmm_ref t JOIN fx_counts r ON r.sample = t.ref AND r.feature = c.feature
WHERE c.raw_count > 0 AND r.raw_count > 0"""
VIEWS["fx_tmm_raw"] = """
SELECT sample, COALESCE(SUM(m / v) / SUM(1 / v), 0e0) AS f FROM (
  SELECT *, RANK() OVER (PARTITION BY sample ORDER BY m) + (COUNT(*) OVER (PARTITION BY sample, m) - 1) / 2e0 AS rm,
         RANK() OVER (PARTITION BY sample ORDER BY a) + (COUNT(*) OVER (PARTITION BY sample, a) - 1) / 2e0 AS ra, COUNT(*) OVER (PARTITION BY sample) AS k
  FROM fx_tmm_pairs) q
WHERE rm BETWEEN FLOOR(k * 0.3e0) + 1 AND k - FLOOR(k * 0.3e0) AND ra BETWEEN FLOOR(k * 0.05e0) + 1 AND k - FLOOR(k * 0.05e0) GROUP BY sample"""
VIEWS["fx_tmm"] = "SELECT sample, POWER(2e0, f - (SELECT AVG(f) FROM fx_tmm_raw)) AS norm_factor FROM fx_tmm_raw"


@query("tmm_factors", "SELECT sample, ROUND(norm_factor, 9) AS norm_factor FROM fx_tmm")
def _(spark, sf):
    return _r(nz.tmm_factors(fx.counts(spark, sf)), "norm_factor", 9)


VIEWS["fx_quantile"] = """
SELECT feature, sample, AVG(mean_value) OVER (PARTITION BY sample, raw_count) AS quantile_norm FROM (
  SELECT *, AVG(raw_count) OVER (PARTITION BY rk) AS mean_value
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY raw_count, feature) AS rk FROM fx_dense) a) b"""


@query("quantile_norm", "SELECT feature, sample, ROUND(quantile_norm, 6) AS quantile_norm FROM fx_quantile")
def _(spark, sf):
    return _r(nz.quantile_norm(fx.counts(spark, sf), fx.samples(spark, sf)), "quantile_norm")


@query("row_center_scale", """
SELECT feature, sample, CASE WHEN sd > 1e-9 THEN ROUND((quantile_norm - mu) / sd, 6) + 0e0 END AS z
FROM (SELECT *, AVG(quantile_norm) OVER w AS mu, STDDEV_SAMP(quantile_norm) OVER w AS sd FROM fx_quantile WINDOW w AS (PARTITION BY feature)) q""")
def _(spark, sf):
    norm = keep(nz.quantile_norm(fx.counts(spark, sf), fx.samples(spark, sf)))
    return _r(nz.row_center_scale(norm, "quantile_norm"), "z")


@query("vst", """
SELECT d.feature, d.sample, ROUND((2 * ASINH(SQRT(0.05e0 * d.raw_count / s.size_factor)) - LN(0.05e0) - LN(4e0)) / LN(2e0), 6) + 0e0 AS vst
FROM fx_dense d JOIN fx_size_factors s ON s.sample = d.sample""")
def _(spark, sf):
    return _r(nz.vst(fx.counts(spark, sf), fx.samples(spark, sf), alpha=0.05), "vst")


@query("vst_parametric", """
SELECT feature, sample, ROUND(LOG2((1 + 2.5e0 + 2 * 0.05e0 * q + 2 * SQRT(0.05e0 * q * (1 + 2.5e0 + 0.05e0 * q))) / (4 * 0.05e0)), 6) + 0e0 AS vst
FROM (SELECT d.feature, d.sample, d.raw_count / s.size_factor AS q FROM fx_dense d JOIN fx_size_factors s ON s.sample = d.sample) x""")
def _(spark, sf):
    return _r(nz.vst(fx.counts(spark, sf), fx.samples(spark, sf), trend=(0.05, 2.5)), "vst")
