"""Design matrices, contrasts and linear models per feature."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from countspark.functions.local_regression import local_regression
from countspark.functions.rows import feature_rows, map_blocks, sample_index
from countspark.functions.scans import scan
from countspark.functions.special import digamma, t_quantile, t_quantiles, t_tail, t_two_sided, trigamma, trigamma_inverse
from countspark.operators.normalize import effective_library
from countspark.session import collect_small, keep, local_table, small


def make_name(text: str) -> str:
    """A syntactic name: every other character becomes a dot, a leading digit gets an X."""
    name = re.sub(r"[^A-Za-z0-9_.]", ".", text)
    return name if re.match(r"[A-Za-z.]", name) else f"X{name}"


def design_matrix(samples: DataFrame, terms: Sequence[str], *, intercept: bool, levels: dict[str, Sequence[str]] | None = None,
                  numeric: Sequence[str] = ()) -> DataFrame:
    """``(sample, coef, value)`` for additive terms.

    Without intercept the first term has one column per level (cell means); all other terms, and all terms with an intercept,
    leave out their first level. Coefficients are named ``<term><level>``. Raises when the columns are not independent.
    """
    sheet = collect_small(samples.select("sample", *[F.col(t).cast("double" if t in numeric else "string").alias(t) for t in terms]))
    columns = {"Intercept": [1.0] * len(sheet)} if intercept else {}
    for i, term in enumerate(terms):
        values = [r[term] for r in sheet]
        if term in numeric:
            columns[make_name(term)] = values
            continue
        known = list((levels or {}).get(term) or sorted(set(values)))
        for level in known if (i == 0 and not intercept) else known[1:]:
            columns[make_name(f"{term}{level}")] = [float(v == level) for v in values]
    matrix = np.array(list(columns.values())).T
    if np.linalg.matrix_rank(matrix) < len(columns):
        raise ValueError(f"design columns are not independent: {list(columns)}")
    kind = samples.schema["sample"].dataType.simpleString()
    rows = [(r["sample"], name, float(column[i])) for i, r in enumerate(sheet) for name, column in columns.items()]
    return local_table(samples.sparkSession, rows, f"sample {kind}, coef string, value double")


def make_contrasts(design: DataFrame, spec: dict[str, str] | None = None, *, prefix: str = "") -> DataFrame:
    """``(contrast, coef, weight)`` from strings such as ``A-B`` or ``0.5*A+0.5*B-C``.

    ``prefix`` is put before names that are not coefficients themselves. Without a specification every coefficient except the
    first becomes a contrast of its own. Unknown coefficients are an error.
    """
    known = {r[0] for r in collect_small(design.select("coef").distinct())}
    if spec is None:
        first = "Intercept" if "Intercept" in known else min(known)
        spec = {c: c for c in sorted(known) if c != first}
    rows = []
    for name, text in spec.items():
        for sign, factor, coef in re.findall(r"([+-]?)\s*(?:([0-9.]+)\s*\*)?\s*([A-Za-z.][A-Za-z0-9_.]*)", text.replace(" ", "")):
            full = coef if coef in known else prefix + coef
            if full not in known:
                raise ValueError(f"contrast {name!r} uses unknown coefficient {coef!r}")
            rows.append((name, full, (-1.0 if sign == "-" else 1.0) * float(factor or 1)))
    return local_table(design.sparkSession, rows, "contrast string, coef string, weight double")


@dataclass(frozen=True)
class Design:
    """A design as arrays: samples in row order, coefficient names, and the matrix itself (samples × coefficients)."""

    samples: list
    coefs: list
    matrix: np.ndarray

    @property
    def df(self) -> int:
        return self.matrix.shape[0] - self.matrix.shape[1]


def design_arrays(design: DataFrame) -> Design:
    """Collect the design table; it has one row per sample and coefficient."""
    coefs = sorted((r["coef"] for r in design.select("coef").distinct().collect()), key=lambda c: (c != "Intercept", c))
    at = [F.coalesce(F.max(F.when(F.col("coef") == c, F.col("value").cast("double"))), F.lit(0.0)).alias(f"v{i}") for i, c in enumerate(coefs)]
    rows = design.groupBy("sample").agg(*at).orderBy("sample").toArrow()  # one row per sample, a number per coefficient
    matrix = np.column_stack([rows.column(f"v{i}").to_numpy() for i in range(len(coefs))]) if coefs else np.zeros((rows.num_rows, 0))
    return Design(rows.column("sample").to_pylist(), coefs, matrix)


def contrast_weights(contrasts: DataFrame, coefs: list) -> dict[str, np.ndarray]:
    """``contrast -> weights`` in coefficient order."""
    out: dict[str, np.ndarray] = {}
    for r in collect_small(contrasts.orderBy("contrast", "coef")):
        if r["coef"] not in coefs:
            raise ValueError(f"contrast {r['contrast']!r} uses unknown coefficient {r['coef']!r}")
        out.setdefault(r["contrast"], np.zeros(len(coefs)))[coefs.index(r["coef"])] += r["weight"]
    return out


def estimate(weights: np.ndarray, coef: str = "coef") -> Column:
    """c'β from the coefficient array; only non-zero weights enter."""
    return sum((F.lit(float(w)) * F.col(coef)[i] for i, w in enumerate(weights) if w), F.lit(0.0))


def unscaled_variance(weights: np.ndarray, cov: str = "cov") -> Column:
    """c'Σc from the flattened covariance array."""
    p = len(weights)
    used = [i for i, w in enumerate(weights) if w]
    return sum((F.lit(float(weights[i] * weights[j])) * F.col(cov)[i * p + j] for i in used for j in used), F.lit(0.0))


def per_contrast(table: DataFrame, weights: dict[str, np.ndarray], *keep_cols: str) -> DataFrame:
    """One row per feature and contrast with estimate ``est`` and unscaled variance ``var``."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("contrast"), estimate(w).alias("est"), unscaled_variance(w).alias("var"))
                               for k, w in weights.items()]))
    return table.select("feature", *keep_cols, each.alias("c")).select("feature", "c.contrast", *keep_cols, "c.est", "c.var")


def least_squares(y: np.ndarray, x: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, unscaled covariances (flattened) and residual variances of a block of features."""
    n, p = x.shape
    if w is None:
        cov = np.linalg.inv(x.T @ x)
        coef = y @ x @ cov
        rss = ((y - coef @ x.T) ** 2).sum(axis=1)
        return coef, np.broadcast_to(cov.reshape(1, -1), (len(y), p * p)), rss / (n - p)
    outer = (x[:, :, None] * x[:, None, :]).reshape(n, p * p)
    cov = np.linalg.inv((w @ outer).reshape(-1, p, p))
    coef = np.einsum("bpq,bq->bp", cov, (w * y) @ x)
    rss = (w * (y - coef @ x.T) ** 2).sum(axis=1)
    return coef, cov.reshape(len(y), p * p), rss / (n - p)


@dataclass(frozen=True)
class LinearFit:
    """``table(feature, coef, cov, sigma2, mean)`` of one linear model per feature, and its design."""

    table: DataFrame
    design: Design
    rows: DataFrame


def lm_fit(norm: DataFrame, value: str, design: DataFrame, *, weights: str | None = None) -> LinearFit:
    """Least squares per feature over dense values; ``weights`` names a column of observation weights."""
    d = design_arrays(design)
    rows = feature_rows(norm, value, design, d.samples, more=(weights,) if weights else ())
    return LinearFit(_lm_table(rows, d, weights), d, rows)


def _lm_table(rows: DataFrame, d: Design, weights: str | None) -> DataFrame:
    x = d.matrix

    def fit(block, extra):
        coef, cov, s2 = least_squares(block, x, extra[weights] if weights else None)
        return {"coef": coef, "cov": cov, "sigma2": s2, "mean": block.mean(axis=1)}

    return keep(map_blocks(rows, len(d.samples), fit, "coef array<double>, cov array<double>, sigma2 double, mean double",
                           extra=(weights,) if weights else ()))


def variance_prior(table: DataFrame, df: int) -> tuple[float, float]:
    """Prior degrees of freedom and scale of the residual variances, from two aggregates of their logarithms."""
    mean, var, n = table.where("sigma2 > 0").agg(F.avg(F.ln("sigma2")), F.var_samp(F.ln("sigma2")), F.count(F.lit(1))).first()
    e_mean = mean - digamma(df / 2) + np.log(df / 2)
    excess = (var or 0.0) - trigamma(df / 2)
    if excess <= 0:
        return float("inf"), float(np.exp(e_mean))
    d0 = 2 * trigamma_inverse(excess)
    return d0, float(np.exp(e_mean + digamma(d0 / 2) - np.log(d0 / 2)))


def ebayes_moderate(fit: LinearFit, contrasts: DataFrame, *, confidence: float = 0.95, proportion: float = 0.01) -> DataFrame:
    """Moderated t per feature and contrast: estimate, confidence limits, statistic, p-value and log odds ``b``.

    ``proportion`` is the share of changed features assumed by the log odds.
    """
    df = fit.design.df
    d0, s02 = variance_prior(fit.table, df)
    n_features = fit.table.count()
    post = F.lit(s02) if np.isinf(d0) else (F.lit(d0 * s02) + df * F.col("sigma2")) / (d0 + df)
    total = min(d0 + df, float(df) * n_features)
    rows = per_contrast(fit.table, contrast_weights(contrasts, fit.design.coefs), "sigma2", "mean")
    tested = rows.withColumn("_se", F.sqrt(post * F.col("var"))).withColumn("t", F.try_divide("est", "_se"))
    tested = keep(tested.select("feature", "contrast", F.col("mean").alias("avg_log2cpm"), F.col("est").alias("avg_log2fc"), "t", "_se", F.col("var").alias("_v")))
    prior = effect_prior(tested, n_features, total, s02, proportion)
    half = F.lit(t_quantile(1 - (1 - confidence) / 2, total)) * F.col("_se")
    v, v0, t2 = F.col("_v"), F.col("_v0"), F.pow("t", F.lit(2.0))
    keep_share = v / (v + v0)
    gain = t2 / 2 * v0 / (v + v0) if np.isinf(d0) else F.lit((1 + d0 + df) / 2) * F.ln((t2 + d0 + df) / (t2 * keep_share + d0 + df))
    odds = F.lit(float(np.log(proportion / (1 - proportion)))) + F.ln(keep_share) / 2 + gain
    return tested.join(small(prior), "contrast").select(
        "feature", "contrast", "avg_log2cpm", "avg_log2fc", "t", (F.col("avg_log2fc") - half).alias("ci_l"),
        (F.col("avg_log2fc") + half).alias("ci_r"), t_tail("t", F.lit(total)).alias("p_value"), odds.alias("b"))


def effect_prior(tested: DataFrame, n_features: int, df: float, s02: float, proportion: float) -> DataFrame:
    """``(contrast, _v0)``: prior variance of true effects, from the largest statistics of each contrast.

    The r-th largest |t| is compared with the quantile it would have if ``proportion`` of the features were changed; the
    excess gives one estimate per rank, and their mean is kept within (0.1² … 4²) / s0².
    """
    top = int(np.ceil(proportion / 2 * n_features))
    p = max(top / n_features, proportion)
    best = W.partitionBy("contrast").orderBy(F.col("_a").desc_nulls_last(), F.col("feature").asc())  # group-limited: few rows leave the map side
    ranked = tested.select("contrast", "feature", F.abs("t").alias("_a"), "_v").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top)

    @F.pandas_udf(T.DoubleType())
    def excess(a: pd.Series, r: pd.Series, v: pd.Series) -> pd.Series:
        size = a.fillna(0).to_numpy()
        null = t_two_sided(size, df)
        target = ((r.to_numpy() - 0.5) / n_features - (1 - p) * null) / p
        out = np.zeros(len(a))
        at = np.flatnonzero((target > null) & (target < 1))
        if len(at):
            out[at] = v.to_numpy()[at] * np.maximum((size[at] / t_quantiles(1 - target[at] / 2, df)) ** 2 - 1, 0)
        return pd.Series(out)

    return ranked.withColumn("_e", excess("_a", "_r", "_v")).groupBy("contrast").agg(
        F.greatest(F.lit(0.01 / s02), F.least(F.lit(16.0 / s02), F.avg("_e"))).alias("_v0"))


@dataclass(frozen=True)
class Voom:
    """``rows(feature, e, w)``: log2 expression and precision weights of all samples in design order."""

    rows: DataFrame
    design: Design

    def long(self, samples: DataFrame) -> DataFrame:
        """``(feature, sample, e, weight)``."""
        cells = self.rows.select("feature", F.posexplode(F.arrays_zip("e", "w")).alias("idx", "c"))
        return cells.join(sample_index(samples, self.design.samples), "idx").select("feature", "sample", F.col("c.e").alias("e"), F.col("c.w").alias("weight"))


def abundance_bins(points: DataFrame, by: str, cols: Sequence[str], *, bins: int) -> list:
    """Mean of ``cols`` in equally filled bins along ``by``; ranks are exact and distributed, at most ``bins`` rows come back."""
    points = keep(points.select("feature", by, *[c for c in cols if c != by]))  # the scan reads its input twice
    ranked = scan(points, [], [F.col(by).asc(), F.col("feature").asc()], number="_i", size="_n")
    count = F.least(F.lit(bins), F.greatest(F.lit(1), F.floor(F.col("_n") / 10)))
    bin_ = F.floor((F.col("_i") - 1) * count / F.col("_n")).alias("bin")
    return collect_small(ranked.groupBy(bin_).agg(*[F.avg(c).alias(c) for c in cols]).orderBy("bin"))


def voom_weights(counts: DataFrame, design: DataFrame, *, factors: DataFrame | None = None, span: float = 0.5) -> Voom:
    """log2 expression with precision weights from the trend of residual deviation over abundance.

    The trend is a robust local regression of √sd on the mean log2 count, over the nearest ``span`` of all features with any count.
    """
    d = design_arrays(design)
    sheet = design.select("sample").distinct()
    lib = {r["sample"]: r["lib_size"] for r in collect_small(effective_library(counts, sheet, factors))}
    size = np.array([float(lib[s]) for s in d.samples])
    shift = np.log2(size + 1) - np.log2(1e6)
    rows = feature_rows(counts, "raw_count", design, d.samples)
    x, n = d.matrix, len(d.samples)
    express = lambda block: np.log2(block + 0.5) - shift

    def points(block, _):
        e = express(block)
        _, _, s2 = least_squares(e, x)
        met = block.any(axis=1)
        return {"sx": np.where(met, e.mean(axis=1) + shift.mean(), np.nan), "sy": np.sqrt(np.sqrt(s2))}

    trend = local_regression(map_blocks(rows, n, points, "sx double, sy double"), "sx", "sy", span=span)

    def weigh(block, _):
        e = express(block)
        coef, _, _ = least_squares(e, x)
        return {"e": e, "w": 1 / np.maximum(trend(coef @ x.T + shift), 1e-8) ** 4}

    return Voom(keep(map_blocks(rows, n, weigh, "e array<double>, w array<double>")), d)


def voom_fit(voom: Voom) -> LinearFit:
    """Weighted linear models on voom expression; the rows are reused, nothing is shuffled again."""
    n = len(voom.design.samples)
    idx = F.sequence(F.lit(0), F.lit(n - 1))
    rows = voom.rows.select("feature", idx.alias("idx"), F.col("e").alias("x"), "w")
    return LinearFit(_lm_table(rows, voom.design, "w"), voom.design, rows)
