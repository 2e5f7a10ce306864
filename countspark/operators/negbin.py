"""Negative-binomial models per feature.

All models read the same feature rows (written once). Each pass is a narrow map over dense blocks in which every step is
vectorised over the features of the block; what is shared between features (trends, priors) is computed by aggregates between
the passes. The methods follow their published descriptions; they are not bit-for-bit equal to any other implementation.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from countspark.functions.rows import feature_rows, map_blocks
from countspark.functions.scans import quantiles, scan
from countspark.functions.special import digamma, erfc, f_quantile, lgamma, normal_two_sided, trigamma, trigamma_inverse
from countspark.operators.linear import Design, abundance_bins, contrast_weights, design_arrays, make_contrasts, per_contrast
from countspark.operators.normalize import effective_library, row_moments
from countspark.session import collect_small, keep, local_table, small

#: Grid of dispersions at which the profile likelihood is evaluated.
GRID = np.geomspace(1e-5, 1e3, 33)
LN2 = math.log(2)
RIDGE = 1e-6


# --- numerics of one block --------------------------------------------------------------------------------------------

def nb_loglik(y, mu, alpha) -> np.ndarray:
    """Log-likelihood summed over samples; ``alpha`` is a column of dispersions."""
    r = 1 / alpha
    return (lgamma(y + r) - lgamma(r) - lgamma(y + 1) + y * np.log(alpha * mu) - (y + r) * np.log1p(alpha * mu)).sum(axis=1)


def _deviance(y, mu, alpha) -> np.ndarray:
    ratio = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0)
    return 2 * (ratio - (y + 1 / alpha) * (np.log1p(alpha * y) - np.log1p(alpha * mu))).sum(axis=1)


def irls(y, x, offset, alpha, *, beta=None, steps: int = 100, prior=None):
    """Log-link fits of a block: coefficients, means and information matrices.

    A step that raises the deviance of a feature is halved for that feature until it does not. ``prior(beta)`` may return an
    extra diagonal precision per coefficient; it is used for shrinkage, from a converged start. An offset per cell needs a start.
    """
    n, p = x.shape
    outer = (x[:, :, None] * x[:, None, :]).reshape(n, p * p)
    eye = np.eye(p) * RIDGE
    shift = (lambda rows: offset) if np.ndim(offset) == 1 else (lambda rows: offset[rows])
    mean = lambda b, rows: np.exp(np.clip(b @ x.T + shift(rows), -30, 30))
    if beta is None:
        lib = np.exp(offset)
        pooled = y.sum(axis=1, keepdims=True) / lib.sum() * lib
        beta = (np.log(np.maximum(0.75 * y + 0.25 * pooled, 1e-8)) - offset) @ x @ np.linalg.pinv(x.T @ x)
    mu = mean(beta, slice(None))
    last = _deviance(y, mu, alpha)
    live = np.arange(len(y))
    for _ in range(steps):
        yl, al, bl, ml = y[live], alpha[live], beta[live], mu[live]
        w = ml / (1 + al * ml)
        info = (w @ outer).reshape(-1, p, p) + eye
        if prior is not None:
            info = info + prior(bl)[:, :, None] * np.eye(p)
        z = bl @ x.T + (yl - ml) / ml
        new = np.linalg.solve(info, ((w * z) @ x)[:, :, None])[:, :, 0]
        m = mean(new, live)
        dev = _deviance(yl, m, al)
        for _ in range(0 if prior is not None else 30):
            bad = np.flatnonzero(~(dev <= last[live] + 1e-7 * (np.abs(last[live]) + 0.1)))
            if not len(bad):
                break
            new[bad] = (new[bad] + bl[bad]) / 2
            m[bad] = mean(new[bad], live[bad])
            dev[bad] = _deviance(yl[bad], m[bad], al[bad])
        moved = np.abs(dev - last[live]) > 1e-8 * (np.abs(dev) + 0.1)
        beta[live], mu[live], last[live] = new, m, dev
        live = live[moved]
        if not len(live):
            break
    w = mu / (1 + alpha * mu)
    return beta, mu, (w @ outer).reshape(-1, p, p) + eye


def adjusted_profile(y, x, offset, grid) -> np.ndarray:
    """Cox–Reid adjusted profile log-likelihood of a block at every dispersion of the grid (features × grid)."""
    out = np.empty((len(y), len(grid)))
    beta = None
    for i, a in enumerate(grid):
        alpha = np.full((len(y), 1), a)
        beta, mu, info = irls(y, x, offset, alpha, beta=beta, steps=50)
        out[:, i] = nb_loglik(y, mu, alpha) - 0.5 * np.linalg.slogdet(info)[1]
    return out


def grid_peak(values: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Argmax over the (log-spaced) grid, refined by the parabola through the best point and its neighbours."""
    logs = np.log(grid)
    step = logs[1] - logs[0]
    i = values.argmax(axis=1)
    j = np.clip(i, 1, len(grid) - 2)
    rows = np.arange(len(values))
    left, mid, right = values[rows, j - 1], values[rows, j], values[rows, j + 1]
    bend = left - 2 * mid + right
    move = np.where(bend < 0, 0.5 * (left - right) / np.where(bend < 0, bend, -1.0), 0.0)
    inside = (i > 0) & (i < len(grid) - 1)
    return np.exp(np.where(inside, logs[j] + np.clip(move, -1, 1) * step, logs[i]))


# --- inputs shared by all models --------------------------------------------------------------------------------------

@dataclass(frozen=True)
class NbInput:
    """Feature rows with any count, the design, and the log offset of every sample."""

    rows: DataFrame
    design: Design
    offset: np.ndarray


def nb_input(counts: DataFrame, design: DataFrame, *, factors: DataFrame | None = None, size_factors: DataFrame | None = None) -> NbInput:
    """Offsets are log size factors if given, else log effective library sizes."""
    d = design_arrays(design)
    rows = feature_rows(counts.where("raw_count > 0"), "raw_count", design, d.samples)
    if size_factors is not None:
        scale = {r["sample"]: r["size_factor"] for r in collect_small(size_factors.select("sample", "size_factor"))}
    else:
        lib = effective_library(counts, design.select("sample").distinct(), factors)
        scale = {r["sample"]: r["lib_size"] for r in collect_small(lib)}
    return NbInput(rows, d, np.log(np.array([float(scale[s]) for s in d.samples])))


def _average_log2cpm(y, offset, prior: float = 2.0):
    """log2 of the mean count per million with a prior scaled to the library; for size factors, per mean library of 1e6."""
    lib = np.exp(offset)
    scaled = prior * lib / lib.mean()
    return np.log2(((y + scaled) / (lib + 2 * scaled)).mean(axis=1) * 1e6)


def profile_table(data: NbInput, grid: np.ndarray = GRID) -> DataFrame:
    """``(feature, apl array, base_mean, avg_log2cpm)``: the one expensive pass, written and reused."""
    x, offset = data.design.matrix, data.offset
    scale = np.exp(offset)

    def run(y, _):
        return {"apl": adjusted_profile(y, x, offset, grid), "base_mean": (y / scale).mean(axis=1), "avg_log2cpm": _average_log2cpm(y, offset)}

    return keep(map_blocks(data.rows, len(scale), run, "apl array<double>, base_mean double, avg_log2cpm double"))


def _binned_profiles(profiles: DataFrame, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean abundance and mean profile of equally filled abundance bins, smoothed over neighbouring bins."""
    ranked = scan(profiles.select("feature", "avg_log2cpm", "apl"), [], [F.col("avg_log2cpm").asc(), F.col("feature").asc()], number="_i", size="_n")
    count = F.least(F.lit(bins), F.greatest(F.lit(1), F.floor(F.col("_n") / 50)))
    bin_ = F.floor((F.col("_i") - 1) * count / F.col("_n")).alias("bin")
    sums = [F.avg(F.col("apl")[i]).alias(f"a{i}") for i in range(len(GRID))]
    got = collect_small(ranked.groupBy(bin_).agg(F.avg("avg_log2cpm").alias("x"), *sums).orderBy("bin"))
    x, y = np.array([r["x"] for r in got]), np.array([[r[f"a{i}"] for i in range(len(GRID))] for r in got])
    padded = np.pad(y, ((2, 2), (0, 0)), mode="edge")
    return x, sum(padded[i:i + len(y)] for i in range(5)) / 5


def trended_deviances(data: NbInput, dispersion: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``(feature, avg_log2cpm, s2)``: residual deviance per degree of freedom of the model with dispersions that depend on abundance only.

    Features with a fitted mean below 1 in some sample have no value: their deviance does not follow the variance.
    """
    x, offset, df = data.design.matrix, data.offset, data.design.df

    def run(y, _):
        at = _average_log2cpm(y, offset)
        alpha = dispersion(at)[:, None]
        _, mu, _ = irls(y, x, offset, alpha)
        s2 = _deviance(y, mu, alpha) / df
        return {"avg_log2cpm": at, "s2": np.where((mu.min(axis=1) >= 1) & (s2 > 0), s2, np.nan)}

    return keep(map_blocks(data.rows, len(offset), run, "avg_log2cpm double, s2 double"))


def prior_degrees(deviances: DataFrame, df: int) -> float:
    """Prior degrees of freedom from the spread of the logarithms of all ``s2`` around a cubic curve over abundance.

    With own dispersions scattered like those of ``d`` degrees of freedom, ``s2`` follows an F distribution with ``df`` and ``d``; the variance of
    its logarithm is that of the two chi-squares. No scatter beyond the first gives infinity. All sums are aggregates.
    """
    told = deviances.where(F.col("s2") > 0).select("avg_log2cpm", F.ln("s2").alias("e"))
    n, centre, scale, level = told.agg(F.count(F.lit(1)), F.avg("avg_log2cpm"), F.stddev_pop("avg_log2cpm"), F.avg("e")).first()
    if n < 10:
        return float("inf")
    x, e = (F.col("avg_log2cpm") - centre) / (scale or 1.0), F.col("e") - level
    powers = [F.avg(F.pow(x, F.lit(float(k)))) for k in range(7)]
    crossed = [F.avg(F.pow(x, F.lit(float(k))) * e) for k in range(4)]
    got = told.agg(*powers, *crossed, F.avg(e * e)).first()
    moments = np.array([[got[i + j] for j in range(4)] for i in range(4)])
    right = np.array(got[7:11])
    left_over = max(got[11] - right @ np.linalg.lstsq(moments, right, rcond=None)[0], 0.0) * n / (n - 4)
    excess = left_over - trigamma(df / 2)
    return 2 * trigamma_inverse(excess) if excess > 1e-6 else float("inf")


def nb_dispersion_edger(data: NbInput, *, prior_df: float | None = None, bins: int = 512) -> DataFrame:
    """``(feature, avg_log2cpm, common, trended, dispersion, prior_df)``; ``dispersion`` is the feature's own, pulled towards its neighbours.

    The pull has the weight of ``prior_df`` degrees of freedom; without a value it is estimated from the deviances of all features under the
    trend, as the one-call form of the method does. Features without scatter of their own get the trend (infinite degrees).
    """
    profiles = profile_table(data)
    total = profiles.agg(*[F.sum(F.col("apl")[i]) for i in range(len(GRID))]).first()
    common = float(grid_peak(np.array([total], dtype=float), GRID)[0])
    bx, by = _binned_profiles(profiles, bins)
    trend = grid_peak(by, GRID)
    along = lambda at: np.exp(np.interp(at, bx, np.log(trend)))
    prior = prior_degrees(trended_deviances(data, along), data.design.df) if prior_df is None else float(prior_df)
    weight = min(prior, 1e6) / data.design.df

    def run(batches):
        for pdf in batches:
            own = np.vstack(pdf["apl"].to_numpy())
            at = pdf["avg_log2cpm"].to_numpy()
            shared = np.column_stack([np.interp(at, bx, by[:, i]) for i in range(len(GRID))])
            yield pd.DataFrame({"feature": pdf["feature"], "avg_log2cpm": at, "common": common, "trended": along(at),
                                "dispersion": grid_peak(own + weight * shared, GRID), "prior_df": prior})

    kind = data.rows.schema["feature"].dataType.simpleString()
    return profiles.select("feature", "avg_log2cpm", "apl").mapInPandas(run, f"feature {kind}, avg_log2cpm double, common double, trended double, dispersion double, prior_df double")


def moment_dispersion(counts: DataFrame, size_factors: DataFrame, n_samples: int) -> float:
    """Mean over features of the moment estimate (variance − mean)/mean², not below 1e-8."""
    scaled = counts.join(small(size_factors), "sample").select("feature", (F.col("raw_count") / F.col("size_factor")).alias("v"))
    m = row_moments(scaled, "v", n_samples).where("mean > 0")
    value = m.agg(F.avg(F.greatest((F.col("variance") - F.col("mean")) / F.pow("mean", F.lit(2.0)), F.lit(0.0)))).first()[0]
    return max(float(value or 0.0), 1e-8)


def _parametric_trend(points: np.ndarray) -> tuple[float, float]:
    """a0 + a1/mean by iterated weighted least squares with gamma errors on binned (mean, dispersion) points."""
    mean, disp = points[:, 0], points[:, 1]
    x = np.column_stack([np.ones_like(mean), 1 / mean])
    fit = np.array([max(np.median(disp), 1e-6), 1.0])
    for _ in range(50):
        w = 1 / np.maximum(x @ fit, 1e-8)
        new = np.maximum(np.linalg.lstsq(x * w[:, None], disp * w, rcond=None)[0], 1e-8)
        if np.abs(np.log(new / fit)).max() < 1e-8:
            break
        fit = new
    return float(fit[0]), float(fit[1])


@dataclass(frozen=True)
class DispersionTrend:
    """a0 + a1/mean, the scatter of the logarithms of own estimates around it, and the variance of the prior of the logarithm."""

    a0: float
    a1: float
    scatter: float
    prior: float


def _own_dispersions(data: NbInput) -> DataFrame:
    """``(feature, base_mean, apl, disp_gene)``: the peak of every feature's own profile."""
    kind = data.rows.schema["feature"].dataType.simpleString()

    def own(batches):
        for pdf in batches:
            yield pd.DataFrame({"feature": pdf["feature"], "base_mean": pdf["base_mean"], "apl": pdf["apl"],
                                "disp_gene": grid_peak(np.vstack(pdf["apl"].to_numpy()), GRID)})

    schema = f"feature {kind}, base_mean double, apl array<double>, disp_gene double"
    return profile_table(data).select("feature", "base_mean", "apl").mapInPandas(own, schema)


def _dispersion_trend(genes: DataFrame, df: int, fit: str, bins: int) -> DispersionTrend:
    usable = genes.where(F.col("disp_gene") > 10 * GRID[0])
    if fit == "mean":
        lo, centre, hi = quantiles(usable, [], "disp_gene", {"lo": 0.001, "mid": 0.5, "hi": 0.999}).first()
        a0, a1 = usable.where(F.col("disp_gene").between(lo, hi)).agg(F.avg("disp_gene")).first()[0], 0.0
        centre = math.log(centre / a0)
    elif fit == "parametric":
        got = abundance_bins(usable, "base_mean", ["base_mean", "disp_gene"], bins=bins)
        a0, a1 = _parametric_trend(np.array([[r["base_mean"], r["disp_gene"]] for r in got]))
        centre = None
    else:
        raise ValueError(f"unknown trend {fit!r}")
    trend = F.lit(float(a0)) + F.lit(float(a1)) / F.col("base_mean")
    residual = usable.select((F.ln("disp_gene") - F.ln(trend)).alias("r"))
    if centre is None:
        centre = quantiles(residual, [], "r", {"m": 0.5}).first()[0]
    mad = quantiles(residual.select(F.abs(F.col("r") - centre).alias("d")), [], "d", {"m": 0.5}).first()[0] * 1.4826
    return DispersionTrend(float(a0), float(a1), mad, max(mad ** 2 - trigamma(df / 2), 0.25))


def _pulled_dispersions(genes: DataFrame, trend: DispersionTrend) -> DataFrame:
    """Own estimates pulled towards the trend; those far above it keep their own."""
    kind = genes.schema["feature"].dataType.simpleString()

    def shrink(batches):
        logs = np.log(GRID)
        for pdf in batches:
            centre_ = np.log(pdf["disp_fit"].to_numpy())
            penalty = (logs[None, :] - centre_[:, None]) ** 2 / (2 * trend.prior)
            pulled = grid_peak(np.vstack(pdf["apl"].to_numpy()) - penalty, GRID)
            out = np.log(pdf["disp_gene"].to_numpy()) > centre_ + 2 * trend.scatter
            yield pd.DataFrame({"feature": pdf["feature"], "base_mean": pdf["base_mean"], "disp_gene": pdf["disp_gene"], "disp_fit": pdf["disp_fit"],
                                "dispersion": np.where(out, pdf["disp_gene"], pulled), "outlier": out})

    fitted = F.lit(trend.a0) + F.lit(trend.a1) / F.greatest(F.col("base_mean"), F.lit(1e-8))
    return genes.withColumn("disp_fit", fitted).mapInPandas(
        shrink, f"feature {kind}, base_mean double, disp_gene double, disp_fit double, dispersion double, outlier boolean")


def dispersions_and_trend(data: NbInput, *, fit: str = "mean", bins: int = 512) -> tuple[DataFrame, DispersionTrend]:
    """The table of ``nb_dispersion_deseq`` and the trend behind it, for estimating further features under the same trend."""
    genes = keep(_own_dispersions(data))
    trend = _dispersion_trend(genes, data.design.df, fit, bins)
    return _pulled_dispersions(genes, trend), trend


def nb_dispersion_deseq(data: NbInput, *, fit: str = "mean", bins: int = 512) -> DataFrame:
    """``(feature, base_mean, disp_gene, disp_fit, dispersion, outlier)``: own estimate, trend, and shrunken value.

    ``fit='mean'`` uses a trimmed mean of the own estimates as a flat trend, ``'parametric'`` a0 + a1/mean. Needs an input
    with size factors.
    """
    return dispersions_and_trend(data, fit=fit, bins=bins)[0]


def bcv_data(dispersion: DataFrame) -> DataFrame:
    """Biological coefficient of variation (√dispersion) against abundance."""
    return dispersion.select("feature", "avg_log2cpm", *[F.sqrt(c).alias(f"bcv_{n}") for c, n in (("common", "common"), ("trended", "trended"), ("dispersion", "tagwise"))])


def disp_plot_data(dispersion: DataFrame) -> DataFrame:
    """Own, fitted and final dispersion against the mean."""
    return dispersion.where("base_mean > 0").select("feature", "base_mean", "disp_gene", "disp_fit", "dispersion", "outlier")


# --- fits and tests ---------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class NbFit:
    """``table(feature, coef, cov, loglik, base_mean, avg_log2cpm, max_cooks)`` and the rows (with dispersion) behind it."""

    table: DataFrame
    rows: DataFrame
    design: Design
    offset: np.ndarray


#: Fixed values of the published method: up to so many replicates, one in so many is trimmed at either end, and the variance scaled.
TRIMMED = ((3, 3, 2.04), (23, 4, 1.86), (float("inf"), 8, 1.51))


def _robust_dispersion(q, cells) -> np.ndarray:
    """Moment dispersion from trimmed variances of the replicate cells, at least 0.04."""
    worst = np.zeros(len(q))
    for members in cells:
        part = np.sort(q[:, members], axis=1)
        n = len(members)
        trim, scale = next((t, s) for upto, t, s in TRIMMED if n <= upto)
        cut = n // trim
        inner = part[:, cut:n - cut] if n > 2 * cut else part
        centre = inner.mean(axis=1, keepdims=True)
        squares = np.sort((part - centre) ** 2, axis=1)
        kept = squares[:, cut:n - cut] if n > 2 * cut else squares
        worst = np.maximum(worst, scale * kept.mean(axis=1))
    mean = np.maximum(q.mean(axis=1), 1e-8)
    return np.maximum((worst - mean) / mean ** 2, 0.04)[:, None]


def replicate_cells(x: np.ndarray, least: int = 3) -> list[np.ndarray]:
    """Index arrays of samples with identical design rows, for cells of at least ``least`` samples."""
    _, cell = np.unique(np.round(x, 9), axis=0, return_inverse=True)
    cell = cell.reshape(-1)
    return [np.flatnonzero(cell == c) for c in range(cell.max() + 1) if (cell == c).sum() >= least]


def _cooks(y, mu, alpha, cov, x, scale, cells) -> np.ndarray:
    """Cook's distance of every cell of a block, with a robust dispersion so that an outlier does not hide itself."""
    w = mu / (1 + alpha * mu)
    hat = np.clip(w * np.einsum("np,bpq,nq->bn", x, cov, x), 0, 1 - 1e-9)
    pearson = (y - mu) ** 2 / (mu + _robust_dispersion(y / scale, cells) * mu ** 2)
    return pearson / x.shape[1] * hat / (1 - hat) ** 2


def nb_glm_fit(data: NbInput, dispersion: DataFrame) -> NbFit:
    """One log-linear model per feature with its dispersion; natural-log coefficients in design order.

    ``max_cooks`` is NULL in designs without a replicated cell.
    """
    rows = keep(data.rows.join(small(dispersion.select("feature", "dispersion")), "feature"))
    x, offset = data.design.matrix, data.offset
    n, p = x.shape
    scale = np.exp(offset)
    cells = replicate_cells(x)
    replicated = np.concatenate(cells) if cells else np.array([], dtype=int)

    def run(y, extra):
        alpha = extra["dispersion"][:, None]
        beta, mu, info = irls(y, x, offset, alpha)
        cov = np.linalg.inv(info)
        cooks = np.full(len(y), np.nan)
        if len(replicated) and n > p:
            cooks = _cooks(y, mu, alpha, cov, x, scale, cells)[:, replicated].max(axis=1)
        return {"coef": beta, "cov": cov.reshape(len(y), p * p), "loglik": nb_loglik(y, mu, alpha), "base_mean": (y / scale).mean(axis=1),
                "avg_log2cpm": _average_log2cpm(y, offset), "max_cooks": cooks}

    table = keep(map_blocks(rows, n, run, "coef array<double>, cov array<double>, loglik double, base_mean double, avg_log2cpm double, max_cooks double",
                            extra=("dispersion",)))
    return NbFit(table, rows, data.design, offset)


#: Fixed values of the published method: replicates from which on cells are replaced, share trimmed at either end, quantile of the limit.
REPLACE_FROM, TRIM, COOKS_QUANTILE = 7, 0.2, 0.99


def replaced_outliers(fit: NbFit, *, least: int = REPLACE_FROM) -> DataFrame:
    """Feature rows ``(feature, idx, x, max_cooks)`` of the features that have influential cells, with these cells replaced.

    A cell is influential if its Cook's distance is above the 99 % point of F; it is replaced if its sample has at least ``least``
    replicates, by the mean of the feature's normalised counts without the highest and lowest 20 %, times the size factor, without the fraction.
    ``max_cooks`` is the largest distance among replicated cells that cannot be replaced, NULL where there are none. Only rows whose
    largest distance is above the limit are read a second time.
    """
    x, offset = fit.design.matrix, fit.offset
    n, p = x.shape
    scale, cells = np.exp(offset), replicate_cells(x)
    replaceable = np.zeros(n, dtype=bool)
    for members in replicate_cells(x, least):
        replaceable[members] = True
    other = np.array([i for members in cells for i in members if not replaceable[i]], dtype=int)
    limit = f_quantile(COOKS_QUANTILE, p, n - p) if n > p else math.inf
    cut = int(n * TRIM)

    def run(y, extra):
        alpha, beta, cov = extra["dispersion"][:, None], extra["coef"], extra["cov"].reshape(len(y), p, p)
        mu = np.exp(np.clip(beta @ x.T + offset, -30, 30))
        cooks = _cooks(y, mu, alpha, cov, x, scale, cells)
        bad = (cooks > limit) & replaceable
        q = np.sort(y / scale, axis=1)[:, cut:n - cut].mean(axis=1, keepdims=True)
        return {"new": np.where(bad, np.floor(q * scale + 1e-9), y), "n_replaced": bad.sum(axis=1),
                "max_cooks": cooks[:, other].max(axis=1) if len(other) else np.full(len(y), np.nan)}

    suspect = fit.table.where(F.col("max_cooks") > limit) if replaceable.any() and n > p else fit.table.where(F.lit(False))
    rows = fit.rows.join(small(suspect.select("feature", "coef", "cov")), "feature")
    done = map_blocks(rows, n, run, "new array<double>, n_replaced int, max_cooks double", extra=("dispersion", "coef", "cov"))
    return done.where("n_replaced > 0").select("feature", F.sequence(F.lit(0), F.lit(n - 1)).alias("idx"), F.col("new").alias("x"), "max_cooks", "n_replaced")


def refit_outliers(data: NbInput, fit: NbFit, trend: DispersionTrend, *, least: int = REPLACE_FROM) -> NbFit:
    """The fit with influential cells of well replicated samples replaced and only the features they belong to estimated again.

    The second fit takes the trend and prior of the first; rows without replaced cells are those of the first fit. A feature that has no
    count left gets zero coefficients.
    """
    if not replicate_cells(fit.design.matrix, least):
        return fit
    changed = keep(replaced_outliers(fit, least=least))
    if changed.isEmpty():
        return fit
    again = NbInput(changed.select("feature", "idx", "x"), data.design, data.offset)
    second = nb_glm_fit(again, keep(_pulled_dispersions(keep(_own_dispersions(again)), trend)))
    zeros = F.transform("coef", lambda c: F.when(F.col("base_mean") > 0, c).otherwise(F.lit(0.0)))
    table = second.table.drop("max_cooks").join(small(changed.select("feature", "max_cooks")), "feature").withColumn("coef", zeros)
    key = small(changed.select("feature"))
    merged = [old.join(key, "feature", "left_anti").unionByName(new.select(*old.columns)) for old, new in ((fit.table, table), (fit.rows, second.rows))]
    return NbFit(keep(merged[0]), keep(merged[1]), fit.design, fit.offset)


def _without(weights: np.ndarray) -> np.ndarray:
    """Basis of the coefficient vectors on which the contrast is zero."""
    full = np.linalg.qr(np.column_stack([weights, np.eye(len(weights))]))[0]
    return full[:, 1:len(weights)]


def glm_lrt(fit: NbFit, contrasts: DataFrame) -> DataFrame:
    """Likelihood-ratio test of each contrast: the null model is the design restricted to a zero contrast."""
    weights = contrast_weights(contrasts, fit.design.coefs)
    x, offset = fit.design.matrix, fit.offset
    nulls = [x @ _without(w) for w in weights.values()]

    def run(y, extra):
        alpha, full, beta = extra["dispersion"][:, None], extra["loglik"], extra["coef"]
        stats = []
        for null in nulls:
            if null.shape[1]:
                _, mu0, _ = irls(y, null, offset, alpha)
            else:
                mu0 = np.broadcast_to(np.exp(offset), y.shape)
            stats.append(np.maximum(2 * (full - nb_loglik(y, mu0, alpha)), 0))
        lr = np.column_stack(stats)
        lfc = np.column_stack([beta @ w / LN2 for w in weights.values()])
        return {"lfc": lfc, "lr": lr, "p": erfc(np.sqrt(lr / 2)), "avg_log2cpm": _average_log2cpm(y, offset)}

    fitted = fit.rows.join(small(fit.table.select("feature", "coef", "loglik")), "feature")
    arrays = map_blocks(fitted, len(offset), run, "lfc array<double>, lr array<double>, p array<double>, avg_log2cpm double", extra=("dispersion", "coef", "loglik"))
    names = F.array(*[F.lit(k) for k in weights])
    long = arrays.select("feature", "avg_log2cpm", F.explode(F.arrays_zip(names.alias("contrast"), "lfc", "lr", "p")).alias("c"))
    return long.select("feature", "c.contrast", "avg_log2cpm", F.col("c.lfc").alias("avg_log2fc"), F.col("c.lr").alias("stat"), F.col("c.p").alias("p_value"))


@F.pandas_udf(T.DoubleType())
def _shifted_tail(z: pd.Series) -> pd.Series:
    """min(1, 2·(1 − Φ(z)))."""
    return pd.Series(np.where(z.isna(), np.nan, np.minimum(1.0, erfc(z.fillna(0).to_numpy() / math.sqrt(2)))))


def nb_wald(fit: NbFit, contrasts: DataFrame, *, lfc: float = 0.0, cooks: bool = True) -> DataFrame:
    """Wald test per feature and contrast; ``lfc`` tests |log2 fold change| ≤ lfc. Influential outliers get a NULL p-value."""
    rows = per_contrast(fit.table, contrast_weights(contrasts, fit.design.coefs), "base_mean", "avg_log2cpm", "max_cooks")
    n, p = fit.design.matrix.shape
    change, se = F.col("est") / LN2, F.sqrt("var") / LN2
    tested = rows.withColumn("avg_log2fc", change).withColumn("lfc_se", se)
    tested = tested.withColumn("stat", (F.abs("avg_log2fc") - lfc) / F.col("lfc_se") if lfc else F.col("avg_log2fc") / F.col("lfc_se"))
    tail = _shifted_tail("stat") if lfc else normal_two_sided("stat")
    if cooks and n > p:
        limit = f_quantile(COOKS_QUANTILE, p, n - p)
        tail = F.when(F.coalesce(F.col("max_cooks") <= limit, F.lit(True)), tail)
    return tested.withColumn("p_value", tail).select("feature", "contrast", "base_mean", "avg_log2cpm", "avg_log2fc", "lfc_se", "stat", "p_value")


def wald_lfc_threshold(fit: NbFit, contrasts: DataFrame, *, lfc: float = 1.0, cooks: bool = True) -> DataFrame:
    return nb_wald(fit, contrasts, lfc=lfc, cooks=cooks)


def results_contrast(fit: NbFit, design: DataFrame, spec, *, cooks: bool = True) -> DataFrame:
    """Wald results for ``(variable, A, B)`` or for one coefficient by name."""
    if isinstance(spec, str):
        contrasts = make_contrasts(design, {spec: spec})
    else:
        variable, a, b = spec
        known = set(fit.design.coefs)
        terms = [f"{sign}{variable}{level}" for sign, level in (("", a), ("-", b)) if f"{variable}{level}" in known]
        if not terms:
            raise ValueError(f"no coefficients for {spec!r}")
        contrasts = make_contrasts(design, {f"{variable}_{a}_vs_{b}": "".join(terms)})
    return nb_wald(fit, contrasts, cooks=cooks)


def lowess(x: np.ndarray, y: np.ndarray, span: float = 0.2) -> np.ndarray:
    """Locally linear fit with tricube weights (no robustness steps) at every x."""
    k = max(3, int(np.ceil(span * len(x))))
    out = np.empty(len(x))
    for i, at in enumerate(x):
        d = np.abs(x - at)
        h = max(np.sort(d)[min(k, len(x)) - 1], 1e-12)
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        sw = np.sqrt(w)
        a = np.column_stack([np.ones_like(x), x - at])
        out[i] = np.linalg.lstsq(a * sw[:, None], y * sw, rcond=None)[0][0]
    return out


def rejections_by_cut(de: DataFrame, mean: str, *, alpha: float, cuts: int) -> tuple[DataFrame, DataFrame]:
    """``(contrast, i, cut)`` and ``(contrast, i, n_rejected)`` for quantile cuts of the mean.

    Only p-values up to alpha can be rejected, so only those are expanded over the cuts they pass and ranked; the number of
    tests per cut is a plain count.
    """
    lowest = de.where(F.col("p_value").isNotNull())
    zero = de.groupBy("contrast").agg(F.avg((F.col(mean) == 0).cast("double")).alias("z"))
    top = F.when(F.col("z") < 0.95, F.lit(0.95)).otherwise(F.lit(1.0))
    theta = zero.select("contrast", F.array(*[F.col("z") + (top - F.col("z")) * i / (cuts - 1) for i in range(cuts)]).alias("_theta"))
    probs = {f"q{i}": F.col("_theta")[i] for i in range(cuts)}
    cut_table = keep(quantiles(de, ["contrast"], mean, probs, at=theta).select("contrast", F.array(*probs).alias("cuts")))
    tested = lowest.join(small(cut_table), "contrast").withColumn("_passed", F.size(F.filter("cuts", lambda c: c <= F.col(mean))))
    tested = keep(tested.select("contrast", "feature", "p_value", "_passed").where("_passed > 0"))
    passed = tested.groupBy("contrast", "_passed").agg(F.count(F.lit(1)).alias("n"))
    levels = passed.select("contrast", "n", F.explode(F.sequence(F.lit(1), F.col("_passed"))).alias("i")).groupBy("contrast", "i").agg(F.sum("n").alias("m"))
    near = tested.where(F.col("p_value") <= alpha).select("contrast", "feature", "p_value", F.explode(F.sequence(F.lit(1), F.col("_passed"))).alias("i"))
    ranked = scan(near, ["contrast", "i"], [F.col("p_value").asc(), F.col("feature").asc()], number="rank")
    ok = ranked.join(small(levels), ["contrast", "i"]).where(F.col("p_value") <= alpha * F.col("rank") / F.col("m"))
    cut_rows = cut_table.select("contrast", F.posexplode("cuts").alias("i", "cut")).withColumn("i", F.col("i") + 1)
    return cut_rows, ok.groupBy("contrast", "i").agg(F.max("rank").alias("n_rejected"))


def independent_filtering(de: DataFrame, *, mean: str = "base_mean", alpha: float = 0.1, cuts: int = 50) -> DataFrame:
    """Adjusted p-values with the mean cut that maximises rejections (smoothed); below the cut they are NULL."""
    from countspark.functions.adjust import bh_adjust

    de = keep(de)
    cut_rows, rejected = rejections_by_cut(de, mean, alpha=alpha, cuts=cuts)
    curve = collect_small(cut_rows.join(small(rejected), ["contrast", "i"], "left").na.fill(0, ["n_rejected"]).orderBy("contrast", "i"))
    chosen = []
    for contrast in sorted({r["contrast"] for r in curve}):
        part = [r for r in curve if r["contrast"] == contrast]
        count = np.array([r["n_rejected"] for r in part], dtype=float)
        pick = 0
        if count.max() > 10:
            smooth = lowess(np.arange(len(count), dtype=float), count)
            slack = np.sqrt(((count - smooth)[count > 0] ** 2).mean())
            above = np.flatnonzero(count > smooth.max() - slack)
            pick = int(above[0]) if len(above) else int(count.argmax())
        chosen.append((contrast, float(part[pick]["cut"])))
    cut = local_table(de.sparkSession, chosen, "contrast string, mean_cut double")
    marked = de.join(small(cut), "contrast").withColumn("_p", F.when(F.col(mean) >= F.col("mean_cut"), F.col("p_value")))
    return bh_adjust(marked, "_p", by=["contrast"]).drop("_p")


def prior_scale(fit: NbFit, coef: str, *, most: float = 1.0) -> float:
    """Scale of the prior of one coefficient (natural logarithm): the root of the effect variance of highest marginal likelihood, at most ``most``.

    Estimates are taken as normal around effects that are normal around zero, so the marginal variance of an estimate is the effect variance
    plus its own. The slope of the log-likelihood is an aggregate over all features; Newton steps on the logarithm of the variance stay
    inside the bracket that the signs seen so far allow.
    """
    at, p = fit.design.coefs.index(coef), len(fit.design.coefs)
    est, var = F.col("coef")[at], F.col("cov")[at * p + at]
    table = fit.table.select((est * est).alias("b2"), var.alias("v")).where("v > 0")
    low, high = math.log(1e-6), math.log(400.0)
    log_a = math.log(0.1)
    for _ in range(60):
        a = F.lit(math.exp(log_a))
        total = a + F.col("v")
        slope, bend = table.agg(F.sum((F.col("b2") - total) / (total * total) / 2), F.sum(1 / (total * total) / 2 - F.col("b2") / (total * total * total))).first()
        if slope is None:
            return most
        step_slope = slope * math.exp(log_a)
        step_bend = bend * math.exp(2 * log_a) + step_slope
        low, high = (log_a, high) if slope > 0 else (low, log_a)
        target = log_a - step_slope / step_bend if step_bend < 0 else math.inf
        new = target if low < target < high else (low + high) / 2
        moved, log_a = abs(new - log_a), new
        if moved < 1e-9:
            break
    return min(math.exp(log_a / 2), most)


#: Steps of the two quadratures, standard deviations along sinh around the mode and along the logarithm of the distance to zero.
SINH_STEPS, LOG_STEPS = np.arange(-6.0, 6.01, 0.4), np.arange(-8.0, 6.01, 0.4)


def sign_error(y, x, offset, alpha, at: int, scale: float, beta, sd) -> np.ndarray:
    """Posterior probability that the coefficient ``at`` has another sign than ``beta`` has; a block of features.

    The posterior along the coefficient is the likelihood with the other coefficients at their best (and their curvature, Laplace's
    approximation) times the Cauchy prior. Its whole mass is summed along sinh steps around the mode, the mass beyond zero along steps of the
    logarithm of the distance to zero, both without a cut at a fixed number of deviations.
    """
    others = [j for j in range(x.shape[1]) if j != at]
    rest = x[:, others]
    mode, side = beta[:, at], np.where(beta[:, at] >= 0, 1.0, -1.0)
    warm = beta[:, others].copy()

    def log_density(value):
        shift = offset + value[:, None] * x[:, at]
        if others:
            nonlocal warm
            warm, mu, info = irls(y, rest, shift, alpha, beta=warm.copy(), steps=50)
            extra = -0.5 * np.linalg.slogdet(info)[1]
        else:
            mu, extra = np.exp(np.clip(shift, -30, 30)), 0.0
        return nb_loglik(y, mu, alpha) + extra - np.log1p((value / scale) ** 2)

    top = log_density(mode)
    whole = np.zeros(len(y))
    for steps in (SINH_STEPS[SINH_STEPS > -0.1], SINH_STEPS[SINH_STEPS < -0.1][::-1]):  # away from the mode, each fit starts from the last
        warm = beta[:, others].copy()
        for u in steps:
            whole += np.exp(np.minimum(log_density(mode + sd * math.sinh(u)) - top, 50)) * math.cosh(u) * 0.4 * sd
    warm = beta[:, others].copy()
    beyond = np.zeros(len(y))
    for i, u in enumerate(LOG_STEPS):
        distance = sd * math.exp(u)
        part = np.exp(np.minimum(log_density(-side * distance) - top, 50)) * distance
        beyond += part * (0.4 if i else 0.2 + 1.0)  # the first also stands for what lies closer to zero, where the density is level
    return np.clip(beyond / np.maximum(whole, 1e-300), 0, 1)


def lfc_shrink(fit: NbFit, coef: str, *, scale: float | None = None) -> DataFrame:
    """``(feature, lfc_mle, lfc_shrunk, lfc_sd, sign_error)``: posterior mode of one coefficient under a Cauchy prior; log2 units.

    The scale of the prior comes from all features (``prior_scale``) unless given. The prior enters as a ridge that is re-weighted by the
    current estimate, which has the posterior mode as its fixed point. ``sign_error`` is the posterior probability of the other sign.
    """
    at = fit.design.coefs.index(coef)
    p = len(fit.design.coefs)
    scale = prior_scale(fit, coef) if scale is None else float(scale)
    scale2 = scale * scale
    x, offset = fit.design.matrix, fit.offset

    def prior(beta):
        out = np.zeros_like(beta)
        out[:, at] = 2 / (scale2 + beta[:, at] ** 2)
        return out

    def run(y, extra):
        alpha = extra["dispersion"][:, None]
        raw = extra["coef"]
        beta, _, info = irls(y, x, offset, alpha, beta=raw.copy(), prior=prior)
        curve = np.zeros_like(beta)
        curve[:, at] = np.maximum(2 * (scale2 - beta[:, at] ** 2) / (scale2 + beta[:, at] ** 2) ** 2, 0)
        cov = np.linalg.inv(info + curve[:, :, None] * np.eye(p))
        sd = np.sqrt(cov[:, at, at])
        return {"lfc_mle": raw[:, at] / LN2, "lfc_shrunk": beta[:, at] / LN2, "lfc_sd": sd / LN2,
                "sign_error": sign_error(y, x, offset, alpha, at, scale, beta, np.minimum(sd, 4 * scale + np.abs(beta[:, at])))}

    fitted = fit.rows.join(small(fit.table.select("feature", F.col("coef"))), "feature")
    return map_blocks(fitted, len(offset), run, "lfc_mle double, lfc_shrunk double, lfc_sd double, sign_error double", extra=("dispersion", "coef"))


def s_values(shrunk: DataFrame) -> DataFrame:
    """``lfc_shrunk`` rows with ``s_value``: the mean sign error of all features whose sign is at least as certain."""
    ranked = scan(shrunk, [], [F.col("sign_error").asc_nulls_last(), F.col("feature").asc()], number="_i", sums={"_s": "sign_error"})
    return ranked.withColumn("s_value", F.when(F.col("sign_error").isNotNull(), F.col("_s") / F.col("_i"))).drop("_i", "_s")


# --- exact test -------------------------------------------------------------------------------------------------------

def split_tails(s1: np.ndarray, total: np.ndarray, n1: int, n2: int, alpha: np.ndarray) -> np.ndarray:
    """Twice the smaller tail of the first group's sum given the total, both sums negative binomial with equal means; a block of features.

    The weights of the splits of a total have one mode. They are summed from the observed split outwards in both directions, each from
    its neighbour by their ratio and for all features at once, until what is left cannot count in double precision. The work follows
    the width of the distribution and not the total.
    """
    s1, total = np.asarray(s1, float), np.asarray(total, float)
    r1, r2 = n1 / np.maximum(alpha, 1e-12), n2 / np.maximum(alpha, 1e-12)
    mode = np.clip(np.round(total * n1 / (n1 + n2)), 0, total)
    log_w = lambda k: lgamma(k + r1) - lgamma(k + 1) + lgamma(total - k + r2) - lgamma(total - k + 1)
    own = log_w(s1)
    peak = np.maximum(log_w(mode), own)

    def outwards(step: int) -> np.ndarray:
        """Σ of the weights from the observed split (included) on in one direction."""
        sums, at, level = np.exp(own - peak), s1.copy(), own - peak
        open_, terms = np.flatnonzero(at < total if step > 0 else at > 0), 64
        while len(open_):
            t, a, b = total[open_, None], r1[open_, None], r2[open_, None]
            k = at[open_, None] + step * np.arange(terms)
            valid = (k < t) if step > 0 else (k > 0)
            k = np.where(valid, k, 0 if step > 0 else t)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = (k + a) / (k + 1) * (t - k) / (t - k - 1 + b) if step > 0 else k / (k - 1 + a) * (t - k + b) / (t - k + 1)
                logs = level[open_, None] + np.cumsum(np.where(valid, np.log(np.where(valid, ratio, 1.0)), 0.0), axis=1)
            w = np.where(valid, np.exp(logs), 0.0)
            sums[open_] += w.sum(1)
            at[open_] += step * terms
            level[open_] = logs[:, -1]
            falling = (at[open_] - mode[open_]) * step > 0
            open_ = open_[~(~valid[:, -1] | (falling & (w[:, -1] * np.maximum(total[open_], 1) < 1e-17 * sums[open_])))]
            terms = min(2 * terms, max(64, 4_000_000 // max(1, len(open_))))
        return sums

    below, above = outwards(-1), outwards(1)
    whole = below + above - np.exp(own - peak)
    return np.where(total > 0, np.minimum(1.0, 2 * np.minimum(below, above) / np.maximum(whole, 1e-300)), 1.0)


def exact_test(counts: DataFrame, samples: DataFrame, dispersion: DataFrame, *, group: str, pair: tuple, factors: DataFrame | None = None,
               prior: float = 0.125) -> DataFrame:
    """Exact negative-binomial test of two groups of samples after scaling their counts to a common library size."""
    sheet = samples.where(F.col(group).isin(list(pair)))
    level = {r["sample"]: r[group] for r in collect_small(sheet.select("sample", group))}
    names = sorted(level)
    lib = {r["sample"]: r["lib_size"] for r in collect_small(effective_library(counts, samples, factors))}
    size = np.array([float(lib[s]) for s in names])
    common = float(np.exp(np.log(size).mean()))
    first = np.array([level[s] == pair[0] for s in names])
    n1, n2 = int(first.sum()), int((~first).sum())
    rows = feature_rows(counts.where("raw_count > 0"), "raw_count", sheet, names)
    rows = keep(rows.join(small(dispersion.select("feature", "dispersion")), "feature"))
    label = f"{pair[1]}_vs_{pair[0]}"

    def run(y, extra):
        scaled = y * common / size
        s1, s2 = scaled[:, first].sum(axis=1), scaled[:, ~first].sum(axis=1)
        p = split_tails(np.round(s1), np.round(s1) + np.round(s2), n1, n2, extra["dispersion"])
        rate1 = (s1 / n1 + prior) / common
        rate2 = (s2 / n2 + prior) / common
        return {"avg_log2fc": np.log2(rate2 / rate1), "avg_log2cpm": _average_log2cpm(y, np.log(size)), "p_value": p}

    out = map_blocks(rows, len(names), run, "avg_log2fc double, avg_log2cpm double, p_value double", extra=("dispersion",))
    return out.withColumn("contrast", F.lit(label))
