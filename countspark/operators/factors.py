"""Regularised log transformation and hidden factors of the samples."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from countspark.functions.monotone import pool_neighbours
from countspark.functions.rows import _dense_blocks, feature_rows, map_blocks, sample_index, sample_names
from countspark.functions.special import erfc, f_tail, normal_upper_quantile
from countspark.operators.linear import design_arrays
from countspark.operators.multivariate import sample_components
from countspark.operators.negbin import LN2, nb_dispersion_deseq, nb_input
from countspark.operators.normalize import size_factors as estimate_size_factors
from countspark.session import keep, local_table, small

#: Resolution and range of the histogram of absolute log2 deviations.
DEVIATION_BINS, DEVIATION_MAX = 4000, 20.0
#: Fixed value: 97.5 % point of the standard normal distribution.
NORMAL_975 = 1.959963984540054


def _deviation_scale(rows: DataFrame, n: int, scale: np.ndarray) -> float:
    """σ of the sample effects: the weighted 95 % quantile of |log2 deviation| matched to that of a normal distribution.

    The quantile is read from a histogram that tasks accumulate, at a resolution of 0.005.
    """

    def run(batches):
        total = np.zeros(DEVIATION_BINS)
        for batch in batches:
            disp = batch.column("disp_fit").to_numpy(zero_copy_only=False)
            for lo, hi, block in _dense_blocks(batch, n):
                q = block / scale
                mean = q.mean(axis=1, keepdims=True)
                deviation = np.abs(np.log2(q + 0.5) - np.log2(mean + 0.5))
                weight = np.broadcast_to(1 / (1 / np.maximum(mean, 1e-8) + disp[lo:hi, None]), deviation.shape)
                total += np.histogram(deviation, bins=DEVIATION_BINS, range=(0, DEVIATION_MAX), weights=weight)[0]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["h"])

    parts = rows.select("idx", "x", "disp_fit").mapInArrow(run, "h array<double>")
    cells = parts.select(F.posexplode("h").alias("i", "w")).groupBy("i").agg(F.sum("w").alias("w")).where("w > 0").orderBy("i").collect()
    weights = np.array([r["w"] for r in cells])
    at = int(np.searchsorted(np.cumsum(weights), 0.95 * weights.sum()))
    upper = (cells[min(at, len(cells) - 1)]["i"] + 0.5) * DEVIATION_MAX / DEVIATION_BINS
    return max(upper / NORMAL_975, 1e-3)


def _ridge_log2(y, offset, alpha, sigma) -> np.ndarray:
    """Posterior mode of intercept + sample effect per cell, on the log2 scale, by Newton steps on an arrow-shaped system."""
    lam = 1 / (sigma * LN2) ** 2
    scale = np.exp(offset)
    base = np.log(np.maximum((y / scale).mean(axis=1, keepdims=True), 1e-8))
    effect = np.zeros_like(y)
    for _ in range(100):
        mu = np.exp(np.clip(base + effect + offset, -30, 30))
        w = mu / (1 + alpha * mu)
        g = (y - mu) / (1 + alpha * mu)
        g_effect = g - lam * effect
        corner = (w - w * w / (w + lam)).sum(axis=1, keepdims=True) + 1e-6
        step0 = (g.sum(axis=1, keepdims=True) - (w * g_effect / (w + lam)).sum(axis=1, keepdims=True)) / corner
        step0 = np.clip(step0, -5, 5)
        step = np.clip((g_effect - w * step0) / (w + lam), -5, 5)
        base, effect = base + step0, effect + step
        if max(np.abs(step0).max(), np.abs(step).max()) < 1e-8:
            break
    return (base + effect) / LN2


def rlog(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """Regularised log2 values ``(feature, sample, rlog)``, blind to the groups."""
    names = sample_names(samples)
    factors = keep(estimate_size_factors(counts, len(names)))
    design = keep(samples.select("sample", F.lit("Intercept").alias("coef"), F.lit(1.0).alias("value")))
    data = nb_input(counts, design, size_factors=factors)
    dispersion = nb_dispersion_deseq(data, fit="mean")
    rows = keep(data.rows.join(small(dispersion.select("feature", "disp_fit")), "feature"))
    offset, n = data.offset, len(names)
    sigma = _deviation_scale(rows, n, np.exp(offset))
    wide = map_blocks(rows, n, lambda y, e: {"r": _ridge_log2(y, offset, e["disp_fit"][:, None], sigma)}, "r array<double>", extra=("disp_fit",))
    return wide.select("feature", F.posexplode("r").alias("idx", "rlog")).join(sample_index(samples, names), "idx").select("feature", "sample", "rlog")


def _factor_table(template: DataFrame, names: list, vectors: np.ndarray) -> DataFrame:
    kind = template.schema["sample"].dataType.simpleString()
    return local_table(template.sparkSession, [(s, k + 1, float(vectors[i, k])) for i, s in enumerate(names) for k in range(vectors.shape[1])],
                                                 f"sample {kind}, factor int, value double")


def ruv_factors(counts: DataFrame, samples: DataFrame, controls: DataFrame, *, k: int = 2, value: str = "raw_count") -> DataFrame:
    """Unwanted factors from control features: leading sample vectors of their centred log counts."""
    names = sample_names(samples)
    kept = counts.join(small(controls.select("feature").distinct()), "feature", "left_semi")
    rows = feature_rows(kept, value, samples, names)

    def prepare(x):
        logs = np.log(x + 1)
        return logs - logs.mean(axis=1, keepdims=True)

    vectors, _, _ = sample_components(rows, len(names), k, prepare)
    return _factor_table(samples, names, vectors)


def _rss(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    q = np.linalg.qr(x)[0]
    return np.maximum((y * y).sum(axis=1) - ((y @ q) ** 2).sum(axis=1), 1e-12)


def nested_f_p(y: np.ndarray, small_x: np.ndarray, big_x: np.ndarray) -> np.ndarray:
    """p-values of the F test of two nested linear models for a block."""
    d1, d2 = big_x.shape[1] - small_x.shape[1], len(big_x) - big_x.shape[1]
    rss0, rss1 = _rss(y, small_x), _rss(y, big_x)
    return f_tail((rss0 - rss1) / d1 / (rss1 / d2), d1, d2)


#: Fixed values of the published method: p-values are held above this one, and the kernel is so many times the usual width.
LEAST_P, KERNEL_FACTOR = 1e-8, 1.5
#: Normal scores of the p-values between which tasks count, a hundredth apart; far finer than the kernel.
SCORES = np.linspace(-1, 1, 1122) * float(normal_upper_quantile(LEAST_P))
SCORE_P = erfc(-SCORES / math.sqrt(2)) / 2


def _count_scores(p: np.ndarray) -> np.ndarray:
    """Numbers of p-values between neighbouring scores; those beyond the ends count in the outer intervals."""
    return np.bincount(_score_bin(p), minlength=len(SCORES) - 1).astype(float)


def _score_bin(p: np.ndarray) -> np.ndarray:
    return np.clip(np.searchsorted(SCORE_P, p, side="right") - 1, 0, len(SCORES) - 2)


def null_curve(counts: np.ndarray) -> np.ndarray:
    """Probability of the null hypothesis per interval of scores: π0·φ(z)/f(z), at most 1, made rising in z by pooling neighbours.

    ``f`` is a normal-kernel density of all scores, computed from their counts; π0 is the share of p-values above 0.8 over 0.2.
    """
    n, z = counts.sum(), (SCORES[1:] + SCORES[:-1]) / 2
    if n == 0:
        return np.ones_like(z)
    mean = (counts * z).sum() / n
    sd = math.sqrt((counts * (z - mean) ** 2).sum() / max(n - 1, 1))
    upto = np.cumsum(counts)
    spread = (z[np.searchsorted(upto, 0.75 * n)] - z[np.searchsorted(upto, 0.25 * n)]) / 1.34
    width = max(KERNEL_FACTOR * 0.9 * (min(sd, spread) or sd or 1.0) * n ** -0.2, SCORES[1] - SCORES[0])
    kernel = np.exp(-((z[:, None] - z[None, :]) / width) ** 2 / 2) / (width * math.sqrt(2 * math.pi))
    density = kernel @ counts / n
    high = int(np.searchsorted(SCORE_P, 0.8))
    pi0 = min(1.0, counts[high:].sum() / n / (1 - SCORE_P[high]))
    raw = np.minimum(1.0, pi0 * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / np.maximum(density, 1e-300))
    held = np.flatnonzero(counts)
    return pool_neighbours(raw[held], counts[held])[np.clip(np.searchsorted(held, np.arange(len(z)), side="right") - 1, 0, None)]


def sva_factors(counts: DataFrame, design: DataFrame, null: DataFrame, *, n_sv: int = 2, rounds: int = 5, value: str = "raw_count") -> DataFrame:
    """Surrogate variables: leading vectors of the log counts, features weighted by P(hidden factor) · (1 − P(interest)).

    Each round is two narrow passes over the same rows: counts of the normal scores of both p-values, from which the driver gets the two
    curves of null probabilities (``null_curve``), then the weighted decomposition.
    """
    full, base = design_arrays(design), design_arrays(null)
    names, n = full.samples, len(full.samples)
    rows = feature_rows(counts, value, design, names)
    q = np.linalg.qr(full.matrix)[0]

    def residual(x):
        logs = np.log(x + 1)
        return logs - (logs @ q) @ q.T

    vectors, _, _ = sample_components(rows, n, n_sv, residual)
    for _ in range(rounds):
        hidden = np.column_stack([base.matrix, vectors])
        both = np.column_stack([full.matrix, vectors])

        def p_values(x, h=hidden, b=both):
            logs = np.log(x + 1)
            return nested_f_p(logs, base.matrix, h), nested_f_p(logs, h, b)

        def histograms(x):
            return np.vstack([_count_scores(p) for p in p_values(x)])

        null_hidden, null_interest = (null_curve(c) for c in _fold_rows(rows, n, 2, len(SCORES) - 1, histograms))

        def weighted(x, hidden_=null_hidden, interest_=null_interest, of=p_values):
            p_hidden, p_interest = of(x)
            weight = (1 - hidden_[_score_bin(p_hidden)]) * interest_[_score_bin(p_interest)]
            logs = np.log(x + 1) * weight[:, None]
            return logs - logs.mean(axis=1, keepdims=True)

        vectors, _, _ = sample_components(rows, n, n_sv, weighted)
    return _factor_table(design, names, vectors)


def _fold_rows(rows: DataFrame, n: int, height: int, width: int, fn) -> np.ndarray:
    """Σ over blocks of ``fn(block)`` for a small ``height × width`` result."""

    def run(batches):
        total = np.zeros((height, width))
        for batch in batches:
            for _, _, block in _dense_blocks(batch, n):
                total += fn(block)
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()])], ["v"])

    parts = rows.select("idx", "x").mapInArrow(run, "v array<double>")
    cells = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(height * width)
    for r in cells:
        out[r["i"]] = r["v"]
    return out.reshape(height, width)


def add_factors(design: DataFrame, factors: DataFrame, *, prefix: str = "W") -> DataFrame:
    """A design with the factors as further coefficients."""
    extra = factors.select("sample", F.concat(F.lit(prefix), F.col("factor").cast("string")).alias("coef"), "value")
    return keep(design.unionByName(extra))
