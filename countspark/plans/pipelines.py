"""One-call analyses: compositions of the operators, all ending in the same result table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from countspark.model import Experiment
from countspark.operators import linear, negbin, normalize as nz
from countspark.operators.detable import de_table
from countspark.session import as_written, keep


def voom_analysis(exp: Experiment, *, threshold: float = 0.05, tmm: bool = True) -> DataFrame:
    """TMM → voom → weighted linear models → moderated t → result table."""
    counts = as_written(exp.counts)
    factors = keep(nz.tmm_factors(counts)) if tmm else None
    voom = linear.voom_weights(counts, exp.design, factors=factors)
    return de_table(keep(linear.ebayes_moderate(linear.voom_fit(voom), exp.contrasts)), threshold=threshold)


def edger_analysis(exp: Experiment, *, threshold: float = 0.05, prior_df: float | None = 10) -> DataFrame:
    """TMM → dispersions → log-linear models → likelihood-ratio tests → result table.

    ``prior_df`` is that of the dispersions estimated in steps; None estimates it, as the one-call form does.
    """
    counts = as_written(exp.counts)
    factors = keep(nz.tmm_factors(counts))
    data = negbin.nb_input(counts, exp.design, factors=factors)
    fit = negbin.nb_glm_fit(data, keep(negbin.nb_dispersion_edger(data, prior_df=prior_df)))
    return de_table(keep(negbin.glm_lrt(fit, exp.contrasts)), threshold=threshold)


def deseq2_analysis(exp: Experiment, *, threshold: float = 0.05, trend: str = "mean", replace_from: int | None = negbin.REPLACE_FROM) -> DataFrame:
    """Size factors → dispersions → fits → outliers replaced and their features fitted again → Wald tests → result table.

    Influential cells are replaced in samples with at least ``replace_from`` replicates (None: nowhere); elsewhere they make a p-value NULL.
    """
    counts = as_written(exp.counts)
    factors = keep(nz.size_factors(counts, exp.samples.count()))
    data = negbin.nb_input(counts, exp.design, size_factors=factors)
    dispersion, along = negbin.dispersions_and_trend(data, fit=trend)
    fit = negbin.nb_glm_fit(data, keep(dispersion))
    if replace_from is not None:
        fit = negbin.refit_outliers(data, fit, along, least=replace_from)
    return de_table(keep(negbin.nb_wald(fit, exp.contrasts)), threshold=threshold)
