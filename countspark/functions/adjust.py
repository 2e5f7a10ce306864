"""Multiple-testing corrections per group (contrast, gene-set collection …). NULL p-values stay NULL and are not counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from countspark.functions.scans import PIECE, running_extreme, scan_pieces


def _ranked(df: DataFrame, p: str, by: Sequence[str], key: str) -> tuple[DataFrame, bool]:
    order = [F.col(p).asc_nulls_last(), F.col(key).asc()]
    return scan_pieces(df.withColumn("_tested", F.col(p).isNotNull().cast("bigint")), by, order, number="_rank", totals={"_m": "_tested"})


def _finish(df: DataFrame, p: str, out: str, rank: str | None = None) -> DataFrame:
    capped = F.when(F.col(p).isNotNull(), F.least(F.col(out), F.lit(1.0)))
    df = df.withColumn(out, capped)
    df = df.withColumnRenamed("_rank", rank) if rank else df.drop("_rank")
    return df.drop("_q", "_m", "_tested", PIECE)


def bh_adjust(df: DataFrame, p: str = "p_value", *, by: Sequence[str] = ("contrast",), key: str = "feature",
              out: str = "adj_p", rank: str | None = None) -> DataFrame:
    """Benjamini–Hochberg: the smallest ``p·n/rank`` at or above each rank, at most 1.

    Adjusted values never fall along the order of p, so the rank by (p, key) is also the rank by (adjusted p, p, key);
    ``rank`` names a column to keep it in.
    """
    ranked, single = _ranked(df, p, by, key)
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_m") / F.col("_rank"))
    backwards = [F.col(p).desc_nulls_first(), F.col(key).desc()]
    return _finish(running_extreme(ranked, by, backwards, "_q", out, how="min", backwards=True, single=single), p, out, rank)


def holm_adjust(df: DataFrame, p: str = "p_value", *, by: Sequence[str] = ("contrast",), key: str = "set_id",
                out: str = "adj_p") -> DataFrame:
    """Holm: the largest ``p·(n − rank + 1)`` at or below each rank, at most 1."""
    ranked, single = _ranked(df, p, by, key)
    ranked = ranked.withColumn("_q", F.col(p) * (F.col("_m") - F.col("_rank") + 1))
    forwards = [F.col(p).asc_nulls_last(), F.col(key).asc()]
    return _finish(running_extreme(ranked, by, forwards, "_q", out, how="max", backwards=False, single=single), p, out)


def holm_filter(df: DataFrame, p: str = "p_value", *, by: Sequence[str] = ("contrast",), key: str = "set_id",
                alpha: float = 0.05) -> DataFrame:
    """Rows whose Holm-adjusted p-value is at most ``alpha``."""
    return holm_adjust(df, p, by=by, key=key).where(F.col("adj_p") <= alpha)
