"""Writers. Errors are raised, never turned into warnings. Every write is distributed: one file per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from countspark.operators.reshape import spread_counts
from countspark.session import keep


def write_table(df: DataFrame, path: str, *, fmt: str = "tab.gz") -> None:
    """Write as ``tab`` (tab-separated text), ``tab.gz`` (the same, gzipped) or ``parquet``."""
    if fmt == "parquet":
        df.write.mode("errorifexists").parquet(path)
    elif fmt in ("tab", "tab.gz"):
        compression = "gzip" if fmt == "tab.gz" else "none"
        df.write.mode("errorifexists").csv(path, sep="\t", header=True, compression=compression, nullValue="NA")
    else:
        raise ValueError(f"unknown format {fmt!r}")


def wide_matrix(df: DataFrame, value: str, samples: Sequence, *, fill: float | int | None = 0) -> DataFrame:
    """Features × samples, absent cells as ``fill`` (None leaves them empty)."""
    return spread_counts(df, value, samples, fill=fill)


def write_wide_matrix(df: DataFrame, path: str, value: str, *, samples: Sequence, fmt: str = "tab.gz", fill: float | int | None = 0) -> None:
    """One table, or, with more samples than ``spark.sql.pivotMaxValues``, a table per block of that many samples below ``path``."""
    width = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    if len(samples) <= width:
        write_table(wide_matrix(df, value, samples, fill=fill), path, fmt=fmt)
        return
    features = keep(df.select("feature").distinct())
    for no, at in enumerate(range(0, len(samples), width)):
        block = list(samples[at:at + width])
        wide = wide_matrix(df.where(F.col("sample").isin(block)), value, block, fill=None)
        whole = features.join(wide, "feature", "left")
        write_table(whole if fill is None else whole.na.fill(fill), f"{path}/block_{no:05d}", fmt=fmt)


def write_de_report(de: DataFrame, norm: DataFrame, path: str, *, fmt: str = "tab.gz") -> None:
    """The result table and the normalised counts it was computed from, below one folder."""
    write_table(de, f"{path}/de", fmt=fmt)
    write_table(norm, f"{path}/normalised", fmt=fmt)


def write_comparison_report(tables: dict[str, DataFrame], comparison: tuple[DataFrame, DataFrame, DataFrame], path: str, *,
                            fmt: str = "tab.gz") -> None:
    """Result table of each method plus the three summaries of ``compare_des``."""
    for method, de in tables.items():
        write_table(de, f"{path}/{method}/de", fmt=fmt)
    for name, df in zip(("calls", "by_method", "by_consistency"), comparison):
        write_table(df, f"{path}/{name}", fmt=fmt)


def gsea_matrix(norm: DataFrame, value: str, de: DataFrame, mapping: DataFrame, *, samples: Sequence, max_adj: float = 0.05,
                min_abs_lfc: float = 1.0, digits: int = 2) -> DataFrame:
    """Rounded normalised values of the significant features under upper-case symbols; features without a symbol are dropped, absent cells are 0."""
    hits = de.where((F.col("adj_p") < max_adj) & (F.abs("avg_log2fc") > min_abs_lfc)).select("feature").distinct()
    symbols = mapping.where(F.col("symbol").isNotNull()).select("feature", F.upper("symbol").alias("symbol"))
    picked = norm.join(hits, "feature", "left_semi").join(symbols, "feature")
    rounded = picked.withColumn(value, F.round(value, digits))
    return rounded.groupBy("feature", "symbol").pivot("sample", list(samples)).agg(F.first(value)).na.fill(0)


def gsea_export(norm: DataFrame, value: str, de: DataFrame, mapping: DataFrame, path: str, *, samples: Sequence, digits: int = 2) -> None:
    write_table(gsea_matrix(norm, value, de, mapping, samples=samples, digits=digits), path, fmt="tab")
