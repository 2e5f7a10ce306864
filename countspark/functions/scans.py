"""Ranks, running sums and exact quantiles of groups that may be too large for one task.

A window over ``sample`` or ``contrast`` would sort a whole group in one task. Here rows are range-partitioned by
(group, order), so a large group is spread over many tasks; the window runs inside each (group, partition) piece, and one
small row per piece carries the totals of the pieces before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from countspark.session import keep_measured, small

PIECE = "_piece"


def spread(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, bool]:
    """Rows in range partitions of (by, order), written once, with the partition number as ``_piece``.

    The flag says whether all rows fitted into one partition (adaptive execution merges small ones); then plain windows do.
    """
    keys = [F.col(c) for c in by]
    ranged = df.repartitionByRange(*keys, *order).withColumn(PIECE, F.spark_partition_id())
    rows, seen = keep_measured(ranged, low=F.min(PIECE), high=F.max(PIECE))
    return rows, seen["low"] == seen["high"]


def _join(df: DataFrame, carry: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on (by, piece) that also matches NULL group keys."""
    on = [PIECE, *by]
    right = carry.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in carry.columns if c not in on])
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return df.join(right, cond, how).drop(*[f"_r_{c}" for c in on])


def scan(df: DataFrame, by: Sequence[str], order: Sequence[Column], *, number: str | None = None,
         sums: dict[str, str] | None = None, totals: dict[str, str] | None = None, size: str | None = None) -> DataFrame:
    """Add a row number, inclusive running sums, group totals and the group size.

    ``order`` must end in a unique key. ``sums`` and ``totals`` map new column names to existing numeric columns.
    """
    return scan_pieces(df, by, order, number=number, sums=sums, totals=totals, size=size)[0].drop(PIECE)


def scan_pieces(df: DataFrame, by: Sequence[str], order: Sequence[Column], *, number: str | None = None,
                sums: dict[str, str] | None = None, totals: dict[str, str] | None = None, size: str | None = None) -> tuple[DataFrame, bool]:
    """``scan`` that leaves ``_piece`` in the rows and says whether there is only one piece."""
    sums, totals = sums or {}, totals or {}
    rows, single = spread(df, by, order)
    whole = W.partitionBy(*by)
    if single:
        upto = whole.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        cols = {name: F.sum(src).over(upto) for name, src in sums.items()}
        cols |= {name: F.sum(src).over(whole) for name, src in totals.items()}
        if number:
            cols[number] = F.row_number().over(whole.orderBy(*order)).cast("bigint")
        if size:
            cols[size] = F.count(F.lit(1)).over(whole)
        return rows.withColumns(cols), True
    measures = [F.count(F.lit(1)).alias("_n")]
    measures += [F.sum(src).alias(f"_s_{out}") for out, src in sums.items()]
    measures += [F.sum(src).alias(f"_t_{out}") for out, src in totals.items()]
    pieces = rows.groupBy(*by, PIECE).agg(*measures)
    before = whole.orderBy(PIECE).rowsBetween(W.unboundedPreceding, -1)
    carry = pieces.select(
        *by, PIECE,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_size"),
        *[F.coalesce(F.sum(f"_s_{out}").over(before), F.lit(0)).alias(f"_b_{out}") for out in sums],
        *[F.sum(f"_t_{out}").over(whole).alias(f"_w_{out}") for out in totals])
    local = W.partitionBy(*by, PIECE).orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    cols = {name: F.sum(src).over(upto) + F.col(f"_b_{name}") for name, src in sums.items()}
    cols |= {name: F.col(f"_w_{name}") for name in totals}
    if number:
        cols[number] = F.row_number().over(local) + F.col("_before")
    if size:
        cols[size] = F.col("_size")
    helpers = ["_before", "_size", *[f"_b_{o}" for o in sums], *[f"_w_{o}" for o in totals]]
    return _join(rows, small(carry), by).withColumns(cols).drop(*helpers), False


def running_extreme(rows: DataFrame, by: Sequence[str], order: Sequence[Column], col: str, out: str, *,
                    how: str, backwards: bool, single: bool) -> DataFrame:
    """Running ``min`` or ``max`` of ``col`` over rows that carry ``_piece``; ``backwards`` runs from the last row to the first.

    ``order`` is the order in the direction of the run.
    """
    agg = F.min if how == "min" else F.max
    if single:
        return rows.withColumn(out, agg(col).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    best = F.least if how == "min" else F.greatest
    step = F.col(PIECE).desc() if backwards else F.col(PIECE).asc()
    before = W.partitionBy(*by).orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    pieces = rows.groupBy(*by, PIECE).agg(agg(col).alias("_e"))
    carry = pieces.select(*by, PIECE, agg("_e").over(before).alias("_e"))
    upto = W.partitionBy(*by, PIECE).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = _join(rows, small(carry), by)
    return joined.withColumn(out, best(agg(col).over(upto), F.col("_e"))).drop("_e")


def value_counts(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values per group with their number of occurrences; combined on the map side before the shuffle."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.cast("bigint").alias("_times"))


def average_ranks(df: DataFrame, by: Sequence[str], value: str, out: str, *, size: str | None = None) -> DataFrame:
    """Rank of ``value`` within its group, ties averaged; ``size`` names a column for the number of ranked rows of the group."""
    return df.join(small(rank_table(df, by, value, out, size=size).drop("_times")), [*by, value], "left")


def rank_table(df: DataFrame, by: Sequence[str], value: str, out: str, *, extra: DataFrame | None = None, size: str | None = None) -> DataFrame:
    """Average rank of every distinct (group, value), plus ``_times``. ``extra(by…, value, _times)`` adds values without a row (zeros)."""
    counts = value_counts(df, by, value)
    if extra is not None:
        counts = (counts.unionByName(extra.select(*by, F.col(value), F.col("_times").cast("bigint")))
                  .groupBy(*by, value).agg(F.sum("_times").alias("_times")).where("_times > 0"))
    ranked = scan(counts, by, [F.col(value).asc()], sums={"_upto": "_times"}, totals={size: "_times"} if size else None)
    return ranked.select(*by, value, (F.col("_upto") - (F.col("_times") - 1) / 2).alias(out), "_times", *([size] if size else []))


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float | Column], *, weight: str | None = None,
              at: DataFrame | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation between order statistics) per group: one column per entry of ``probs``.

    A probability may be a column of ``at``, a small table with one row per group.
    """
    ranked = scan(value_counts(df, by, value, weight).where("_times > 0"), by, [F.col(value).asc()],
                  sums={"_upto": "_times"}, totals={"_all": "_times"})
    if at is not None:
        ranked = ranked.join(small(at), list(by))
    places = F.array(*[((F.col("_all") - 1) * (p if isinstance(p, Column) else F.lit(float(p)))) for p in probs.values()])
    holds = lambda index: (F.col("_upto") - F.col("_times") <= index) & (index < F.col("_upto"))
    wanted = F.transform(places, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    hits = F.filter(wanted, lambda s: holds(F.floor(s["x"])) | holds(F.ceil(s["x"])))
    found = ranked.select(*by, F.col(value).cast("double").alias("_v"), "_upto", "_times", F.explode(hits).alias("s"))
    ends = found.groupBy(*by, F.col("s.i").alias("_i")).agg(
        F.max(F.when(holds(F.floor("s.x")), F.col("_v"))).alias("_lo"), F.max(F.when(holds(F.ceil("s.x")), F.col("_v"))).alias("_hi"),
        F.max("s.x").alias("_x"))
    level = F.col("_lo") + (F.col("_x") - F.floor("_x")) * (F.col("_hi") - F.col("_lo"))
    return ends.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, level)).alias(name) for i, name in enumerate(probs)])
