"""Ranks, running totals and exact quantiles without a window over all rows of a group.

A window is one task per group, which fails when a group holds a third of the data. Here rows are dealt
into ranges of consecutive keys, as many as the row count asks for, and written. Totals are formed inside
the ranges, and the totals of the ranges are added up as offsets. Every size takes this one way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkplume.session import materialize

ROWS_PER_RANGE = 250_000


def running_total(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    weight: str | None = None,
    name: str = "running",
    rows_per_range: int = ROWS_PER_RANGE,
    rows: int | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` (default 1) over rows up to and including this one within ``by``.

    Ascending, NULLs last; rows that agree in all of ``order`` come in any order. NULL is a group of its own.
    ``rows_per_range`` sets the size of a task and nothing else. ``rows``: the number of rows where it is known, which
    spares writing ``df`` to count it.
    """
    w = F.col(weight) if weight else F.lit(1).cast("long")
    if rows is None:
        df = materialize(df, "ordered")
        rows = df.count()
    ranges = max(1, -(-rows // rows_per_range))
    sort = [F.col(c).asc_nulls_last() for c in order]
    dealt = df.repartitionByRange(ranges, *[F.col(c).asc_nulls_last() for c in by], *sort)
    dealt = materialize(dealt.withColumn("_range", F.spark_partition_id()), "ranges")

    inside = Window.partitionBy(*by, "_range").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*by, "_range")
        .agg(F.sum(w).alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(ahead), F.lit(0)))
        .select("_range", "_offset", *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)])
    )
    same = [F.col("_range") == F.col("_own")] + [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
    return (
        dealt.withColumn(name, F.sum(w).over(inside))
        .join(offsets.withColumnRenamed("_range", "_own"), same)
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_range", "_own", "_offset", *[f"_by{k}" for k in range(len(by))])
    )


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Repeats collapse first, so a hot value is one row from here on."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Exact quantiles per group with linear interpolation between neighbours."""
    counted = running_total(value_counts(df, by, value), [value], by, "n", "upto", rows_per_range)
    totals = counted.groupBy(*by).agg(F.sum("n").alias("n_values"))
    rows = counted.join(totals, list(by))
    v = F.col(value)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("n_values") - 1) * F.lit(p)
        for side, index in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("upto") - F.col("n") <= index) & (index < F.col("upto"))
            aggs.append(F.max(F.when(inside, v)).alias(f"{name}_{side}"))
    out = rows.groupBy(*by).agg(F.max("n_values").alias("n_values"), *aggs)
    return out.select(
        *by,
        "n_values",
        *[
            (
                F.col(f"{n}_lo")
                + (F.col(f"{n}_hi") - F.col(f"{n}_lo"))
                * ((F.col("n_values") - 1) * F.lit(p) - F.floor((F.col("n_values") - 1) * F.lit(p)))
            ).alias(n)
            for n, p in probs.items()
        ],
    )
