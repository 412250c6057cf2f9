"""From raw sample rows to located per-system statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkplume.functions import scalars as S

CONTAMINANTS = ("PFOA", "PFOS")
WATER_TYPES = ("GW", "SW")
DATASET = ("contaminant", "water_type")
DESCRIPTIVE = ("system_name", "size", "mrl", "units", "region", "state")


def filter_samples(
    df: DataFrame,
    contaminants: Sequence[str] = CONTAMINANTS,
    water_types: Sequence[str] = WATER_TYPES,
) -> DataFrame:
    return df.where(F.col("contaminant").isin(*contaminants) & F.col("water_type").isin(*water_types))


def impute_nondetect(df: DataFrame, fill: float = S.NON_DETECT) -> DataFrame:
    return df.withColumn("value", S.impute(F.col("value"), fill))


def with_dataset(df: DataFrame) -> DataFrame:
    """All contaminant/water-type pairs stay in one DataFrame, told apart by this key."""
    return df.withColumn("dataset", F.concat_ws("_", *DATASET))


def with_season(df: DataFrame, date: str = "collection_date") -> DataFrame:
    """Rows outside both seasons leave; one pass serves all seasonal datasets."""
    return df.withColumn("season", S.season(F.col(date))).where(F.col("season").isNotNull())


def _nulls_last(order: str):
    """A key that orders by a column and still picks a row where it is NULL."""
    return F.struct(F.col(order).isNull(), F.col(order))


def first_per_key(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The whole row with the smallest ``order`` per key, NULL after all others. Partial aggregation makes hot keys cheap."""
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), _nulls_last(order)).alias("_row"))
        .select(*key, "_row.*")
        .select(*df.columns)
    )


def system_stats(
    df: DataFrame,
    by: Sequence[str] = (*DATASET, "system_id"),
    descriptive: Sequence[str] = DESCRIPTIVE,
    value: str = "value",
    date: str = "collection_date",
    order: str = "row_id",
) -> DataFrame:
    """Nine statistics per system and the descriptive columns of its first row.

    One aggregate in place of nine: partial results per (system, date) are combined before the
    second exchange, so a system with a third of all samples still arrives as one row per date and
    map task. Rows without a system id vanish, as in a join on the id.
    """
    v, d = F.col(value), F.col(date)
    return (
        df.where(F.col("system_id").isNotNull())
        .groupBy(*by)
        .agg(
            F.min_by(F.struct(*descriptive), _nulls_last(order)).alias("_first"),
            F.avg(v).alias("mean_value"),
            F.min(v).alias("min_value"),
            F.max(v).alias("max_value"),
            (F.max(v) - F.min(v)).alias("value_range"),
            F.stddev_samp(v).alias("std_dev"),
            F.count(v).alias("n_values"),
            F.count_distinct(d).alias("n_dates"),
            F.min(d).alias("first_date"),
            F.max(d).alias("last_date"),
        )
        .select(*by, "_first.*", "mean_value", "min_value", "max_value", "value_range", "std_dev",
                "n_values", "n_dates", "first_date", "last_date")
    )


def max_row_per_system(
    df: DataFrame,
    by: Sequence[str] = (*DATASET, "system_id"),
    value: str = "value",
    order: str = "row_id",
) -> DataFrame:
    """Row with the largest value per system; among equals the first one."""
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(F.col(value), -F.col(order)))
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(best.alias("_row")).select(*by, "_row.*").select(*df.columns)


def padded_zips(zips: DataFrame, zip_col: str = "zip") -> DataFrame:
    return zips.withColumn(zip_col, S.zfill(F.col(zip_col), 5))


def join_zips(samples: DataFrame, zips: DataFrame, on: str = "system_id") -> DataFrame:
    """Left join; a system that serves several ZIPs repeats its samples."""
    return samples.join(zips, on, "left")


def max_by_zip(
    df: DataFrame, contaminant: str, water_type: str, zip_col: str = "zip"
) -> DataFrame:
    """Largest value of every numeric column per ZIP; rows without a ZIP leave."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != zip_col]
    rows = df.where(
        (F.col("contaminant") == contaminant) & (F.col("water_type") == water_type) & F.col(zip_col).isNotNull()
    )
    return rows.groupBy(zip_col).agg(*[F.max(c).alias(c) for c in numeric])


def max_by_zip_of(
    samples: DataFrame, zips: DataFrame, contaminant: str, water_type: str, on: str = "system_id", zip_col: str = "zip"
) -> DataFrame:
    """``max_by_zip`` of the samples joined to their ZIPs, with the maxima per system taken before the join."""
    rows = samples.where((F.col("contaminant") == contaminant) & (F.col("water_type") == water_type))
    numeric = [f.name for f in samples.schema if isinstance(f.dataType, T.NumericType) and f.name != on]
    most = rows.groupBy(on).agg(*[F.max(c).alias(c) for c in numeric])
    served = zips.where(F.col(zip_col).isNotNull()).select(on, zip_col).distinct().join(most, on)
    order = [c for c in samples.columns if c == on or c in numeric]
    if not isinstance(samples.schema[on].dataType, T.NumericType):
        order.remove(on)
    return served.groupBy(zip_col).agg(*[F.max(c).alias(c) for c in order])


def count_per_zip(zips: DataFrame, zip_col: str = "zip") -> DataFrame:
    """Bridge rows per ZIP, repeats included."""
    return zips.groupBy(zip_col).agg(F.count(F.lit(1)).alias("n_rows"))


def systems_per_zip(zips: DataFrame, zip_col: str = "zip", key: str = "system_id") -> DataFrame:
    """The set of systems of each ZIP, one row per member.

    A set is kept as rows and not as one array: a ZIP that many systems serve has no single-task step.
    """
    return zips.select(zip_col, key).distinct()


def zip_set_sizes(zips: DataFrame, zip_col: str = "zip", key: str = "system_id") -> DataFrame:
    return systems_per_zip(zips, zip_col, key).groupBy(zip_col).agg(F.count(F.lit(1)).alias("n_systems"))


def key_overlap(a: DataFrame, b: DataFrame, key: str = "system_id") -> DataFrame:
    """Distinct keys of ``a`` that also occur in ``b``; both sides shrink before the join."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def unmatched_keys(a: DataFrame, b: DataFrame, key: str = "system_id") -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def unmatched_count(a: DataFrame, b: DataFrame, key: str = "system_id") -> DataFrame:
    return unmatched_keys(a, b, key).agg(F.count(F.lit(1)).alias("n_unmatched"))


def join_points(
    points: DataFrame,
    stats: DataFrame,
    points_name: str,
    stats_name: str,
    on: str = "system_id",
) -> DataFrame:
    """Keep systems found on both sides. Columns are qualified by table; the bare name is the alias."""
    left = points.select(
        *[F.col(c).alias(f"{points_name}_{c}", metadata={"alias": c}) for c in points.columns]
    )
    right = stats.select(
        *[F.col(c).alias(f"{stats_name}_{c}", metadata={"alias": c}) for c in stats.columns]
    )
    return left.join(right, F.col(f"{points_name}_{on}") == F.col(f"{stats_name}_{on}"), "inner")
