"""From sample rows to training and test points of one dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkplume.functions import scalars as S
from sparkplume.operators import prepare as P
from sparkplume.operators.spatial import clip_points, train_test_split
from sparkplume.session import materialize
from sparkplume.sources.tables import file_position


def dataset_points(samples: DataFrame, systems: DataFrame, contaminant: str, water_type: str) -> DataFrame:
    """``system_id, x, y, z``: mean value of every located system of one dataset.

    The filter reaches the scan; only the columns of the mean are read. Samples shrink to one row per
    system before they meet the locations.
    """
    rows = P.filter_samples(samples, [contaminant], [water_type])
    means = (
        P.impute_nondetect(rows)
        .where(F.col("system_id").isNotNull())
        .groupBy("system_id")
        .agg(F.avg("value").alias("z"))
    )
    return systems.join(means, "system_id").select("system_id", "x", "y", "z")


def prepared_points(
    samples: DataFrame,
    systems: DataFrame,
    edges: DataFrame,
    seasonal: bool = False,
    percent: int = 90,
    seed: int = 42,
    band: float = 25000.0,
) -> DataFrame:
    """Located per-system statistics of all datasets, clipped and split, in one pass.

    The four datasets (eight by season) differ only in ``dataset``: ``PFOA_GW`` or ``PFOA_GW_sum``.
    Columns: ``dataset, system_id, x, y``, the statistics, and ``is_train``.
    """
    rows = P.impute_nondetect(P.filter_samples(samples))
    by = [*P.DATASET, "system_id"]
    if seasonal:
        rows, by = P.with_season(rows), [*P.DATASET, "season", "system_id"]
    stats = P.system_stats(rows, by)
    stats = stats.withColumn("dataset", F.concat_ws("_", *by[:-1])).drop(*by[:-1])
    # A system has one location but a row per dataset: it is clipped once.
    inside = clip_points(systems.select("system_id", "x", "y"), edges, band)
    located = materialize(inside.join(stats, "system_id"), "located")
    return train_test_split(located, percent, seed, by=["dataset"])


def samples_from_file(raw: DataFrame, order: str | None = None) -> DataFrame:
    """The columns of a sample file under the names the operators use, with the date parsed.

    ``order`` names a column that numbers the rows. Without one, ``raw`` must come straight from a file and rows go by their
    place in it (``file_position``), which decides which row of a system is its first.
    """
    position = F.col(order) if order else file_position()
    return raw.select(
        position.alias("row_id"),
        F.col("PWSID").alias("system_id"),
        F.col("PWSName").alias("system_name"),
        F.col("Size").alias("size"),
        F.col("FacilityWaterType").alias("water_type"),
        F.col("Contaminant").alias("contaminant"),
        F.col("MRL").alias("mrl"),
        F.col("Units").alias("units"),
        F.col("Region").alias("region"),
        F.col("State").alias("state"),
        F.col("AnalyticalResultValue").alias("value"),
        S.parse_date(F.col("CollectionDate")).alias("collection_date"),
    )
