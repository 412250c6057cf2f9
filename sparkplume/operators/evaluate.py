"""Scores of predictions, ranks of runs, classes and confusion matrices. All runs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkplume.functions import scalars as S
from sparkplume.operators.ordering import ROWS_PER_RANGE, running_total
from sparkplume.session import materialize


def pair_obs_pred(observed: DataFrame, predicted: DataFrame, key: str = "system_id", value: str = "z") -> DataFrame:
    """``run_id, key, observed, predicted``; rows with a NULL on either side leave."""
    obs = observed.select(key, F.col(value).alias("observed")).na.drop("any")
    pred = predicted.select("run_id", key, F.col("prediction").alias("predicted")).na.drop("any")
    return obs.join(pred, key).select("run_id", key, "observed", "predicted")


def error_metrics(pairs: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    e = F.col("observed") - F.col("predicted")
    return (
        pairs.where(F.col("predicted").isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
        )
    )


def score_runs(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs with their metrics; a run that produced nothing keeps its row and says so."""
    return runs.join(metrics, "run_id", "left").withColumn(
        "status", F.when(F.col("rmse").isNull(), "failed").otherwise("ok")
    )


def rank_runs(
    runs: DataFrame,
    by: Sequence[str] = ("method", "dataset"),
    name: str = "run_id",
    digits: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Ordinal ranks by RMSE and by MAE (no shared ranks, failed runs last) and their average.

    Equal scores go by name. With ``digits``, scores that agree in so many digits count as equal: two settings that
    pick the same neighbours are then not ordered by the order of a summation.
    """

    def key(score: str):
        return F.col(score) if digits is None else F.format_string(f"%.{digits - 1}e", F.col(score)).cast("double")

    ranked = materialize(runs, "runs")
    rows = ranked.count()  # a row stays a row in both rankings
    ranked = ranked.withColumns({f"_{c}": F.when(F.col(c).isNotNull(), key(c)) for c in ("rmse", "mae")})
    for order, rank in (("_rmse", "rmse_rank"), ("_mae", "mae_rank")):
        ranked = running_total(ranked, [order, name], by, name=rank, rows_per_range=rows_per_range, rows=rows)
    return ranked.withColumn("ave_rank", (F.col("rmse_rank") + F.col("mae_rank")) / 2).drop("_rmse", "_mae")


def top_runs(
    ranked: DataFrame, n: int, by: Sequence[str] = ("method", "dataset"), name: str = "run_id"
) -> DataFrame:
    """The n best runs per group by average rank. The limit applies before the exchange as well."""
    w = Window.partitionBy(*by).orderBy("ave_rank", name)
    return ranked.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= n).drop("_p")


def best_run(ranked: DataFrame, by: Sequence[str] = ("method", "dataset"), name: str = "run_id") -> DataFrame:
    return top_runs(ranked, 1, by, name)


def row_slice(
    df: DataFrame, start: int, stop: int, order: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Rows ``start..stop-1`` counted from 0. The "top 5" of the report is ``row_slice(df, 1, 5)``."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    # the upper bound comes first: it limits rows before they are exchanged
    return (
        df.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= stop).where(F.col("_p") > start).drop("_p")
    )


def classified(pairs: DataFrame, limits: Sequence[float]) -> DataFrame:
    return pairs.withColumn("obs_class", S.classify(F.col("observed"), limits)).withColumn(
        "pred_class", S.classify(F.col("predicted"), limits)
    )


def confusion(pairs: DataFrame, n_classes: int, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """``obs_class, pred_class, n`` per run with every combination of classes present."""
    k = n_classes
    counts = pairs.groupBy(*by).agg(
        *[
            F.count(F.when((F.col("obs_class") == o) & (F.col("pred_class") == p), 1)).alias(f"c{o}{p}")
            for o in range(k)
            for p in range(k)
        ]
    )
    cells = F.array(
        *[
            F.struct(F.lit(o).alias("obs_class"), F.lit(p).alias("pred_class"), F.col(f"c{o}{p}").alias("n"))
            for o in range(k)
            for p in range(k)
        ]
    )
    return counts.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.*")


def accuracy_recall(cm: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Accuracy, and recall of the contaminated classes by exact class; NULL when nothing was observed."""
    n, same, high = F.col("n"), F.col("obs_class") == F.col("pred_class"), F.col("obs_class") > 0
    return cm.groupBy(*by).agg(
        F.try_divide(F.sum(F.when(same, n).otherwise(0)), F.sum(n)).alias("accuracy"),
        F.try_divide(F.sum(F.when(same & high, n).otherwise(0)), F.sum(F.when(high, n).otherwise(0))).alias("recall"),
    )


def mean_performance(scores: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Means over runs; undefined scores do not count."""
    return scores.groupBy(*by).agg(
        F.avg("accuracy").alias("mean_accuracy"), F.avg("recall").alias("mean_recall")
    )
