"""Sweep, evaluation and replay: parameter rows in, rasters and ranked runs out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkplume.functions import scalars as S
from sparkplume.operators import evaluate as E
from sparkplume.operators.idw import idw_sweep, raster_rows
from sparkplume.operators.kriging import krige_sweep
from sparkplume.operators.natural import natural_neighbor
from sparkplume.operators.spatial import BUFFER, Grid, extract_at_points, make_grid, with_cell, zonal_mean, zone_cells
from sparkplume.operators.variogram import fit_semivariogram, semivariogram
from sparkplume.plans.runs import (
    UNIVERSAL_MODELS,
    invalid_runs,
    param_grid,
    run_rows,
    single,
    skip_long_lags,
    with_run_id,
)
from sparkplume.session import materialize


RASTER = "run_id string, cell_id long, row long, col long, value double, variance double, status string"


def sweep_runs(spark, method: str) -> DataFrame:
    """All runs of a method's sweep with ids: IDW 84, OK 420, UK 200, NN 1."""
    return with_run_id(skip_long_lags(param_grid(single(spark), method)))


def fit_for_runs(points: DataFrame, runs: DataFrame, grid: Grid, by: str | None = None) -> DataFrame:
    """Kriging runs with ``a, nugget, sill``. The default lag is the cell size; drift models use the linear shape.

    With ``by``, a column of whole numbers in both, a run has the model fitted to the points of its own group.
    """
    group = [] if by is None else [by]
    lags = [r[0] for r in runs.select(F.coalesce("lag_dist", F.lit(grid.cell)).alias("lag")).distinct().collect()]
    fits = fit_semivariogram(semivariogram(points, lags, by=by), by=by)
    shape = F.when(F.col("model").isin(*UNIVERSAL_MODELS), "Linear").otherwise(F.col("model"))
    keyed = runs.withColumn("_lag", F.coalesce("lag_dist", F.lit(grid.cell))).withColumn("_shape", shape)
    fits = fits.select(
        *group, F.col("lag").alias("_lag"), F.col("model").alias("_shape"), "a", "nugget", "sill"
    )
    return keyed.join(fits, [*group, "_lag", "_shape"], "left").drop("_lag", "_shape")


def sweep(
    points: DataFrame, grid: Grid, runs: DataFrame, cells: DataFrame | None = None
) -> DataFrame:
    """Rasters of all runs of one method: ``run_id, cell_id, row, col, value, variance, status``.

    Runs are checked before any work starts. A run whose model cannot be fitted appears with NULL
    values and a status instead of stopping the others.
    """
    bad = sorted(str(r["run_id"]) for r in invalid_runs(runs).select("run_id").collect())
    if bad:
        raise ValueError(f"{len(bad)} rows that describe no run: {', '.join(bad)}")
    methods = [r[0] for r in runs.select("method").distinct().collect()]
    parts = []
    for method in methods:  # at most four
        mine = runs.where(F.col("method") == method)
        if method == "IDW":
            out = idw_sweep(points, grid, run_rows(mine), cells)
            parts.append(full_raster(out))
        elif method == "NN":
            rows = natural_neighbor(points, grid, cells=cells).withColumn(
                "run_id", F.explode(F.array(*[F.lit(r["run_id"]) for r in run_rows(mine)]))
            )
            parts.append(full_raster(rows.select("run_id", "cell_id", "row", "col", "value")))
        else:
            fitted = run_rows(fit_for_runs(points, mine, grid))
            ready = [r for r in fitted if r["a"] is not None]
            if ready:
                parts.append(full_raster(raster_rows(krige_sweep(points, grid, ready, cells), grid)))
            lost = [r["run_id"] for r in fitted if r["a"] is None]
            if lost:
                empty = cells if cells is not None else make_grid(points.sparkSession, grid)
                empty = empty.withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in lost])))
                empty = empty.withColumns({"value": F.lit(None).cast("double"), "status": F.lit("model not fitted")})
                parts.append(full_raster(empty))
    return reduce(DataFrame.unionByName, parts, points.sparkSession.createDataFrame([], RASTER))


def full_raster(raster: DataFrame, *keep: str) -> DataFrame:
    """The columns of ``RASTER``, with what a method does not have as NULL, after the columns to ``keep``."""
    if "variance" not in raster.columns:
        raster = raster.withColumn("variance", F.lit(None).cast("double"))
    if "status" not in raster.columns:
        raster = raster.withColumn("status", F.when(F.col("value").isNull(), "no data").otherwise("ok"))
    return raster.select(*keep, "run_id", "cell_id", "row", "col", "value", "variance", "status")


def evaluation_cells(test: DataFrame, grid: Grid, buffer: float | None) -> DataFrame:
    """The cells an evaluation reads. A sweep that only needs scores can skip all others."""
    if buffer is None:
        ids = with_cell(test, grid).select("cell_id").distinct()
    else:
        ids = zone_cells(test, buffer, grid).select("cell_id").distinct()
    return make_grid(test.sparkSession, grid).join(ids, "cell_id", "left_semi")


def evaluate(raster: DataFrame, test: DataFrame, grid: Grid, buffer: float | None = BUFFER) -> DataFrame:
    """Observed and predicted value per run and test point: buffer mean, or the containing cell."""
    if buffer is None:
        predicted = extract_at_points(raster, test.select("system_id", "x", "y"), grid)
    else:
        predicted = zonal_mean(raster, zone_cells(test, buffer, grid))
    return E.pair_obs_pred(test, predicted)


def sweep_and_rank(
    train: DataFrame, test: DataFrame, grid: Grid, runs: DataFrame, buffer: float | None = BUFFER, digits: int = 12
) -> DataFrame:
    """Ranked runs with RMSE and MAE at the test points; scores that agree in ``digits`` digits count as equal."""
    cells = materialize(evaluation_cells(test, grid, buffer), "cells")
    metrics = E.error_metrics(evaluate(sweep(train, grid, runs, cells), test, grid, buffer))
    return E.rank_runs(E.score_runs(runs, metrics), by=["method"], digits=digits)


def replay(
    ranked: DataFrame, n: int, train: DataFrame, test: DataFrame, grid: Grid, buffer: float | None = BUFFER
) -> DataFrame:
    """Run the n best settings of one dataset on another and rank them there."""
    top = E.top_runs(ranked, n, by=["method"])
    settings = top.drop("rmse", "mae", "n", "status", "rmse_rank", "mae_rank", "ave_rank")
    settings = materialize(skip_long_lags(settings, replay=True), "settings")
    return sweep_and_rank(train, test, grid, settings, buffer)


def class_scores(pairs: DataFrame, limits=S.TWO_CLASS_LIMITS) -> DataFrame:
    """Accuracy and recall per run from observed and predicted values."""
    return E.accuracy_recall(E.confusion(E.classified(pairs, limits), len(limits) + 1))
