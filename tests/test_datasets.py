"""Several datasets in one job give what each gives alone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkplume.operators import evaluate as E
from sparkplume.operators.idw import idw_sweep
from sparkplume.operators.natural import natural_neighbor
from sparkplume.operators.neighbors import knn
from sparkplume.operators.prepare import first_per_key, system_stats
from sparkplume.operators.spatial import Grid, convex_hull, make_grid
from sparkplume.operators.variogram import fit_semivariogram, semivariogram
from sparkplume.plans import datasets as D
from sparkplume.plans import sweep as W
from sparkplume.plans.runs import run_rows

GRID = Grid(0.0, 0.0, 8046.7, 20, 20)


def points(spark, seed=3):
    r = random.Random(seed)
    rows = [("A", k, r.uniform(0, 160000), r.uniform(0, 160000), r.random()) for k in range(120)]
    rows += [("B", k, *r.choice([(5000.0, 5000.0), (90000.0, r.uniform(0, 1000))]), r.random()) for k in range(300)]  # crowded
    rows += [("C", 1, 1000.0, 1000.0, 0.5), (None, 2, 1.0, 1.0, 1.0), ("A", 500, None, 1.0, 1.0), ("B", 501, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "dataset string, system_id long, x double, y double, z double")


def test_knn_of_groups(spark):
    df = points(spark)
    targets = [(1000 * g + k, 9000.0 * k, 4000.0 * k, name) for g, name in enumerate("ABCD") for k in range(15)] + [(-9, None, 1.0, "A"), (-8, 1.0, 1.0, None)]
    frame = spark.createDataFrame(targets, "target_id long, tx double, ty double, dataset string")
    got = {r.target_id: [(n.d, n.id) for n in r.neighbors] for r in knn(frame, df, 7, leaf=8, by="dataset").collect()}
    assert len(got) == len(targets)
    for name in "ABC":
        own = frame.where(F.col("dataset") == name)
        for r in knn(own, df.where(F.col("dataset") == name), 7, leaf=8).collect():
            assert got[r.target_id] == [(n.d, n.id) for n in r.neighbors]
    assert got[-9] == got[-8] == [] and all(got[3000 + k] == [] for k in range(15))


@pytest.mark.parametrize("buffer", [None, 12000.0])
def test_sweep_of_datasets_equals_each_alone(spark, buffer):
    df = points(spark)
    train, test = df.where("system_id % 5 <> 0"), df.where("system_id % 5 = 0 OR dataset = 'C'")
    runs = W.sweep_runs(spark, "IDW").where("power IN (0.5, 2)").cache()
    pairs = D.sweep_pairs(train, test, GRID, runs, buffer).cache()
    ranked = D.rank_datasets(pairs, runs, test.where("dataset IS NOT NULL"))
    got = {(r.dataset, r.run_id): r for r in ranked.collect()}
    assert len(got) == 3 * runs.count()
    for name in "AB":
        mine = lambda d: d.where(F.col("dataset") == name).drop("dataset")
        for r in W.sweep_and_rank(mine(train), mine(test), GRID, runs, buffer).collect():
            own = got[name, r.run_id]
            assert (own.n, own.rmse_rank, own.mae_rank) == (r.n, r.rmse_rank, r.mae_rank)
            assert own.rmse == pytest.approx(r.rmse, rel=1e-12) and own.mae == pytest.approx(r.mae, rel=1e-12)
    scores = D.top_class_scores(pairs, ranked, 3, (0.5,)).collect()
    assert sorted(r.dataset for r in scores) == ["A"] * 3 + ["B"] * 3 + ["C"] * 3 and all(0 <= r.accuracy <= 1 for r in scores)


def test_dataset_without_training_points_fails_and_stays(spark):
    df = points(spark)
    runs = W.sweep_runs(spark, "IDW").where("type = 'fixed' AND power = 2")
    train, test = df.where("dataset = 'A' AND system_id < 100"), df.where("dataset = 'B' OR system_id >= 100")
    ranked = D.rank_datasets(D.sweep_pairs(train, test, GRID, runs, None), runs, test.where("dataset IS NOT NULL"))
    assert {(r.dataset, r.status) for r in ranked.collect()} == {("A", "ok"), ("B", "failed")}
    assert E.best_run(ranked).count() == 2


def test_groups_of_rasters(spark):
    df = points(spark).where("dataset IN ('A', 'B')").withColumn("part", F.when(F.col("dataset") == "A", 0).otherwise(1).cast("long"))
    runs = run_rows(W.sweep_runs(spark, "IDW").where("power = 2"))
    cells = make_grid(spark, GRID)
    both = cells.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")))
    got = {(r.part, r.run_id, r.cell_id): r for r in idw_sweep(df, GRID, runs, both, "part").collect()}
    assert len(got) == 2 * len(runs) * GRID.size
    for part in (0, 1):
        for r in idw_sweep(df.where(F.col("part") == part), GRID, runs, cells).where("cell_id % 37 = 0").collect():
            own = got[part, r.run_id, r.cell_id]
            assert (own.row, own.col) == (r.row, r.col) and own.value == pytest.approx(r.value, rel=1e-12)


def test_place_without_value_bounds_no_hull(spark):
    sites = [(1, 20000.0, 20000.0, 1.0), (2, 20000.0, 44000.0, 2.0), (3, 44000.0, 20000.0, 3.0), (4, 44000.0, 44000.0, 4.0)]
    schema = "system_id long, x double, y double, z double"
    alone = natural_neighbor(spark.createDataFrame(sites, schema), GRID).collect()
    more = [(5, 150000.0, 150000.0, None), (6, 1.0, 150000.0, float("nan"))]
    assert sorted(natural_neighbor(spark.createDataFrame(sites + more, schema), GRID).collect()) == sorted(alone)
    assert 0 < sum(r.value is not None for r in alone) < GRID.size


def test_hull_leaves_out_rows_that_are_no_place(spark):
    rows = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (1.0, 1.0), (float("nan"), 2.0), (2.0, float("nan")), (None, 9.0)]
    hull = convex_hull(spark.createDataFrame(rows, "x double, y double")).collect()
    assert sorted((r.x, r.y) for r in hull) == [(0.0, 0.0), (0.0, 4.0), (4.0, 0.0)]


def test_first_row_without_an_order(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", None, 2), ("b", 7, 3), ("b", 3, 4)], "k string, o int, v int")
    assert sorted(map(tuple, first_per_key(df, ["k"], "o").collect())) == [("a", None, 1), ("b", 3, 4)]
    stats = df.selectExpr("k AS system_id", "o AS row_id", "v AS state", "double(v) AS value", "current_date() AS collection_date")
    got = {r.system_id: r.state for r in system_stats(stats, ["system_id"], ["state"]).collect()}
    assert got == {"a": 1, "b": 4}


@pytest.mark.parametrize("leaf", [2, 500])
def test_semivariograms_of_groups(spark, leaf):
    """Each group has the bins and fits that it has alone; single points, and rows without a group, have none."""
    df = points(spark).withColumn("part", F.expr("cast(array_position(array('A', 'B', 'C'), dataset) AS long)"))
    lags = [8000.0, 20000.0]
    bins = semivariogram(df, lags, leaf=leaf, by="part").cache()
    fits = {(r.part, r.lag, r.model): r for r in fit_semivariogram(bins, by="part").collect()}
    got = {(r.part, r.lag, r.bin): r for r in bins.collect()}
    assert {part for part, *_ in got} == {1, 2}
    alone = 0
    for part in (1, 2):
        own = semivariogram(df.where(F.col("part") == part), lags, leaf=leaf).cache()
        for r in own.collect():
            alone += 1
            mine = got[part, r.lag, r.bin]
            assert (mine.n_pairs, mine.h) == (r.n_pairs, r.h) and mine.gamma == pytest.approx(r.gamma, rel=1e-9)
        for r in fit_semivariogram(own).collect():
            mine = fits[part, r.lag, r.model]
            assert mine.a == r.a and (mine.nugget, mine.sill) == pytest.approx((r.nugget, r.sill), rel=1e-6, abs=1e-9)
    assert alone == len(got) and len(fits) == 20
    assert semivariogram(df.where("false"), lags, by="part").count() == 0


@pytest.mark.parametrize("method", ["OK", "UK"])
def test_kriging_of_datasets_equals_each_alone(spark, method):
    """Values, variances and status by cell, fixed and variable; a dataset of one place cannot be fitted and says so."""
    df = points(spark)
    some = "num_points = 12 OR (distance = 40250 AND f_pts = 6)"
    runs = W.sweep_runs(spark, method).where(f"({some}) AND coalesce(lag_dist, 0) IN (0, 16000)").cache()
    held = make_grid(spark, GRID).where("cell_id % 41 = 0")
    cells = held.withColumn("dataset", F.explode(F.array(*map(F.lit, "ABC")))).select("dataset", "cell_id")
    got = {(r.dataset, r.run_id, r.cell_id): r for r in D.sweep_datasets(df, GRID, runs, cells).collect()}
    assert len(got) == 3 * runs.count() * held.count()
    assert {r.status for k, r in got.items() if k[0] == "C"} == {"model not fitted"}
    assert all(r.value is None for k, r in got.items() if k[0] == "C")
    for name in "AB":
        for r in W.sweep(df.where(F.col("dataset") == name), GRID, runs, held).collect():
            mine = got[name, r.run_id, r.cell_id]
            assert (mine.row, mine.col, mine.status) == (r.row, r.col, r.status)
            if r.value is not None:
                assert (mine.value, mine.variance) == pytest.approx((r.value, r.variance), rel=1e-6, abs=1e-7)
    assert all(r.value is not None for k, r in got.items() if k[0] == "A")  # those of B lie on a line


def test_methods_in_one_sweep(spark):
    """Runs of several methods go through together; natural neighbours take one dataset."""
    df = points(spark)
    cells = make_grid(spark, GRID).where("cell_id = 45").selectExpr("'A' AS dataset", "cell_id")
    both = W.sweep_runs(spark, "IDW").where("num_points = 12 AND power = 2").unionByName(
        W.sweep_runs(spark, "OK").where("num_points = 12 AND lag_dist = 8000")
    )
    rows = D.sweep_datasets(df, GRID, both, cells).collect()
    assert len(rows) == both.count() == 6 and all(np.isfinite(r.value) for r in rows)
    assert sum(r.variance is None for r in rows) == 1
    with pytest.raises(ValueError, match="NN"):
        D.sweep_datasets(df, GRID, W.sweep_runs(spark, "NN"), cells)


def test_replay_takes_the_best_of_one_dataset(spark):
    df = points(spark).where("dataset IS NOT NULL")
    train, test = df.where("system_id % 5 <> 0"), df.where("system_id % 5 = 0")
    runs = W.sweep_runs(spark, "IDW").where("power = 2").cache()
    ranked = D.rank_datasets(D.sweep_pairs(train, test, GRID, runs, None), runs, test).cache()
    again = D.replay_datasets(ranked, "A", 5, train, test, GRID, None).collect()
    best = [r.run_id for r in E.top_runs(ranked.where("dataset = 'A'"), 5, by=["method"]).collect()]
    assert sorted((r.dataset, r.run_id) for r in again) == sorted(("B", b) for b in best)
    swept = {r.run_id: r.rmse for r in ranked.where("dataset = 'B'").collect()}
    assert all(r.rmse == pytest.approx(swept[r.run_id], rel=1e-12) for r in again)
