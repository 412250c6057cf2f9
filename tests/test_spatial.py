import numpy as np

from sparkplume.operators.evaluate import error_metrics, pair_obs_pred, score_runs
from sparkplume.operators.natural import natural_neighbor
from sparkplume.operators.spatial import (
    Grid,
    clip_points,
    convex_hull,
    extract_at_points,
    make_grid,
    polygon_edges,
    train_test_split,
    zonal_mean,
    zone_cells,
)


def test_clip_counts_a_vertex_once(spark):
    ring = spark.createDataFrame(
        [(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 10.0, 10.0), (3, 5.0, 5.0), (4, 0.0, 10.0)], "i long, x double, y double"
    )
    pts = [(1, 2.0, 5.0), (2, 5.0, 8.0), (3, 9.0, 5.0), (4, -1.0, 5.0), (5, 11.0, 10.0), (6, 4.0, 5.0), (7, -3.0, 10.0)]
    got = clip_points(spark.createDataFrame(pts, "system_id long, x double, y double"), polygon_edges(ring), 2.0)
    assert sorted(r["system_id"] for r in got.collect()) == [1, 3, 6]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_split_is_exact_per_group(spark):
    pts = spark.range(1003).selectExpr("id AS system_id", "id % 3 AS g")
    whole = train_test_split(pts, 90, 42)
    assert whole.where("is_train").count() == 902 and whole.count() == 1003
    per = {r["g"]: (r["n"], r["t"]) for r in train_test_split(pts, 90, 7, by=["g"]).groupBy("g").agg({"*": "count", "is_train": "count"}).selectExpr("g", "`count(1)` n", "0 t").collect()}
    counts = {r["g"]: r["count"] for r in train_test_split(pts, 90, 7, by=["g"]).where("is_train").groupBy("g").count().collect()}
    assert counts == {g: n * 9 // 10 for g, (n, _) in per.items()}
    again = {r[0] for r in train_test_split(pts.repartition(7), 90, 42).where("is_train").select("system_id").collect()}
    assert again == {r[0] for r in whole.where("is_train").select("system_id").collect()}
    coarse = {r[0] for r in train_test_split(pts, 90, 42, rows_per_range=50).where("is_train").select("system_id").collect()}
    assert coarse == again
    assert train_test_split(pts.where("system_id < 0"), 90, 42).count() == 0


def test_hull_of_many_parts(spark):
    rng = np.random.default_rng(5)
    xy = rng.normal(0, 1, (500, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in xy], "x double, y double").repartition(6)
    hull = [(r["x"], r["y"]) for r in convex_hull(df).orderBy("i").collect()]
    for k, (ax, ay) in enumerate(hull):
        bx, by = hull[(k + 1) % len(hull)]
        assert ((bx - ax) * (xy[:, 1] - ay) - (by - ay) * (xy[:, 0] - ax) > -1e-12).all()


def test_snap_and_covering_grid(spark):
    pts = spark.createDataFrame([(-5.0, 12.0), (31.0, 49.9)], "x double, y double")
    g = Grid.covering(pts, 10.0, (2.0, 3.0))
    assert (g.x0, g.y0, g.cols, g.rows) == (-8.0, 3.0, 4, 5)


def test_zone_without_a_centre_takes_the_own_cell(spark):
    grid = Grid(0.0, 0.0, 10.0, 3, 3)
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 15.0, 15.0), (3, 500.0, 0.0)], "system_id long, x double, y double")
    got = sorted(tuple(r) for r in zone_cells(pts, 2.0, grid).collect())
    assert got == [(1, 0), (2, 4)]
    wide = [r["cell_id"] for r in zone_cells(pts.where("system_id = 2"), 10.0, grid).collect()]
    assert sorted(wide) == [1, 3, 4, 5, 7]


def test_missing_cells_and_failed_runs(spark):
    grid = Grid(0.0, 0.0, 10.0, 2, 2)
    raster = spark.createDataFrame(
        [("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, None), ("a", 3, 5.0), ("b", 0, None)], "run_id string, cell_id long, value double"
    )
    test = spark.createDataFrame([(1, 5.0, 5.0, 1.5), (2, 5.0, 15.0, 9.0)], "system_id long, x double, y double, z double")
    zonal = {(r["run_id"], r["system_id"]): r["prediction"] for r in zonal_mean(raster, zone_cells(test, 10.0, grid)).collect()}
    assert zonal == {("a", 1): 2.0, ("a", 2): 3.0}
    metrics = error_metrics(pair_obs_pred(test, extract_at_points(raster, test.select("system_id", "x", "y"), grid)))
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    got = {r["run_id"]: (r["status"], r["n"], r["rmse"]) for r in score_runs(runs, metrics).collect()}
    assert got == {"a": ("ok", 1, 0.5), "b": ("failed", None, None)}


def test_natural_neighbor_range_and_hull(spark):
    rng = np.random.default_rng(6)
    pts = [(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(rng.uniform(20, 80, (25, 3)))]
    df = spark.createDataFrame(pts, "system_id long, x double, y double, z double")
    grid = Grid(0.0, 0.0, 5.0, 20, 20)
    for factor in (1, 3):
        got = natural_neighbor(df, grid, factor).toPandas()
        assert len(got) == 400
        inside = got["value"].dropna()
        zs = [p[3] for p in pts]
        assert 0 < len(inside) < 400 and inside.min() >= min(zs) - 1e-9 and inside.max() <= max(zs) + 1e-9
        assert got[got.cell_id == 0]["value"].isna().all()


def test_masked_grid(spark):
    mask = spark.createDataFrame([(0, 1), (2, 2), (9, 9)], "row long, col long")
    assert sorted(r["cell_id"] for r in make_grid(spark, Grid(0.0, 0.0, 1.0, 3, 3), mask).collect()) == [1, 8]


def test_clip_keeps_repeated_rows(spark):
    ring = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 10.0, 10.0), (3, 0.0, 10.0)], "i long, x double, y double")
    rows = [(1, 5.0, 5.0), (1, 5.0, 5.0), (2, 4.0, 4.0), (3, 5.0, 5.0), (4, 20.0, 5.0), (5, None, 5.0)]
    got = clip_points(spark.createDataFrame(rows, "system_id long, x double, y double"), polygon_edges(ring), 2.0)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5.0, 5.0), (1, 5.0, 5.0), (2, 4.0, 4.0), (3, 5.0, 5.0)]


def test_zone_of_a_point_outside_the_grid(spark):
    grid = Grid(0.0, 0.0, 10.0, 3, 3)
    pts = spark.createDataFrame([(1, -1.0, 5.0), (2, -50.0, 5.0), (3, 1.0, 1.0)], "system_id long, x double, y double")
    assert sorted(tuple(r) for r in zone_cells(pts, 10.0, grid).collect()) == [(1, 0), (3, 0)]
    assert sorted(tuple(r) for r in zone_cells(pts, 1.0, grid).collect()) == [(3, 0)]


def test_split_keeps_rows_without_key_or_group(spark):
    pts = spark.createDataFrame([(k if k % 4 else None, "a" if k % 3 else None) for k in range(40)], "system_id long, g string")
    for by in ((), ("g",)):
        got = train_test_split(pts, 90, 42, by=by)
        assert got.count() == 40 and got.where("is_train IS NULL").count() == 0
    whole = train_test_split(pts, 90, 42)
    assert whole.where("is_train").count() == 36 and whole.where("NOT is_train AND system_id IS NOT NULL").count() == 0
