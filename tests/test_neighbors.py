import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkplume.operators.neighbors import grid_targets, knn, neighbor_rows, radius_blocks, radius_neighbors
from sparkplume.operators.spatial import Grid, disc_cells, make_grid


def skewed(n=3000, seed=1):
    """A third of the points at one place, a third within a metre, the rest spread over 1,000 km."""
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 1e6, (n, 2))
    xy[: n // 3] = (250000.0, 250000.0)
    xy[n // 3 : 2 * n // 3] = 700000.0 + rng.uniform(0, 1, (n // 3, 2))
    return [(i, float(x), float(y), float(rng.uniform(0, 1))) for i, (x, y) in enumerate(xy)]


def frame(spark, pts):
    return spark.createDataFrame(pts, "system_id long, x double, y double, z double").repartition(4)


def nearest(pts, tx, ty, k):
    ids = np.array([p[0] for p in pts])
    x, y = np.array([p[1] for p in pts]), np.array([p[2] for p in pts])
    d = np.sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty))
    order = np.lexsort((ids, d))[:k]
    return list(ids[order]), d


@pytest.mark.parametrize("k", [1, 12, 100])
def test_knn_is_exact_under_skew(spark, k):
    pts = skewed()
    rng = np.random.default_rng(2)
    targets = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1e5, 1.1e6, (60, 2)))]
    targets += [(100, 250000.0, 250000.0), (101, 700000.5, 700000.5), (102, 700001.5, 699999.0)]
    found = knn(spark.createDataFrame(targets, "target_id long, tx double, ty double"), frame(spark, pts), k)
    got = {r["target_id"]: [n["id"] for n in r["neighbors"]] for r in found.collect()}
    assert len(got) == len(targets)
    for i, tx, ty in targets:
        assert got[i] == nearest(pts, tx, ty, k)[0]


def test_crowded_tile_does_not_reach_every_target(spark):
    """Candidates per target stay near k although a third of the points is within a metre."""
    pts = skewed(9000)
    cells = grid_targets(make_grid(spark, Grid(0.0, 0.0, 50000.0, 20, 20)))
    import sparkplume.operators.neighbors as N

    seen = {}
    original = N._within_bound

    def spy(tiles, k):
        out = original(tiles, k)
        seen["reach"] = out
        return out

    N._within_bound = spy
    try:
        knn(cells, frame(spark, pts), 12)
    finally:
        N._within_bound = original
    per_target = seen["reach"].groupBy("target_id").sum("n").toPandas()["sum(n)"]
    assert per_target.max() < 600


def test_fewer_points_than_k_and_none(spark):
    targets = spark.createDataFrame([(1, 0.0, 0.0)], "target_id long, tx double, ty double")
    few = frame(spark, [(5, 1.0, 0.0, 1.0), (4, 1.0, 0.0, 2.0)])
    assert [n["id"] for n in knn(targets, few, 12).first()["neighbors"]] == [4, 5]
    none = knn(targets, few.where("system_id < 0"), 3).collect()
    assert len(none) == 1 and none[0]["neighbors"] == []
    named = few.selectExpr("concat('S', system_id) AS system_id", "x", "y", "z").unionByName(
        spark.createDataFrame([("bad", None, 1.0, 1.0), ("nan", 1.0, float("nan"), 1.0), ("empty", 1.0, 0.0, None)],
                              "system_id string, x double, y double, z double")
    )
    assert [n["id"] for n in knn(targets, named, 12).first()["neighbors"]] == ["S4", "S5"]
    assert knn(targets, named.where("x > 5"), 2).first()["neighbors"] == []


def test_radius_neighbors_equal_brute_force(spark):
    pts = skewed(900)
    grid = Grid(0.0, 0.0, 100000.0, 10, 10)
    got = {}
    for r in radius_neighbors(frame(spark, pts), 120000.0, 6, grid).collect():
        got.setdefault(r["target_id"], set()).add(r["id"])
    for row in range(10):
        for col in range(10):
            near, d = nearest(pts, (col + 0.5) * 1e5, (row + 0.5) * 1e5, 6)
            assert got[row * 10 + col] == {p[0] for p, dist in zip(pts, d) if dist <= 120000.0} | set(near)


def test_radius_blocks_hold_the_neighbors_once(spark):
    """The same neighbours as ``radius_neighbors``, in far fewer rows."""
    df = frame(spark, skewed(900))
    grid = Grid(0.0, 0.0, 20000.0, 50, 50)
    pairs = {(r["target_id"], r["id"]) for r in radius_neighbors(df, 120000.0, 6, grid).collect()}
    targets, places = (d.collect() for d in radius_blocks(df, 120000.0, 6, grid, make_grid(spark, grid)))
    assert sorted(r["target_id"] for r in targets) == list(range(2500))
    shared = [(r["block"], r["id"]) for r in places if r["target_id"] < 0]
    assert len(shared) == len(set(shared)) and 2 * len(places) < len(pairs)
    block, got = {}, {(r["target_id"], r["id"]) for r in places if r["target_id"] >= 0}
    for r in places:
        if r["target_id"] < 0:
            block.setdefault(r["block"], []).append(r)
    for t in targets:
        near = block.get(t["block"], [])
        got |= {(t["target_id"], r["id"]) for r in near if np.hypot(r["x"] - t["tx"], r["y"] - t["ty"]) <= 120000.0}
    assert got == pairs


def test_disc_cells_equal_brute_force(spark):
    grid = Grid(-3.0, 2.0, 1.5, 8, 9)
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y), 0.0) for i, (x, y) in enumerate(rng.uniform(-6, 16, (80, 2)))]
    for radius in (0.0, 0.7, 3.1, 40.0):
        got = {(r["system_id"], r["row"], r["col"]) for r in disc_cells(frame(spark, pts), radius, grid).collect()}
        want = {
            (i, r, c)
            for i, x, y, _ in pts
            for r in range(8)
            for c in range(9)
            if np.sqrt((-3 + (c + 0.5) * 1.5 - x) ** 2 + (2 + (r + 0.5) * 1.5 - y) ** 2) <= radius
        }
        assert got == want


def test_plan_has_no_cross_join(spark):
    found = knn(grid_targets(make_grid(spark, Grid(0.0, 0.0, 50000.0, 20, 20))), frame(spark, skewed()), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert neighbor_rows(found).count() == 2000


def test_targets_without_a_location_stay(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 1.0, 0.0, 1.0)], "system_id long, x double, y double, z double")
    targets = spark.createDataFrame(
        [(1, 0.0, 0.0), (2, None, 0.0), (3, 0.0, float("nan"))], "target_id long, tx double, ty double"
    )
    got = {r["target_id"]: [n["id"] for n in r["neighbors"]] for r in knn(targets, pts, 2).collect()}
    assert got == {1: [1, 2], 2: [], 3: []}


def test_stray_point_far_away(spark):
    """One stray coordinate stretches the extent; tiles go on opening until they are small again."""
    near = [(k, float(k % 30) * 1e-3, float(k // 30) * 1e-3, 1.0) for k in range(900)]
    pts = spark.createDataFrame([*near, (5000, 1e10, 1e10, 1.0)], "system_id long, x double, y double, z double")
    targets = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0145, 0.0145)], "target_id long, tx double, ty double")
    got = {r["target_id"]: [n["id"] for n in r["neighbors"]] for r in knn(targets, pts, 3).collect()}
    for t, x, y in ((1, 0.0, 0.0), (2, 0.0145, 0.0145)):
        want = sorted((((px - x) ** 2 + (py - y) ** 2) ** 0.5, i) for i, px, py, _ in near)[:3]
        assert got[t] == [i for _, i in want]


def test_tasks_of_a_scatter_follow_its_pairs(spark, monkeypatch):
    """Few bytes of points in one partition, with many cells each: the pairs are dealt over tasks, and are the same."""
    import sparkplume.operators.neighbors as N

    rng = np.random.default_rng(21)
    rows = [(g, i, float(x), float(y), 1.0) for g in (0, 1) for i, (x, y) in enumerate(rng.uniform(0, 1000, (300, 2)))]
    rows += [(1, 1000 + i, 500.0, 500.0, 2.0) for i in range(300)] + [(1, 9, None, 1.0, 1.0), (0, None, 5.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "part long, system_id long, x double, y double, z double").coalesce(1)
    grid = Grid(0.0, 0.0, 20.0, 50, 50)
    monkeypatch.setattr(N, "PAIRS_PER_TASK", 50_000, raising=False)
    pairs = N.radius_rows(df, 300.0, grid, by="part")
    held = [r[0] for r in pairs.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(held) > 5 and max(held) < sum(held) / 4
    expected = {}
    centre = (np.arange(50) + 0.5) * 20
    for g, i, x, y, z in rows:
        if x is not None:
            d = np.hypot(centre[None, :] - x, centre[:, None] - y)
            for r, c in zip(*np.nonzero(d <= 300.0)):
                expected[g * 2500 + r * 50 + c, i] = expected.get((g * 2500 + r * 50 + c, i), 0) + 1
    got = {(r.target_id, r.id): r.n for r in pairs.groupBy("target_id", "id").agg(F.count("*").alias("n")).collect()}
    assert got == expected
