import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Row

from sparkplume.operators import kriging as K
from sparkplume.operators import large_systems as L
from sparkplume.operators.idw import idw_sweep, idw_variable
from sparkplume.operators.neighbors import knn
from sparkplume.operators.spatial import Grid
from sparkplume.operators.variogram import fit_semivariogram, semivariogram
from sparkplume.plans.runs import ORDINARY_MODELS
from sparkplume.plans.sweep import evaluation_cells, sweep, sweep_runs

FIELDS = "system_id long, x double, y double, z double"


def field(n=60, f=lambda x, y: np.sin(x / 20) + y / 50, seed=8):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 100, (n, 2))
    return [(i, float(x), float(y), float(f(x, y))) for i, (x, y) in enumerate(xy)]


def targets(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "target_id long, tx double, ty double")


def model(name, k, nugget=0.0, a=60.0):
    return dict(run_id=f"{name}_{k}", model=name, type="variable", num_points=k, a=a, nugget=nugget, sill=1.0)


@pytest.mark.parametrize("name", [*ORDINARY_MODELS, "LinearDrift", "QuadDrift"])
def test_exact_at_the_data(spark, name):
    pts = field()
    df = spark.createDataFrame(pts, FIELDS)
    near = knn(targets(spark, [p[1:3] for p in pts[:10]]), df, 15)
    for r in K.krige(near, [model(name, 15)]).collect():
        assert r["status"] == "ok"
        assert abs(r["value"] - pts[r["target_id"]][3]) < 1e-6 and r["variance"] < 1e-6


@pytest.mark.parametrize(
    "name,f", [("Spherical", lambda x, y: 3.0), ("LinearDrift", lambda x, y: 1 + 2 * x - y),
               ("QuadDrift", lambda x, y: 1 + x * y - 0.1 * x * x + y * y)]
)
def test_drift_reproduces_its_own_field(spark, name, f):
    df = spark.createDataFrame(field(f=f), FIELDS)
    xy = np.random.default_rng(9).uniform(0, 100, (20, 2))
    for r in K.krige(knn(targets(spark, xy), df, 20), [model(name, 20, nugget=0.3)]).collect():
        assert r["status"] == "ok" and r["variance"] >= 0
        assert abs(r["value"] - f(*xy[r["target_id"]])) < 1e-6 * max(1, abs(f(*xy[r["target_id"]])))


def test_flat_variogram_and_too_few_points(spark):
    df = spark.createDataFrame(field(f=lambda x, y: 2.0), FIELDS)
    near = knn(targets(spark, [(50, 50)]), df, 12)
    flat = {**model("Spherical", 12), "sill": 0.0}
    few = model("QuadDrift", 5)
    got = {r["run_id"]: r for r in K.krige(near, [flat, few]).collect()}
    assert abs(got["Spherical_12"]["value"] - 2.0) < 1e-9 and got["Spherical_12"]["variance"] == 0
    assert got["QuadDrift_5"]["value"] is None and got["QuadDrift_5"]["status"] == "too few points"


@pytest.mark.parametrize("name", ["Gaussian", "Linear", "LinearDrift", "QuadDrift"])
def test_batches_and_single_systems_agree_at_any_size(name):
    """A large neighbourhood without nugget: the same value and status as its own system solved alone."""
    rng = np.random.default_rng(10)
    x, y, z = rng.uniform(-50, 50, (3, 300))
    d = np.hypot(x, y)
    order = np.argsort(d)
    part = tuple(v[order] for v in (d, x, y, z))
    small = tuple(v[:40] for v in part)
    run = {**model(name, 300, nugget=0.0), "run_id": "r"}
    got = K._krige_batch(np.array([1, 2, 3]), [part, small, part], [run])
    for row, (_, px, py, pz) in zip(got.itertuples(), [part, small, part]):
        dist = np.hypot(px[:, None] - px, py[:, None] - py)
        value, _, ok = (v[0] for v in K._solve_stack(run, dist[None], px[None], py[None], pz[None]))
        assert row.status == ("ok" if ok else "singular")
        if ok:
            assert row.value == pytest.approx(value, rel=1e-9, abs=1e-9)


def crowded(n=900, count=5):
    """Places of a block, and targets whose neighbourhoods of several hundred places overlap."""
    rng = np.random.default_rng(11)
    x, y, z = rng.uniform(-100, 100, (3, n))
    tx, ty = rng.uniform(-15, 15, (2, count))
    own, parts = [], []
    for i in range(count):
        d = np.hypot(x - tx[i], y - ty[i])
        mine = np.flatnonzero(d <= 80)
        mine = mine[np.argsort(d[mine])]
        own.append(mine)
        parts.append((d[mine], x[mine] - tx[i], y[mine] - ty[i], z[mine]))
    return parts, K.Places(x, y, z, tx, ty, own)


@pytest.mark.parametrize("nugget", [1.0, 0.3, 0.0])
def test_shared_systems_equal_the_direct_solution(nugget):
    """Two radii and all models; whatever the iteration leaves out is solved directly."""
    parts, places = crowded()
    runs = [
        dict(run_id=f"{m}{r}", model=m, type="fixed", distance=r, f_pts=6, a=50.0, nugget=nugget, sill=1.0)
        for m in (*ORDINARY_MODELS, "LinearDrift", "QuadDrift")
        for r in (60.0, 80.0)
    ]
    ids = np.arange(len(parts))
    got, alone = K._krige_batch(ids, parts, runs, places), K._krige_batch(ids, parts, runs)
    assert list(got["status"]) == list(alone["status"])
    for c in ("value", "variance"):
        assert np.allclose(got[c], alone[c], rtol=1e-8, atol=1e-8, equal_nan=True)


def test_large_systems_of_covariances_are_not_solved_directly(monkeypatch):
    parts, places = crowded()
    runs = [
        dict(run_id=m, model=m, type="fixed", distance=80.0, f_pts=6, a=50.0, nugget=0.5, sill=0.5)
        for m in ("Spherical", "Circular", "Exponential", "Gaussian")
    ]
    monkeypatch.setattr(K, "_solve_stack", None)
    got = K._krige_batch(np.arange(len(parts)), parts, runs, places)
    assert len(got) == 20 and set(got["status"]) == {"ok"}


def test_collinear_places_of_a_large_drift_are_singular():
    parts, places = crowded()
    line = K.Places(places.x, 0 * places.y, places.z, places.tx, 0 * places.ty, places.own)
    parts = [(d, x, 0 * y, z) for d, x, y, z in parts]
    runs = [dict(run_id="q", model="QuadDrift", type="fixed", distance=80.0, f_pts=6, a=50.0, nugget=1.0, sill=0.1)]
    got, alone = (K._krige_batch(np.arange(len(parts)), parts, runs, p) for p in (line, None))
    assert list(got["status"]) == list(alone["status"])


def test_places_are_merged(spark):
    df = spark.createDataFrame([(3, 1.0, 1.0, 2.0), (2, 1.0, 1.0, 4.0), (5, 2.0, 2.0, 9.0)], FIELDS)
    assert sorted(tuple(r) for r in K.merge_places(df).collect()) == [(2, 1.0, 1.0, 3.0), (5, 2.0, 2.0, 9.0)]


def test_radius_and_array_paths_agree(spark):
    """Fixed and variable kriging that use the same neighbours give the same surface."""
    df = spark.createDataFrame(field(), FIELDS)
    grid = Grid(0.0, 0.0, 20.0, 5, 5)
    fixed = dict(run_id="f", model="Spherical", type="fixed", distance=1.0, f_pts=9, a=60.0, nugget=0.1, sill=1.0)
    runs = [fixed, model("Spherical", 9, nugget=0.1)]
    got = K.krige_sweep(df, grid, runs).toPandas().pivot(index="target_id", columns="run_id", values="value")
    assert len(got) == 25 and np.allclose(got["f"], got["Spherical_9"])


def test_idw_bounds_hits_and_fallback(spark):
    pts = field() + [(900, 50.0, 50.0, 7.0), (901, 50.0, 50.0, 9.0)]
    df = spark.createDataFrame(pts, FIELDS)
    run = [Row(run_id="v", power=2.0, num_points=5, type="variable")]
    got = {r["target_id"]: r["value"] for r in idw_variable(knn(targets(spark, [(50, 50), (10, 90)]), df, 5), run).collect()}
    assert got[0] == 8.0
    zs = [p[3] for p in pts]
    assert min(zs) <= got[1] <= max(zs)
    grid = Grid(0.0, 0.0, 25.0, 4, 4)
    runs = [
        Row(run_id="all", power=1.0, type="fixed", distance=1000.0, f_pts=2, num_points=None),
        Row(run_id="near", power=1.0, type="fixed", distance=0.001, f_pts=4, num_points=None),
        Row(run_id="v4", power=1.0, type="variable", distance=None, f_pts=None, num_points=4),
    ]
    wide = idw_sweep(df, grid, runs).toPandas().pivot(index="cell_id", columns="run_id", values="value")
    assert len(wide) == 16 and np.allclose(wide["near"], wide["v4"])
    x, y, z = (np.array([p[i] for p in pts]) for i in (1, 2, 3))
    for cell in range(16):
        d = np.hypot(x - (cell % 4 + 0.5) * 25, y - (cell // 4 + 0.5) * 25)
        if (d > 0).all():
            assert abs(wide["all"][cell] - (z / d).sum() / (1 / d).sum()) < 1e-9


@pytest.mark.parametrize("leaf", [1, 5, 1000])
def test_semivariogram_equals_brute_force(spark, leaf):
    """Copies of a place, a crowded corner, trees of several depths."""
    rng = np.random.default_rng(12)
    xy = rng.uniform(0, 100, (120, 2))
    xy[:40] = (33.0, 33.0)
    xy[40:80] = 60 + rng.uniform(0, 1, (40, 2))
    z = rng.normal(1000, 1, 120)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(xy[:, 0], xy[:, 1], z))], FIELDS)
    got = {(r["lag"], r["bin"]): r for r in semivariogram(df, [2.0, 5.0], 6, leaf).collect()}
    i, j = np.triu_indices(120, 1)
    h = np.hypot(xy[i, 0] - xy[j, 0], xy[i, 1] - xy[j, 1])
    for lag in (2.0, 5.0):
        for b in range(6):
            m = np.floor(h / lag) == b
            if m.any():
                r = got.pop((lag, b))
                assert r["n_pairs"] == m.sum()
                assert r["h"] == (b + 0.5) * lag
                assert abs(r["gamma"] - ((z[i] - z[j])[m] ** 2).mean() / 2) < 1e-9
    assert not got


def test_crowded_town_forms_no_point_pairs(spark, monkeypatch):
    """3,000 places within a metre and 100 others: far fewer rows than pairs."""
    import sparkplume.operators.variogram as V

    rng = np.random.default_rng(13)
    xy = np.vstack([500 + rng.uniform(0, 1, (3000, 2)), rng.uniform(0, 1000, (100, 2))])
    df = spark.createDataFrame([(i, float(a), float(b), 1.0) for i, (a, b) in enumerate(xy)], FIELDS)
    seen = []
    original = V._sums

    def counting(pairs, lags, n_lags):
        seen.append(pairs.count())
        return original(pairs, lags, n_lags)

    monkeypatch.setattr(V, "_sums", counting)
    bins = V.semivariogram(df, [40.0]).collect()
    i, j = np.triu_indices(3100, 1)
    d = np.hypot(xy[i, 0] - xy[j, 0], xy[i, 1] - xy[j, 1])
    assert sum(r["n_pairs"] for r in bins) == (d < 480).sum()
    assert sum(seen) < 20_000 < len(d) / 200
    assert V.semivariogram(df.where("false"), [40.0]).count() == 0


def test_spread_places_form_no_rows_of_pairs(spark, monkeypatch):
    """Evenly spread places and narrow bins, where a limit cuts every pair of small tiles: the rows are pairs of blocks."""
    import sparkplume.operators.variogram as V

    rng = np.random.default_rng(14)
    xy = np.vstack([rng.uniform(0, 1000, (1200, 2)), rng.integers(0, 40, (300, 2)) * 25.0])  # distances on the limits too
    z = rng.normal(5, 1, 1500)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(xy, z))], FIELDS)
    seen = []
    original = V._sums

    def counting(pairs, lags, n_lags):
        seen.append(pairs.count())
        return original(pairs, lags, n_lags)

    monkeypatch.setattr(V, "_sums", counting)
    got = {(r["lag"], r["bin"]): r for r in V.semivariogram(df, [25.0, 40.0]).collect()}
    assert sum(seen) < 1000
    i, j = np.triu_indices(1500, 1)
    h = np.hypot(xy[i, 0] - xy[j, 0], xy[i, 1] - xy[j, 1])
    for lag in (25.0, 40.0):
        for b in range(12):
            m = np.floor(h / lag) == b
            r = got.pop((lag, b))
            assert r["n_pairs"] == m.sum() and abs(r["gamma"] - ((z[i] - z[j])[m] ** 2).mean() / 2) < 1e-9
    assert not got


@pytest.mark.parametrize("pack,copies", [(1, 1), (7, 3), (64, 1)])
def test_blocks_meet_like_their_points(monkeypatch, pack, copies):
    """A lattice with distances exactly on the limits beside a town; places that hold several points."""
    import sparkplume.operators.variogram as V

    monkeypatch.setattr(V, "PACK", pack)
    rng = np.random.default_rng(15)
    limits, bins = V._limits([0.1, 8046.7], 4)
    assert (np.diff(limits) > 0).all() and (np.floor(np.sqrt(limits) / 0.1) > np.floor(np.sqrt(np.nextafter(limits, 0)) / 0.1))[:4].all()
    limits = V._limits([3.0, 5.0], 6)[0]
    sides = []
    for shift in (0, 6):
        xy = np.vstack([rng.permutation(144)[:60, None] // [12, 1] % 12 + shift, 4 + rng.uniform(0, 0.01, (60, 2))]).astype(float)
        sides.append((xy, rng.normal(0, 1, (len(xy), copies))))
    boxes = [V._Boxes(*xy.T, np.full(len(xy), float(copies)), z.mean(1), z.var(1) * copies) for xy, z in sides]
    (xa, za), (xb, zb) = [(np.repeat(xy, copies, 0), z.ravel()) for xy, z in sides]
    for one, (x1, z1), (x2, z2) in ((True, (xa, za), (xa, za)), (False, (xa, za), (xb, zb))):
        n, d2 = V._block_pair(boxes[0], None if one else boxes[1], limits)
        i, j = np.triu_indices(len(x1), 1) if one else np.indices((len(x1), len(x2))).reshape(2, -1)
        k = np.searchsorted(limits, ((x1[i] - x2[j]) ** 2).sum(1), side="right")
        assert (n == np.bincount(k, minlength=len(limits) + 1)[:-1]).all()
        assert np.allclose(d2, np.bincount(k, weights=(z1[i] - z2[j]) ** 2, minlength=len(limits) + 1)[:-1])


def test_fit_recovers_a_known_model(spark):
    h = np.arange(0.5, 12)
    gamma = 0.2 + 0.8 * np.where(h < 6, 1.5 * h / 6 - 0.5 * (h / 6) ** 3, 1)
    bins = spark.createDataFrame([(1.0, int(x), 100, float(x), float(g)) for x, g in zip(h, gamma)], "lag double, bin int, n_pairs long, h double, gamma double")
    r = fit_semivariogram(bins, ["Spherical"]).first()
    assert r["a"] == 6.0 and abs(r["nugget"] - 0.2) < 1e-9 and abs(r["sill"] - 0.8) < 1e-9 and r["misfit"] < 1e-9
    flat = bins.selectExpr("lag", "bin", "n_pairs", "h", "double(3) AS gamma")
    r = fit_semivariogram(flat, ["Gaussian"]).first()
    assert abs(r["nugget"] + r["sill"] - 3.0) < 1e-9


def test_natural_neighbor_sweep_and_bad_rows(spark):
    df = spark.createDataFrame(field(), FIELDS)
    grid = Grid(0.0, 0.0, 10.0, 10, 10)
    cells = evaluation_cells(df, grid, None)
    out = sweep(df, grid, sweep_runs(spark, "NN"), cells)
    assert out.count() == cells.count() and set(out.columns) >= {"run_id", "value", "variance", "status"}
    bad = sweep_runs(spark, "IDW").limit(1).selectExpr("* except (power)", "double(null) AS power")
    with pytest.raises(ValueError):
        sweep(df, grid, bad)


@pytest.mark.parametrize(
    "name, a, part", [("Spherical", 6.0, 0.3), ("Linear", 60.0, 0.2), ("Gaussian", 150.0, 0.01), ("Exponential", 20.0, 0.01)]
)
def test_products_of_tiles_equal_those_of_the_matrix(monkeypatch, name, a, part):
    """Short ranges, a kink among the places, and tiles that meet through nodes; blocks kept and formed anew."""
    rng = np.random.default_rng(12)
    x, y = rng.uniform(-100, 100, (2, 6000))
    x[:500] = rng.normal(30, 1, 500)  # a town
    v = rng.normal(size=(6000, 3))
    smooth = lambda h: part * (1 - K._rise(name, h / a))
    want = L._covariances(smooth, x, y) @ v
    monkeypatch.setattr(L, "DENSE", 0)
    for kept in (L.KEPT, 10**5):
        monkeypatch.setattr(L, "KEPT", kept)
        tiles = L.Covariances(smooth, x, y, np.inf if name in K.UNBOUNDED else a)
        assert tiles.matrix is None
        assert np.abs(tiles.times(v) - want).max() < 1e-10
        if name == "Gaussian":
            assert tiles.far is not None


@pytest.mark.parametrize("name, order", [("Spherical", 0), ("LinearDrift", 1), ("Exponential", 0)])
def test_systems_of_many_places_form_no_square(monkeypatch, name, order):
    """Two targets with 5,000 places: the same as the direct solution, in far less memory than one matrix of them."""
    rng = np.random.default_rng(13)
    x, y, z = rng.uniform(-100, 100, (3, 6400))
    tx, ty = np.array([0.0, 5.0]), np.array([0.0, 3.0])
    own, parts = [], []
    for i in range(2):
        d = np.hypot(x - tx[i], y - ty[i])
        own.append(np.argsort(d)[:5000])
        parts.append((d[own[i]], x[own[i]] - tx[i], y[own[i]] - ty[i], z[own[i]]))
    run = dict(run_id="r", model=name, type="fixed", distance=1.0, f_pts=5000, a=4.0, nugget=0.5, sill=0.5)
    solve, direct = K._solve_stack, []
    for px, py, pz in (p[1:] for p in parts):
        dist = np.hypot(px[:, None] - px, py[:, None] - py)
        direct.append([v[0] for v in solve(run, dist[None], px[None], py[None], pz[None])])
        del dist
    monkeypatch.setattr(K, "_solve_stack", None)
    monkeypatch.setattr(L, "DENSE", 0)
    tracemalloc.start()
    got = K._krige_batch(np.arange(2), parts, [run], K.Places(x, y, z, tx, ty, own))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * 5000**2 / 2
    assert np.allclose(got["value"], [v for v, _, _ in direct], rtol=1e-8, atol=1e-8)
    assert np.allclose(got["variance"], [v for _, v, _ in direct], rtol=1e-8, atol=1e-8)


def test_runs_of_a_pure_nugget_share_their_solution(monkeypatch):
    """Shape and range play no part then: one solution for all models, with the variance of each run."""
    parts, places = crowded()
    runs = [
        dict(run_id=f"{m}{s}", model=m, type="fixed", distance=80.0, f_pts=6, a=50.0 * s, nugget=float(s), sill=0.0)
        for m in ORDINARY_MODELS
        for s in (1, 2)
    ]
    calls, solve = [], K.solve_together
    monkeypatch.setattr(K, "solve_together", lambda *a: calls.append(1) or solve(*a))
    got = K._krige_batch(np.arange(len(parts)), parts, runs, places).pivot(index="target_id", columns="run_id", values=["value", "variance"])
    alone = K._krige_batch(np.arange(len(parts)), parts, runs[:1])
    assert len(calls) <= len(parts)
    for r in runs:
        assert np.allclose(got["value", r["run_id"]], alone["value"], rtol=1e-9)
        assert np.allclose(got["variance", r["run_id"]], alone["variance"] * r["nugget"], rtol=1e-9)
