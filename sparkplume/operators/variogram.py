"""Empirical semivariogram (Matheron 1963) and weighted model fit (Cressie 1985)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkplume.operators.spatial import usable
from sparkplume.operators.tiles import BOX, Tiles, build_tiles
from sparkplume.session import materialize

N_LAGS = 12
LEAF = 32_768  # points of a block: pairs of blocks are the unit that travels and is worked on
PACK = 64  # places of a box inside a block
SLAB = 1_024  # rows of PACK distances formed at once
STEPS = 8_192  # equal steps of the squared distance
MAX_TASKS = 2_000
MODELS = ("Spherical", "Circular", "Exponential", "Gaussian", "Linear")
NODE = ("tile", "n", "m", "q", *BOX, "level", "inner")


def _first_pairs(nodes: DataFrame, by: str | None) -> DataFrame:
    """Pairs of nodes of the first level, each once: at most 16 nodes, or so many per group, which meet only each other."""
    group = F.lit(0) if by is None else F.col("tile.g")
    top = nodes.where("level = 1").select(group.alias("g"), F.struct(*NODE).alias("node"))
    sides = [top.select("g", F.col("node").alias(s)) for s in "ab"]
    return sides[0].join(sides[1], "g").where("a.tile <= b.tile").selectExpr("a", "b", "a.tile = b.tile AS same")


def _judge(pairs: DataFrame, lags: Sequence[float], n_lags: int) -> DataFrame:
    """Distance range of each pair of nodes, and what to do with the pair.

    ``done``: all its distances fall in one bin of every lag. ``finish``: two blocks, whose places meet.
    ``open``: look one level deeper. Pairs beyond the reach leave.
    """
    near = [f"greatest(a.a{v} - b.b{v}, b.a{v} - a.b{v}, 0D)" for v in "xy"]
    far = [f"greatest(a.b{v} - b.a{v}, b.b{v} - a.a{v})" for v in "xy"]
    one_bin = " AND ".join(
        f"least(floor(near / {lag!r}D), {n_lags}) = least(floor(far / {lag!r}D), {n_lags})" for lag in lags
    )
    return (
        pairs.selectExpr(
            "a", "b", "same",
            f"sqrt({near[0]} * {near[0]} + {near[1]} * {near[1]}) AS near",
            f"sqrt({far[0]} * {far[0]} + {far[1]} * {far[1]}) AS far",
        )
        .where(f"near < {max(lags) * n_lags!r}D")
        .selectExpr(
            "*",
            f"CASE WHEN {one_bin} THEN 'done' WHEN NOT a.inner AND NOT b.inner THEN 'finish' ELSE 'open' END AS status",
        )
    )


def _open(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replace inner nodes by those below them: both sides, or only the larger one when sizes differ much."""
    size = {s: f"greatest({s}.bx - {s}.ax, {s}.by - {s}.ay)" for s in "ab"}
    step = {
        s: f"{s}.inner AND (same OR NOT {o}.inner OR 2 * {size[s]} >= {size[o]})" for s, o in (("a", "b"), ("b", "a"))
    }
    below = {s: nodes.selectExpr(f"parent AS {s}_parent", f"struct({', '.join(NODE)}) AS {s}_below") for s in "ab"}
    return (
        pairs.selectExpr("a", "b", "same", *[f"CASE WHEN {step[s]} THEN {s}.tile END AS {s}_key" for s in "ab"])
        .join(below["a"], F.expr("a_key = a_parent"), "left")
        .join(below["b"], F.expr("b_key = b_parent"), "left")
        .selectExpr("coalesce(a_below, a) AS a", "coalesce(b_below, b) AS b", "same AS was_same")
        # below a pair of a node with itself, each pair counts once
        .where("NOT was_same OR a.tile <= b.tile")
        .selectExpr("a", "b", "was_same AND a.tile = b.tile AS same")
    )


def _sums(pairs: DataFrame, lags: Sequence[float], n_lags: int) -> DataFrame:
    """Pairs of points and squared differences per joint bin, and per group if tiles have one, from the moments of the nodes."""
    group = [c for c in pairs.select("a.tile.*").columns if c == "g"]
    return (
        pairs.selectExpr(
            *[f"a.tile.g AS {c}" for c in group],
            *[f"int(least(floor(near / {lag!r}D), {n_lags})) AS b{i}" for i, lag in enumerate(lags)],
            "CASE WHEN same THEN a.n * (a.n - 1) div 2 ELSE a.n * b.n END AS n",
            "CASE WHEN same THEN a.n * a.q ELSE a.n * b.n * (a.m - b.m) * (a.m - b.m) + b.n * a.q + a.n * b.q END AS d2",
        )
        .groupBy(*group, *[f"b{i}" for i in range(len(lags))])
        .agg(F.sum("n").alias("n"), F.sum("d2").alias("d2"))
    )


def _limits(lags: Sequence[float], n_lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances at which some lag begins a new bin, and the bin of every lag from each of them on.

    A limit is the first double whose root, divided by the lag and rounded down, is in the new bin.
    """

    def first(value: float, reached) -> float:
        while reached(np.nextafter(value, 0.0)):
            value = np.nextafter(value, 0.0)
        while not reached(value):
            value = np.nextafter(value, np.inf)
        return float(value)

    at = sorted({first(k * k * lag * lag, lambda v: np.floor(np.sqrt(v) / lag) >= k) for lag in lags for k in range(1, n_lags + 1)})
    limits = np.array(at)
    roots = np.sqrt(np.concatenate([[0.0], limits]))
    return limits, np.stack([np.minimum(np.floor(roots / lag), n_lags) for lag in lags], axis=1).astype(int)


class _Histogram:
    """Numbers of pairs and sums of squared differences between limits of the squared distance.

    Values are counted by equal steps of the squared distance; those in a step that holds a limit are compared with the limits.
    """

    def __init__(self, limits: np.ndarray):
        self.limits, self.last = limits, len(limits)
        self.scale = STEPS / limits[-1]
        held = np.minimum(limits * self.scale, STEPS).astype(np.int64)
        self.cut = np.zeros(STEPS + 1, dtype=bool)
        self.cut[held] = self.cut[STEPS] = True
        self.between = np.searchsorted(held, np.arange(STEPS + 1), side="right")
        self.n, self.d2 = np.zeros(self.last + 1), np.zeros(self.last + 1)
        self.step_n, self.step_d2 = np.zeros(STEPS + 1), np.zeros(STEPS + 1)

    def between_limits(self, square: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.limits, square, side="right")

    def add_to(self, k: np.ndarray, n: np.ndarray | None, d2: np.ndarray) -> None:
        self.n += np.bincount(k, weights=n, minlength=self.last + 1)
        self.d2 += np.bincount(k, weights=d2, minlength=self.last + 1)

    def add(self, square: np.ndarray, n: np.ndarray | None, d2: np.ndarray) -> None:
        step = np.minimum(square * self.scale, STEPS).astype(np.int64)
        self.step_n += np.bincount(step, weights=n, minlength=STEPS + 1)
        self.step_d2 += np.bincount(step, weights=d2, minlength=STEPS + 1)
        near = np.flatnonzero(self.cut[step])
        self.add_to(self.between_limits(square[near]), None if n is None else n[near], d2[near])

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Per limit reached, without what lies beyond the last one."""
        whole = ~self.cut
        self.add_to(self.between[whole], self.step_n[whole], self.step_d2[whole])
        self.step_n[:], self.step_d2[:] = 0.0, 0.0
        return self.n[:-1], self.d2[:-1]


def _moments(n, m, q, n2, m2, q2):
    """Pairs and squared differences between two sets of values given by count, mean and squared deviations."""
    return n * n2, n * n2 * (m - m2) ** 2 + n2 * q + n * q2


class _Boxes:
    """The places of a block in boxes of neighbours, ``PACK`` a box: sorted strips, each cut along the other axis.

    A row of ``places`` is a box; empty places are infinitely far and count nothing.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, q: np.ndarray):
        strips = np.array_split(np.argsort(x, kind="stable"), math.ceil(math.sqrt(len(x) / PACK)))
        packs = [s[np.argsort(y[s], kind="stable")][i : i + PACK] for s in strips for i in range(0, len(s), PACK)]
        self.held = np.array([len(p) for p in packs])
        self.places = np.zeros((5, len(packs), PACK))
        self.places[:2] = np.inf
        for i, p in enumerate(packs):
            self.places[:, i, : len(p)] = x[p], y[p], n[p], m[p], q[p]
        inside = np.arange(PACK) < self.held[:, None]
        self.low = np.where(inside, self.places[:2], np.inf).min(axis=2)
        self.high = np.where(inside, self.places[:2], -np.inf).max(axis=2)
        _, _, pn, pm, pq = self.places
        self.n = pn.sum(axis=1)
        self.m = (pn * pm).sum(axis=1) / self.n
        self.q = (pq + pn * (pm - self.m[:, None]) ** 2).sum(axis=1)
        self.size = (self.high - self.low).max(axis=0)

    def range_to(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance between other boxes (rows) and these (columns)."""
        gap = np.maximum(np.maximum(self.low[:, None] - high[:, :, None], low[:, :, None] - self.high[:, None]), 0.0)
        span = np.maximum(self.high[:, None] - low[:, :, None], high[:, :, None] - self.low[:, None])
        return gap[0] * gap[0] + gap[1] * gap[1], span[0] * span[0] + span[1] * span[1]


def _places_meet(box: int, side: _Boxes, others: np.ndarray, other: _Boxes, out: _Histogram, plain: bool) -> None:
    """The places of one box with boxes of the other side, whole boxes where no limit cuts them."""
    x, y, n, m, q = side.places[:, box, : side.held[box]]
    near, far = other.range_to(np.stack([x, y]), np.stack([x, y]))
    near, far = out.between_limits(near[:, others]), out.between_limits(far[:, others])
    p, j = np.nonzero((near == far) & (near < out.last))
    o = others[j]
    out.add_to(near[p, j], *_moments(n[p], m[p], q[p], other.n[o], other.m[o], other.q[o]))
    p, j = np.nonzero((near < far) & (near < out.last))
    j = others[j]
    for s in range(0, len(p), SLAB):
        ps, js = p[s : s + SLAB, None], j[s : s + SLAB]
        dx, dy, dm = (other.places[c, js] - v[ps] for c, v in ((0, x), (1, y), (3, m)))
        square = dx * dx + dy * dy
        if plain:
            out.add(square.ravel(), None, (dm * dm).ravel())
        else:
            pairs, d2 = _moments(n[ps], m[ps], q[ps], *other.places[2:, js])
            out.add(square.ravel(), pairs.ravel(), d2.ravel())


def _block_pair(a: _Boxes, b: _Boxes | None, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and squared differences between limits: of two blocks, or within one if ``b`` is None."""
    out, other = _Histogram(limits), a if b is None else b
    plain = all((s.places[2] <= 1).all() and (s.places[4] == 0).all() for s in (a, other))
    low, high = other.range_to(a.low, a.high)
    near, far = out.between_limits(low), out.between_limits(high)
    once = np.ones(near.shape, dtype=bool) if b is not None else np.triu(np.ones(near.shape, dtype=bool), 1)
    i, j = np.nonzero(once & (near == far) & (near < out.last))
    out.add_to(near[i, j], *_moments(a.n[i], a.m[i], a.q[i], other.n[j], other.m[j], other.q[j]))
    cut = once & (near < far) & (near < out.last)
    wider = a.size[:, None] >= other.size
    for i in np.flatnonzero((cut & wider).any(axis=1)):
        _places_meet(i, a, np.flatnonzero(cut[i] & wider[i]), other, out, plain)
    for j in np.flatnonzero((cut & ~wider).any(axis=0)):
        _places_meet(j, other, np.flatnonzero(cut[:, j] & ~wider[:, j]), a, out, plain)
    if b is None:
        for i, held in enumerate(a.held):
            x, y, n, m, q = a.places[:, i, :held]
            p, o = np.triu_indices(held, 1)
            dx, dy = x[p] - x[o], y[p] - y[o]
            out.add(dx * dx + dy * dy, *_moments(n[p], m[p], q[p], n[o], m[o], q[o]))
            out.add_to(np.zeros(held, dtype=int), n * (n - 1) / 2, n * q)  # within a place
    return out.totals()


def _blocks(tiles: Tiles, points: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tile, x, y, n, m, q``: the places of each tile that has no tiles below, as arrays of at most as many as its points."""
    places = (
        tiles.levels(points)
        .join(nodes.where("NOT inner").select("tile"), "tile", "left_semi")
        .groupBy("tile", "x", "y")
        .agg(*map(F.expr, ("count(1) n", "avg(z) m", "var_pop(z) * count(1) q")))
    )
    held = places.groupBy("tile").agg(F.collect_list(F.struct(*"xynmq")).alias("p"))
    return materialize(held.select("tile", *[F.col(f"p.{c}").alias(c) for c in "xynmq"]), "blocks")


def _block_sums(pairs: DataFrame, blocks: DataFrame, lags: Sequence[float], n_lags: int, by: str | None) -> DataFrame:
    """As ``_sums`` for pairs of blocks ``a, b, same``: their places meet inside a task, one pair of blocks at a time."""
    group = [] if by is None else ["g"]
    limits, bins = _limits(lags, n_lags)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        sides = [_Boxes(*(np.asarray(row[f"{s}_{c}"], dtype=float) for c in "xynmq")) for s in ("a" if row["same"] else "ab")]
        n, d2 = _block_pair(sides[0], None if row["same"] else sides[1], limits)
        found = np.flatnonzero(n)
        out = {f"b{i}": bins[found, i] for i in range(len(lags))} | {"n": n[found].astype(np.int64), "d2": d2[found]}
        return pd.DataFrame({**{c: np.full(len(found), row[c]) for c in group}, **out})

    pairs = materialize(pairs.withColumn("pair", F.monotonically_increasing_id()), "block_pairs")
    side = {s: blocks.selectExpr(f"tile AS {s}", *[f"{c} AS {s}_{c}" for c in "xynmq"]) for s in "ab"}
    # a block with itself travels once
    joined = pairs.join(side["a"], "a").join(side["b"].withColumn("same", F.lit(False)), ["b", "same"], "left")
    joined = joined.select("pair", "same", *[F.col(f"a.{c}") for c in group], *[f"{s}_{c}" for s in "ab" for c in "xynmq"])
    # the cost is in the pairs of places and not in the bytes, so the number of tasks follows the pairs of blocks
    tasks = max(1, min(pairs.count(), MAX_TASKS))
    schema = ", ".join([*(f"{c} long" for c in group), *(f"b{i} int" for i in range(len(lags))), "n long", "d2 double"])
    met = joined.repartition(tasks, "pair").groupBy("pair").applyInPandas(meet, schema)
    return met.groupBy(*group, *[f"b{i}" for i in range(len(lags))]).agg(F.sum("n").alias("n"), F.sum("d2").alias("d2"))


def semivariogram(
    points: DataFrame, lags: Sequence[float], n_lags: int = N_LAGS, leaf: int = LEAF, by: str | None = None
) -> DataFrame:
    """``lag, bin, n_pairs, h, gamma`` for every lag distance; h is the middle of the bin.

    Pairs of tiles stand for all pairs of their points. As soon as every distance between two tiles
    falls in one bin, their counts, means and variances give the exact contribution; otherwise the
    larger tile is opened, down to blocks of at most ``leaf`` points. Two blocks meet inside a task in the same way, with
    boxes of neighbouring places, so a crowded town is few nodes for all that is far from it, and for itself. What travels
    is a pair of blocks: the number of rows follows the square of the blocks, and pairs of points are never rows.

    With ``by``, a column of whole numbers, every group of points has bins of its own, named by that column; all groups
    go through the same steps together. A group of fewer than two points has none.
    """
    group = [] if by is None else [by]
    lags = sorted({float(lag) for lag in lags})
    spark = points.sparkSession
    sites = materialize(usable(points, *group).select("x", "y", "z", *group).na.drop("any"), "sites")
    tiles = build_tiles(sites, leaf, ("avg(z) m", "var_pop(z) * count(1) q"), by)
    parts = []
    if tiles is not None:
        nodes = tiles.reachable().selectExpr("parent", "tile", "n", "m", "q", *BOX, "level", f"{tiles.crowded} AS inner")
        nodes = materialize(nodes, "nodes")
        pairs = materialize(_judge(_first_pairs(nodes, by), lags, n_lags), "node_pairs")
        meeting = []
        while True:
            parts.append(_sums(pairs.where("status = 'done'"), lags, n_lags))
            meeting.append(pairs.where("status = 'finish'").selectExpr("a.tile AS a", "b.tile AS b", "same"))
            todo = pairs.where("status = 'open'")
            if todo.isEmpty():
                break
            pairs = materialize(_judge(_open(todo, nodes), lags, n_lags), "node_pairs")
        parts.append(_block_sums(reduce(DataFrame.unionByName, meeting), _blocks(tiles, sites, nodes), lags, n_lags, by))
    columns = ", ".join([*("g long" for _ in group), *(f"b{i} int" for i in range(len(lags)))])
    joint = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], f"{columns}, n long, d2 double"))
    by_lag = F.explode(
        F.array(*[F.struct(F.lit(lag).alias("lag"), F.col(f"b{i}").alias("bin")) for i, lag in enumerate(lags)])
    )
    return (
        joint.withColumn("_b", by_lag)
        .where(F.col("_b.bin") < n_lags)
        .groupBy(*[F.col("g").alias(c) for c in group], F.col("_b.lag").alias("lag"), F.col("_b.bin").alias("bin"))
        .agg(F.sum("n").alias("n_pairs"), F.try_divide(F.sum("d2"), 2 * F.sum("n")).alias("gamma"))
        .where("n_pairs > 0")
        .selectExpr(*group, "lag", "bin", "n_pairs", "(bin + 0.5D) * lag AS h", "gamma")
    )


def shape(model: str, h: Column, a: Column) -> Column:
    """Unit-sill variogram shape at distance ``h`` for range ``a``."""
    u = h / a
    if model == "Spherical":
        rise = 1.5 * u - 0.5 * u * u * u
    elif model == "Circular":
        v = F.least(u, F.lit(1.0))
        rise = 1.0 - F.lit(2 / math.pi) * F.acos(v) + F.lit(2 / math.pi) * v * F.sqrt(1.0 - v * v)
    elif model == "Exponential":
        return F.lit(1.0) - F.exp(-3.0 * u)
    elif model == "Gaussian":
        return F.lit(1.0) - F.exp(-3.0 * u * u)
    elif model in ("Linear", "LinearDrift", "QuadDrift"):
        return F.least(u, F.lit(1.0))
    else:
        raise ValueError(f"unknown model {model!r}")
    return F.when(u < 1.0, rise).otherwise(1.0)


def fit_semivariogram(
    bins: DataFrame, models: Sequence[str] = MODELS, n_lags: int = N_LAGS, by: str | None = None
) -> DataFrame:
    """``lag, model, a, nugget, sill, misfit``: best of the candidate ranges 1..n_lags lags, for every group of bins.

    For a given range the model is linear in nugget and sill, so their weighted least-squares solution
    is closed-form; weights are pairs over squared distance. Works on bins only, a few rows per lag.
    """
    rows = bins.withColumn("w", F.col("n_pairs") / (F.col("h") * F.col("h")))
    rows = rows.withColumn("a", F.explode(F.sequence(F.lit(1), F.lit(n_lags)))).withColumn(
        "a", F.col("a") * F.col("lag")
    )
    shapes = F.explode(
        F.array(*[F.struct(F.lit(m).alias("model"), shape(m, F.col("h"), F.col("a")).alias("f")) for m in models])
    )
    group = [] if by is None else [by]
    rows = rows.withColumn("_m", shapes).select(*group, "lag", F.col("_m.model").alias("model"), "a", "w", F.col("_m.f").alias("f"), F.col("gamma").alias("y"))
    w, f, y = F.col("w"), F.col("f"), F.col("y")
    key = [*group, "lag", "model", "a"]
    sums = rows.groupBy(*key).agg(
        F.sum(w).alias("sw"),
        F.sum(w * f).alias("sf"),
        F.sum(w * f * f).alias("sff"),
        F.sum(w * y).alias("sy"),
        F.sum(w * f * y).alias("sfy"),
    )
    det = F.col("sw") * F.col("sff") - F.col("sf") * F.col("sf")
    # Equal shapes in all bins leave the slope undetermined; round-off must not decide it.
    usable = det > F.lit(1e-9) * F.col("sw") * F.col("sff")
    solved = (
        sums.withColumn("c", F.when(usable, F.try_divide(F.col("sw") * F.col("sfy") - F.col("sf") * F.col("sy"), det)))
        .withColumn("c0", (F.col("sy") - F.col("c") * F.col("sf")) / F.col("sw"))
        .withColumn("c", F.when(F.col("c0") < 0, F.try_divide(F.col("sfy"), F.col("sff"))).otherwise(F.col("c")))
        .withColumn("c0", F.when(F.col("c0") < 0, F.lit(0.0)).otherwise(F.col("c0")))
    )
    flat = F.col("c").isNull() | (F.col("c") < 0)
    solved = solved.select(
        *key,
        F.when(flat, F.col("sy") / F.col("sw")).otherwise(F.col("c0")).alias("nugget"),
        F.when(flat, F.lit(0.0)).otherwise(F.col("c")).alias("sill"),
        (F.col("sy") / F.col("sw")).alias("mean_y"),
    )
    err = y - F.col("nugget") - F.col("sill") * f
    dev = y - F.col("mean_y")
    scored = (
        rows.join(solved, key)
        .groupBy(*key, "nugget", "sill")
        .agg(F.sum(w * err * err).alias("rss"), F.sum(w * dev * dev).alias("tss"))
        # relative to the flat fit and rounded: ties between ranges go to the shorter one
        .withColumn("misfit", F.round(F.coalesce(F.try_divide(F.col("rss"), F.col("tss")), F.lit(1.0)), 9))
    )
    best = F.min_by(F.struct("a", "nugget", "sill", "misfit"), F.struct("misfit", "a"))
    return scored.groupBy(*group, "lag", "model").agg(best.alias("_b")).select(*group, "lag", "model", "_b.*")
