"""Ordinary and universal kriging with prediction variance.

Spark finds the neighbours and spreads the targets. Inside a task, systems of equal size are solved
together as one stack, directly. A fixed radius may hold thousands of places: blocks of neighbouring
targets meet their places once, and their large systems are solved by iteration over shared covariances
(``large_systems``), without the square of their places in memory. What does not converge there is solved directly, with it.
Weights depend on the model, its range and the share of the nugget: runs that agree in them share the solution.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sparkplume.operators.large_systems import solve_together
from sparkplume.operators.neighbors import grid_targets, knn, radius_blocks
from sparkplume.operators.spatial import Grid, make_grid, usable
from sparkplume.session import materialize

SCHEMA = "run_id string, target_id long, value double, variance double, status string"
COLUMNS = {"run_id": object, "target_id": "int64", "value": float, "variance": float, "status": object}
DRIFT_ORDER = {"LinearDrift": 1, "QuadDrift": 2}
UNBOUNDED = ("Exponential", "Gaussian")  # models that never reach their sill
STACK_DOUBLES = 4_000_000  # size of one stack of systems
DIRECT_PLACES = 256  # a system of more places is solved by iteration, if its target has neighbours to share it with
SHARED_DOUBLES = 4_000_000  # of the right sides that are solved together; those of one target may have more


def merge_places(points: DataFrame, by: str | None = None) -> DataFrame:
    """Points at one location (of one group) become one with their mean; equal locations would make systems singular."""
    group = [] if by is None else [by]
    return (
        usable(points, *group)
        .groupBy(*group, "x", "y")
        .agg(F.min("system_id").alias("system_id"), F.avg("z").alias("z"))
        .select("system_id", "x", "y", "z", *group)
    )


def _rise(model: str, u: np.ndarray) -> np.ndarray:
    """Unit-sill variogram shape at scaled distance u."""
    v = np.minimum(u, 1.0)
    if model == "Spherical":
        return 1.5 * v - 0.5 * v**3
    if model == "Circular":
        return 1 - 2 / np.pi * np.arccos(v) + 2 / np.pi * v * np.sqrt(1 - v * v)
    if model == "Exponential":
        return 1 - np.exp(-3 * u)
    if model == "Gaussian":
        return 1 - np.exp(-3 * u * u)
    return v


def _nugget(run: dict) -> float:
    total = run["nugget"] + run["sill"]
    return run["nugget"] / total if total > 0 else 0.0


def _gamma(run: dict, h: np.ndarray) -> np.ndarray:
    """Semivariance relative to nugget plus sill; weights do not depend on that scale."""
    nugget = _nugget(run)
    return np.where(h > 0, nugget + (1 - nugget) * _rise(run["model"], h / run["a"]), 0.0)


def _drift(order: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    terms = [np.ones_like(x)]
    if order >= 1:
        terms += [x, y]
    if order >= 2:
        terms += [x * x, x * y, y * y]
    return np.stack(terms, axis=-1)


def _solve_stack(
    run: dict, dist: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predictions, variances relative to nugget plus sill, and an ok flag for targets at the origin of their coordinates."""
    b, n = x.shape
    scale = np.maximum(np.hypot(x, y).max(axis=1, keepdims=True), 1e-9)
    f = _drift(DRIFT_ORDER.get(run["model"], 0), x / scale, y / scale)
    p = f.shape[-1]
    lhs = np.zeros((b, n + p, n + p))
    lhs[:, :n, :n] = _gamma(run, dist)
    lhs[:, :n, n:] = f
    lhs[:, n:, :n] = f.transpose(0, 2, 1)
    rhs = np.zeros((b, n + p))
    rhs[:, :n] = _gamma(run, np.hypot(x, y))
    rhs[:, n] = 1.0
    w = np.full((b, n + p), np.nan)
    try:
        w = np.linalg.solve(lhs, rhs[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:  # one singular system fails the stack
        for i in range(b):
            try:
                w[i] = np.linalg.solve(lhs[i], rhs[i])
            except np.linalg.LinAlgError:
                pass
    miss = np.abs(np.einsum("bij,bj->bi", lhs, w) - rhs).max(axis=1)
    ok = np.isfinite(w).all(axis=1) & (miss < 1e-6) & (np.abs(w[:, :n]).max(axis=1) < 1e6)
    value = (w[:, :n] * z).sum(axis=1)
    return value, np.maximum((w * rhs).sum(axis=1), 0.0), ok


def _used(run: dict, d: np.ndarray) -> int:
    """How many of the neighbours, ordered by distance, the run uses."""
    if run["type"] == "variable":
        return min(len(d), int(run["num_points"]))
    return max(int(np.searchsorted(d, run["distance"], side="right")), min(len(d), int(run["f_pts"])))


def _setting(run: dict) -> tuple:
    return tuple(run.get(c) for c in ("type", "num_points", "distance", "f_pts"))


def _system(run: dict) -> tuple:
    """What weights depend on besides the places: terms of the drift, shape, range, share of the nugget.

    Variances are those of a run whose nugget and sill add up to one; a share of one leaves nothing of the shape.
    """
    shape = "Linear" if run["model"] in DRIFT_ORDER else run["model"]
    share = _nugget(run)
    return (_terms(run), "Nugget", 0.0, 1.0) if share == 1.0 else (_terms(run), shape, run["a"], share)


@dataclass(frozen=True)
class Places:
    """Places of a block of targets: their coordinates and values, and per target its own ones ordered by distance."""

    x: np.ndarray
    y: np.ndarray
    z: np.ndarray
    tx: np.ndarray
    ty: np.ndarray
    own: list[np.ndarray]


def _joint(places: Places, systems: list[tuple[int, int]]) -> np.ndarray:
    """Which places the systems (target, number of places) have."""
    mine = np.zeros(len(places.x), dtype=bool)
    for t, n in systems:
        mine[places.own[t][:n]] = True
    return mine


def _neighbouring(
    places: Places, systems: list[tuple[int, int]], side: float, sides: int
) -> Iterator[list[tuple[int, int]]]:
    """Systems of targets within a square, halved until their right sides have ``SHARED_DOUBLES`` or they are alone."""
    todo = [systems]
    while todo:
        some = todo.pop()
        at = [t for t, _ in some]
        axis = max((places.tx, places.ty), key=lambda c: np.ptp(c[at]))
        wide = np.ptp(axis[at]) > side
        if len(some) > 1 and (wide or np.count_nonzero(_joint(places, some)) * len(some) * sides > SHARED_DOUBLES):
            some = sorted(some, key=lambda s: axis[s[0]])
            todo += [some[len(some) // 2 :], some[: len(some) // 2]]
        else:
            yield some


class _Together:
    """Systems of neighbouring targets over the places that any of them has."""

    def __init__(self, places: Places, systems: list[tuple[int, int]], order: int):
        joint = _joint(places, systems)
        at = np.flatnonzero(joint)
        where = np.cumsum(joint) - 1
        self.x, self.y, self.z = places.x[at], places.y[at], places.z[at]
        self.index, self.distance, self.drift = [], [], []
        self.member = np.zeros((len(systems), len(at)), dtype=bool)
        for i, (t, n) in enumerate(systems):
            mine = where[places.own[t][:n]]
            x, y = self.x[mine] - places.tx[t], self.y[mine] - places.ty[t]
            h = np.hypot(x, y)
            scale = max(h.max(), 1e-9)
            self.member[i, mine] = True
            self.index.append(mine)
            self.distance.append(h)
            self.drift.append(_drift(order, x / scale, y / scale))

    def solve(self, runs: Sequence[dict]) -> list[dict[tuple, tuple]]:
        """Per system its (value, variance) by what weights depend on, for ``runs`` that share their covariances.

        What is not solved is left out.
        """
        terms = max(_terms(r) for r in runs)
        run = runs[0]
        rhs = np.zeros((len(self.x), len(self.index), terms + 1))
        for i, mine in enumerate(self.index):
            rhs[mine, i, :terms] = self.drift[i][:, :terms]
            rhs[mine, i, terms] = 1 - _gamma(run, self.distance[i])
        part = 1 - _nugget(run)
        found, product, ok = solve_together(
            lambda h: part * (1 - _rise(run["model"], h / run["a"])),
            self.x,
            self.y,
            self.member,
            rhs,
            np.inf if run["model"] in UNBOUNDED else run["a"],
        )
        out: list[dict[tuple, tuple]] = [{} for _ in self.index]
        for i in np.flatnonzero(ok):
            mine = self.index[i]
            z, given, inverse, back = self.z[mine], rhs[mine, i], found[mine, i], product[mine, i]
            for r in runs:
                p = _terms(r)
                f, c0 = given[:, :p], given[:, terms]
                unit = np.zeros(p)
                unit[0] = 1.0
                try:
                    m = np.linalg.solve(f.T @ inverse[:, :p], unit - f.T @ inverse[:, terms])
                except np.linalg.LinAlgError:
                    continue
                w = inverse[:, terms] + inverse[:, :p] @ m
                miss = max(np.abs(back[:, terms] + back[:, :p] @ m - c0 - f @ m).max(), np.abs(f.T @ w - unit).max())
                if miss < 1e-9 and np.abs(w).max() < 1e6:
                    out[i][_system(r)] = (w @ z, max(w @ (1 - c0) + m[0], 0.0))
        return out


def _solve_large(
    places: Places, large: dict[float, list[tuple[int, int]]], fits: dict[tuple, dict]
) -> dict[tuple, tuple[float, float]]:
    """(value, variance) by system, number of places and target of the ``large`` systems, which are given by radius."""
    shared: dict[tuple, list[dict]] = {}
    for key, run in fits.items():
        shared.setdefault(key[1:], []).append(run)
    terms = max(_terms(r) for r in fits.values())
    order = max(DRIFT_ORDER.get(r["model"], 0) for r in fits.values())
    out: dict[tuple, tuple[float, float]] = {}
    vain: set[tuple] = set()  # models whose systems did not converge
    for radius, systems in large.items():
        for some in _neighbouring(places, systems, max(radius / 3, 1e-9), terms + 1):
            together = _Together(places, some, order)
            for model, runs in shared.items():
                if model in vain:
                    continue
                got = together.solve(runs)
                if not any(got):
                    vain.add(model)
                out |= {(key, n, t): v for (t, n), by_key in zip(some, got) for key, v in by_key.items()}
    return out


def _krige_batch(
    ids: np.ndarray, parts: list[tuple], runs: Sequence[dict], places: Places | None = None
) -> pd.DataFrame:
    """All runs at the targets of one batch.

    ``parts`` holds per target (d, x, y, z), coordinates relative to the target. Runs differ in their
    model and in how many neighbours they use; each such pair is solved once, whichever runs share it (``_system``).
    With ``places``, targets share the work on systems of more than ``DIRECT_PLACES``.
    """
    fits = {_system(r): r for r in runs}
    used = {_setting(r): np.array([_used(r, d) for d, *_ in parts], dtype=int) for r in runs}
    solved: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    large: dict[float, list[tuple[int, int]]] = {}
    if places is not None:
        known = set()
        for run in sorted(runs, key=lambda r: r["distance"]):
            for t, n in enumerate(used[_setting(run)].tolist()):
                if n > DIRECT_PLACES and (t, n) not in known:
                    known.add((t, n))
                    large.setdefault(run["distance"], []).append((t, n))
    shared = _solve_large(places, large, fits) if large else {}
    for n in np.unique(np.concatenate(list(used.values()))):
        every = np.flatnonzero(np.any([u == n for u in used.values()], axis=0))
        for key in fits:
            solved[key, n] = (np.full(len(ids), np.nan), np.full(len(ids), np.nan), np.zeros(len(ids), dtype=bool))
            for t in every:
                if (key, n, t) in shared:
                    for to, source in zip(solved[key, n], (*shared[key, n, t], True)):
                        to[t] = source
        where = every[[any((key, n, t) not in shared for key in fits) for t in every]]
        size = max(1, STACK_DOUBLES // (n + 6) ** 2)
        for s in range(0, len(where), size):
            at = where[s : s + size]
            x, y, z = (np.stack([parts[i][c][:n] for i in at]) for c in (1, 2, 3))
            dist = np.hypot(x[:, :, None] - x[:, None, :], y[:, :, None] - y[:, None, :])
            for key, run in fits.items():
                if n < _terms(run):
                    continue
                value, variance, ok = solved[key, n]
                left = ~ok[at]
                if left.any():
                    value[at[left]], variance[at[left]], ok[at[left]] = _solve_stack(
                        run, dist[left], x[left], y[left], z[left]
                    )
    columns: dict[str, list[np.ndarray]] = {c: [] for c in ("run_id", "target_id", "value", "variance", "status")}
    for run in runs:
        use = used[_setting(run)]
        value, variance, ok = np.full(len(ids), np.nan), np.full(len(ids), np.nan), np.zeros(len(ids), dtype=bool)
        for n in np.unique(use):
            mine = use == n
            for to, source in zip((value, variance, ok), solved[_system(run), n]):
                to[mine] = source[mine]
        variance *= run["nugget"] + run["sill"]
        value[~ok], variance[~ok] = np.nan, np.nan
        columns["run_id"].append(np.full(len(ids), run["run_id"], dtype=object))
        columns["target_id"].append(ids)
        columns["value"].append(value)
        columns["variance"].append(variance)
        columns["status"].append(
            np.where(ok, "ok", np.where(use < _terms(run), "too few points", "singular")).astype(object)
        )
    return pd.DataFrame({c: np.concatenate(v) for c, v in columns.items()})


def _terms(run: dict) -> int:
    return (1, 3, 6)[DRIFT_ORDER.get(run["model"], 0)]


@dataclass(frozen=True)
class Groups:
    """Targets numbered through groups of ``size`` cells; a run belongs to the group that its field ``by`` names."""

    by: str
    size: int


def _by_group(runs: Sequence[Row], groups: Groups | None) -> dict[int, list[dict]]:
    """The runs of each group; without groups all are those of group 0."""
    out: dict[int, list[dict]] = {}
    for r in runs:
        plain = r.asDict() if isinstance(r, Row) else dict(r)
        out.setdefault(0 if groups is None else plain[groups.by], []).append(plain)
    return out


def _krige_groups(
    ids: np.ndarray, parts: list[tuple], runs: dict[int, list[dict]], groups: Groups | None
) -> Iterator[pd.DataFrame]:
    """The targets of each group with the runs of that group; a group without runs gives no rows."""
    number = np.zeros(len(ids), dtype=np.int64) if groups is None else ids // groups.size
    for group in np.unique(number):
        at = np.flatnonzero(number == group)
        if int(group) in runs:
            yield _krige_batch(ids[at], [parts[i] for i in at], runs[int(group)])


def _spread(df: DataFrame, by: str = "target_id", each: int = 4) -> DataFrame:
    """Partition for the solver. Its cost is in the solving and not in the bytes, so the number of
    tasks follows the cores and not the size of the input."""
    return df.repartition(each * df.sparkSession.sparkContext.defaultParallelism, by)


def _clean(df: DataFrame) -> DataFrame:
    """A failed target keeps its row with NULL and the reason."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("value", "variance")})


def krige(neighbors: DataFrame, runs: Sequence[Row], groups: Groups | None = None) -> DataFrame:
    """Predict at each target for each run from its sorted ``neighbors`` array (see ``knn``).

    A run holds ``run_id, model, a, nugget, sill`` and either type ``variable`` with ``num_points`` or
    type ``fixed`` with ``distance, f_pts``; for the latter the array must reach over the radius. The
    array crosses to Python once for all runs. With ``groups`` a target has the runs of its own group.
    """
    plain = _by_group(runs, groups)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, parts = batch["target_id"].to_numpy(), []
            for tx, ty, d, x, y, z in zip(batch["tx"], batch["ty"], batch["d"], batch["x"], batch["y"], batch["z"]):
                parts.append((np.asarray(d), np.asarray(x) - tx, np.asarray(y) - ty, np.asarray(z)))
            yield from _krige_groups(ids, parts, plain, groups)

    n = F.col("neighbors")
    flat = neighbors.select("target_id", "tx", "ty", *[n[c].alias(c) for c in ("d", "x", "y", "z")])
    return _clean(_spread(flat).mapInPandas(solve, SCHEMA))


def _block(targets: pd.DataFrame, rows: pd.DataFrame, radius: float) -> tuple[np.ndarray, list[tuple], Places]:
    """The targets of one block that have neighbours, their sorted neighbours, and all places of the block."""
    targets = targets.sort_values("target_id")
    near = rows[rows["target_id"] < 0].sort_values("id", kind="stable")
    beyond = rows[rows["target_id"] >= 0].sort_values(["d", "id"])
    x, y, z = (np.concatenate([near[c].to_numpy(), beyond[c].to_numpy()]) for c in ("x", "y", "z"))
    ids, tx, ty = (targets[c].to_numpy() for c in ("target_id", "tx", "ty"))
    after, far = beyond["target_id"].to_numpy(), beyond["d"].to_numpy()
    parts, own, kept = [], [], []
    for i in range(len(ids)):
        dx, dy = x[: len(near)] - tx[i], y[: len(near)] - ty[i]
        d = np.sqrt(dx * dx + dy * dy)
        mine = np.flatnonzero(d <= radius)
        mine = mine[np.argsort(d[mine], kind="stable")]
        more = np.flatnonzero(after == ids[i])
        d, mine = np.concatenate([d[mine], far[more]]), np.concatenate([mine, len(near) + more])
        if len(mine):
            kept.append(i)
            own.append(mine)
            parts.append((d, x[mine] - tx[i], y[mine] - ty[i], z[mine]))
    return ids[kept], parts, Places(x, y, z, tx[kept], ty[kept], own)


def krige_blocks(
    targets: DataFrame, places: DataFrame, radius: float, runs: Sequence[Row], groups: Groups | None = None
) -> DataFrame:
    """As ``krige`` for runs of type ``fixed`` from the two sides of ``radius_blocks``, one task group per block."""
    plain = _by_group(runs, groups)
    empty = pd.DataFrame({c: pd.Series(dtype=t) for c, t in COLUMNS.items()})

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, parts, block = _block(left, right, radius)
        group = 0 if groups is None or not len(ids) else int(ids[0]) // groups.size  # a block is of one group
        if not len(ids) or group not in plain:
            return empty
        return _krige_batch(ids, parts, plain[group], block)

    left, right = (_spread(df, "block", 16).groupBy("block") for df in (targets, places))
    return _clean(left.cogroup(right).applyInPandas(solve, SCHEMA))


def krige_sweep(
    points: DataFrame, grid: Grid, runs: Sequence[Row], cells: DataFrame | None = None, by: str | None = None
) -> DataFrame:
    """``run_id, target_id, value, variance, status`` of all runs, fixed and variable.

    ``by`` numbers groups of points, cells and runs: a run is a row of one group, with that group's model, and all
    groups share one search. Targets are numbered on through the groups, ``cells`` must then be given.
    """
    groups = None if by is None else Groups(by, grid.size)
    points = materialize(merge_places(points, by), "places")
    cells = cells if cells is not None else make_grid(points.sparkSession, grid)
    cells = materialize(cells, "cells")
    parts = []
    variable = [r for r in runs if r["type"] == "variable"]
    if variable:
        k = max(int(r["num_points"]) for r in variable)
        neighbors = materialize(knn(grid_targets(cells, grid, by), points, k, by=by), "neighbors")
        parts.append(krige(neighbors, variable, groups))
    fixed = [r for r in runs if r["type"] == "fixed"]
    if fixed:
        radius = float(max(r["distance"] for r in fixed))
        targets, near = radius_blocks(points, radius, max(int(r["f_pts"]) for r in fixed), grid, cells, by)
        parts.append(krige_blocks(targets, near, radius, fixed, groups))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
