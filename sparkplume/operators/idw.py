"""Inverse-distance weighting for whole sweeps.

Pairs of a cell and a point are visited once, whatever the number of runs. They are summed per power
and search setting that includes it, all in one aggregate per target; a run is read off the target's row.
Sums combine before the exchange, so crowded places do not concentrate in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sparkplume.operators.neighbors import grid_targets, knn, neighbor_rows, radius_rows
from sparkplume.operators.spatial import Grid, make_grid
from sparkplume.session import materialize


def _band(measure: Column, limits: Sequence) -> Column:
    out = None
    for i, limit in enumerate(limits):
        out = F.when(measure <= limit, i) if out is None else out.when(measure <= limit, i)
    return out


def _band_sums(pairs: DataFrame, band: Column, bands: int, powers: Sequence[float], head: str = "") -> DataFrame:
    """One row per target: for each band, what it and all smaller ones hold.

    ``n``, exact ``hits`` and their ``hit_z``, and numerator and denominator per power, all followed by the band's number.
    """
    d, z = F.col("d"), F.col("z")
    parts = {"n": F.lit(1), "hits": F.when(d == 0, 1).otherwise(0), "hit_z": F.when(d == 0, z).otherwise(0.0)}
    for i, p in enumerate(powers):
        w = F.when(d > 0, F.lit(1.0) / F.pow(d, F.lit(float(p)))).otherwise(0.0)
        parts |= {f"num{i}": w * z, f"den{i}": w}
    rows = pairs.select("target_id", band.alias("band"), *[c.alias(k) for k, c in parts.items()]).where("band IS NOT NULL")
    sums = [F.sum(F.when(F.col("band") <= b, F.col(k))).alias(f"{head}{k}_{b}") for b in range(bands) for k in parts]
    return rows.groupBy("target_id").agg(*sums)


def _value(band: int, power: int, head: str = "") -> Column:
    """A point exactly at the target gives its own value; several there, their mean."""
    hits = F.col(f"{head}hits_{band}")
    mean = F.try_divide(F.col(f"{head}num{power}_{band}"), F.col(f"{head}den{power}_{band}"))
    return F.when(hits > 0, F.col(f"{head}hit_z_{band}") / hits).otherwise(mean)


def _per_run(sums: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``run_id, target_id, value``: the runs are read off a target's row, without another exchange."""
    runs = F.array(*[F.struct(F.lit(r).alias("run_id"), v.alias("value")) for r, v in values.items()])
    return sums.select("target_id", F.inline(runs)).select("run_id", "target_id", "value")


def _near_sums(neighbors: DataFrame, counts: Sequence[int], powers: Sequence[float]) -> DataFrame:
    return _band_sums(neighbor_rows(neighbors), _band(F.col("rank"), counts), len(counts), powers)


def idw_variable(neighbors: DataFrame, runs: Sequence[Row]) -> DataFrame:
    """``run_id, target_id, value`` from the nearest ``num_points`` neighbours of each target."""
    powers = sorted({r["power"] for r in runs})
    counts = sorted({int(r["num_points"]) for r in runs})
    values = {r["run_id"]: _value(counts.index(int(r["num_points"])), powers.index(r["power"])) for r in runs}
    return _per_run(_near_sums(neighbors, counts, powers), values)


def idw_fixed(
    points: DataFrame, neighbors: DataFrame, runs: Sequence[Row], grid: Grid, cells: DataFrame | None = None, by: str | None = None
) -> DataFrame:
    """All points within ``distance``; where they are fewer than ``f_pts``, the nearest ``f_pts``.

    The sums within the radius come from scattering the points over cells and never form a list of
    neighbours, so there is no limit on how many points a radius may hold.
    """
    powers = sorted({r["power"] for r in runs})
    radii = sorted({r["distance"] for r in runs})
    counts = sorted({int(r["f_pts"]) for r in runs})
    pairs = radius_rows(points, radii[-1], grid, cells, by)
    wide = _band_sums(pairs, _band(F.col("d"), radii), len(radii), powers, "wide_")
    values = {}
    for r in runs:
        power, band, need = powers.index(r["power"]), radii.index(r["distance"]), int(r["f_pts"])
        enough = F.when(F.col(f"wide_n_{band}") >= need, _value(band, power, "wide_"))
        values[r["run_id"]] = F.coalesce(enough, _value(counts.index(need), power))
    return _per_run(_near_sums(neighbors, counts, powers).join(wide, "target_id", "left"), values)


def idw_sweep(
    points: DataFrame, grid: Grid, runs: Sequence[Row], cells: DataFrame | None = None, by: str | None = None
) -> DataFrame:
    """Raster rows ``run_id, cell_id, row, col, value`` of all runs.

    ``cells`` restricts the work to some cells (a mask, or the cells an evaluation reads). The
    neighbours are searched once for the largest setting and written, then serve all runs. ``by`` numbers groups
    of points and cells: every group has rasters of its own, named by that column, in the same job.
    """
    points = materialize(points.select("system_id", "x", "y", "z", *([] if by is None else [by])), "train")
    cells = cells if cells is not None else make_grid(points.sparkSession, grid)
    if not runs:
        raise ValueError("no runs")
    variable = [r for r in runs if r["type"] == "variable"]
    fixed = [r for r in runs if r["type"] == "fixed"]
    k = max([int(r["num_points"]) for r in variable] + [int(r["f_pts"]) for r in fixed])
    neighbors = materialize(knn(grid_targets(cells, grid, by), points, k, by=by), "neighbors")
    parts = []
    if variable:
        parts.append(idw_variable(neighbors, variable))
    if fixed:
        parts.append(idw_fixed(points, neighbors, fixed, grid, cells, by))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return raster_rows(out, grid, by)


def raster_rows(values: DataFrame, grid: Grid, by: str | None = None) -> DataFrame:
    """Name the target of a grid prediction by its cell, and its group if there are groups."""
    rest = [c for c in values.columns if c not in ("run_id", "target_id")]
    group = [] if by is None else [F.expr(f"target_id div {grid.size}").alias(by)]
    cell = "target_id" if by is None else f"target_id % {grid.size}"
    return values.select(
        *group,
        "run_id",
        F.expr(cell).alias("cell_id"),
        F.expr(f"({cell}) div {grid.cols}").alias("row"),
        F.expr(f"({cell}) % {grid.cols}").alias("col"),
        *rest,
    )
