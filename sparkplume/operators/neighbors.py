"""Nearest-neighbour and radius search.

``knn`` is exact and keeps working when a small area holds a third of all points. Points are counted
in nested square tiles. For each target, the counts and bounding boxes of the tiles give an upper
bound for the distance of the k-th neighbour; tiles beyond it leave, the others are opened one level
deeper, until small tiles remain. Only then are points met. No step pairs a target with all points
of a crowded tile.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkplume.operators.spatial import Grid, disc_cells, make_grid, usable
from sparkplume.operators.tiles import BOX, build_tiles, literal
from sparkplume.session import materialize

PAIRS_PER_TASK = 10_000_000  # of a cell and a point in its disc
BLOCKS = 144  # squares of cells a grid is cut into at least, where it has that many cells


def knn(targets: DataFrame, points: DataFrame, k: int, leaf: int | None = None, by: str | None = None) -> DataFrame:
    """The k nearest points of each target, ordered by distance, then by id.

    ``targets(target_id, tx, ty)`` with unique ids, ``points(system_id, x, y, z)``. Result:
    ``target_id, tx, ty, neighbors array<struct<d, id, x, y, z>>``. A target gets fewer than k entries
    only when there are fewer than k points, and none when it has no location. With ``by``, a column of both sides,
    a target meets the points of its own group only; all groups share one search.
    """
    leaf = leaf or max(32, k // 2)
    # At one place at most k points can be among the k nearest: those with the smallest ids. The rank
    # limit is applied before the exchange too, so copies of one place do not travel.
    group = [] if by is None else [by]
    place = Window.partitionBy(*group, "x", "y").orderBy("system_id")
    points = materialize(
        usable(points, *group)
        .withColumn("_rn", F.row_number().over(place))
        .where(F.col("_rn") <= k)
        .drop("_rn"),
        "points",
    )
    targets = targets.select("target_id", "tx", "ty", *group)
    tiles = build_tiles(points, leaf, by=by)
    entry = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("id", points.schema["system_id"].dataType)])
    for c in ("x", "y", "z"):
        entry = entry.add(c, T.DoubleType())
    none = F.array().cast(T.ArrayType(entry))
    if tiles is None:
        return targets.drop(*group).withColumn("neighbors", none)
    located = "tx IS NOT NULL AND ty IS NOT NULL AND NOT isnan(tx) AND NOT isnan(ty)"
    lost = targets.where(f"NOT ({located})").drop(*group).withColumn("neighbors", none)
    targets = targets.where(located)

    cols = ("tile", "n", *BOX)
    top = tiles.table.where("level = 1").select(*cols)
    if by is None:
        every_top = ", ".join(
            f"named_struct('tile', {literal(r.tile)}, 'n', {r.n}L, " + ", ".join(f"'{c}', {r[c]!r}D" for c in BOX) + ")"
            for r in top.collect()  # at most 16 rows
        )
        opened = targets.selectExpr("*", f"inline(array({every_top}))")
    else:
        top = top.withColumn(by, F.col("tile.g"))
        opened = targets.join(top, by).drop(by)
        alone = targets.join(top.select(by).distinct(), by, "left_anti")  # groups without points, and no group
        lost = lost.union(alone.select("target_id", "tx", "ty").withColumn("neighbors", none))
    reach = _within_bound(opened, k)
    inner = tiles.inner()
    for level in range(2, tiles.last + 1):
        below = (
            tiles.table.where(f"level = {level}")
            .join(inner, "parent", "left_semi")
            .selectExpr("parent", *[f"{c} AS c_{c}" for c in cols])
        )
        opened = reach.join(below, F.expr("tile = parent"), "left").selectExpr(
            "target_id", "tx", "ty", *[f"coalesce(c_{c}, {c}) AS {c}" for c in cols]
        )
        reach = _within_bound(opened, k)

    tagged = tiles.levels(points).select("system_id", "x", "y", "z", "tile")
    found = (
        reach.select("target_id", "tx", "ty", "tile", "bound")
        .join(tagged, "tile")
        .withColumn("d", F.expr("sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty))"))
        .where("d <= bound")
    )
    row = "struct(d, system_id AS id, x, y, z)"
    nearest = found.groupBy("target_id", "tx", "ty").agg(
        F.expr(f"slice(sort_array(collect_list({row})), 1, {k})").alias("neighbors")
    )
    return nearest.union(lost)


def _within_bound(tiles: DataFrame, k: int) -> DataFrame:
    """Drop tiles that lie wholly beyond the bound of the k-th distance.

    Taking tiles by their farthest corner until they hold k points gives the bound.
    """
    near_x, near_y = "greatest(ax - tx, tx - bx, 0D)", "greatest(ay - ty, ty - by, 0D)"
    far_x, far_y = "greatest(abs(ax - tx), abs(bx - tx))", "greatest(abs(ay - ty), abs(by - ty))"
    upto = "PARTITION BY target_id ORDER BY far, tile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    own = ("target_id", "tx", "ty", "tile", "n", "ax", "bx", "ay", "by")
    return (
        tiles.selectExpr(
            *own,
            f"sqrt({near_x} * {near_x} + {near_y} * {near_y}) AS near",
            f"sqrt({far_x} * {far_x} + {far_y} * {far_y}) AS far",
        )
        .selectExpr("*", f"sum(n) OVER ({upto}) AS held")
        .selectExpr(
            *own,
            "near",
            f"coalesce(min(CASE WHEN held >= {k} THEN far END) OVER (PARTITION BY target_id), double('inf')) AS bound",
        )
        .where("near <= bound")
        .drop("near")
    )


def neighbor_rows(neighbors: DataFrame) -> DataFrame:
    """One row per target and neighbour with its 1-based rank."""
    return neighbors.selectExpr("target_id", "tx", "ty", "posexplode(neighbors) AS (pos, n)").selectExpr(
        "target_id", "tx", "ty", "bigint(pos + 1) AS rank", "n.d", "n.id", "n.x", "n.y", "n.z"
    )


def grid_targets(cells: DataFrame, grid: Grid | None = None, by: str | None = None) -> DataFrame:
    group = [] if by is None else [by]
    return cells.select(grid_target(grid, by).alias("target_id"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), *group)


def grid_target(grid: Grid, by: str | None = None):
    """The target of a cell: its number, counted on through the groups if ``by`` numbers them."""
    return F.col("cell_id") if by is None else F.col(by) * F.lit(grid.size) + F.col("cell_id")


def _spread(points: DataFrame, radius: float, grid: Grid, by: str | None) -> DataFrame:
    """Deal points over tasks by the cells of their discs: a few bytes of points are very many pairs.

    A task has points of neighbouring rows of the grid, and of one group where it can, so that its sums are of few cells.
    """
    cells = min(math.pi * (radius / grid.cell + 1) ** 2, grid.size)
    tasks = math.ceil(points.count() * cells / PAIRS_PER_TASK)
    group = [] if by is None else [by]
    return points.repartitionByRange(max(1, tasks), *group, "y", "x", "system_id")


def radius_rows(
    points: DataFrame, radius: float, grid: Grid, cells: DataFrame | None = None, by: str | None = None
) -> DataFrame:
    """One row per cell and point within ``radius``. Work grows with the points times the disc's cells.

    ``points`` are counted, so they should be written already. With ``by``, a column of whole numbers in ``points`` and
    ``cells``, a cell meets the points of its own group.
    """
    points = _spread(usable(points, *([] if by is None else [by])), radius, grid, by)
    pairs = disc_cells(points, radius, grid).select(
        grid_target(grid, by).alias("target_id"),
        grid.center_x(F.col("col")).alias("tx"),
        grid.center_y(F.col("row")).alias("ty"),
        F.col("dist").alias("d"),
        F.col("system_id").alias("id"),
        "x",
        "y",
        "z",
    )
    if cells is None:
        return pairs
    return pairs.join(cells.select(grid_target(grid, by).alias("target_id")), "target_id", "left_semi")


def radius_neighbors(
    points: DataFrame,
    radius: float,
    min_points: int,
    grid: Grid,
    cells: DataFrame | None = None,
    by: str | None = None,
) -> DataFrame:
    """All points within the radius of each cell and, where they are too few, the nearest ``min_points``.

    Result: ``target_id, tx, ty, d, id, x, y, z``. The two sources do not overlap: the nearest points
    contribute only those beyond the radius. With ``by``, as in ``radius_rows``, groups meet only themselves.
    """
    points = materialize(points, "points")
    targets = grid_targets(cells if cells is not None else make_grid(points.sparkSession, grid), grid, by)
    beyond = (
        neighbor_rows(knn(targets, points, min_points, by=by)).where(F.col("d") > radius).drop("rank")
    )
    return radius_rows(points, radius, grid, cells, by).unionByName(beyond)


def radius_blocks(
    points: DataFrame, radius: float, min_points: int, grid: Grid, cells: DataFrame, by: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """What ``radius_neighbors`` pairs, not yet paired: squares of cells, and the points that any cell of them may reach.

    Results: ``block, target_id, tx, ty`` and ``block, target_id, d, id, x, y, z``. A point is there once for a block, with -1 as
    its target; a point that is one of the nearest ``min_points`` of a cell beyond its radius is there for that cell.
    ``points`` and ``cells`` should be written already. With ``by``, as in ``radius_rows``, a block is of one group.
    """
    side = max(1, min(round(radius / 2 / grid.cell), math.isqrt(grid.size // BLOCKS)))
    squares = Grid(grid.x0, grid.y0, grid.cell * side, -(-grid.rows // side), -(-grid.cols // side))
    cell = f"(target_id % {grid.size})"
    group = "" if by is None else f"target_id div {grid.size} * {squares.size} + "
    number = f"{group}{cell} div {grid.cols * side} * {squares.cols} + {cell} % {grid.cols} div {side} AS block"
    targets = grid_targets(cells, grid, by)
    own = targets.selectExpr(number, "target_id", "tx", "ty")
    # the centres of the cells of a square are at most half a diagonal from its own
    reach = radius + 0.7072 * (side - 1) * grid.cell
    near = disc_cells(usable(points, *([] if by is None else [by])), reach, squares)
    near = near.withColumn("block", grid_target(squares, by)).join(own.select("block").distinct(), "block", "left_semi")
    near = near.selectExpr("block", "-1L AS target_id", "CAST(NULL AS DOUBLE) AS d", "system_id AS id", "x", "y", "z")
    beyond = neighbor_rows(knn(targets, points, min_points, by=by)).where(F.col("d") > radius)
    return own, near.unionByName(beyond.selectExpr(number, "target_id", "d", "id", "x", "y", "z"))
