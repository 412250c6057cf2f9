"""Natural neighbour interpolation in its discrete form (Park et al. 2006)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkplume.operators.neighbors import grid_targets, knn
from sparkplume.operators.spatial import Grid, clip_points, convex_hull, disc_cells, make_grid, polygon_edges, usable
from sparkplume.session import materialize


def natural_neighbor(
    points: DataFrame, grid: Grid, oversample: int = 1, cells: DataFrame | None = None
) -> DataFrame:
    """``cell_id, row, col, value``; NULL outside the hull of the sites.

    Every fine cell has a nearest site at distance d and gives that site's value to all cells within d
    of it; a cell's prediction is the mean of what it was given. Denser sites mean smaller discs, so
    the scatter shrinks as the data grows. ``oversample`` is odd: then each cell's centre is a fine
    centre and every cell receives something.
    """
    if oversample % 2 == 0:
        raise ValueError("oversample must be odd")
    spark = points.sparkSession
    points = materialize(usable(points), "sites")  # a place without a value is no site and bounds no hull
    fine = grid_targets(make_grid(spark, grid.refined(oversample)))
    nearest = knn(fine, points, 1).select(
        "tx", "ty", F.get("neighbors", 0)["d"].alias("d"), F.get("neighbors", 0)["z"].alias("z")
    )
    given = (
        disc_cells(nearest, F.col("d"), grid, "tx", "ty")
        .groupBy("cell_id")
        .agg(F.avg("z").alias("value"))
    )
    cells = cells if cells is not None else make_grid(spark, grid)
    hull = polygon_edges(materialize(convex_hull(points), "hull"))
    inside = clip_points(cells.select("cell_id", "cx", "cy"), hull, grid.cell, "cx", "cy").select("cell_id")
    return (
        cells.select("cell_id", "row", "col")
        .join(given.join(inside, "cell_id", "left_semi"), "cell_id", "left")
        .select("cell_id", "row", "col", "value")
    )
