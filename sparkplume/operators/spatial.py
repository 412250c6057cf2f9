"""Grid, clip, split, cell extraction and buffers. Range conditions become equi-joins on cells or bands."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkplume.operators.ordering import ROWS_PER_RANGE, running_total

CELL_SIZE = 8046.7  # five miles in metres; fixed value
BUFFER = 8046.7  # radius of the evaluation buffers


@dataclass(frozen=True)
class Grid:
    """Cells of equal size, counted from the corner (x0, y0). ``cell_id`` numbers them by rows."""

    x0: float
    y0: float
    cell: float
    rows: int
    cols: int

    @classmethod
    def covering(cls, points: DataFrame, cell: float = CELL_SIZE, snap: tuple[float, float] = (0.0, 0.0)) -> Grid:
        """Smallest grid that holds all points, with its corner on the snap lattice."""
        b = points.agg(
            F.min("x").alias("ax"), F.min("y").alias("ay"), F.max("x").alias("bx"), F.max("y").alias("by")
        ).first()
        if b["ax"] is None:
            raise ValueError("no points to cover")
        x0 = snap[0] + ((b["ax"] - snap[0]) // cell) * cell
        y0 = snap[1] + ((b["ay"] - snap[1]) // cell) * cell
        return cls(x0, y0, cell, int((b["by"] - y0) // cell) + 1, int((b["bx"] - x0) // cell) + 1)

    def row_of(self, y: Column) -> Column:
        return F.floor((y - F.lit(self.y0)) / F.lit(self.cell)).cast("long")

    def col_of(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.x0)) / F.lit(self.cell)).cast("long")

    def center_x(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + F.lit(0.5)) * F.lit(self.cell)

    def center_y(self, row: Column) -> Column:
        return F.lit(self.y0) + (row + F.lit(0.5)) * F.lit(self.cell)

    def cell_id(self, row: Column, col: Column) -> Column:
        return row * F.lit(self.cols).cast("long") + col

    @property
    def size(self) -> int:
        return self.rows * self.cols

    def refined(self, factor: int) -> Grid:
        return Grid(self.x0, self.y0, self.cell / factor, self.rows * factor, self.cols * factor)


def usable(points: DataFrame, *keep: str) -> DataFrame:
    """``system_id, x, y, z`` of the points that have a location and a value, and the columns to ``keep``."""
    return points.select("system_id", "x", "y", "z", *keep).where(
        " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("x", "y", "z"))
    )


def make_grid(spark: SparkSession, grid: Grid, mask: DataFrame | None = None) -> DataFrame:
    """One row per cell: ``cell_id, row, col, cx, cy``; with ``mask(row, col)`` only cells found there.

    Cells are numbered by one distributed range, so no join builds the rectangle.
    """
    cells = spark.range(grid.rows * grid.cols).selectExpr(
        "id AS cell_id", f"id div {grid.cols} AS row", f"id % {grid.cols} AS col"
    )
    cells = cells.select("*", grid.center_x(F.col("col")).alias("cx"), grid.center_y(F.col("row")).alias("cy"))
    if mask is None:
        return cells
    inside = cells.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi")
    return inside.select("cell_id", "row", "col", "cx", "cy")


def cells_touched(points: DataFrame, grid: Grid) -> DataFrame:
    """Distinct cells that contain a point; usable as a mask."""
    return with_cell(points, grid).select("row", "col").distinct()


def with_cell(points: DataFrame, grid: Grid) -> DataFrame:
    """Row, column and id of the cell that contains each point; points outside the grid leave."""
    return (
        points.withColumn("row", grid.row_of(F.col("y")))
        .withColumn("col", grid.col_of(F.col("x")))
        .where(F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1))
        .withColumn("cell_id", grid.cell_id(F.col("row"), F.col("col")))
    )


def disc_cells(df: DataFrame, radius: Column | float, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """One row per (input row, cell whose centre lies within ``radius``), with ``cell_id, row, col, dist``.

    Only indices that can lie in the disc are produced: rows first, then the chord of each row.
    """
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    px, py = F.col(x), F.col(y)
    lo_row = F.greatest(grid.row_of(py - r), F.lit(0).cast("long"))
    hi_row = F.least(grid.row_of(py + r), F.lit(grid.rows - 1).cast("long"))
    by_row = df.withColumn("_r", r).withColumn(
        "row", F.explode(F.when(lo_row <= hi_row, F.sequence(lo_row, hi_row)).otherwise(F.array().cast("array<bigint>")))
    )
    dy = F.abs(grid.center_y(F.col("row")) - py)
    # One cell of slack on both sides: the exact test below decides.
    half = F.sqrt(F.greatest(F.col("_r") * F.col("_r") - dy * dy, F.lit(0.0)))
    lo_col = F.greatest(grid.col_of(px - half) - 1, F.lit(0).cast("long"))
    hi_col = F.least(grid.col_of(px + half) + 1, F.lit(grid.cols - 1).cast("long"))
    dx = grid.center_x(F.col("col")) - px
    ey = grid.center_y(F.col("row")) - py
    return (
        by_row.withColumn(
            "col",
            F.explode(F.when(lo_col <= hi_col, F.sequence(lo_col, hi_col)).otherwise(F.array().cast("array<bigint>"))),
        )
        .withColumn("dist", F.sqrt(dx * dx + ey * ey))
        .where(F.col("dist") <= F.col("_r"))
        .drop("_r")
        .withColumn("cell_id", grid.cell_id(F.col("row"), F.col("col")))
    )


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Closed ring ``(ring, i, x, y)`` to edges. Vertex i joins vertex i+1; the last one joins the first."""
    ring = ["ring"] if "ring" in vertices.columns else []
    ends = vertices.select(*ring, (F.col("i") - 1).alias("i"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    steps = vertices.join(ends, [*ring, "i"]).select(F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    closing = vertices.groupBy(*ring).agg(
        F.max_by("x", "i").alias("x1"), F.max_by("y", "i").alias("y1"), F.min_by("x", "i").alias("x2"), F.min_by("y", "i").alias("y2")
    )
    return steps.unionByName(closing.select("x1", "y1", "x2", "y2"))


def clip_points(points: DataFrame, edges: DataFrame, band: float, x: str = "x", y: str = "y") -> DataFrame:
    """Rows inside the polygon: an odd number of edges lies to their right. Rows without a location leave.

    Edges are spread over horizontal bands, so a point meets only the edges of its own band. The
    crossing test is half-open, which makes a vertex count once. Locations are tested once each, and
    all rows at a location that passes stay, repeated ones too.
    """
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.where(F.col("y1") != F.col("y2")).withColumn(
        "_band", F.explode(F.sequence(F.floor(lo / band).cast("long"), F.floor(hi / band).cast("long")))
    )
    places = points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL").distinct()
    px, py = F.col("_x"), F.col("_y")
    spans = (F.col("y1") > py) != (F.col("y2") > py)
    cut = F.col("x1") + (py - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    inside = (
        places.withColumn("_band", F.floor(py / band).cast("long"))
        .join(banded, "_band")
        .where(spans & (px < cut))
        .groupBy("_x", "_y")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") % 2 == 1)
    )
    return points.join(inside, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left_semi")


def train_test_split(
    points: DataFrame,
    percent: int = 90,
    seed: int = 42,
    key: str = "system_id",
    by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``is_train``: the first ``percent`` of the keys in md5 order, exactly, per ``by`` group.

    Rows without a key come last in their group; NULL in ``by`` is a group of its own. No row leaves.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    ranked = running_total(points.withColumn("_h", h), ["_h", key], by, name="_rank", rows_per_range=rows_per_range)
    if by:
        total = ranked.groupBy(*by).agg(F.max("_rank").alias("_total"))
        total = total.select("_total", *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)])
        sized = ranked.join(total, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)])
    else:
        sized = ranked.withColumn("_total", F.lit(ranked.agg(F.max("_rank")).first()[0]))
    return sized.withColumn("is_train", F.col("_rank") * 100 <= F.col("_total") * percent).select(*points.columns, "is_train")


def extract_at_points(raster: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
    """Value of the containing cell at each point and run; the point columns plus ``run_id, prediction``."""
    cells = with_cell(points, grid).drop("row", "col")
    return cells.join(
        raster.select("cell_id", "run_id", F.col("value").alias("prediction")), "cell_id"
    ).drop("cell_id")


def zone_cells(points: DataFrame, radius: float, grid: Grid, zone: str = "system_id") -> DataFrame:
    """Cells of each buffer ``(zone, cell_id)``: those whose centre it holds.

    A buffer without a centre takes the cell of its point. A point outside the grid has the cells its buffer
    reaches; only a zone that reaches none leaves.
    """
    rows = points.select(zone, "x", "y")
    held = disc_cells(rows, radius, grid).select(zone, "cell_id")
    # the nearest centre of a point on the grid is that of its own cell
    dx = grid.center_x(F.col("col")) - F.col("x")
    dy = grid.center_y(F.col("row")) - F.col("y")
    own = with_cell(rows, grid).where(F.sqrt(dx * dx + dy * dy) > radius).select(zone, "cell_id")
    return held.unionByName(own)


def zonal_mean(raster: DataFrame, zones: DataFrame, zone: str = "system_id") -> DataFrame:
    """Mean of the cells of each buffer per run; cells without data are left out, empty buffers too."""
    return (
        zones.join(raster.where(F.col("value").isNotNull()).select("cell_id", "run_id", "value"), "cell_id")
        .groupBy("run_id", zone)
        .agg(F.avg("value").alias("prediction"))
    )


def _hull_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hull of everything seen; between batches only the current hull is kept."""
    kept: list[tuple[float, float]] = []
    for batch in batches:
        pts = sorted(set(kept) | set(zip(batch["x"].tolist(), batch["y"].tolist())))
        kept = _half(pts) + _half(pts[::-1]) if len(pts) > 2 else pts
    yield pd.DataFrame({"i": range(len(kept)), "x": [p[0] for p in kept], "y": [p[1] for p in kept]})


def _half(pts: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Turning points of one side, without its last point, which opens the other side."""
    out: list[tuple[float, float]] = []
    for p in pts:
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (
            p[0] - out[-2][0]
        ):
            out.pop()
        out.append(p)
    return out[:-1]


def convex_hull(points: DataFrame) -> DataFrame:
    """Hull vertices ``(i, x, y)`` in ring order.

    Each task reduces its points to their own hull, and the hulls of the tasks, a few vertices each,
    are joined into one.
    """
    schema = "i long, x double, y double"
    rows = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select("x", "y")
    local = rows.mapInPandas(_hull_part, schema)
    # an exchange, not a coalesce: that would pull the local hulls into the same single task
    return local.select("x", "y").repartition(1).mapInPandas(_hull_part, schema)
