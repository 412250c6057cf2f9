"""Nested square tiles over points, deeper only where it is crowded.

Each tile has its point count and the bounding box of its points. Searches decide from these which
tiles matter before they look at any point.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkplume.session import materialize

LEVEL_BITS = 2  # a tile opens into 4 x 4 tiles
# 50 bits per axis, as many as a double can tell apart in a wide extent: below this level points of a tile share
# their location but for rounding
MAX_LEVEL = 25
BOX = ("ax", "bx", "ay", "by")


@dataclass(frozen=True)
class Tiles:
    """``table(level, tile, parent, n, ax, bx, ay, by, ...)`` and what is needed to use it."""

    table: DataFrame
    last: int
    leaf: int
    frame: tuple[float, float, float]
    by: str | None = None

    @property
    def crowded(self) -> str:
        """Condition of a tile that has tiles below it: too many points, at more than one place."""
        return f"(n > {self.leaf} AND (ax < bx OR ay < by) AND level < {self.last})"

    def inner(self) -> DataFrame:
        """Ids of the tiles that have tiles below them."""
        return self.table.where(self.crowded).selectExpr("tile AS parent")

    def reachable(self) -> DataFrame:
        """Tiles of the first level and all tiles below an inner one."""
        return self.table.where("level = 1").unionByName(
            self.table.where("level > 1").join(self.inner(), "parent", "left_semi")
        )

    def levels(self, points: DataFrame) -> DataFrame:
        """Each point once per level with its ``tile`` and the ``parent`` above."""
        return _levels(points, 1, self.last, self.frame, self.by)


def _tile(level: int, frame: tuple[float, float, float], by: str | None = None) -> str:
    """SQL of the tile that holds (x, y): its level and both indices, after the group if there are groups."""
    group = "" if by is None else f"'g', {by}, "
    if level == 0:
        return f"named_struct({group}'l', 0, 'x', 0L, 'y', 0L)"
    x0, y0, side = frame
    full = 1 << (LEVEL_BITS * MAX_LEVEL)
    shift = LEVEL_BITS * (MAX_LEVEL - level)
    ix, iy = (
        f"shiftright(least(cast(floor(({v} - {lo!r}D) / {side!r}D * {full}D) as bigint), {full - 1}L), {shift})"
        for v, lo in (("x", x0), ("y", y0))
    )
    return f"named_struct({group}'l', {level}, 'x', {ix}, 'y', {iy})"


def literal(tile) -> str:
    """SQL of a tile that was read."""
    return f"named_struct('l', {tile.l}, 'x', {tile.x}L, 'y', {tile.y}L)"


def _levels(points: DataFrame, first: int, last: int, frame: tuple[float, float, float], by: str | None = None) -> DataFrame:
    entries = ", ".join(
        f"named_struct('level', {level}, 'tile', {_tile(level, frame, by)}, 'parent', {_tile(level - 1, frame, by)})"
        for level in range(first, last + 1)
    )
    return points.selectExpr("*", f"inline(array({entries}))")


def build_tiles(points: DataFrame, leaf: int, extra: Sequence[str] = (), by: str | None = None) -> Tiles | None:
    """Tiles of ``points(x, y, ...)``, which should be written already; None without points.

    ``extra`` adds aggregates per tile. With ``by``, each value of that column has tiles of its own. Levels are added while a tile of the last one is crowded, and
    then only for the points in crowded tiles.
    """
    box = points.selectExpr("count(1) n", "min(x) ax", "min(y) ay", "max(x) bx", "max(y) by").first()
    if box["n"] == 0:
        return None
    frame = (box["ax"], box["ay"], max(box["bx"] - box["ax"], box["by"] - box["ay"], 1e-6) * (1 + 1e-9))
    aggregates = [F.expr(e) for e in ("count(1) n", "min(x) ax", "max(x) bx", "min(y) ay", "max(y) by", *extra)]

    def grow(rows: DataFrame, first: int, last: int) -> DataFrame:
        return _levels(rows, first, last, frame, by).groupBy("level", "tile", "parent").agg(*aggregates)

    last = 1
    while last < MAX_LEVEL and box["n"] > leaf * 16**last:
        last += 1
    table = materialize(grow(points, 1, last), "tiles")
    while last < MAX_LEVEL:
        full = table.where(f"level = {last} AND n > {leaf} AND (ax < bx OR ay < by)").selectExpr("tile AS full_tile")
        if full.isEmpty():
            break
        step = min(2, MAX_LEVEL - last)
        inside = points.join(full, F.expr(f"{_tile(last, frame, by)} = full_tile"), "left_semi")
        table = materialize(table.unionByName(grow(inside, last + 1, last + step)), "tiles")
        last += step
    return Tiles(table, last, leaf, frame, by)
