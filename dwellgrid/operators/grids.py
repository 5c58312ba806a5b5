"""Reading a gridded function of two directions at any point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.operators.ordered import bounded_broadcast

#: Grids of at most so many nodes are broadcast.
SMALL_GRID = 200_000


def grid_cells(grid: DataFrame, i: str, j: str, value: str, around: int) -> DataFrame:
    """ci, cj and the values v00, v10, v01, v11 at a cell's corners; the first index closes a circle of ``around`` nodes."""
    corner = lambda a, b: F.struct(F.pmod(F.col(i) - a, F.lit(around)).cast("long").alias("ci"), (F.col(j) - b).cast("long").alias("cj"), F.lit(f"{a}{b}").alias("at"))
    each = grid.select(F.col(value).cast("double").alias("v"), F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c"))
    return each.groupBy("c.ci", "c.cj").agg(*[F.max(F.when(F.col("c.at") == at, F.col("v"))).alias(f"v{at}") for at in ("00", "10", "01", "11")])


def sampler(grid: DataFrame, i: str, j: str, value: str, *, around: int, first: float, step: float, count: int, turn: float = 360.0, small: int = SMALL_GRID):
    """A function (points, angle, height, name) -> points with the grid read by bilinear interpolation.

    Nodes: angle ``i * turn / around``, any angle is wrapped; height ``first +
    j * step`` for j under ``count`` (two at least). NULL outside the heights,
    for a NULL angle or height, and where a corner that counts is missing. A
    point is joined to the one cell that holds it; a grid too large to
    broadcast is joined by shuffle."""
    cells = grid_cells(grid, i, j, value, around)

    def read(points: DataFrame, angle: Column, height: Column, name: str = "sample") -> DataFrame:
        u, v = F.pmod(angle.cast("double"), F.lit(turn)) * around / turn, (height.cast("double") - first) / step
        inside = (v >= 0) & (v <= count - 1)
        work = points.withColumns({"_u": u, "_v": F.when(inside, v)})
        work = work.withColumns({"_ci": F.pmod(F.floor("_u"), F.lit(around)), "_cj": F.least(F.floor("_v"), F.lit(count - 2))})
        side = bounded_broadcast(cells, small)
        side = cells if side is None else side
        work = work.join(side, (F.col("_ci") == F.col("ci")) & (F.col("_cj") == F.col("cj")), "left")
        x, y = F.col("_u") - F.floor("_u"), F.col("_v") - F.col("_cj")
        # a corner of no weight need not be there
        part = lambda w, c: F.when(w == 0, F.lit(0.0)).otherwise(w * F.col(c))
        value_ = part((1 - x) * (1 - y), "v00") + part(x * (1 - y), "v10") + part((1 - x) * y, "v01") + part(x * y, "v11")
        return work.select(*[points[c] for c in points.columns], F.when(F.col("_u").isNotNull() & F.col("_v").isNotNull(), value_).alias(name))

    return read


def sampled(points: DataFrame, angle: Column, height: Column, sample, name: str = "sample") -> DataFrame:
    """Points with a function of two directions beside them: ``sample`` is a ``sampler`` or any function of the same form."""
    return sample(points, angle, height, name)
