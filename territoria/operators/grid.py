"""Regular grids as long tables (one row per cell): generation, sampling, resampling, filling, masking, densities."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.operators.ranking import quantiles
from territoria.operators.inference import gaussian, labelled
from territoria.operators.spatial import knn_join, polygon_join


@dataclass(frozen=True)
class Grid:
    """Cell (ix, iy) is centred at (x0 + ix*dx, y0 + iy*dy); dy < 0 stores north first."""

    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per cell; cells are numbered in one distributed range, no cross join."""
        n = spark.range(self.nx * self.ny)
        ix, iy = (F.col("id") % self.nx).cast("int"), F.floor(F.col("id") / self.nx).cast("int")
        return n.select(ix.alias("ix"), iy.alias("iy"), (self.x0 + ix * self.dx).alias("x"), (self.y0 + iy * self.dy).alias("y"))

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Index of the cell holding a point; outside the grid gives null."""
        ix = F.floor((x - self.x0) / self.dx + 0.5).cast("int")
        iy = F.floor((y - self.y0) / self.dy + 0.5).cast("int")
        ok = (ix >= 0) & (ix < self.nx) & (iy >= 0) & (iy < self.ny)
        return F.when(ok, ix), F.when(ok, iy)


# Bounds of the metric grid (m) and of the lon/lat grids (degrees), and the cell sizes in km at 111 km per degree.
METRIC_BOUNDS = (-700000.0, 6000000.0, 1300000.0, 7200000.0)
LONLAT_BOUNDS = (-5.2, 41.2, 9.8, 51.2)
LONLAT_KM = {"5km": 5.0, "15km": 15.0, "30km": 30.0}


def _steps(low: float, high: float, step: float) -> int:
    """Number of centres low + step/2, low + 3*step/2, … below high."""
    return math.ceil((high - (low + step / 2)) / step)


def metric_grid(resolution: float = 5000.0, bounds: tuple[float, float, float, float] = METRIC_BOUNDS) -> Grid:
    """Cell centres, west to east and north to south."""
    west, south, east, north = bounds
    return Grid(west + resolution / 2, north - resolution / 2, resolution, -resolution, _steps(west, east, resolution), _steps(south, north, resolution))


def lonlat_grid(key: str = "15km", bounds: tuple[float, float, float, float] = LONLAT_BOUNDS) -> Grid:
    west, south, east, north = bounds
    step = LONLAT_KM[key] / 111.0
    return Grid(west + step / 2, south + step / 2, step, step, _steps(west, east, step), _steps(south, north, step))


def synthetic_cube(cells: DataFrame, start: str, end: str, seed: int = 42, mean: float = 0.0, std: float = 1.0, keys: Sequence[str] | None = None) -> DataFrame:
    """Gaussian value per cell and month, made of the seed, the cell's ``keys`` (all its columns, if none are given) and the month alone."""
    months = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    cube = cells.withColumn("month", F.explode(months))
    return cube.withColumn("value", F.lit(mean) + std * gaussian(labelled(seed, *[F.col(k) for k in keys or cells.columns], F.col("month"))))


def sample_cells(points: DataFrame, cells: DataFrame, grid: Grid, values: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Value of the cell that holds each point, by equi-join on the cell index."""
    ix, iy = grid.cell(F.col(x), F.col(y))
    p = points.withColumn("ix", ix).withColumn("iy", iy)
    return p.join(cells.select("ix", "iy", *values), ["ix", "iy"], "left").drop("ix", "iy")


def density(points: DataFrame, grid: Grid, value: str, cells: DataFrame | None = None, area: float | None = None,
            x: str = "x", y: str = "y") -> DataFrame:
    """Sum per cell over the cell area; points off the grid drop out. With ``cells`` every cell appears, 0 when empty."""
    area = abs(grid.dx * grid.dy) / 1e6 if area is None else area
    ix, iy = grid.cell(F.col(x), F.col(y))
    per_cell = points.select(ix.alias("ix"), iy.alias("iy"), F.col(value).alias("_v")).where(F.col("ix").isNotNull() & F.col("iy").isNotNull()).groupBy(
        "ix", "iy").agg((F.sum("_v") / area).alias("density"))
    if cells is None:
        return per_cell
    return cells.join(per_cell, ["ix", "iy"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def capped_share(cells: DataFrame, value: str = "density", cap: float = 0.95, out: str = "stress") -> DataFrame:
    """Capped at the exact p95 of the active cells and divided by the largest capped value."""
    limit = quantiles(cells.where(F.col(value) > 0), value, [cap], prefix="_q").toDF("_cap")
    top = cells.agg(F.max(value).alias("_top"))
    j = cells.crossJoin(F.broadcast(limit)).crossJoin(F.broadcast(top))
    peak = F.least("_cap", "_top")
    return j.withColumn(out, F.coalesce(F.try_divide(F.least(F.greatest(F.col(value), F.lit(0.0)), F.col("_cap")), peak), F.lit(0.0))).drop("_cap", "_top")


def coarsen(cells: DataFrame, k: int, nx: int, ny: int, value: str, how: str = "mean") -> DataFrame:
    """Blocks of k x k cells; a partial edge block is completed by repeating the edge cells."""
    padx, pady = -nx % k, -ny % k
    rx = F.when(F.col("ix") == nx - 1, padx + 1).otherwise(1)
    ry = F.when(F.col("iy") == ny - 1, pady + 1).otherwise(1)
    fn = {"mean": F.avg, "median": F.median, "max": F.max}[how]
    padded = cells.withColumn("_r", F.explode(F.array_repeat(F.lit(1), rx * ry))) if (padx or pady) else cells
    return padded.groupBy(F.floor(F.col("ix") / k).cast("int").alias("ix"), F.floor(F.col("iy") / k).cast("int").alias("iy")).agg(fn(value).alias(value))


def _spread(cells: DataFrame, nx: int, ny: int, columns: Sequence[str]) -> DataFrame:
    """Each cell sent to the 3x3 targets that read it; targets beyond the edge fold back onto it."""
    off = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    s = cells.select("ix", "iy", *columns, F.explode(off).alias("o"))
    tx = F.least(F.greatest(F.col("ix") + F.col("o.i"), F.lit(0)), F.lit(nx - 1))
    ty = F.least(F.greatest(F.col("iy") + F.col("o.j"), F.lit(0)), F.lit(ny - 1))
    own = (F.col("o.i") == 0) & (F.col("o.j") == 0)
    return s.select(tx.alias("ix"), ty.alias("iy"), own.alias("own"), *columns)


def median3(cells: DataFrame, value: str, nx: int, ny: int, out: str = "smoothed") -> DataFrame:
    """3x3 median; null cells stay null and count as 0 for their neighbours. ``cells`` must hold the full grid."""
    g = _spread(cells, nx, ny, [value]).groupBy("ix", "iy").agg(
        F.median(F.coalesce(value, F.lit(0.0))).alias("_m"), F.max(F.when(F.col("own"), F.col(value))).alias("_c"))
    return g.select("ix", "iy", F.when(F.col("_c").isNotNull(), F.col("_m")).alias(out))


def land_cells(sites: DataFrame, cells: DataFrame, grid: Grid, pet: str, share: float = 0.6, site_id: str = "id") -> DataFrame:
    """Grid node of each site, moved to the 3x3 cell with the largest PET when the centre has less than ``share`` of it."""
    off = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    ix, iy = grid.cell(F.col("x"), F.col("y"))
    near = sites.select(site_id, ix.alias("_ix"), iy.alias("_iy")).where(F.col("_ix").isNotNull() & F.col("_iy").isNotNull()).select(
        site_id, "_ix", "_iy", F.explode(off).alias("o")).select(
        site_id, "_ix", "_iy", (F.col("_ix") + F.col("o.i")).alias("ix"), (F.col("_iy") + F.col("o.j")).alias("iy"))
    j = near.join(cells.select("ix", "iy", pet), ["ix", "iy"], "inner")
    centre = F.max(F.when((F.col("ix") == F.col("_ix")) & (F.col("iy") == F.col("_iy")), F.col(pet)))
    best = F.max_by(F.struct("ix", "iy"), F.struct(F.col(pet), -F.col("ix"), -F.col("iy")))
    g = j.groupBy(site_id).agg(F.first("_ix").alias("_cx"), F.first("_iy").alias("_cy"), centre.alias("_c"), F.max(pet).alias("_m"), best.alias("_b"))
    moved = F.col("_c").isNull() | (F.col("_c") < share * F.col("_m"))
    return g.select(site_id, F.when(moved, F.col("_b.ix")).otherwise(F.col("_cx")).alias("ix"), F.when(moved, F.col("_b.iy")).otherwise(F.col("_cy")).alias("iy"), moved.alias("rerouted"))


def bilinear(targets: DataFrame, cells: DataFrame, grid: Grid, value: str, target_id: str = "id", x: str = "x", y: str = "y",
             keys: Sequence[str] = (), tolerate: float | None = 0.01, out: str = "value") -> DataFrame:
    """Weighted sum of the four surrounding cells. Targets off the grid are null.

    ``tolerate``: nulls count as 0 and spoil the result once they carry more than this weight.
    ``None``: any null corner with weight makes the result null.
    ``keys`` (for example the month) are extra columns of ``cells`` carried to the result.
    """
    fx, fy = (F.col(x) - grid.x0) / grid.dx, (F.col(y) - grid.y0) / grid.dy
    t = targets.select(target_id, fx.alias("_fx"), fy.alias("_fy")).where(
        F.col("_fx").between(0, grid.nx - 1) & F.col("_fy").between(0, grid.ny - 1))
    ix, iy = F.least(F.floor("_fx"), F.lit(max(grid.nx - 2, 0))).cast("int"), F.least(F.floor("_fy"), F.lit(max(grid.ny - 2, 0))).cast("int")
    t = t.select(target_id, ix.alias("_i"), iy.alias("_j"), (F.col("_fx") - ix).alias("_u"), (F.col("_fy") - iy).alias("_v"))
    u, v = F.col("_u"), F.col("_v")
    corners = F.array(*[F.struct((F.col("_i") + a).alias("ix"), (F.col("_j") + b).alias("iy"), ((u if a else 1 - u) * (v if b else 1 - v)).alias("w"))
                        for a in (0, 1) for b in (0, 1)])
    c = t.select(target_id, F.inline(corners)).where(F.col("w") > 0)
    j = c.join(cells.select("ix", "iy", *keys, F.col(value).alias("_val")), ["ix", "iy"], "inner" if keys else "left")
    have = F.sum(F.when(F.col("_val").isNotNull(), F.col("w")).otherwise(0.0))
    total = F.sum(F.col("w") * F.coalesce("_val", F.lit(0.0)))
    limit = 1e-12 if tolerate is None else tolerate
    g = j.groupBy(target_id, *keys).agg(F.when(1 - have <= limit + 1e-12, total).alias(out))
    return targets.join(g, target_id, "left") if not keys else targets.join(g, target_id, "inner")


def fill_nearest(cells: DataFrame, value: str, cell_id: str = "cell", x: str = "ix", y: str = "iy", root: float = 4096.0) -> DataFrame:
    """Null cells take the value of the nearest valid cell (smaller id on a tie). ``root`` is the coarsest search cell."""
    p = cells.withColumn("x", F.col(x).cast("double")).withColumn("y", F.col(y).cast("double"))
    holes = p.where(F.col(value).isNull()).select(cell_id, "x", "y")
    valid = p.where(F.col(value).isNotNull()).select(F.col(cell_id).alias("_src"), "x", "y", F.col(value).alias("_near"))
    near = knn_join(holes, valid, 1, cell_id, "_src", carry=["_near"], root=root).select(cell_id, "_near")
    return cells.join(near, cell_id, "left").withColumn(value, F.coalesce(value, "_near")).drop("_near")


def burn(cells: DataFrame, polys: DataFrame, key: str, values: Sequence[str], cell_id: str = "id") -> DataFrame:
    """Attributes of the polygon over each cell centre; the largest polygon wins where they overlap."""
    return polygon_join(cells, polys, key, values, cell_id, near=None, largest=True)


def cube_rows(df: DataFrame, grid: str, month: str, values: Sequence[str], fill: float = -9999.0) -> DataFrame:
    """Sink form of a cube: float values with the fill code, partition columns ``grid`` and ``year``."""
    return df.select("ix", "iy", month, *[F.coalesce(F.col(v).cast("float"), F.lit(fill).cast("float")).alias(v) for v in values],
                     F.lit(grid).alias("grid"), F.year(month).alias("year"))
