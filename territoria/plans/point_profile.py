"""Profiles of points from a scored grid: the nearest cell's scores of a year or a month, and its twelve months.

Every point has a row; one without a cell within reach, or without coordinates, has nulls and ``covered`` false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.functions.combine import stress_index
from territoria.functions.scalars import score_band, stress_to_score
from territoria.operators.spatial import nearest_join

ANNUAL = ("wsi_mean", "wsi_p10", "wsi_p90", "bws_norm", "gws_norm", "drought_norm_mean", "wsi_uncertainty")
REACH_KM = 50.0


def month_scores(components: DataFrame, cell: str, month: str) -> DataFrame:
    """(cell, m, water_score, wsi, drought_norm) from one year's component rows (bws, gws, drought); months of the year once each."""
    w = components.withColumn("wsi", stress_index("bws", "gws", "drought"))
    return w.select(cell, F.month(month).alias("m"), stress_to_score("wsi").alias("water_score"), "wsi", F.col("drought").alias("drought_norm"))


def _block(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in names])


def _nearest(points: DataFrame, cells: DataFrame, cell: str, point: str, reach: float) -> DataFrame:
    """All points with the nearest of ``cells`` (cell, x, y): cell, dist, covered. The profile of a cell is joined by its key afterwards."""
    return nearest_join(points, cells.select(cell, "x", "y"), point, cell, max_km=reach)


def point_profile(points: DataFrame, cells: DataFrame, months: DataFrame, cell: str, point: str = "id", reach: float = REACH_KM) -> DataFrame:
    """One row per point (id, x, y, month): nearest cell, score, components, seasonal block, and the annual block where a month is shown.

    ``cells``: cell, lon, lat, x, y and the yearly figures; ``months``: ``month_scores``. A point's ``month`` may be null; a
    month that its cell lacks falls back to the year, as ``mode`` says.
    """
    near = _nearest(points, cells, cell, point, reach).select(point, "month", cell, "dist", "covered")
    j = near.join(cells.drop("x", "y"), cell, "left")
    m = months.select(cell, F.col("m").alias("month"), F.col("water_score").alias("_score"), F.col("wsi").alias("_wsi"), F.col("drought_norm").alias("_drought"), F.lit(True).alias("_monthly"))
    j = j.join(m, [cell, "month"], "left").withColumn("_monthly", F.coalesce("_monthly", F.lit(False)))
    pick = lambda own, year: F.when(F.col("_monthly"), F.col(own)).otherwise(F.col(year))
    j = j.withColumn("_year_score", F.col("water_score")).withColumn("water_score", pick("_score", "water_score"))
    mode = F.when(F.col("_monthly"), F.concat(F.lit("month_"), "month")).otherwise(F.lit("annual_mean"))
    components = F.struct(*[F.col(c) for c in ANNUAL], pick("_wsi", "wsi_mean").alias("wsi"), pick("_drought", "drought_norm_mean").alias("drought_norm"))
    year = F.struct(F.col("_year_score").alias("water_score"), *[F.col(c) for c in ("wsi_mean", "wsi_p10", "wsi_p90")])
    here = F.col("covered")
    return j.select(
        point, "month", "covered", F.when(here, mode).alias("mode"), F.when(here, F.struct(F.col(cell).alias("cell"), "lon", "lat", F.col("dist").alias("distance_km"))).alias("nearest"),
        "water_score", F.when(F.col("water_score").isNotNull(), score_band("water_score")["level"]).alias("level"), F.when(here, components).alias("components"),
        F.when(here, _block("worst_month_score", "summer_mean_score")).alias("seasonal"), F.when(F.col("_monthly"), year).alias("annual"))


def point_months(points: DataFrame, cells: DataFrame, months: DataFrame, cell: str, point: str = "id", reach: float = REACH_KM) -> DataFrame:
    """One row per point: covered, the annual block, and the cell's months in order as an array of (month, water_score, wsi, drought_norm)."""
    row = F.struct(F.col("m").alias("month"), "water_score", "wsi", "drought_norm")
    series = months.groupBy(cell).agg(F.sort_array(F.collect_list(row)).alias("months"))
    j = _nearest(points, cells, cell, point, reach).select(point, cell, "covered").join(cells.drop("x", "y"), cell, "left").join(series, cell, "left")
    year = _block("water_score", "water_score_p10", "water_score_p90", "worst_month_score", "summer_mean_score")
    return j.select(point, "covered", F.col(cell).alias("cell"), F.when(F.col("covered"), year).alias("annual"), "months")
