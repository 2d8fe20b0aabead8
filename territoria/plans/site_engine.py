"""Local index of every site and month at once: series per distinct cell, computed once and joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.functions.combine import local_index, reliability
from territoria.functions.scalars import linear_stress
from territoria.operators import series


def cell_series(cube: DataFrame, cell: str, month: str, index: str) -> DataFrame:
    """Drought stress per cell and month with its persistence, variability and missing share."""
    d = cube.withColumn("d", linear_stress(index))
    k = [cell]
    return d.select(cell, month, "d", series.rolling_mean("d", k, month, 3).alias("s"), series.rolling_variability("d", k, month, 12).alias("v"),
                    series.null_share(index, k, month, 12).alias("null_share"))


def local_stress(sites: DataFrame, cells: DataFrame, cell: str, month: str, b: Column, g: Column, fit_p: Column, distance_km: Column, site: str = "id") -> DataFrame:
    """(site, month, index, contributions…): six components combined with weights of missing ones redistributed."""
    names = ("b", "g", "d", "s", "v", "u")
    j = sites.join(cells, cell).withColumn("_u", reliability("null_share", b, g, fit_p, distance_km))
    # A projection of its own for the six values: an expression over plain columns isn't merged into the ones before it.
    j = j.select(site, month, *[c.alias(f"_{n}") for n, c in zip(names, (b, g, F.col("d"), F.col("s"), F.col("v"), F.col("_u")))])
    return j.withColumn("_i", local_index({n: f"_{n}" for n in names})).select(site, month, "_i.*")
