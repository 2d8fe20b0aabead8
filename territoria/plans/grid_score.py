"""Grid scoring: components per cell and month to index, percentiles, uncertainty and 0-100 scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.functions.combine import WEIGHTS_INDEX, index_sigma, stress_index
from territoria.functions.scalars import stress_to_score, uncertainty_points


def index_over_time(df: DataFrame, keys: Sequence[str], month: str, bws: str = "bws", gws: str = "gws",
                    drought: str = "drought", weights=WEIGHTS_INDEX, summer: tuple[int, int] = (6, 9)) -> DataFrame:
    """One row per cell from its months (a bounded group): index mean and percentiles, seasonal and worst scores.

    Percentiles swap sides when the index becomes a score.
    """
    w = df.withColumn("_w", stress_index(bws, gws, drought, weights))
    score = stress_to_score("_w")
    agg = w.groupBy(*keys).agg(
        F.avg("_w").alias("wsi_mean"), F.percentile("_w", F.array(F.lit(0.1), F.lit(0.9))).alias("_p"),
        F.first(bws, True).alias("bws_norm"), F.first(gws, True).alias("gws_norm"),
        F.avg(drought).alias("drought_norm_mean"), F.stddev_pop(drought).alias("drought_std"),
        F.min(score).alias("worst_month_score"),
        F.avg(F.when(F.month(month).between(*summer), score)).alias("summer_mean_score"))
    agg = agg.withColumn("wsi_p10", F.col("_p")[0]).withColumn("wsi_p90", F.col("_p")[1]).drop("_p")
    sigma = index_sigma("bws_norm", "gws_norm", "drought_norm_mean", weights)
    return agg.withColumn("wsi_uncertainty", sigma).withColumn("water_score", stress_to_score("wsi_mean")).withColumn(
        "water_score_p10", stress_to_score("wsi_p90")).withColumn("water_score_p90", stress_to_score("wsi_p10")).withColumn(
        "water_score_uncertainty", uncertainty_points("wsi_uncertainty"))


def enforce_temporal_variance(scored: DataFrame) -> None:
    """Halts when the drought component does not vary over time anywhere."""
    spread = scored.agg(F.avg("drought_std").alias("s")).head()["s"]
    if spread is None or spread < 1e-6:
        raise ValueError("drought component has no variation over time")


def component_months(static: DataFrame, months: DataFrame, cell: str, month: str, baseline, window: int = 12, year: int | None = None) -> DataFrame:
    """(cell, month, bws, gws, drought) from raw layers.

    ``static``: cell, bws_raw, gws_raw, station_z, withdrawals. ``months``: cell, month, precip.
    Rolling precipitation -> gamma index -> drought stress; groundwater from layer and stations; demand stress raised
    by withdrawals; rows of the target year only, if one is given.
    """
    from territoria.functions.combine import layered_mean
    from territoria.functions.scalars import clip01, linear_stress, withdrawal_modulation, z_to_stress
    from territoria.operators.grid import capped_share
    from territoria.operators.series import rolling_sum, spi_gamma

    acc = months.withColumn("acc", rolling_sum("precip", [cell], month, window))
    spi = spi_gamma(acc, [cell], "acc", baseline).withColumn("drought", linear_stress("spi"))
    spi = spi if year is None else spi.where(F.year(month) == year)
    s = capped_share(static, "withdrawals", out="pressure")
    gws = layered_mean({"_g": 0.5, "_z": 0.2}, ["_g", "_z"])
    s = s.withColumn("_g", clip01("gws_raw", 5)).withColumn("_z", z_to_stress("station_z")).select(
        cell, withdrawal_modulation(clip01("bws_raw", 5), "pressure").alias("bws"), gws.alias("gws"))
    return spi.join(s, cell).select(cell, month, "bws", "gws", "drought")


def score_cells(static: DataFrame, months: DataFrame, cell: str, month: str, baseline, window: int = 12, year: int | None = None) -> DataFrame:
    """From raw layers to scored cells: ``index_over_time`` of ``component_months`` per cell."""
    return index_over_time(component_months(static, months, cell, month, baseline, window, year), [cell], month)
