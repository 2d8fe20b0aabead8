"""File sinks: sorted CSV, partitioned cubes, GeoJSON features and text reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.operators.grid import cube_rows


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """Fixed column order, globally sorted across the part files."""
    df.orderBy(*order).select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_cube(df: DataFrame, path: str, grid: str, month: str, values: Sequence[str], fill: float = -9999.0) -> None:
    """Float cube with the fill code, one folder per grid and year; rows of one folder are brought together first."""
    rows = cube_rows(df, grid, month, values, fill)
    rows.repartition("grid", "year", F.floor(F.col("iy") / 64)).write.mode("overwrite").partitionBy("grid", "year").parquet(path)


def feature(lon: str, lat: str, properties: Sequence[str]) -> Column:
    """One GeoJSON point feature as a JSON string."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})


def write_geojson(df: DataFrame, path: str, lon: str, lat: str, properties: Sequence[str]) -> None:
    """Newline-delimited GeoJSON: one feature per line, written in parallel."""
    df.select(feature(lon, lat, properties).alias("value")).write.mode("overwrite").text(path)


def report_lines(checks: DataFrame) -> DataFrame:
    """Check rows to report text, a summary line last. A report has as many lines as there are rules."""
    mark = F.when(F.col("passed"), "PASS").when(F.col("warning"), "WARN").otherwise("FAIL")
    body = checks.select(F.lit(0).alias("part"), F.format_string("[%s] %s (threshold %.3f %s)", mark, F.col("message"), F.col("threshold"), F.col("unit")).alias("value"))
    tail = checks.agg(F.lit(1).alias("part"), F.format_string("%d/%d checks passed", F.count_if("passed"), F.count(F.lit(1))).alias("value"))
    return body.unionByName(tail)


def write_report(checks: DataFrame, path: str) -> None:
    report_lines(checks).orderBy("part", "value").select("value").coalesce(1).write.mode("overwrite").text(path)
