"""File sources: declared schemas, odd dialects, JSON record pages, fallbacks and materialise-once caches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, sep: str = ",",
             quote: str = '"', encoding: str = "UTF-8") -> DataFrame:
    """Typed scan: key columns stay strings when the schema says so; only the chosen columns are parsed."""
    df = (spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", quote)
          .option("encoding", encoding).option("enforceSchema", False).csv(path))
    return df.select(*columns) if columns else df


def read_pages(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Landed API pages ``{"data": [record…], "next": …}`` to one row per record; one page may span many lines."""
    pages = spark.read.schema(f"data ARRAY<{record}>, next STRING").option("multiLine", True).json(path)
    return pages.select(F.inline("data"))


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def union_lower(chunks: Sequence[DataFrame]) -> DataFrame:
    """Regional chunks with inconsistent case or missing columns, stacked by lower-case name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [lower_names(c) for c in chunks])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """Materialise once: write the table if the folder holds no finished write, then read it."""
    if not _exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def first_available(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Source fallback: the first parquet folder that exists and has a row."""
    for path in paths:
        if _exists(spark, path):
            df = spark.read.parquet(path)
            if not df.isEmpty():
                return df
    raise FileNotFoundError(f"no usable source among {list(paths)}")


# Coordinate and time names met in climate files, and ours.
ALIASES = {"valid_time": "time", "latitude": "lat", "longitude": "lon"}


def harmonise(df: DataFrame, keep: Sequence[str], aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """Lower-case, rename aliases, drop extra coordinates, and turn NaN into null."""
    df = lower_names(df)
    df = df.toDF(*[aliases.get(c, c) for c in df.columns]).select(*keep)
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in keep])


def merge_variables(variables: Sequence[DataFrame], keys: Sequence[str] = ("time", "lat", "lon"), year: int | None = None,
                    limit_months: int = 12) -> DataFrame:
    """Outer merge of one frame per variable; a frame longer than ``limit_months`` is cut to ``year`` first."""
    out = []
    for v in variables:
        if year is not None:
            months = v.agg(F.count_distinct(F.trunc(keys[0], "month"))).head()[0]
            v = v.where(F.year(keys[0]) == year) if months > limit_months else v
        out.append(v)
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), out)


def polygons(df: DataFrame, key: str, where=None) -> DataFrame:
    """Attribute filter, one row per id (the smallest ring text wins), bounding box columns added."""
    from territoria.functions.geo import ring_area, ring_bounds

    df = df if where is None else df.where(where)
    cols = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.to_json("ring")).alias("_r")).select(key, "_r.*")
    return one.select("*", *[c.alias(n) for n, c in ring_bounds("ring").items()], ring_area("ring").alias("area"))
