"""Relational joins with the semantics the site tables need; broadcasts are left to Spark's size check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territoria.functions.scalars import wall_micros, wall_time


def lookup_join(df: DataFrame, dim: DataFrame, on: str | Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Left join to a dimension, absent keys (and null attributes) filled with defaults."""
    out = df.join(dim, on, "left")
    return out.select(*[
        F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in out.columns])


def left_join_matched(df: DataFrame, dim: DataFrame, on: str | Sequence[str], required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(matched rows, one-row report of how many were unmatched)."""
    joined = df.join(dim, on, "left")
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    report = joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("n_unmatched"))
    return joined.where(~missing), report


def missing_from(expected: DataFrame, df: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return expected.join(df.select(*([on] if isinstance(on, str) else on)).distinct(), on, "left_anti")


def orphan_edges(edges: DataFrame, nodes: DataFrame, ends: tuple[str, str] = ("src", "dst"), node: str = "id") -> DataFrame:
    """(edge columns, missing_end): one row per end that is not a node."""
    parts = []
    for end in ends:
        parts.append(edges.join(nodes.select(F.col(node).alias(end)).distinct(), end, "left_anti")
                     .select(*edges.columns, F.lit(end).alias("missing_end")))
    return parts[0].unionByName(parts[1])


def both_ends_in(edges: DataFrame, nodes: DataFrame, ends: tuple[str, str] = ("src", "dst"), node: str = "id") -> DataFrame:
    for end in ends:
        edges = edges.join(nodes.select(F.col(node).alias(end)), end, "left_semi")
    return edges


def either_end_in(edges: DataFrame, nodes: DataFrame, ends: tuple[str, str] = ("src", "dst"), node: str = "id") -> DataFrame:
    """Two flags by left join instead of a union of two scans; node ids are made distinct first."""
    ids = nodes.select(node).distinct()
    out = edges
    for i, end in enumerate(ends):
        out = out.join(ids.select(F.col(node).alias(end), F.lit(True).alias(f"_in{i}")), end, "left")
    return out.where(F.col("_in0").isNotNull() | F.col("_in1").isNotNull()).select(*edges.columns)


def active_on(df: DataFrame, start: str, end: str, day: Column) -> DataFrame:
    return df.where((F.col(start) <= day) & (F.col(end) >= day))


def active_per_day(df: DataFrame, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """Number of intervals open on each day of the span: +1/-1 steps summed per day, then a running total over
    the calendar (one row per day and key), instead of a range join."""
    steps = df.where(F.col(start) <= F.col(end)).select(
        *keys, F.inline(F.array(
            F.struct(F.col(start).alias("day"), F.lit(1).alias("step")),
            F.struct(F.date_add(F.col(end), 1).alias("day"), F.lit(-1).alias("step")))))
    per_day = steps.groupBy(*keys, "day").agg(F.sum("step").alias("step"))
    span = per_day.groupBy(*keys).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    calendar = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("day"))
    w = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    filled = calendar.join(per_day, [*keys, "day"], "left")
    return filled.select(*keys, "day", F.sum(F.coalesce("step", F.lit(0))).over(w).alias("n_active"))


def time_intersection(a: DataFrame, b: DataFrame, on: Sequence[str], minimum: int = 24) -> DataFrame:
    """Inner join on the common time index, empty when fewer than ``minimum`` points are shared."""
    both = a.join(b, list(on), "inner")
    size = both.agg(F.count(F.lit(1)).alias("_common"))
    return both.crossJoin(F.broadcast(size)).where(F.col("_common") >= minimum).drop("_common")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, value: str,
                    bucket_seconds: int = 3600, out: str = "nearest") -> DataFrame:
    """For each left row the right row nearest in time (earlier wins a tie): ``out`` value and ``out_ts``.

    The search runs inside (keys, time bucket), so a busy key is spread over its buckets; the last and first
    readings of the neighbouring non-empty buckets are carried in from a per-bucket summary.
    """
    keys = list(keys)
    stamp = wall_micros(ts)
    bucket = F.floor(stamp / (bucket_seconds * 1_000_000)).cast("long")
    lf = left.withColumn("_ts", stamp).withColumn("_b", bucket)
    rt = (right.where(F.col(ts).isNotNull()).select(*keys, stamp.alias("_ts"), F.col(value).alias("_v"))
          .groupBy(*keys, "_ts").agg(F.min("_v").alias("_v")).withColumn("_b", F.floor(F.col("_ts") / (bucket_seconds * 1_000_000)).cast("long")))
    reading = F.struct(F.col("_ts").alias("t"), F.col("_v").alias("v"))
    ends = rt.groupBy(*keys, "_b").agg(F.min_by(reading, "_ts").alias("_first"), F.max_by(reading, "_ts").alias("_last"))
    spots = lf.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "full_outer")
    back = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy(*keys).orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    spots = spots.select(*keys, "_b", F.last("_last", True).over(back).alias("_prev"),
                         F.first("_first", True).over(ahead).alias("_next"))
    both = lf.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    both = both.unionByName(rt.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    inner = W.partitionBy(*keys, "_b").orderBy("_ts", "_side")
    tail = W.partitionBy(*keys, "_b").orderBy(F.col("_ts").desc(), F.col("_side"))
    mine = F.when(F.col("_side") == 0, reading)
    both = both.withColumn("_before", F.last(mine, True).over(inner)).withColumn("_after", F.last(mine, True).over(tail))
    rows = both.where(F.col("_side") == 1).join(spots, [*keys, "_b"], "left")
    before, after = F.coalesce("_before", "_prev"), F.coalesce("_after", "_next")
    pick = F.when(after.isNull() | (F.col("_ts") - before["t"] <= after["t"] - F.col("_ts")), before).otherwise(after)
    return rows.withColumn("_pick", pick).select(
        *left.columns, F.col("_pick")["v"].alias(out),
        wall_time(F.col("_pick")["t"]).alias(f"{out}_ts"))


def year_over_year(df: DataFrame, keys: Sequence[str], year: str, value: str, a: int, b: int, limit: float = 0.5) -> DataFrame:
    """Common keys of two years side by side with the ratio and a flag for a change beyond ``limit``.

    One pass: conditional sums instead of a self join.
    """
    agg = df.where(F.col(year).isin(a, b)).groupBy(*keys).agg(
        F.sum(F.when(F.col(year) == a, F.col(value))).alias("before"), F.sum(F.when(F.col(year) == b, F.col(value))).alias("after"))
    ratio = F.try_divide("after", "before")
    return agg.where(F.col("before").isNotNull() & F.col("after").isNotNull()).withColumn("ratio", ratio).withColumn(
        "flagged", F.coalesce(F.abs(ratio - 1) > limit, F.lit(False)))


def per_distinct(df: DataFrame, key: Sequence[str], compute) -> DataFrame:
    """Work sharing: compute once per distinct key, join the result back to every row."""
    key = list(key)
    return df.join(compute(df.select(*key).distinct()), key, "left")
