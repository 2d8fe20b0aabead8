"""Site, climate, station, network and production frames derived from the driver tables, and the same CTEs in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.functions.geo import plane_km
from territoria.functions.scalars import clip01
from territoria.sources.tables import Tables


def lon_of(key: str | Column) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return -5.0 + (k * 37 % 1400) / F.lit(100.0)


def lat_of(key: str | Column) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return 41.5 + (k * 53 % 950) / F.lit(100.0)


def lon_sql(k: str) -> str:
    return f"(-5e0 + ({k} * 37 % 1400) / 100e0)"


def lat_sql(k: str) -> str:
    return f"(41.5e0 + ({k} * 53 % 950) / 100e0)"


def c01(e: str, maximum: str = "1e0") -> str:
    return f"(CASE WHEN ({e}) IS NOT NULL THEN least(greatest(({e}) / {maximum}, 0e0), 1e0) END)"


def sites(t: Tables) -> DataFrame:
    """One row per customer: position, index components (some null) and a 1-4 level from the urgent orders."""
    urgent = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("_u"))
    k = F.col("c_custkey")
    return t.customer.join(urgent, k == F.col("o_custkey"), "left").select(
        k.alias("id"), "c_nationkey", "c_mktsegment", lon_of(k).alias("lon"), lat_of(k).alias("lat"),
        clip01(F.col("c_acctbal") + 1000, 11000).alias("x_bws"),
        ((k * 29 % 101) / 100).alias("x_aridity"),
        F.when(k % 5 != 2, (k * 31 % 101) / 100).alias("x_gws"),
        ((k * 17 % 97) / 96).alias("x_sv"),
        F.when(k % 11 != 4, (k * 41 % 601) / 100 - 3).alias("spei3"),
        F.when(k % 13 != 5, (k * 59 % 601) / 100 - 3).alias("spei12"),
        F.least(F.coalesce("_u", F.lit(0)) + 1, F.lit(4)).cast("int").alias("level"),
    )


SITES = f"""sites AS (
  SELECT c_custkey AS id, c_nationkey, c_mktsegment, {lon_sql('c_custkey')} AS lon, {lat_sql('c_custkey')} AS lat,
    {c01('c_acctbal + 1000', '11000e0')} AS x_bws, (c_custkey * 29 % 101) / 100e0 AS x_aridity,
    CASE WHEN c_custkey % 5 <> 2 THEN (c_custkey * 31 % 101) / 100e0 END AS x_gws,
    (c_custkey * 17 % 97) / 96e0 AS x_sv,
    CASE WHEN c_custkey % 11 <> 4 THEN (c_custkey * 41 % 601) / 100e0 - 3 END AS spei3,
    CASE WHEN c_custkey % 13 <> 5 THEN (c_custkey * 59 % 601) / 100e0 - 3 END AS spei12,
    least(coalesce(u, 0) + 1, 4)::INT AS level
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1) q
    ON c_custkey = o_custkey)"""


def supplier_month(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("station"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month")).agg(
        F.sum("l_extendedprice").alias("precip"), (F.sum("l_quantity") * 1500).alias("pet"))


SUPPLIER_MONTH = """sm AS (SELECT l_suppkey AS station, date_trunc('month', l_shipdate)::DATE AS month,
    sum(l_extendedprice) AS precip, sum(l_quantity) * 1500 AS pet FROM lineitem GROUP BY 1, 2)"""


def nation_month(t: Tables) -> DataFrame:
    """Monthly totals per supplier nation: lines are summed per supplier and month before they meet the dimension."""
    sm = supplier_month(t)
    s = t.supplier.select(F.col("s_suppkey").alias("station"), F.col("s_nationkey").alias("nation"))
    return sm.join(s, "station").groupBy("nation", "month").agg(F.sum("precip").alias("precip"), F.sum("pet").alias("pet"))


NATION_MONTH = """nm AS (SELECT s_nationkey AS nation, date_trunc('month', l_shipdate)::DATE AS month,
    sum(l_extendedprice) AS precip, sum(l_quantity) * 1500 AS pet
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def stations(t: Tables) -> DataFrame:
    """One row per supplier on the km plane, with a value in 0..500 and a capacity."""
    k = F.col("s_suppkey")
    x, y = plane_km(lon_of(k), lat_of(k))
    return t.supplier.select(k.alias("sid"), lon_of(k).alias("lon"), lat_of(k).alias("lat"), x.alias("x"), y.alias("y"),
                             (F.col("s_acctbal") / 20 + 50).alias("value"), (k % 90 + 10).cast("double").alias("cap"),
                             F.col("s_nationkey").alias("zone"))


def plane_sql(lon: str, lat: str) -> str:
    return f"({lon}) * 111e0 * cos(radians({lat})) AS x, ({lat}) * 111e0 AS y"


STATIONS = f"""stations AS (SELECT s_suppkey AS sid, {lon_sql('s_suppkey')} AS lon, {lat_sql('s_suppkey')} AS lat,
    {plane_sql(lon_sql('s_suppkey'), lat_sql('s_suppkey'))}, s_acctbal / 20 + 50 AS value,
    (s_suppkey % 90 + 10)::DOUBLE AS cap, s_nationkey AS zone FROM supplier)"""


def site_points(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    x, y = plane_km(lon_of(k), lat_of(k))
    return t.customer.select(k.alias("id"), lon_of(k).alias("lon"), lat_of(k).alias("lat"), x.alias("x"), y.alias("y"))


SITE_POINTS = f"""pts AS (SELECT c_custkey AS id, {lon_sql('c_custkey')} AS lon, {lat_sql('c_custkey')} AS lat,
    {plane_sql(lon_sql('c_custkey'), lat_sql('c_custkey'))} FROM customer)"""


def production(t: Tables) -> DataFrame:
    """Hourly production per carrier from the events; null readings are injected by a fixed rule."""
    v = F.when(F.col("event_id") % 17 != 0, F.col("value"))
    return t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("carrier")).agg(
        F.sum(v).alias("mw"), F.count(v).alias("n"))


PRODUCTION = """prod AS (SELECT date_trunc('hour', ts) AS ts, event_type AS carrier,
    sum(CASE WHEN event_id % 17 <> 0 THEN value END) AS mw,
    count(CASE WHEN event_id % 17 <> 0 THEN value END) AS n FROM events GROUP BY 1, 2)"""

# Emission factors (g/kWh) per production class of the driver's events.
FACTORS = {"click": 12.0, "view": 6.0, "purchase": 490.0, "signup": 820.0, "error": 44.0}
FACTORS_SQL = "ef(carrier, ef) AS (VALUES " + ", ".join(f"('{k}', {v}e0)" for k, v in FACTORS.items()) + ")"


def factors(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(FACTORS.items()), "carrier string, ef double")
