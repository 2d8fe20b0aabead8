"""Energy operators: dispatch by capacity, emission mixes, conservation, pooling and line loading."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.functions.scalars import ColumnLike, col
from territoria.operators.ranking import quantiles

# Load centres (lat, lon, thousand inhabitants) of the population weights.
CITIES = (
    (48.857, 2.352, 12400), (45.764, 4.836, 2300), (43.297, 5.381, 1900), (43.605, 1.444, 1400), (50.633, 3.067, 1500),
    (44.838, -0.579, 1300), (43.710, 7.262, 1000), (47.218, -1.554, 1000), (48.573, 7.752, 800), (48.114, -1.681, 750),
    (45.189, 5.724, 700), (49.443, 1.100, 700), (43.611, 3.877, 800), (43.125, 5.930, 600), (47.394, 0.685, 500),
    (45.434, 4.390, 500), (45.783, 3.083, 500), (48.692, 6.184, 430), (47.903, 1.909, 440), (47.322, 5.041, 400),
    (47.473, -0.556, 420), (49.120, 6.176, 390), (49.183, -0.371, 400), (48.391, -4.486, 300), (47.996, 0.191, 350),
    (49.894, 2.296, 350), (45.834, 1.261, 280), (42.699, 2.896, 320), (47.240, 6.024, 250), (43.300, -0.370, 240),
)


def emission_mix(production: DataFrame, factors: DataFrame, keys: Sequence[str], carrier: str = "carrier", mw: str = "mw",
                 default: float = 300.0) -> DataFrame:
    """Intensity Σ(EF·MW)/Σ(MW) per key; production is summed per (key, carrier) before it meets the factors."""
    part = production.groupBy(*keys, carrier).agg(F.sum(mw).alias("_mw"))
    j = part.join(factors, carrier, "left").withColumn("_ef", F.coalesce("ef", F.lit(default)))
    return j.groupBy(*keys).agg(F.sum("_mw").alias("total_mw"), F.try_divide(F.sum(F.col("_ef") * F.col("_mw")), F.sum("_mw")).alias("intensity"))


def mix_shares(production: DataFrame, keys: Sequence[str], carrier: str = "carrier", mw: str = "mw") -> DataFrame:
    """Energy per carrier (1e6 units) and its percentage of the key's total."""
    per = production.groupBy(*keys, carrier).agg((F.sum(mw) / 1e6).alias("energy"))
    whole = per.groupBy(*keys).agg(F.sum("energy").alias("_t")) if keys else per.agg(F.sum("energy").alias("_t"))
    j = per.join(whole, list(keys), "inner") if keys else per.crossJoin(F.broadcast(whole))
    return j.select(*keys, carrier, "energy", F.try_divide(100 * F.col("energy"), F.col("_t")).alias("share_pct"))


def capacity_shares(plants: DataFrame, carrier: str = "carrier", cap: str = "cap") -> DataFrame:
    total = plants.groupBy(carrier).agg(F.sum(cap).alias("_t"))
    return plants.join(total, carrier).withColumn("share", F.try_divide(cap, "_t")).drop("_t")


def disaggregate(production: DataFrame, plants: DataFrame, ts: str = "ts", carrier: str = "carrier", mw: str = "mw",
                 cap: str = "cap", salts: int = 16) -> DataFrame:
    """(ts, plant columns, mw): national production spread by capacity share within the carrier.

    A carrier is a hot key by nature, so the plants are salted and the hours, far fewer rows, repeated once per salt. The
    merge hint keeps both sides off the driver: Spark's size estimate of a repeated side leaves the repeats out.
    """
    shares = capacity_shares(plants, carrier, cap).withColumn("_salt", F.pmod(F.xxhash64(*plants.columns), F.lit(salts)).cast("int"))
    hours = production.select(ts, carrier, F.col(mw).alias("_mw"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return hours.join(shares.hint("merge"), [carrier, "_salt"]).withColumn(mw, F.col("_mw") * F.col("share")).drop("_mw", "_salt", "share")


def conservation(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "mw") -> DataFrame:
    """Totals of two frames per key, their ratio in percent and the residual."""
    x = a.groupBy(*keys).agg(F.sum(value).alias("before"))
    y = b.groupBy(*keys).agg(F.sum(value).alias("after"))
    return x.join(y, list(keys), "full_outer").select(
        *keys, "before", "after", (100 * F.try_divide("after", "before")).alias("kept_pct"),
        (F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))).alias("residual"))


def signed_split(value: ColumnLike) -> tuple[Column, Column]:
    """(generation, pumping) of a signed storage series."""
    v = col(value)
    return F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))), F.when(v.isNotNull(), F.greatest(-v, F.lit(0.0)))


def population_weight(lat: ColumnLike, lon: ColumnLike, floor_km: float = 5.0) -> Column:
    """Σ population / distance² over the fixed city list, distance in flat degrees x 111."""
    la, lo = col(lat), col(lon)
    return reduce(add, [p / F.pow(F.greatest(111 * F.hypot(la - a, lo - b), F.lit(floor_km)), F.lit(2.0)) for a, b, p in CITIES])


def load_weights(nodes: DataFrame, lat: str = "lat", lon: str = "lon", node: str = "sid") -> DataFrame:
    w = nodes.select(node, population_weight(lat, lon).alias("_w"))
    return w.crossJoin(F.broadcast(w.agg(F.sum("_w").alias("_t")))).select(node, (F.col("_w") / F.col("_t")).alias("weight"))


def zone_mean(df: DataFrame, zone: str, value: str, weight: str) -> DataFrame:
    """Zone mean weighted by weight + 1."""
    w = F.col(weight) + 1
    return df.where(F.col(value).isNotNull()).groupBy(zone).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("zone_value"))


def pool_within(fact: DataFrame, capacity: DataFrame, alpha: float, unit: str = "gen", zone: str = "zone", ts: str = "ts", mw: str = "mw",
                cap: str = "cap") -> DataFrame:
    """alpha·own + (1-alpha)·(capacity share)·(zone total), which keeps every zone's total. Zones under 0.1 stay as they are."""
    zone_cap = capacity.groupBy(zone).agg(F.sum(cap).alias("_zc"))
    share = capacity.join(zone_cap, zone).select(unit, zone, F.when(F.col("_zc") >= 0.1, F.col(cap) / F.col("_zc")).alias("_s"))
    rows = fact.join(share, unit)
    totals = rows.groupBy(ts, zone).agg(F.sum(mw).alias("_zt"))
    pooled = alpha * F.col(mw) + (1 - alpha) * F.col("_s") * F.col("_zt")
    return rows.join(totals, [ts, zone]).withColumn("pooled", F.coalesce(pooled, F.col(mw))).drop("_s", "_zt")


def line_loading(flows: DataFrame, line: str = "line", flow: str = "flow", s_nom: str = "s_nom") -> DataFrame:
    """Peak utilisation per line and the hours above its rating."""
    u = F.abs(flow) / F.col(s_nom)
    return flows.where(F.col(s_nom) > 0).groupBy(line).agg(
        F.max(u).alias("peak"), F.avg(u).alias("mean_use"), F.count_if(u > 1).alias("n_over"), F.count_if(F.abs(flow) > 1e-6).alias("n_active"))


def category_capacity(df: DataFrame, category: str, cap: str, unit: float = 1000.0) -> DataFrame:
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), (F.sum(cap) / unit).alias("capacity")).orderBy(F.desc("capacity"), category)


def use_distribution(loading: DataFrame, probs: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99, 1.0), full: float = 1.0, high: float = 0.8) -> DataFrame:
    """One row: quantiles of the lines' ``peak`` use (``p50`` …), share and number beyond ``full``, number beyond ``high``."""
    n = loading.agg(F.count("peak").alias("n_lines"), F.avg((F.col("peak") > full).cast("double")).alias("share_over"), F.count_if(F.col("peak") > full).alias("n_over"), F.count_if(F.col("peak") > high).alias("n_high"))
    return n.crossJoin(F.broadcast(quantiles(loading, "peak", list(probs))))
