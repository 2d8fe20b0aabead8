"""Time series, aggregations, joins, sampling, checks and the star schema over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territoria.functions import scalars as S
from territoria.functions.distributions import norm_ppf
from territoria.operators import joins, quality, ranking, sampling, series, stats, warehouse
from territoria.plans.catalog.scoring import SITE_INDEX, gamma_cdf_sql, ppf_sql, restriction_orders, site_index_frame
from territoria.plans.inputs import (
    FACTORS, NATION_MONTH, PRODUCTION, SITES, STATIONS, SUPPLIER_MONTH, c01, lat_sql, lon_sql, nation_month, production,
    site_points, sites, stations, supplier_month,
)
from territoria.plans.registry import query


def r(c, d=6):
    return F.round(c, d)


# --- windows ---------------------------------------------------------------------------------

@query("rolling_windows", "W1 W2 W3 W10 W11", f"""
WITH {SUPPLIER_MONTH}, v AS (SELECT station, month, CASE WHEN (year(month) * 12 + month(month) + station) % 23 <> 0 THEN precip / 1e6 END AS q FROM sm),
 a AS (SELECT *, CASE WHEN count(q) OVER w3 = 3 THEN sum(q) OVER w3 END AS s3, CASE WHEN count(q) OVER w12 = 12 THEN sum(q) OVER w12 END AS s12,
   CASE WHEN count(q) OVER w3 = 3 THEN avg(q) OVER w3 END AS persistence, CASE WHEN count(q) OVER w12 >= 6 THEN least(stddev_samp(q) OVER w12 / 0.5e0, 1e0) END AS variability,
   avg((q IS NULL)::INT) OVER w12 AS null_share, lag(q, 1) OVER o AS l1, lag(q, 2) OVER o AS l2 FROM v
   WINDOW o AS (PARTITION BY station ORDER BY month), w3 AS (PARTITION BY station ORDER BY month ROWS 2 PRECEDING), w12 AS (PARTITION BY station ORDER BY month ROWS 11 PRECEDING))
SELECT station, month, round(s3, 9) AS s3, round(s12, 9) AS s12, round(persistence, 9) AS persistence, round(variability, 9) AS variability, round(null_share, 9) AS null_share,
  round((q + l1 + l2) / 3, 9) AS mem_mean, round(CASE WHEN q + l1 + l2 IS NOT NULL THEN least(q, l1, l2) END, 9) AS mem_min, round(q - l2, 9) AS mem_trend,
  round(s3 - s12 / 4, 11) AS delta, coalesce(s3 - s12 / 4 < -0.5, false) AS acute FROM a""")
def rolling_windows(t):
    m = F.col("month")
    v = supplier_month(t).select("station", "month", F.when((F.year(m) * 12 + F.month(m) + F.col("station")) % 23 != 0, F.col("precip") / 1e6).alias("q"))
    k, o = ["station"], "month"
    a = v.select("*", series.rolling_sum("q", k, o, 3).alias("s3"), series.rolling_sum("q", k, o, 12).alias("s12"),
                 series.rolling_mean("q", k, o).alias("persistence"), series.rolling_variability("q", k, o).alias("variability"),
                 series.null_share("q", k, o).alias("null_share"), *[c.alias(n) for n, c in series.lagged("q", k, o).items()])
    delta, acute = series.window_delta("s3", F.col("s12") / 4)
    return a.select("station", "month", *[r(c, 9).alias(c) for c in ("s3", "s12", "persistence", "variability", "null_share")],
                    *[r(c, 9).alias(n) for n, c in series.memory_features("q", "q_lag1", "q_lag2").items()], r(delta, 11).alias("delta"), acute.alias("acute"))


_Z = f"""{SUPPLIER_MONTH},
 st AS (SELECT station, month(month) AS m, avg(precip) AS mu, stddev_samp(precip) AS sd, count(precip) AS n FROM sm WHERE year(month) BETWEEN 1995 AND 1999 GROUP BY 1, 2),
 z AS (SELECT sm.station, month, precip, CASE WHEN sd > 0 AND n >= 3 THEN (precip - mu) / sd END AS z FROM sm LEFT JOIN st ON sm.station = st.station AND month(month) = m)"""


def station_z(t):
    return series.baseline_z(supplier_month(t), ["station"], "month", "precip", (1995, 1999), 3)


@query("monthly_baseline_z", "A8", f"WITH {_Z} SELECT station, month, round(z, 6) AS z FROM z")
def monthly_baseline_z(t):
    return station_z(t).select("station", "month", r("z").alias("z"))


@query("dry_spell_metrics", "A30 A31 W8 J2", f"""
WITH {_Z}, y AS (SELECT station, year(month)::DOUBLE AS y, avg(z) AS az, min(z) AS mz FROM z GROUP BY 1, 2),
 f1 AS (SELECT station, count(*) FILTER (mz < -1.5) AS critical_years FROM y GROUP BY 1),
 f3 AS (SELECT station, count(az) AS n_years, CASE WHEN count(az) < 5 THEN 0e0 ELSE regr_slope(az, y) * 10 END AS trend FROM y GROUP BY 1),
 f AS (SELECT station, month, coalesce(z < -0.5, false)::INT AS f FROM z),
 i AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY month) - sum(f) OVER (PARTITION BY station ORDER BY month) AS g FROM f),
 rl AS (SELECT station, g, count(*) AS n FROM i WHERE f = 1 GROUP BY 1, 2),
 f2 AS (SELECT station, count(*) AS n_runs, avg(n) AS mean_run FROM rl GROUP BY 1)
SELECT f1.station, critical_years, n_years, round(trend, 5) AS trend, coalesce(n_runs, 0) AS n_runs, round(coalesce(mean_run, 0), 6) AS mean_run
FROM f1 JOIN f3 ON f1.station = f3.station LEFT JOIN f2 ON f1.station = f2.station""")
def dry_spell_metrics(t):
    z, k = station_z(t), ["station"]
    out = series.critical_years(z, k, "month", "z", -1.5).join(series.decadal_trend(z, k, "month", "z"), "station").join(
        series.mean_run_length(z, k, "month", F.col("z") < -0.5), "station")
    return out.select("station", "critical_years", "n_years", r("trend", 5).alias("trend"), "n_runs", r("mean_run").alias("mean_run"))


@query("hot_dry_months", "W9", f"""
WITH {_Z}, d AS (SELECT l_suppkey AS station, l_shipdate::DATE AS day, max(l_quantity) AS temp FROM lineitem GROUP BY 1, 2),
 dd AS (SELECT *, date_trunc('month', day)::DATE AS month, (temp > 12)::INT AS hot FROM d WHERE month(day) IN (6, 7, 8)),
 i AS (SELECT *, row_number() OVER w - sum(hot) OVER w AS g FROM dd WINDOW w AS (PARTITION BY station, month ORDER BY day)),
 rn AS (SELECT DISTINCT station, month FROM (SELECT station, month, g, count(*) AS n FROM i WHERE hot = 1 GROUP BY 1, 2, 3) WHERE n >= 2)
SELECT z.station, count(*) FILTER (z < -0.5 AND month(z.month) IN (6, 7, 8) AND rn.month IS NOT NULL) AS hot_dry_months
FROM z LEFT JOIN rn ON z.station = rn.station AND z.month = rn.month GROUP BY 1""")
def hot_dry_months(t):
    d = t.lineitem.groupBy(F.col("l_suppkey").alias("station"), F.col("l_shipdate").cast("date").alias("day")).agg(F.max("l_quantity").alias("temp"))
    return series.hot_dry_months(station_z(t), d, ["station"], "month", "day", "temp", hot=12, run=2, dry=-0.5)


@query("radar_normalisation", "W12", f"""
WITH {_Z}, f AS (SELECT station, avg(z) AS a, stddev_samp(z) AS b, 1e0 AS c FROM z GROUP BY 1)
SELECT station, round((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()), 6) AS a_norm, round((max(b) OVER () - b) / (max(b) OVER () - min(b) OVER ()), 6) AS b_norm, 0.5e0 AS c_norm FROM f""")
def radar_normalisation(t):
    f = station_z(t).groupBy("station").agg(F.avg("z").alias("a"), F.stddev_samp("z").alias("b"), F.lit(1.0).alias("c"))
    out = series.minmax_scale(f, {"a": True, "b": False, "c": True})
    return out.select("station", r("a_norm").alias("a_norm"), r("b_norm").alias("b_norm"), "c_norm")


@query("percentile_rank_index", "W6", f"""
WITH {SITES}, p AS (SELECT id, (rank() OVER (ORDER BY x_bws) + (count(*) OVER (PARTITION BY x_bws) - 1) / 2e0) / count(*) OVER () AS pb,
   (rank() OVER (ORDER BY x_sv) + (count(*) OVER (PARTITION BY x_sv) - 1) / 2e0) / count(*) OVER () AS ps FROM sites)
SELECT id, round(pb, 7) AS p_bws, round(ps, 7) AS p_sv, round(0.6e0 * pb + 0.4e0 * ps, 7) AS index FROM p""")
def percentile_rank_index(t):
    s = sites(t).select("id", "x_bws", "x_sv")
    s = ranking.with_rank(ranking.with_rank(s, "x_bws", "pb", percentile=True), "x_sv", "ps", percentile=True)
    return s.select("id", r("pb", 7).alias("p_bws"), r("ps", 7).alias("p_sv"), r(0.6 * F.col("pb") + 0.4 * F.col("ps"), 7).alias("index"))


@query("rank_swaps", "W7", f"""
WITH {SITE_INDEX}, k AS (SELECT c_nationkey, id, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(h2, 9) DESC, id) AS r2, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(h3, 9) DESC, id) AS r3 FROM idx)
SELECT c_nationkey AS zone, count(*) AS n, count(*) FILTER (r2 <> r3) AS swapped, max(abs(r2 - r3)) AS largest FROM k GROUP BY 1""")
def rank_swaps(t):
    s = site_index_frame(t).select(F.col("c_nationkey").alias("zone"), "id", F.round("h2", 9).alias("h2"), F.round("h3", 9).alias("h3"))
    k = ranking.position(ranking.position(s, "h2", "id", ["zone"], "r2", descending=True), "h3", "id", ["zone"], "r3", descending=True)
    return k.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r2") != F.col("r3")).alias("swapped"), F.max(F.abs(F.col("r2") - F.col("r3"))).alias("largest"))


@query("cumulative_revenue", "W14", """
WITH c AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1),
 s AS (SELECT v, count(*) AS n, sum(v) AS a FROM c GROUP BY 1)
SELECT v AS value, n, rank_desc, round(share, 8) AS running_share FROM (SELECT v, n, sum(n) OVER w - n + 1 AS rank_desc, sum(a) OVER w / sum(a) OVER () AS share FROM s WINDOW w AS (ORDER BY v DESC))""")
def cumulative_revenue(t):
    c = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return ranking.cumulative_share(c, "v").select("value", "n", "rank_desc", r("running_share", 8).alias("running_share"))


@query("top_site_frequency", "W15 M22 J19", f"""
WITH {SITES}, p(wid, wb) AS (VALUES (0, 0.3e0), (1, 0.4e0), (2, 0.5e0), (3, 0.6e0), (4, 0.7e0)),
 s AS (SELECT wid, c_nationkey AS zone, id, round(wb * x_bws + (1 - wb) * x_sv, 9) AS h FROM sites, p),
 k AS (SELECT *, row_number() OVER (PARTITION BY wid, zone ORDER BY h DESC, id) AS top, row_number() OVER (PARTITION BY wid, zone ORDER BY h, id) AS bottom FROM s)
SELECT zone, id, count(*) FILTER (top <= 3) AS n_top, count(*) FILTER (bottom <= 3) AS n_bottom FROM k WHERE top <= 3 OR bottom <= 3 GROUP BY 1, 2""")
def top_site_frequency(t):
    wb = F.explode(F.array(*[F.struct(F.lit(i).alias("wid"), F.lit(v).alias("wb")) for i, v in enumerate((0.3, 0.4, 0.5, 0.6, 0.7))]))
    s = sites(t).select(F.col("c_nationkey").alias("zone"), "id", "x_bws", "x_sv", wb.alias("p")).select(
        "p.wid", "zone", "id", F.round(F.col("p.wb") * F.col("x_bws") + (1 - F.col("p.wb")) * F.col("x_sv"), 9).alias("h"))
    top = ranking.top_per_group(s, ["wid", "zone"], [F.desc("h"), F.asc("id")], 3).select("zone", "id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    low = ranking.top_per_group(s, ["wid", "zone"], [F.asc("h"), F.asc("id")], 3).select("zone", "id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    return top.unionByName(low).groupBy("zone", "id").agg(F.sum("a").alias("n_top"), F.sum("b").alias("n_bottom"))


# --- aggregations ----------------------------------------------------------------------------

@query("hourly_resample", "A1", """
SELECT date_trunc('hour', ts) AS bucket, event_type, count(value) AS n, round(avg(value), 5) AS mean FROM events GROUP BY 1, 2""")
def hourly_resample(t):
    return series.resample(t.events, "ts", "hour", [F.count("value").alias("n"), r(F.avg("value"), 5).alias("mean")], ["event_type"])


@query("calendar_resamples", "A1", """
SELECT 'day' AS unit, date_trunc('day', ts)::TIMESTAMP AS bucket, round(avg(value), 5) AS mean FROM events GROUP BY 1, 2 UNION ALL
SELECT 'week', date_trunc('week', ts)::TIMESTAMP, round(avg(value), 5) FROM events GROUP BY 1, 2 UNION ALL
SELECT 'quarter_hour', time_bucket(INTERVAL 15 MINUTE, ts), round(avg(value), 5) FROM events GROUP BY 1, 2 UNION ALL
SELECT 'hour_of_day', TIMESTAMP '2000-01-01 00:00:00' + INTERVAL 1 HOUR * hour(ts), round(avg(value), 5) FROM events GROUP BY 1, 2""")
def calendar_resamples(t):
    """All four resolutions from one pass: quarter-hour sums and counts are rolled up."""
    q = t.events.groupBy(F.window("ts", "15 minutes")["start"].alias("q")).agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    b = F.explode(F.array(
        F.struct(F.lit("day").alias("unit"), F.date_trunc("day", "q").cast("timestamp_ntz").alias("bucket")),
        F.struct(F.lit("week").alias("unit"), F.date_trunc("week", "q").cast("timestamp_ntz").alias("bucket")),
        F.struct(F.lit("quarter_hour").alias("unit"), F.col("q").cast("timestamp_ntz").alias("bucket")),
        F.struct(F.lit("hour_of_day").alias("unit"), F.expr("timestamp_ntz'2000-01-01 00:00:00' + make_dt_interval(0, hour(q))").alias("bucket"))))
    return q.select(b.alias("b"), "s", "n").groupBy("b.unit", "b.bucket").agg(r(F.sum("s") / F.sum("n"), 5).alias("mean"))


@query("department_levels", "A2 J16", """
WITH v AS (SELECT CASE WHEN o_custkey % 96 < 10 THEN '0' ELSE '' END || (o_custkey % 96)::VARCHAR AS dept, o_orderkey AS k, o_orderdate::DATE AS s, o_orderdate::DATE + (o_orderkey % 90)::INT AS e,
   CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '4' THEN 1 ELSE 0 END AS lv FROM orders),
 g AS (SELECT dept, CASE k % 3 WHEN 0 THEN greatest(lv, 1) WHEN 1 THEN lv ELSE 0 END AS sev, k FROM v WHERE s <= DATE '1998-07-15' AND e >= DATE '1998-07-15')
SELECT dept, max(sev) AS level, count(k) AS n_orders, CASE max(sev) WHEN 1 THEN 'vigilance' WHEN 2 THEN 'alerte' WHEN 3 THEN 'alerte_renforcee' WHEN 4 THEN 'crise' END AS label FROM g GROUP BY 1""")
def department_levels(t):
    from territoria.functions.text import LEVELS, severity_max

    day = F.lit("1998-07-15").cast("date")
    g = joins.active_on(restriction_orders(t), "start", "end", day).select("dept", "order_id", severity_max("levels").alias("sev"))
    agg = g.groupBy("dept").agg(F.max("sev").alias("level"), F.count("order_id").alias("n_orders"))
    names = F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (v, k)])
    return agg.withColumn("label", F.try_element_at(names, F.col("level")))


@query("active_orders_per_day", "J16", """
WITH v AS (SELECT o_orderdate::DATE AS s, o_orderdate::DATE + (o_orderkey % 90)::INT AS e FROM orders),
 st AS (SELECT s AS day, 1 AS x FROM v UNION ALL SELECT e + 1, -1 FROM v), d AS (SELECT day, sum(x) AS x FROM st GROUP BY 1),
 c AS (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY))::DATE AS day)
SELECT c.day, sum(coalesce(x, 0)) OVER (ORDER BY c.day) AS n_active FROM c LEFT JOIN d ON c.day = d.day""")
def active_orders_per_day(t):
    return joins.active_per_day(restriction_orders(t), "start", "end")


@query("dataset_summary", "A4 E3", f"""
WITH {SITES}
SELECT count(*) AS n_total, count(x_gws) AS n_valid, round(avg(x_gws), 6) AS mean, min(x_gws) AS min, max(x_gws) AS max, round(stddev_pop(x_gws), 6) AS std, min(lon) FILTER (x_gws IS NOT NULL) AS west,
  max(lon) FILTER (x_gws IS NOT NULL) AS east, min(lat) FILTER (x_gws IS NOT NULL) AS south, max(lat) FILTER (x_gws IS NOT NULL) AS north,
  round(quantile_cont(x_gws, 0.1), 6) AS p10, round(quantile_cont(x_gws, 0.5), 6) AS median, round(quantile_cont(x_gws, 0.9), 6) AS p90 FROM sites""")
def dataset_summary(t):
    d = stats.dataset_stats(sites(t), "x_gws", "lon", "lat")
    return d.select("n_total", "n_valid", *[r(c).alias(c) if c in ("mean", "std", "p10", "median", "p90") else c for c in d.columns[2:]])


@query("reading_quality", "A5", """
WITH v AS (SELECT CASE WHEN event_id % 17 <> 0 THEN value END AS v FROM events)
SELECT count(*) AS n_total, count(v) AS n_valid, count(*) - count(v) AS n_null, round(100.0e0 * avg((v IS NULL)::INT), 6) AS null_pct, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max,
  round(quantile_cont(v, 0.05), 5) AS p5, round(quantile_cont(v, 0.25), 5) AS p25, round(quantile_cont(v, 0.5), 5) AS p50, round(quantile_cont(v, 0.75), 5) AS p75, round(quantile_cont(v, 0.95), 5) AS p95 FROM v""")
def reading_quality(t):
    q = stats.quality_report(t.events.select(F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("v")), "v")
    return q.select("n_total", "n_valid", "n_null", r("null_pct").alias("null_pct"), r("mean").alias("mean"), r("std").alias("std"), "min", "max",
                    *[r(c, 5).alias(c) for c in ("p5", "p25", "p50", "p75", "p95")])


@query("layer_summary", "A6", f"""
WITH {_Z}, s AS (SELECT year(month) AS year, z, 1 / (1 + exp(0.8e0 * z)) AS stress FROM z)
SELECT year, round(avg(z), 6) AS index_mean, round(stddev_pop(z), 6) AS index_std, round(100 * avg((z < -1)::INT), 6) AS dry_pct, round(100 * avg((z < -2)::INT), 6) AS very_dry_pct,
  round(100 * avg((stress > 0.7)::INT), 6) AS high_stress_pct, round(quantile_cont(stress, 0.05), 6) AS p5, round(quantile_cont(stress, 0.95), 6) AS p95 FROM s GROUP BY 1""")
def layer_summary(t):
    s = station_z(t).select(F.year("month").alias("year"), "z", S.z_to_stress("z").alias("stress"))
    d = stats.layer_summary(s, ["year"], "z", "stress")
    return d.select("year", *[r(c).alias(c) for c in d.columns[1:]])


@query("null_profile", "A7", f"""
WITH {SITES}
SELECT u.column_name, u.n_null, round(100e0 * n_null / n, 6) AS null_pct FROM (SELECT count(*) AS n, unnest(['x_gws', 'spei3', 'spei12', 'x_bws']) AS column_name,
  unnest([count(*) - count(x_gws), count(*) - count(spei3), count(*) - count(spei12), count(*) - count(x_bws)]) AS n_null FROM sites) u""")
def null_profile(t):
    return stats.null_counts(sites(t), ["x_gws", "spei3", "spei12", "x_bws"]).withColumn("null_pct", r("null_pct"))


@query("value_counts_describe", "A7", """
WITH l AS (SELECT 'l_quantity' AS column_name, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem)
SELECT column_name, count(v) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.25), 5) AS p25, round(quantile_cont(v, 0.5), 5) AS p50, round(quantile_cont(v, 0.75), 5) AS p75 FROM l GROUP BY 1
UNION ALL SELECT 'flag_' || l_returnflag, count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lineitem GROUP BY 1""")
def value_counts_describe(t):
    d = stats.describe(t.lineitem, ["l_quantity", "l_discount", "l_extendedprice"])
    d = d.select("column_name", "n", r("mean", 5).alias("mean"), r("std", 5).alias("std"), "min", "max", *[r(c, 5).alias(c) for c in ("p25", "p50", "p75")])
    v = stats.value_counts(t.lineitem, ["l_returnflag"]).select(F.concat(F.lit("flag_"), "l_returnflag").alias("column_name"), "n")
    return d.unionByName(v, allowMissingColumns=True)


@query("station_anomalies", "A9 P5", """
WITH a AS (SELECT o_custkey AS station, avg(o_totalprice) FILTER (o_orderdate >= '2000-06-01') AS rm, avg(o_totalprice) FILTER (o_orderdate < '2000-06-01') AS bm,
  stddev_samp(o_totalprice) FILTER (o_orderdate < '2000-06-01') AS bs, count(*) FILTER (o_orderdate >= '2000-06-01') AS n_recent, count(*) FILTER (o_orderdate < '2000-06-01') AS n_baseline FROM orders GROUP BY 1)
SELECT station, round(rm::DECIMAL(18,6), 2)::DOUBLE AS recent_mean, round(bm::DECIMAL(18,6), 2)::DOUBLE AS baseline_mean, round(bs::DECIMAL(18,6), 2)::DOUBLE AS baseline_std, round((rm - bm) / bs, 3) AS zscore, n_recent, n_baseline,
  round(1 / (1 + exp(0.8e0 * round((rm - bm) / bs, 3))), 6) AS stress FROM a WHERE n_recent >= 2 AND n_baseline >= 5 AND bs >= 0.01""")
def station_anomalies(t):
    o = t.orders.withColumnRenamed("o_custkey", "station")
    cut = F.lit("2000-06-01").cast("timestamp_ntz")
    d = F.col("o_orderdate")
    return series.station_anomaly(o, "station", "o_orderdate", "o_totalprice", d >= cut, d < cut, 2, 5).withColumn("stress", r("stress"))


@query("aridity_index", "A10 P6", f"""
WITH {NATION_MONTH}, a AS (SELECT nation, sum(precip) FILTER (year(month) BETWEEN 1996 AND 1999) / 4 AS p, sum(pet) FILTER (year(month) BETWEEN 1996 AND 1999) / 4 AS e FROM nm GROUP BY 1)
SELECT nation, round(p, 4) AS p_year, round(e, 4) AS pet_year, round(p / e, 6) AS aridity, round(1 / (1 + pow(p / e / 0.65e0, 3)), 6) AS aridity_stress FROM a""")
def aridity_index(t):
    a = series.aridity(nation_month(t), ["nation"], "month", "precip", "pet", (1996, 1999))
    return a.select("nation", r("p_year", 4).alias("p_year"), r("pet_year", 4).alias("pet_year"), r("aridity").alias("aridity"), r("aridity_stress").alias("aridity_stress"))


@query("temporal_percentiles", "A17 P36 P37 A18 Q1", f"""
WITH {_Z}, d AS (SELECT station, month, {c01('-z', '3e0')} AS dr, (station * 29 % 101) / 100e0 AS b, (station * 17 % 97) / 96e0 AS g FROM z),
 w AS (SELECT *, {c01('0.60e0 * b + 0.25e0 * g + 0.15e0 * dr')} AS wsi FROM d)
SELECT station, round(avg(wsi), 8) AS wsi_mean, round(quantile_cont(wsi, 0.1), 8) AS wsi_p10, round(quantile_cont(wsi, 0.9), 8) AS wsi_p90, round(avg(dr), 8) AS drought_mean,
  round(least(sqrt(pow(0.60e0 * 0.12e0 * any_value(b), 2) + pow(0.25e0 * 0.18e0 * any_value(g), 2) + pow(0.15e0 * 0.22e0 * avg(dr), 2)), 1e0), 8) AS sigma,
  round(min(100 * (1 - wsi)), 6) AS worst, round(avg(100 * (1 - wsi)) FILTER (month(month) BETWEEN 6 AND 9), 6) AS summer FROM w GROUP BY 1""")
def temporal_percentiles(t):
    from territoria.plans.grid_score import index_over_time

    k = F.col("station")
    d = station_z(t).select("station", "month", S.linear_stress("z").alias("drought"), ((k * 29 % 101) / 100).alias("bws"), ((k * 17 % 97) / 96).alias("gws"))
    o = index_over_time(d, ["station"], "month")
    return o.select("station", r("wsi_mean", 8).alias("wsi_mean"), r("wsi_p10", 8).alias("wsi_p10"), r("wsi_p90", 8).alias("wsi_p90"), r("drought_norm_mean", 8).alias("drought_mean"),
                    r("wsi_uncertainty", 8).alias("sigma"), r("worst_month_score", 6).alias("worst"), r("summer_mean_score", 6).alias("summer"))


@query("region_means", "A19", f"""
WITH {SITES} SELECT round(avg(x_bws) FILTER (lat BETWEEN 42 AND 44 AND lon BETWEEN 3 AND 7), 6) AS south, round(avg(x_bws) FILTER (lat BETWEEN 47.5 AND 49 AND lon BETWEEN -4.5 AND -1), 6) AS west,
  round(avg(x_bws) FILTER (lat BETWEEN 44.5 AND 47 AND lon BETWEEN 5.5 AND 7.5), 6) AS alps FROM sites""")
def region_means(t):
    def box(s, n, w, e):
        return r(F.avg(F.when(F.col("lat").between(s, n) & F.col("lon").between(w, e), F.col("x_bws"))))
    return sites(t).agg(box(42, 44, 3, 7).alias("south"), box(47.5, 49, -4.5, -1).alias("west"), box(44.5, 47, 5.5, 7.5).alias("alps"))


_YEARS = range(1995, 2002)


@query("year_pivot", "A20", f"""
SELECT o_custkey AS site, {', '.join(f"round(coalesce(sum(o_totalprice) FILTER (year(o_orderdate) = {y}), 0), 2) AS y{y}" for y in _YEARS)},
  round(coalesce(sum(o_totalprice) FILTER (year(o_orderdate) IS NULL OR year(o_orderdate) NOT BETWEEN {_YEARS[0]} AND {_YEARS[-1]}), 0), 2) AS other FROM orders GROUP BY 1""")
def year_pivot(t):
    year = F.year("o_orderdate")
    slot = F.when(year.between(_YEARS[0], _YEARS[-1]), F.concat(F.lit("y"), year.cast("string"))).otherwise("other")
    columns = [*[f"y{y}" for y in _YEARS], "other"]
    p = t.orders.select(F.col("o_custkey").alias("site"), slot.alias("slot"), "o_totalprice").groupBy("site").pivot("slot", columns).agg(F.sum("o_totalprice"))
    return p.fillna(0, columns).select("site", *[F.round(c, 2).alias(c) for c in columns])


@query("value_histogram", "A21", """
SELECT CASE WHEN value < 20 THEN 0 WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 WHEN value < 200 THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg(value), 5) AS mean,
  CASE WHEN value < 20 THEN 0e0 WHEN value < 50 THEN 20e0 WHEN value < 100 THEN 50e0 WHEN value < 200 THEN 100e0 ELSE 200e0 END AS low FROM events GROUP BY 1, 4""")
def value_histogram(t):
    return stats.histogram(t.events, "value", [0, 20, 50, 100, 200, 1e9], aggs=[r(F.avg("value"), 5).alias("mean")])


def model_vs_reference(t):
    p = production(t)
    w = p.groupBy("ts").agg(*[F.sum(F.when(F.col("carrier") == c, F.coalesce("mw", F.lit(0.0)))).alias(c) for c in ("click", "view")])
    return w.where(F.col("click").isNotNull() & F.col("view").isNotNull()).select("ts", (F.col("click") + 1).alias("true"), (F.col("view") + 1).alias("pred"))


_MVR = f"""{PRODUCTION}, mr AS (SELECT ts, sum(coalesce(mw, 0)) FILTER (carrier = 'click') + 1 AS tv, sum(coalesce(mw, 0)) FILTER (carrier = 'view') + 1 AS pred FROM prod GROUP BY 1),
 m AS (SELECT *, abs(tv - pred) AS ae, pred - tv AS e FROM mr WHERE tv IS NOT NULL AND pred IS NOT NULL)"""


@query("model_error_metrics", "A28 J17", f"""
WITH {_MVR}
SELECT count(*) AS n, round(avg(ae), 5) AS mae, round(sqrt(avg(e * e)), 5) AS rmse, round(100 * sum(ae) / sum(tv), 5) AS wmape, round(100 * avg(ae / abs(tv)), 5) AS mape,
  round(avg(200 * ae / (abs(tv) + abs(pred) + 1e-10)), 5) AS smape, round(degrees(avg(atan(ae / (abs(tv) + 1e-10)))), 5) AS maape, round(avg(e), 5) AS bias,
  round(1 - sum(e * e) / (var_pop(tv) * count(*)), 5) AS r2, round(1 - var_pop(e) / var_pop(tv), 5) AS r2_centred, round(stddev_pop(e), 5) AS rmse_centred, round(corr(tv, pred), 6) AS corr,
  round(quantile_cont(ae, 0.5), 5) AS medae, round(quantile_cont(ae, 0.95), 5) AS ae_p95, round(quantile_cont(ae, 0.99), 5) AS ae_p99 FROM m""")
def model_error_metrics(t):
    d = stats.error_metrics(joins.time_intersection(model_vs_reference(t).select("ts", "true"), model_vs_reference(t).select("ts", "pred"), ["ts"]), "true", "pred")
    return d.select("n", *[r(c, 6 if c == "corr" else 5).alias(c) for c in d.columns[1:]])


@query("regime_errors", "A29", f"""
WITH {_MVR}, b AS (SELECT *, CASE WHEN tv < 50 THEN 'low' WHEN tv < 200 THEN 'mid' ELSE 'high' END AS regime FROM m)
SELECT regime, count(*) AS n, round(100 * avg((ae > 20)::INT), 5) AS over_20_pct, round(100 * avg((ae > 50)::INT), 5) AS over_50_pct, round(100 * avg((ae > 100)::INT), 5) AS over_100_pct,
  count(*) FILTER (tv >= 100) AS n_high, count(*) FILTER (tv >= 100 AND pred < tv) AS n_high_under, round(avg(pred - tv) FILTER (tv >= 100 AND pred < tv), 5) AS high_under_bias,
  count(*) FILTER (tv > 100 AND pred < 50) AS high_as_low, count(*) FILTER (tv < 20 AND pred > 100) AS low_as_high, count(*) FILTER (tv > 200 AND pred < 100) AS very_high_as_mid FROM b GROUP BY 1""")
def regime_errors(t):
    d = stats.regime_errors(model_vs_reference(t).withColumn("regime", S.regime_band("true")), "true", "pred", ["regime"])
    return d.select(*[r(c, 5).alias(c) if c.endswith(("pct", "bias")) else c for c in d.columns])


@query("component_correlations", "A32", f"""
WITH {SITES} SELECT a, b, round(r, 6) AS r, abs(r) > 0.5 AS flagged FROM (SELECT unnest(['x_bws', 'x_bws', 'x_aridity']) AS a, unnest(['x_aridity', 'x_sv', 'x_sv']) AS b,
  unnest([corr(x_bws, x_aridity), corr(x_bws, x_sv), corr(x_aridity, x_sv)]) AS r FROM sites)""")
def component_correlations(t):
    return stats.pearson_pairs(sites(t), ["x_bws", "x_aridity", "x_sv"], 0.5).withColumn("r", r("r"))


@query("component_vif", "A33")
def component_vif(t):
    return stats.vif(sites(t), ["x_bws", "x_aridity", "x_sv", "x_gws"])


@query("component_pca", "A34")
def component_pca(t):
    return stats.pca_summary(sites(t), ["x_bws", "x_aridity", "x_sv", "x_gws"])


def rank_sql(col: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {col}" if part else f"PARTITION BY {col}"
    return f"(rank() OVER ({p}ORDER BY {col}) + (count(*) OVER ({q}) - 1) / 2e0)"


def spearman_p_sql(table: str) -> str:
    """``table`` (n, rho, …) with p: the two-sided Student probability by the continued fraction of the incomplete beta."""
    def part(x: str, a: str, b: str) -> str:
        even = f"(i // 2) * ({b} - i // 2) / (({a} + 2 * (i // 2) - 1) * ({a} + 2 * (i // 2)))"
        odd = f"-({a} + i // 2) * ({a} + {b} + i // 2) / (({a} + 2 * (i // 2)) * ({a} + 2 * (i // 2) + 1))"
        numbers = f"list_transform(range(400, 0, -1), lambda i: {x} * (CASE WHEN i % 2 = 0 THEN {even} ELSE {odd} END))"
        front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})) / {a}"
        return f"{front} / list_reduce(list_concat([1e0], {numbers}), lambda f, d: 1 + d / f)"

    a, b, x = "(df / 2e0)", "0.5e0", "(df / (df + tt * tt))"
    near = f"{x} <= ({a} + 1) / ({a} + {b} + 2)"
    return (f"SELECT *, CASE WHEN tt = 0 THEN 1e0 WHEN {near} THEN {part(x, a, b)} ELSE 1 - {part(f'(1 - {x})', b, a)} END AS p FROM "
            f"(SELECT *, n - 2 AS df, rho * sqrt((n - 2) / greatest(1 - rho * rho, 1e-300)) AS tt FROM {table})")


@query("index_level_spearman", "A35 A22", f"""
WITH {SITE_INDEX}, v AS (SELECT round(h2, 9) AS h, level FROM idx WHERE h2 IS NOT NULL), k AS (SELECT {rank_sql('h')} AS a, {rank_sql('level')} AS b FROM v), c AS (SELECT count(*) AS n, corr(a, b) AS rho FROM k), x AS ({spearman_p_sql('c')}) SELECT n, round(rho, 7) AS rho, round(p, 6) AS p_value FROM x""")
def index_level_spearman(t):
    s = stats.spearman(site_index_frame(t).withColumn("h", F.round("h2", 9)), "h", "level")
    return s.select("n", r("rho", 7).alias("rho"), r(stats.spearman_p("rho", "n")).alias("p_value"))


@query("feature_screening", "A36", f"""
WITH {SITES}, l AS (SELECT level, unnest(['x_bws', 'x_aridity', 'x_gws', 'x_sv', 'spei3']) AS feature, unnest([x_bws, x_aridity, x_gws, x_sv, spei3]) AS v FROM sites),
 k AS (SELECT feature, {rank_sql('v', 'feature')} AS a, {rank_sql('level', 'feature')} AS b FROM l WHERE v IS NOT NULL), c AS (SELECT feature, count(*) AS n, corr(a, b) AS rho FROM k GROUP BY 1), x AS ({spearman_p_sql('c')})
SELECT feature, n, round(rho, 7) AS rho, round(abs(rho), 7) AS strength, rho < 0 AS flip, round(p, 6) AS p_value FROM x""")
def feature_screening(t):
    d = stats.screen_features(sites(t), ["x_bws", "x_aridity", "x_gws", "x_sv", "spei3"], "level")
    return d.withColumn("p_value", r(stats.spearman_p("rho", "n"))).withColumn("rho", r("rho", 7)).withColumn("strength", r("strength", 7))


@query("concordant_pairs", "J20", f"""
WITH {SITES}, p AS (SELECT a.x_bws AS ha, b.x_bws AS hb, a.level AS la, b.level AS lb FROM sites a JOIN sites b ON a.id < b.id)
SELECT (SELECT count(*) FROM sites) AS n, round(100e0 * count(*) FILTER ((ha - hb) * (la - lb) > 0) / count(*), 7) AS pct,
  round(100e0 * (count(*) FILTER ((ha - hb) * (la - lb) > 0) + 0.5e0 * count(*) FILTER (la = lb)) / count(*), 7) AS pct_ties_half FROM p""")
def concordant_pairs(t):
    d = stats.concordant_pairs(sites(t), "x_bws", "level", [1, 2, 3, 4])
    return d.select("n", r("pct", 7).alias("pct"), r("pct_ties_half", 7).alias("pct_ties_half"))


@query("hour_completeness", "A37 U3 S14", """
WITH e AS (SELECT unnest(generate_series(date_trunc('hour', (SELECT min(ts) FROM events)), date_trunc('hour', (SELECT max(ts) FROM events)), INTERVAL 1 HOUR)) AS h),
 p AS (SELECT date_trunc('day', h)::DATE AS period, count(*) AS n_expected FROM e GROUP BY 1), k AS (SELECT DISTINCT event_type FROM events),
 g AS (SELECT event_type, date_trunc('day', ts)::DATE AS period, count(DISTINCT date_trunc('hour', ts)) AS n_seen FROM events GROUP BY 1, 2)
SELECT k.event_type, p.period, n_expected, coalesce(n_seen, 0) AS n_seen, n_expected - coalesce(n_seen, 0) AS n_missing, round(100e0 * coalesce(n_seen, 0) / n_expected, 5) AS coverage_pct
FROM p CROSS JOIN k LEFT JOIN g ON g.event_type = k.event_type AND g.period = p.period""")
def hour_completeness(t):
    return stats.completeness(t.events, ["event_type"], "ts", "hour", "day").withColumn("coverage_pct", r("coverage_pct", 5))


@query("robust_outliers", "A16", """
WITH m AS (SELECT median(o_totalprice / (1 + o_orderkey % 4)) AS med FROM orders), v AS (SELECT o_orderkey, o_totalprice / (1 + o_orderkey % 4) AS v, med FROM orders, m), d AS (SELECT median(abs(v - med)) AS mad FROM v)
SELECT o_orderkey, round(CASE WHEN NOT (mad >= 1e-10 AND abs(v - med) / (1.4826e0 * mad) > 2.5) THEN v END, 4) AS cleaned FROM v, d""")
def robust_outliers(t):
    v = t.orders.select("o_orderkey", (F.col("o_totalprice") / (1 + F.col("o_orderkey") % 4)).alias("v"))
    return stats.mad_outliers(v, "v", 2.5).select("o_orderkey", r("cleaned", 4).alias("cleaned"))


@query("ecdf_index", "A41 A42 P25", f"""
WITH {SUPPLIER_MONTH}, b AS (SELECT station, month, round(precip - pet, 2) AS d FROM sm),
 c AS (SELECT t.station, t.month, t.d, count(s.d) FILTER (s.d <= t.d) AS below, count(s.d) AS n FROM b t LEFT JOIN b s ON s.station = t.station AND month(s.month) = month(t.month) AND year(s.month) BETWEEN 1995 AND 1999 GROUP BY 1, 2, 3),
 p AS (SELECT *, CASE WHEN n >= 4 THEN (below + 0.5e0) / (n + 1) END AS p FROM c), z AS (SELECT *, {ppf_sql('p', '1e-4')} AS spei FROM p)
SELECT year(month) AS year, count(spei) AS n, round(avg(spei), 6) AS mean, round(stddev_pop(spei), 6) AS std, round(quantile_cont(spei, 0.5), 6) AS median, round(min(spei), 6) AS min, round(max(spei), 6) AS max,
  round(100 * avg((spei <= -3.5)::INT), 6) AS sat_low_pct, round(100 * avg((spei >= 3.5)::INT), 6) AS sat_high_pct FROM z GROUP BY 1""")
def ecdf_index(t):
    b = supplier_month(t).select("station", "month", F.month("month").alias("cal"), F.round(F.col("precip") - F.col("pet"), 2).alias("d"))
    z = series.spei_ecdf(b, ["station", "cal"], "d", F.year("month").between(1995, 1999), min_values=4)
    z = z.withColumn("year", F.year("month"))
    s = series.index_sanity(z, "spei", ["year"]).join(z.groupBy("year").agg(F.count("spei").alias("n")), "year")
    s = s.join(ranking.quantiles(z, "spei", [0.5], ["year"]).withColumnRenamed("p50", "median"), "year", "left")
    return s.select("year", "n", *[r(c).alias(c) for c in ("mean", "std", "median", "min", "max", "sat_low_pct", "sat_high_pct")])


@query("thom_gamma_fit", "A39", f"""
WITH {NATION_MONTH}, a AS (SELECT nation, month(month) AS cal, avg(precip) AS m, avg(ln(precip)) AS lm FROM nm GROUP BY 1, 2), g AS (SELECT *, ln(m) - lm AS a FROM a WHERE ln(m) - lm > 1e-9)
SELECT nation, cal, round((1 + sqrt(1 + 4 * a / 3)) / (4 * a), 4) AS shape, round(m / ((1 + sqrt(1 + 4 * a / 3)) / (4 * a)), 3) AS scale FROM g""")
def thom_gamma_fit(t):
    a = nation_month(t).groupBy("nation", F.month("month").alias("cal")).agg(F.avg("precip").alias("m"), F.avg(F.ln("precip")).alias("lm"))
    shape, scale = series.thom_gamma("m", "lm")
    return a.where(F.ln("m") - F.col("lm") > 1e-9).select("nation", "cal", r(shape, 4).alias("shape"), r(scale, 3).alias("scale"))


def _balance(t):
    m = nation_month(t).withColumn("cal", F.month("month"))
    return m.withColumn("d", F.col("precip") - F.col("pet"))


_BALANCE = f"""{NATION_MONTH}, b AS (SELECT nation, month, month(month) AS cal, precip, precip - pet AS d FROM nm)"""


def gamma_shape_sql(g: str) -> str:
    """Newton on ln a - digamma(a) = g from the closed-form start."""
    v, y = "(1 / ((a + 8) * (a + 8)))", "(a + 8)"
    digamma = f"(ln({y}) - 0.5e0 / {y} - {v} * (1 / 12e0 - {v} * (1 / 120e0 - {v} * (1 / 252e0 - {v} * (1 / 240e0 - {v} / 132e0)))) - {' - '.join(f'1 / (a + {k})' for k in range(8))})"
    trigamma = f"(1 / {y} + {v} / 2 + {v} / {y} * (1 / 6e0 - {v} * (1 / 30e0 - {v} * (1 / 42e0 - {v} / 30e0))) + {' + '.join(f'1 / ((a + {k}) * (a + {k}))' for k in range(8))})"
    start = f"(3 - {g} + sqrt(({g} - 3) * ({g} - 3) + 24 * {g})) / (12 * {g})"
    return f"list_reduce(list_concat([{start}], [{', '.join(['0e0'] * 12)}]), lambda a, i: greatest(a - (ln(a) - {digamma} - {g}) / (1 / a - {trigamma}), 1e-8))"


def spi_sql(table: str, keys: str, value: str, base: str, extra: str = "") -> str:
    """CTEs ``fit`` and ``spi``: the gamma index of ``value`` in ``table``, fitted per ``keys`` on the rows of ``base``."""
    on = " AND ".join(f"t.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    return f"""fit0 AS (SELECT {keys}, count({value}) FILTER ({base}) AS n, count(*) FILTER ({base} AND {value} > 0) AS np, avg(({value} = 0)::INT) FILTER ({base}) AS q0,
  avg({value}) FILTER ({base} AND {value} > 0) AS m, avg(CASE WHEN {value} > 0 THEN ln({value}) END) FILTER ({base}) AS lm FROM {table} GROUP BY {keys}),
 fit1 AS (SELECT *, CASE WHEN ln(m) - lm > 0 THEN ln(m) - lm END AS g FROM fit0), fit AS (SELECT *, {gamma_shape_sql('g')} AS a FROM fit1),
 spi0 AS (SELECT t.*, f.n, f.np, CASE WHEN {value} IS NULL THEN NULL WHEN {value} <= 0 THEN q0 ELSE q0 + (1 - q0) * {gamma_cdf_sql('a', f'({value} / (m / a))')} END AS p FROM {table} t JOIN fit f ON {on}),
 spi AS (SELECT *, CASE WHEN n < 10 THEN NULL WHEN np < 4 THEN 0e0 WHEN {value} IS NOT NULL THEN {ppf_sql('p', '1e-6')} END AS spi FROM spi0)"""


@query("gamma_drought_index", "A39 P27 F1", f"WITH {_BALANCE}, {spi_sql('b', 'nation', 'precip', 'year(month) BETWEEN 1995 AND 1999')} SELECT nation, month, round(spi, 6) AS spi FROM spi")
def gamma_drought_index(t):
    z = series.spi_gamma(_balance(t), ["nation"], "precip", F.year("month").between(1995, 1999))
    return z.select("nation", "month", r("spi").alias("spi"))


def loglogistic_sql(keys: str, base: str, least: int) -> str:
    """CTEs ``fit`` (keys, m, t, shift) by Newton's method with bounded steps and ``p`` with the probability of every row of b."""
    using = f"USING ({keys})"
    return f"""o AS (SELECT {keys}, 1 - min(d) AS shift, count(*) AS n FROM b WHERE {base} GROUP BY {keys}), y AS (SELECT {keys}, shift, ln(d + shift) AS y FROM b JOIN o {using} WHERE {base} AND n >= {least}),
 it AS (SELECT 0 AS k, {keys}, avg(y) AS m, ln(stddev_pop(y) * sqrt(3) / pi()) AS t FROM y GROUP BY {keys} HAVING stddev_pop(y) >= 1e-12 UNION ALL
  SELECT k + 1, {keys}, m - CASE WHEN det > 0 THEN least(greatest((tt * gm - mt * gt) / det, -exp(t)), exp(t)) ELSE exp(t) * sign(gm) / 8 END,
   t - CASE WHEN det > 0 THEN least(greatest((mm * gt - mt * gm) / det, -0.5e0), 0.5e0) ELSE 0.1e0 * sign(gt) END FROM (SELECT *, mm * tt - mt * mt AS det FROM
   (SELECT k, {keys}, m, t, -sum(f) / exp(t) AS gm, count(*) - sum(f * z) AS gt, sum(h) / exp(2 * t) AS mm, (sum(h * z) + sum(f)) / exp(t) AS mt, sum(h * z * z) + sum(f * z) AS tt FROM
    (SELECT *, (1 - f * f) / 2 AS h FROM (SELECT *, tanh(z / 2) AS f FROM (SELECT it.*, (y - m) / exp(t) AS z FROM it JOIN y {using} WHERE k < 80))) GROUP BY k, {keys}, m, t))),
 fit AS (SELECT {keys}, m, t, shift FROM it JOIN o {using} WHERE k = 80), p AS (SELECT b.*, CASE WHEN t IS NULL THEN NULL WHEN d + shift > 0 THEN 1 / (1 + pow((d + shift) / exp(m), -exp(-t))) ELSE 0e0 END AS p FROM b LEFT JOIN fit {using})"""


@query("loglogistic_drought_index", "A38 P26 S6", f"""WITH RECURSIVE {_BALANCE}, {loglogistic_sql('nation, cal', 'year(month) BETWEEN 1995 AND 2000', 4)}, z AS (SELECT *, {ppf_sql('p', '1e-6')} AS spei FROM p)
SELECT nation, month, round(spei, 6) AS spei FROM z""")
def loglogistic_drought_index(t):
    z = series.spei_loglogistic(_balance(t), ["nation", "cal"], "d", F.year("month").between(1995, 2000), min_values=4)
    return z.select("nation", "month", r("spei").alias("spei"))


@query("whole_series_drought_index", "A38b", f"""WITH RECURSIVE {_BALANCE}, {loglogistic_sql('nation', 'true', 10)}, z AS (SELECT *, {ppf_sql('p', '1e-6')} AS spei FROM p)
SELECT nation, month, round(spei, 6) AS spei FROM z""")
def whole_series_drought_index(t):
    z = series.spei_loglogistic(_balance(t), ["nation"], "d", F.lit(True))
    return z.select("nation", "month", r("spei").alias("spei"))


@query("pearson3_drought_index", "A40 P28", f"""WITH {_BALANCE}, a AS (SELECT nation, cal, avg(d) AS loc, stddev_pop(d) AS sc FROM b WHERE year(month) BETWEEN 1995 AND 2000 GROUP BY 1, 2 HAVING count(*) >= 4),
 f AS (SELECT nation, cal, loc, sc, avg(pow((d - loc) / sc, 3)) AS k FROM b JOIN a USING (nation, cal) WHERE year(month) BETWEEN 1995 AND 2000 AND sc > 0 GROUP BY 1, 2, 3, 4),
 x AS (SELECT b.*, k, 4 / (k * k) AS al, greatest(2 / k * ((d - loc) / sc + 2 / k), 0e0) AS x FROM b LEFT JOIN f USING (nation, cal)),
 p AS (SELECT *, CASE WHEN k > 0 THEN {gamma_cdf_sql('al', 'x')} WHEN k < 0 THEN 1 - {gamma_cdf_sql('al', 'x')} END AS p FROM x), z AS (SELECT *, {ppf_sql('p', '1e-4')} AS spei FROM p)
SELECT nation, month, round(spei, 6) AS spei FROM z""")
def pearson3_drought_index(t):
    z = series.spei_pearson3(_balance(t), ["nation", "cal"], "d", F.year("month").between(1995, 2000), min_values=4)
    return z.select("nation", "month", r("spei").alias("spei"))


@query("fit_goodness", "A43", f"""WITH RECURSIVE {_BALANCE}, {loglogistic_sql('nation', 'true', 10)},
 g AS (SELECT nation, p, row_number() OVER (PARTITION BY nation ORDER BY d, month) AS i, count(*) OVER (PARTITION BY nation) AS n FROM p WHERE p IS NOT NULL),
 k AS (SELECT nation, max(greatest(i / n::DOUBLE - p, p - (i - 1) / n::DOUBLE)) AS ks, max(n) AS n FROM g GROUP BY 1), x AS (SELECT *, ks * (sqrt(n) + 0.12e0 + 0.11e0 / sqrt(n)) AS x FROM k),
 v AS (SELECT *, CASE WHEN x < 0.2 THEN 1e0 ELSE least(greatest(list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2e0 ELSE -2e0 END) * exp(-2e0 * j * j * x * x))), 0e0), 1e0) END AS p_value FROM x)
SELECT nation, round(ks, 8) AS ks, n, round(p_value, 6) AS p_value, p_value < 0.05 AS rejected FROM v""")
def fit_goodness(t):
    from territoria.functions.distributions import loglogistic_cdf

    b = _balance(t)
    p = series.loglogistic_params(b, ["nation"], "d", F.lit(True))
    j = b.join(p, "nation").withColumn("_p", loglogistic_cdf(F.col("d") + F.col("shift"), "shape", "scale"))
    k = series.ks_test(j, ["nation"], "d", F.col("_p"))
    return k.select("nation", r("ks", 8).alias("ks"), "n", r("p_value").alias("p_value"), (F.col("p_value") < 0.05).alias("rejected"))


# --- joins and sets --------------------------------------------------------------------------

@query("matched_report", "J2", """
SELECT count(*) AS n_rows, count(*) FILTER (o_orderkey IS NULL) AS n_unmatched FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'""")
def matched_report(t):
    o = t.orders.where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return joins.left_join_matched(t.lineitem.select("l_orderkey"), o, "l_orderkey", ["o_totalprice"])[1]


def network_edges(t):
    """Supplier-part edges with quantity as weight."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("w"))


@query("edge_membership", "J4 J5 J6", """
WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), n AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 2000)
SELECT 'orphan_src' AS kind, count(*) AS n, sum(w) AS w FROM e WHERE src NOT IN (SELECT id FROM n) UNION ALL SELECT 'orphan_dst', count(*), sum(w) FROM e WHERE dst NOT IN (SELECT id FROM n)
UNION ALL SELECT 'both', count(*), sum(w) FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) UNION ALL SELECT 'either', count(*), sum(w) FROM e WHERE src IN (SELECT id FROM n) OR dst IN (SELECT id FROM n)""")
def edge_membership(t):
    e, n = network_edges(t), t.supplier.where(F.col("s_acctbal") > 2000).select(F.col("s_suppkey").alias("id"))
    o = joins.orphan_edges(e, n).select(F.concat(F.lit("orphan_"), "missing_end").alias("kind"), "w")
    parts = o.unionByName(joins.both_ends_in(e, n).select(F.lit("both").alias("kind"), "w")).unionByName(joins.either_end_in(e, n).select(F.lit("either").alias("kind"), "w"))
    return parts.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


@query("nearest_reading", "J18", """
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, ts, min(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT event_id, value AS nearest, nearest_ts FROM (SELECT l.event_id, q.value, q.ts AS nearest_ts, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(q.ts)), q.ts) AS rn FROM l LEFT JOIN q ON l.user_id = q.user_id) WHERE rn = 1""")
def nearest_reading(t):
    left = t.events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    right = t.events.where(F.col("event_type") == "view").select("user_id", "ts", "value")
    return joins.nearest_in_time(left, right, ["user_id"], "ts", "value", 6 * 3600).select("event_id", "nearest", "nearest_ts")


@query("year_over_year", "J24", """
WITH a AS (SELECT o_custkey AS site, sum(o_totalprice) FILTER (year(o_orderdate) = 1997) AS before, sum(o_totalprice) FILTER (year(o_orderdate) = 1998) AS after FROM orders GROUP BY 1)
SELECT site, round(before, 2) AS before, round(after, 2) AS after, round(after / before, 6) AS ratio, abs(after / before - 1) > 0.5 AS flagged FROM a WHERE before IS NOT NULL AND after IS NOT NULL""")
def year_over_year(t):
    o = t.orders.select(F.col("o_custkey").alias("site"), F.year("o_orderdate").alias("year"), "o_totalprice")
    d = joins.year_over_year(o, ["site"], "year", "o_totalprice", 1997, 1998)
    return d.select("site", r("before", 2).alias("before"), r("after", 2).alias("after"), r("ratio").alias("ratio"), "flagged")


@query("set_operations", "U1 U2 U3 U4 S10", """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION ALL SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'difference', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'distinct', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def set_operations(t):
    from territoria.sources.readers import union_lower

    a = t.lineitem.where(F.col("l_returnflag") == "A").select(F.col("l_partkey").alias("K")).distinct()
    b = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select(F.col("l_partkey").alias("k")).distinct()
    u = union_lower([a, b])
    a = a.toDF("k")
    parts = {"union": u, "intersect": a.intersect(b), "difference": a.subtract(b), "distinct": u.distinct()}
    out = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("shared_cell_work", "U5 J11", f"""
WITH {SITES}, c AS (SELECT id, floor((lon + 5) / 0.25e0)::BIGINT AS ix, floor((lat - 41) / 0.25e0)::BIGINT AS iy FROM sites)
SELECT id, ix, iy, round(sin(ix * 0.1e0) * cos(iy * 0.1e0), 7) AS cell_value FROM c""")
def shared_cell_work(t):
    c = sites(t).select("id", F.floor((F.col("lon") + 5) / 0.25).alias("ix"), F.floor((F.col("lat") - 41) / 0.25).alias("iy"))
    return joins.per_distinct(c, ["ix", "iy"], lambda d: d.withColumn("cell_value", r(F.sin(F.col("ix") * 0.1) * F.cos(F.col("iy") * 0.1), 7))).select("id", "ix", "iy", "cell_value")


# --- sampling --------------------------------------------------------------------------------

@query("top_and_bottom", "K1 K2", """
(SELECT 'top' AS side, p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10) UNION ALL (SELECT 'bottom', p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 10)""")
def top_and_bottom(t):
    p = t.part.select("p_partkey", "p_retailprice")
    top, low = ranking.top_k(p, ["p_retailprice", "p_partkey"], 10), ranking.top_k(p, ["p_retailprice", "p_partkey"], 10, False)
    return top.select(F.lit("top").alias("side"), "*").unionByName(low.select(F.lit("bottom").alias("side"), "*"))


@query("stable_sample", "K4", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR || ':42'), o_orderkey LIMIT 500")
def stable_sample(t):
    return sampling.stable_sample(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 42)


@query("stratified_split", "K5", f"""
WITH {SITES}, k AS (SELECT id, level, row_number() OVER (PARTITION BY level ORDER BY substr(md5(id::VARCHAR || ':7'), 1, 12)) AS rn, count(*) OVER (PARTITION BY level) AS n FROM sites) SELECT id, level, rn <= floor(n * 0.7e0) AS is_train FROM k""")
def stratified_split(t):
    return sampling.stratified_split(sites(t).select("id", "level"), "id", "level", 0.7, 7)


@query("strided_rows", "K3 K6 E4", f"""
WITH {SITES}, c AS (SELECT floor((lon + 5) / 0.25e0)::BIGINT AS ix, floor((lat - 41) / 0.25e0)::BIGINT AS iy, avg(x_gws) AS v FROM sites GROUP BY 1, 2)
SELECT ix, iy, round(v, 6) AS v FROM c WHERE ix % 2 = 0 AND iy % 2 = 0 AND v IS NOT NULL""")
def strided_rows(t):
    c = sites(t).groupBy(F.floor((F.col("lon") + 5) / 0.25).alias("ix"), F.floor((F.col("lat") - 41) / 0.25).alias("iy")).agg(F.avg("x_gws").alias("v"))
    return sampling.stride(c, ["ix", "iy"], 2).where(F.col("v").isNotNull()).withColumn("v", r("v"))


# --- checks ----------------------------------------------------------------------------------

def _scored_sites(t):
    s = sites(t)
    wsi = 0.6 * F.col("x_bws") + 0.25 * F.coalesce("x_gws", F.lit(0.4)) + 0.15 * F.col("x_sv")
    return s.withColumn("wsi", wsi).select("id", "lon", "lat", F.col("spei3").alias("spi"), F.col("x_bws").alias("bws_norm"), F.col("wsi").alias("wsi_mean"), (F.col("wsi") * 0.8).alias("wsi_p10"),
                                           (F.col("wsi") * 1.1).alias("wsi_p90"), (0.12 * F.col("wsi")).alias("wsi_uncertainty"), (100 * (1 - F.col("wsi"))).alias("score"))


_SCORED = f"""{SITES}, sc AS (SELECT id, lon, lat, spei3 AS spi, x_bws AS bws, 0.6e0 * x_bws + 0.25e0 * coalesce(x_gws, 0.4e0) + 0.15e0 * x_sv AS wsi FROM sites)"""


@query("integrity_gate", "Q1", f"""
WITH {_SCORED} SELECT count(wsi) AS n_valid, round(max(abs(1.1e0 * wsi - 0.8e0 * wsi)), 6) AS max_gap, round(100e0 * avg((abs(1.1e0 * wsi - 0.8e0 * wsi) < 1e-6)::INT), 6) AS equal_pct, round(min(wsi), 6) AS lowest, round(max(wsi), 6) AS highest,
  (count(wsi) = 0 OR max(abs(0.3e0 * wsi)) < 1e-6 OR min(wsi) < -0.01 OR max(wsi) > 1.01) AS halt, 100e0 * avg((abs(0.3e0 * wsi) < 1e-6)::INT) > 10 AS warn FROM sc""")
def integrity_gate(t):
    g = quality.integrity_gate(_scored_sites(t))
    return g.select("n_valid", *[r(c).alias(c) for c in ("max_gap", "equal_pct", "lowest", "highest")], "halt", "warn")


@query("validation_report", "Q2 S18", f"""
WITH {_SCORED}, a AS (SELECT CASE WHEN stddev_pop(spi) BETWEEN 0.2 AND 2 AND count(spi) >= 30 THEN avg(spi) END AS v1,
  CASE WHEN avg(bws) FILTER (lon < -1 AND lat > 47) <= 0.12 THEN avg(bws) FILTER (lon > 4 AND lat < 44) ELSE -1e0 END AS v2, avg(wsi) AS v3,
  CASE WHEN avg((100 * (1 - wsi) BETWEEN 0 AND 100)::INT) >= 0.999 AND max(100 * (1 - wsi)) - min(100 * (1 - wsi)) >= 5 THEN stddev_pop(100 * (1 - wsi)) ELSE 0e0 END AS v4,
  avg(0.12e0 * wsi) AS v5, avg(100 * (1 - wsi)) FILTER (lon > 5 AND lat > 44.5 AND lat < 47.5) AS v6 FROM sc)
SELECT name, coalesce(passed, false) AS passed, round(value, 6) AS value, threshold, unit, soft AND NOT coalesce(passed, false) AS warning FROM (SELECT unnest(['index_plausible', 'regional_gradient', 'national_range', 'score_range', 'uncertainty_bounds', 'alpine_score']) AS name,
  unnest([abs(v1) < 2.5, v2 >= 0.032, v3 BETWEEN 0.1 AND 0.5, v4 >= 1, v5 BETWEEN 0.02 AND 0.3, v6 >= 60]) AS passed, unnest([v1, v2, v3, v4, v5, v6]) AS value, unnest([2.5e0, 0.04e0, 0.5e0, 1e0, 0.3e0, 60e0]) AS threshold,
  unnest(['index mean', 'mean demand stress', 'mean index', 'standard deviation', 'mean sigma', 'mean score']) AS unit, unnest([false, true, true, false, false, true]) AS soft FROM a)""")
def validation_report(t):
    e = quality.expect(_scored_sites(t), quality.validation_rules())
    return e.select("name", "passed", r("value").alias("value"), "threshold", "unit", "warning")


@query("structure_scorecard", "Q3 Q4 Q5", f"""
WITH {_SCORED}, c AS (SELECT 'structure' AS module, unnest([true, true, false]) AS ok UNION ALL SELECT 'ranges', unnest([(SELECT greatest(0 - min(wsi), max(wsi) - 1) <= 0.01 FROM sc), (SELECT greatest(0 - min(spi), max(spi) - 1) <= 0.01 FROM sc)])),
 m AS (SELECT module, count(*) FILTER (ok) AS n_pass, count(*) AS n_total FROM c GROUP BY 1)
SELECT module, n_pass, n_total, CASE WHEN n_pass = n_total THEN 'PASS' WHEN n_total - n_pass <= 2 AND n_pass >= 0.7 * n_total THEN 'WARN' ELSE 'FAIL' END AS status,
  CASE WHEN n_pass = n_total THEN greatest(85, floor(100e0 * n_pass / n_total)::INT) ELSE floor(100e0 * n_pass / n_total)::INT END AS score, (SELECT bool_and(ok) FROM c) AS go FROM m""")
def structure_scorecard(t):
    s = _scored_sites(t)
    checks = quality.expect(s, quality.structure_rules(s.columns, ["wsi_mean", "score", "worst_month_score"], {"wsi_mean": (0, 1), "spi": (0, 1)}))
    return quality.scorecard(checks).crossJoin(F.broadcast(quality.go_no_go(checks).select("go"))).select("module", "n_pass", "n_total", "status", "score", "go")


@query("plausible_ranges", "Q7", """
WITH g(p_type, low, high) AS (VALUES ('ECONOMY', 900e0, 1000e0), ('PROMO', 950e0, 1090e0), ('LARGE', 0e0, 10e0))
SELECT p.p_type, count(p_retailprice) AS n, round(avg((p_retailprice BETWEEN low AND high)::INT), 6) AS share_ok FROM part p JOIN g ON p.p_type = g.p_type GROUP BY 1""")
def plausible_ranges(t):
    g = t.spark.createDataFrame([("ECONOMY", 900.0, 1000.0), ("PROMO", 950.0, 1090.0), ("LARGE", 0.0, 10.0)], "p_type string, low double, high double")
    return quality.plausible_ranges(t.part, "p_type", "p_retailprice", g).withColumn("share_ok", r("share_ok"))


# --- star schema -----------------------------------------------------------------------------

def _fact(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").cast("date").alias("date"),
                              (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("order_line"))
    return lines, _products(t)


def _products(t):
    p = t.part.select(F.when(F.col("p_partkey") % 97 == 0, "bad").otherwise(F.col("p_partkey").cast("string")).alias("product_id"), F.col("p_name").alias("name"),
                      F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("category"), F.col("p_retailprice").cast("string").alias("price"))
    return warehouse.exclude(warehouse.clean_products(p, "product_id", "category", "price"), "product_id", [29, 30])


_PROD = "pr AS (SELECT p_partkey AS product_id, p_name AS name, CASE WHEN p_type <> 'SMALL' THEN p_type ELSE 'Non classe' END AS category, p_retailprice AS price FROM part WHERE p_partkey % 97 <> 0 AND p_partkey NOT IN (29, 30))"


@query("clean_dimensions", "D1 D3", f"WITH {_PROD} SELECT product_id, name, category, price FROM pr")
def clean_dimensions(t):
    return _products(t)


@query("calendar_dimension", "D2 S14", """
WITH d AS (SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY))::DATE AS date)
SELECT date, year(date) AS year, 'T' || quarter(date)::VARCHAR AS quarter, month(date) AS month_no, monthname(date) AS month_name, dayname(date) AS weekday, dayofweek(date) IN (0, 6) AS is_weekend FROM d""")
def calendar_dimension(t):
    return warehouse.calendar_of(t.orders, "o_orderdate")


@query("fact_sales", "D4 W4 J5", f"""
WITH {_PROD} SELECT row_number() OVER (ORDER BY l_orderkey * 8 + l_linenumber, l_partkey * 100000 + l_suppkey, l_extendedprice) AS sale_id, l_orderkey * 8 + l_linenumber AS order_line, l_partkey AS product_id, l_extendedprice AS amount FROM lineitem WHERE l_partkey IN (SELECT product_id FROM pr)""")
def fact_sales(t):
    lines, products = _fact(t)
    lines = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("order_line"), F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("amount"),
                              (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("tie"))
    return warehouse.fact_sales(lines, products, "product_id", "order_line", "tie", ["amount"]).select("sale_id", "order_line", "product_id", "amount")


@query("monthly_revenue", "D5", f"""
WITH {_PROD} SELECT month(l_shipdate) AS month_no, monthname(l_shipdate) AS month_name, count(*) AS n_sales, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN pr ON l_partkey = product_id GROUP BY 1, 2""")
def monthly_revenue(t):
    lines, products = _fact(t)
    kept = lines.join(products.select("product_id"), "product_id", "left_semi")
    days = warehouse.calendar_of(t.lineitem, "l_shipdate")
    return warehouse.revenue_by(kept, days, "date", ["month_no", "month_name"], "amount").orderBy("month_no")


@query("top_products", "D6 K1", f"""
WITH {_PROD} SELECT name, category, count(*) AS n_sales, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN pr ON l_partkey = product_id GROUP BY 1, 2 ORDER BY revenue DESC, name LIMIT 5""")
def top_products(t):
    lines, products = _fact(t)
    return warehouse.revenue_by(lines, products, "product_id", ["name", "category"], "amount").orderBy(F.desc("revenue"), "name").limit(5)


@query("revenue_by_city", "D6", """
SELECT n_name AS city, count(*) AS n_sales, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY revenue DESC LIMIT 10""")
def revenue_by_city(t):
    cities = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("city"))
    return warehouse.revenue_by(t.orders.select("o_custkey", "o_totalprice"), cities, "o_custkey", ["city"], "o_totalprice").orderBy(F.desc("revenue")).limit(10)


@query("referential_integrity", "Q6 J4", f"""
WITH {_PROD} SELECT 'products' AS check_name, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT product_id FROM pr) UNION ALL
SELECT 'dates', count(*) FROM lineitem WHERE year(l_shipdate) <> 1998 UNION ALL SELECT 'customers', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def referential_integrity(t):
    lines, products = _fact(t)
    days = warehouse.calendar_of(t.lineitem, "l_shipdate").where(F.col("year") == 1998)
    a = warehouse.orphan_counts(lines, {"products": (products, "product_id"), "dates": (days, "date")})
    rich = t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"))
    return a.unionByName(warehouse.orphan_counts(t.orders, {"customers": (rich, "o_custkey")}))
