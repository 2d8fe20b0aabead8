"""End-to-end flows: grid scoring, the site engine, and the cube and page sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from territoria.functions.scalars import SCORE_BANDS, score_band
from territoria.operators import quality
from territoria.plans.catalog.climate import _Z, spi_sql, station_z
from territoria.plans.catalog.scoring import _BAND as BAND_SQL
from territoria.plans.grid_score import component_months, index_over_time
from territoria.plans.inputs import SITE_POINTS, SITES, STATIONS, SUPPLIER_MONTH, c01, site_points, sites, stations, supplier_month
from territoria.plans.point_profile import month_scores, point_months, point_profile
from territoria.plans.registry import query
from territoria.plans.site_engine import cell_series, local_stress
from territoria.session import cut_lineage, work_folder
from territoria.sources.readers import merge_variables
from territoria.sources.sinks import feature
from territoria.streaming.refresh import landed, monthly_means, refresh_means


def r(c, d=6):
    return F.round(c, d)


_GRID = f"""{SUPPLIER_MONTH}, ac AS (SELECT station AS cell, month, CASE WHEN count(precip) OVER w = 3 THEN sum(precip) OVER w END AS acc FROM sm WINDOW w AS (PARTITION BY station ORDER BY month ROWS 2 PRECEDING)),
 {spi_sql('ac', 'cell', 'acc', 'year(month) BETWEEN 1995 AND 1999')}, dr AS (SELECT cell, month, {c01('-spi', '3e0')} AS drought FROM spi WHERE year(month) = 2000),
 vol AS (SELECT l_suppkey AS cell, sum(l_quantity) AS w FROM lineitem GROUP BY 1), cp AS (SELECT quantile_cont(w, 0.95) FILTER (w > 0) AS cap, max(w) AS top FROM vol JOIN supplier ON s_suppkey = cell),
 st AS (SELECT cell, {c01('s_suppkey * 29 % 101 / 20e0', '5e0')} AS b, CASE WHEN s_suppkey % 5 <> 2 THEN {c01('s_suppkey * 31 % 101 / 20e0', '5e0')} END AS g, 1 / (1 + exp(0.8e0 * ((s_suppkey * 41 % 601) / 100e0 - 3))) AS z,
  coalesce(least(greatest(w, 0), cap) / least(cap, top), 0) AS pr FROM supplier JOIN vol ON s_suppkey = cell, cp),
 sc AS (SELECT cell, {c01('b + (1 - b) * 0.5e0 * pr')} AS bws, {c01('(coalesce(0.5e0 * g, 0) + 0.2e0 * z) / (CASE WHEN g IS NULL THEN 0e0 ELSE 0.5e0 END + 0.2e0)')} AS gws FROM st),
 wm AS (SELECT cell, month, bws, gws, drought, {c01('0.60e0 * bws + 0.25e0 * gws + 0.15e0 * drought')} AS w FROM dr JOIN sc USING (cell)),
 ag AS (SELECT cell, avg(w) AS wsi_mean, quantile_cont(w, 0.1) AS wsi_p10, quantile_cont(w, 0.9) AS wsi_p90, least(sqrt(pow(0.6e0 * 0.12e0 * max(bws), 2) + pow(0.25e0 * 0.18e0 * max(gws), 2) + pow(0.15e0 * 0.22e0 * avg(drought), 2)), 1e0) AS wsi_uncertainty,
  100 * (1 - avg(w)) AS water_score, max(bws) AS bws_norm, max(gws) AS gws_norm, avg(drought) AS drought_norm_mean, min(100 * (1 - w)) AS worst_month_score, avg(100 * (1 - w)) FILTER (month(month) BETWEEN 6 AND 9) AS summer_mean_score FROM wm GROUP BY cell)"""
_SCORES = ("wsi_mean", "wsi_p10", "wsi_p90", "wsi_uncertainty", "water_score", "worst_month_score", "summer_mean_score")


@query("grid_pipeline_scores", "E5 A17 A39 P11 P12 P29 P30b", f"""WITH {_GRID} SELECT cell, {', '.join(f'round({c}, 4) AS {c}' for c in _SCORES)}, {BAND_SQL.format('water_score', [b[0] for b in SCORE_BANDS])} AS level FROM ag""")
def grid_pipeline_scores(t):
    """Suppliers as cells: raw layers from their attributes, monthly precipitation from the lines."""
    s = index_over_time(_components(t), ["cell"], "month")
    return s.select("cell", *[r(c, 4).alias(c) for c in _SCORES], score_band("water_score")["level"].alias("level"))


def _components(t):
    k = F.col("s_suppkey")
    vol = t.lineitem.groupBy(F.col("l_suppkey").alias("cell")).agg(F.sum("l_quantity").alias("withdrawals"))
    static = t.supplier.select(k.alias("cell"), ((k * 29 % 101) / 20).alias("bws_raw"), F.when(k % 5 != 2, (k * 31 % 101) / 20).alias("gws_raw"), ((k * 41 % 601) / 100 - 3).alias("station_z")).join(vol, "cell")
    months = supplier_month(t).select(F.col("station").alias("cell"), "month", "precip")
    return component_months(static, months, "cell", "month", F.year("month").between(1995, 1999), window=3, year=2000)


def _profile_inputs(t):
    """Sites that ask for a month (or, by 13, for the year), the scored cells with their place, and their months."""
    points = site_points(t).withColumn("month", F.when(F.col("id") % 13 > 0, (F.col("id") % 13).cast("int")))
    components = cut_lineage(_components(t))
    place = stations(t).select(F.col("sid").alias("cell"), "lon", "lat", "x", "y")
    cells = index_over_time(components, ["cell"], "month").join(place, "cell")
    return points, cells, month_scores(components, "cell", "month")


_PROFILE = f"""{_GRID}, {SITE_POINTS}, {STATIONS},
 nn AS (SELECT id, cell, d, lon, lat FROM (SELECT p.id, ag.cell, s.lon, s.lat, sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2)) AS d, row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2)), s.sid) AS rank FROM pts p, ag JOIN stations s ON s.sid = ag.cell) WHERE rank = 1 AND d <= 50),
 po AS (SELECT p.id, CASE WHEN p.id % 13 > 0 THEN (p.id % 13)::INT END AS month, nn.cell, nn.d, nn.lon, nn.lat FROM pts p LEFT JOIN nn ON nn.id = p.id),
 pr AS (SELECT po.*, ag.* EXCLUDE (cell), wm.cell IS NOT NULL AS monthly, wm.w, wm.drought, 100 * (1 - wm.w) AS score FROM po LEFT JOIN ag ON ag.cell = po.cell LEFT JOIN wm ON wm.cell = po.cell AND month(wm.month) = po.month)"""
_SHOWN = ("wsi_mean", "wsi_p10", "wsi_p90", "wsi_uncertainty")


@query("point_profile", "E1 J7", f"""WITH {_PROFILE}, s AS (SELECT *, CASE WHEN monthly THEN score ELSE water_score END AS shown FROM pr)
SELECT id, month, cell IS NOT NULL AS covered, CASE WHEN cell IS NOT NULL THEN CASE WHEN monthly THEN 'month_' || month ELSE 'annual_mean' END END AS mode, cell, round(lon, 4) AS lon, round(lat, 4) AS lat, round(d, 4) AS distance_km,
  round(shown, 4) AS water_score, CASE WHEN shown IS NOT NULL THEN {BAND_SQL.format('shown', [b[0] for b in SCORE_BANDS])} END AS level, {', '.join(f'round({c}, 4) AS {c}' for c in _SHOWN)},
  round(CASE WHEN monthly THEN w ELSE wsi_mean END, 4) AS wsi, round(CASE WHEN monthly THEN drought ELSE drought_norm_mean END, 4) AS drought_norm, round(bws_norm, 4) AS bws_norm, round(gws_norm, 4) AS gws_norm,
  round(worst_month_score, 4) AS worst_month_score, round(summer_mean_score, 4) AS summer_mean_score, round(CASE WHEN monthly THEN water_score END, 4) AS annual_water_score, round(CASE WHEN monthly THEN wsi_p90 END, 4) AS annual_wsi_p90 FROM s""")
def point_profile_query(t):
    """The blocks of the profile, a column a field."""
    p = point_profile(*_profile_inputs(t), "cell")
    parts = [*[f"components.{c}" for c in _SHOWN], "components.wsi", "components.drought_norm", "components.bws_norm", "components.gws_norm", "seasonal.worst_month_score", "seasonal.summer_mean_score"]
    return p.select("id", "month", "covered", "mode", "nearest.cell", *[r(f"nearest.{c}", 4).alias(c) for c in ("lon", "lat", "distance_km")], r("water_score", 4).alias("water_score"), "level",
                    *[r(c, 4).alias(c.split(".")[1]) for c in parts], r("annual.water_score", 4).alias("annual_water_score"), r("annual.wsi_p90", 4).alias("annual_wsi_p90"))


@query("point_months", "E2 J7", f"""WITH {_PROFILE}
SELECT pr.id, pr.cell IS NOT NULL AS covered, round(pr.water_score, 4) AS annual_score, round(100 * (1 - wsi_p90), 4) AS score_p10, round(100 * (1 - wsi_p10), 4) AS score_p90, month(wm.month)::INT AS month,
  round(100 * (1 - wm.w), 4) AS water_score, round(wm.w, 4) AS wsi, round(wm.drought, 4) AS drought_norm FROM pr LEFT JOIN wm ON wm.cell = pr.cell""")
def point_months_query(t):
    """The months of every site, a row a month; a site beyond reach has one row of nulls."""
    points, cells, months = _profile_inputs(t)
    m = point_months(points, cells, months, "cell").select("id", "covered", "annual", F.explode_outer("months").alias("m"))
    return m.select("id", "covered", r("annual.water_score", 4).alias("annual_score"), r("annual.water_score_p10", 4).alias("score_p10"), r("annual.water_score_p90", 4).alias("score_p90"),
                    "m.month", *[r(f"m.{c}", 4).alias(c) for c in ("water_score", "wsi", "drought_norm")])


_KNOWN = {1: True, 2: True, 9: True, 0: False, -7: False}
_CHECKS = [("structure", "twelve_months", "count(*) FILTER (months <> 12)", "= 0"), ("percentiles", "mean_again", "max(abs(mean - wsi_mean))", "< 0.001"), ("percentiles", "p10_again", "max(abs(p10 - wsi_p10))", "< 0.002"),
           ("percentiles", "p90_again", "max(abs(p90 - wsi_p90))", "< 0.002"), ("variation", "widest_spread", "max(wsi_p90 - wsi_p10)", "> 0.01"), ("variation", "spread_share", "100 * avg((wsi_p90 - wsi_p10 > 1e-6)::INT)", "> 90"),
           ("seasons", "worst_again", "max(abs(worst - worst_month_score))", "< 0.1"), ("seasons", "worst_over_summer", "count(*) FILTER (worst_month_score > summer_mean_score + 0.1)", "= 0"),
           ("seasons", "summer_over_annual", "count(*) FILTER (summer_mean_score > water_score + 0.1)", "= 0"),
           *[("mask", f"point_{k}_{'scored' if v else 'masked'}", f"count(*) FILTER (cell = {k} AND water_score IS NOT NULL)", f"= {int(v)}") for k, v in _KNOWN.items()]]


@query("grid_checks", "Q3", f"""WITH {_GRID}, ag2 AS (SELECT cell, count(DISTINCT month(month)) AS months, sum(w) / count(w) AS mean, quantile_cont(w, 0.1) AS p10, quantile_cont(w, 0.9) AS p90, min(100 * (1 - w)) AS worst FROM wm GROUP BY 1),
 j AS (SELECT * FROM ag JOIN ag2 USING (cell)) """ + " UNION ALL ".join(f"SELECT '{m}' AS module, '{n}' AS name, round({v}, 6)::DOUBLE AS value, coalesce(({v}) {c}, false) AS passed FROM j" for m, n, v, c in _CHECKS))
def grid_checks(t):
    """The scored cells against their own months."""
    components = cut_lineage(_components(t))
    checks = quality.grid_checks(index_over_time(components, ["cell"], "month"), month_scores(components, "cell", "month"), "cell", _KNOWN)
    return checks.select("module", "name", r("value").alias("value"), "passed")


@query("site_engine", "E6 U5 W2 W3 P30c P38", f"""
WITH {_Z}, d AS (SELECT station, month, z, {c01('-z', '3e0')} AS d FROM z),
 c AS (SELECT station, month, d, CASE WHEN count(d) OVER w3 = 3 THEN avg(d) OVER w3 END AS s, CASE WHEN count(d) OVER w12 >= 6 THEN least(stddev_samp(d) OVER w12 / 0.5e0, 1e0) END AS v, avg((z IS NULL)::INT) OVER w12 AS ns FROM d
   WINDOW w3 AS (PARTITION BY station ORDER BY month ROWS 2 PRECEDING), w12 AS (PARTITION BY station ORDER BY month ROWS 11 PRECEDING)),
 {SITES}, n AS (SELECT count(*) AS n FROM supplier), j AS (SELECT id, month, x_bws AS b, x_gws AS g, d, s, v, least(0.30e0 * ns + 0.25e0 * 0.5e0 * (x_gws IS NULL)::INT + 0.25e0 * {c01('1 - 10 * x_sv')} + 0.20e0 * {c01('(id % 30) / 14e0')}, 1e0) AS u
   FROM sites, n JOIN c ON true WHERE c.station = id % n)
SELECT id, month, round((0.25e0 * b + coalesce(0.15e0 * g, 0) + coalesce(0.25e0 * d, 0) + coalesce(0.15e0 * s, 0) + coalesce(0.10e0 * v, 0) + 0.10e0 * u)
  / (0.25e0 + CASE WHEN g IS NULL THEN 0 ELSE 0.15e0 END + CASE WHEN d IS NULL THEN 0 ELSE 0.25e0 END + CASE WHEN s IS NULL THEN 0 ELSE 0.15e0 END + CASE WHEN v IS NULL THEN 0 ELSE 0.10e0 END + 0.10e0), 6) AS index,
  g IS NULL OR d IS NULL OR s IS NULL OR v IS NULL AS redistributed FROM j""")
def site_engine(t):
    """The index of every site in every month."""
    cells = cell_series(station_z(t), "station", "month", "z")
    n = t.supplier.agg(F.count(F.lit(1)).alias("_n"))
    s = sites(t).crossJoin(F.broadcast(n)).withColumn("station", F.col("id") % F.col("_n"))
    e = local_stress(s, cells, "station", "month", F.col("x_bws"), F.col("x_gws"), F.col("x_sv"), F.col("id") % 30)
    return e.select("id", "month", r("index").alias("index"), "redistributed")


@query("cube_merge", "S6 S7 P1 S16", """
WITH a AS (SELECT l_suppkey AS cell, date_trunc('month', l_shipdate)::DATE AS time, sum(l_quantity) AS tp FROM lineitem WHERE l_returnflag <> 'R' AND year(l_shipdate) = 1998 GROUP BY 1, 2),
 b AS (SELECT l_suppkey AS cell, date_trunc('month', l_shipdate)::DATE AS time, -sum(l_tax) AS pev FROM lineitem WHERE l_returnflag = 'R' AND year(l_shipdate) = 1998 GROUP BY 1, 2)
SELECT coalesce(a.cell, b.cell) AS cell, coalesce(a.time, b.time) AS time, round(coalesce(tp, -9999), 4) AS tp, round(coalesce(abs(pev) * 1000, -9999), 4) AS pet FROM a FULL JOIN b ON a.cell = b.cell AND a.time = b.time""")
def cube_merge(t):
    li = t.lineitem.select(F.col("l_suppkey").alias("cell"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("time"), "l_returnflag", "l_quantity", "l_tax")
    tp = li.where(F.col("l_returnflag") != "R").groupBy("cell", "time").agg(F.sum("l_quantity").alias("tp"))
    pev = li.where(F.col("l_returnflag") == "R").groupBy("cell", "time").agg((-F.sum("l_tax")).alias("pev"))
    m = merge_variables([tp, pev], ("time", "cell"), year=1998)
    return m.select("cell", "time", r(F.coalesce("tp", F.lit(-9999.0)), 4).alias("tp"), r(F.coalesce(F.abs("pev") * 1000, F.lit(-9999.0)), 4).alias("pet"))


@query("json_records", "S4 P42", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, user_id FROM events""")
def json_records(t):
    """Each event as a one-record page ``{"data": [...]}`` parsed back with a declared schema."""
    page = F.to_json(F.struct(F.array(F.struct("event_id", F.from_json("props", "k INT")["k"].alias("k"), "user_id")).alias("data")))
    schema = "data ARRAY<STRUCT<event_id: BIGINT, k: INT, user_id: BIGINT>>"
    return t.events.select(F.from_json(page, schema).alias("p")).select(F.inline("p.data"))


@query("geojson_features", "S17", f"""
WITH {SITES} SELECT id, length('{{"type":"Feature","geometry":{{"type":"Point","coordinates":[]}},"properties":{{"id":,"level":}}}}') + length(id::VARCHAR) + 1 AS shortest, level FROM sites""")
def geojson_features(t):
    f = sites(t).select("id", "level", feature("lon", "lat", ["id", "level"]).alias("j"))
    parsed = F.from_json("j", "type STRING, properties STRUCT<id: BIGINT, level: INT>")
    empty = F.regexp_replace("j", r'\[[^\]]*\]', "[]")
    return f.select(parsed["properties"]["id"].alias("id"), F.length(empty).alias("shortest"), parsed["properties"]["level"].alias("level"))


@query("station_monthly_means", "T1 A1", """
SELECT user_id AS station, date_trunc('month', ts)::DATE AS month, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1, 2""")
def station_monthly_means(t):
    from territoria.streaming.refresh import monthly_batch

    b = monthly_batch(t.events.withColumnRenamed("user_id", "station"), "station", "event_id", "ts", "value")
    return b.select("station", "month", r("mean").alias("mean"), "n")


@query("streamed_monthly_means", "T1", """
SELECT user_id AS station, date_trunc('month', ts)::DATE AS month, round(sum(value) / count(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1, 2""")
def streamed_monthly_means(t):
    """The events land in three parts, with a run after each; the later parts bring most readings once more, and they add nothing."""
    folder = f"{work_folder(t.spark)}/means-{uuid.uuid4().hex}"
    events = t.events.select("event_id", "ts", "user_id", "value")
    for part in (F.col("event_id") % 2 == 0, F.col("event_id") % 3 > 0, F.lit(True)):
        events.where(part).write.mode("append").parquet(f"{folder}/landed")
        stream = landed(t.spark, f"{folder}/landed", events.schema)
        refresh_means(stream, folder, f"{folder}/checkpoint", "user_id", "event_id", "ts", "value").awaitTermination()
    m = monthly_means(t.spark, folder)
    return m.select("station", "month", r("mean").alias("mean"), "n")
