"""Spatial joins, grids and interpolation over customer sites, supplier stations and nation polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from territoria.functions.geo import to_lambert93
from territoria.functions import geo as G
from territoria.operators import grid as gr
from territoria.operators import interpolate as ip
from territoria.operators import spatial as sp
from territoria.operators import stats
from territoria.operators.ranking import with_rank
from territoria.plans.catalog.network_sql import LINES_SQL
from territoria.plans.inputs import SITE_POINTS, SITES, STATIONS, c01, lat_of, lat_sql, lon_of, lon_sql, site_points, sites, stations
from territoria.plans.registry import query


def r(c, d=6):
    return F.round(c, d)


def r_binary(c, d):
    """Rounds c · 10^d as it is stored, like SQL: 20.275 is a little less as a double and gives 20.27. ``r`` rounds its shortest decimal."""
    return F.round(c * 10.0**d) / 10.0**d


_D = "sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2))"
_NEAR = f"""{SITE_POINTS}, {STATIONS},
 nn AS (SELECT id, sid, d, value, zone, row_number() OVER (PARTITION BY id ORDER BY d, sid) AS rank FROM (SELECT p.id, s.sid, {_D} AS d, s.value, s.zone FROM pts p, stations s))"""


@query("nearest_station", "J7 E1 P45", f"""
WITH {_NEAR} SELECT p.id, CASE WHEN d <= 60 THEN sid END AS sid, round(CASE WHEN d <= 60 THEN d END, 5) AS dist, round(CASE WHEN d <= 60 THEN value ELSE 50e0 END, 4) AS value, d <= 60 AS covered FROM pts p JOIN nn ON p.id = nn.id AND rank = 1""")
def nearest_station(t):
    j = sp.nearest_join(site_points(t), stations(t), max_km=60, carry=["value"], fallback={"value": 50.0})
    return j.select("id", "sid", r("dist", 5).alias("dist"), r("value", 4).alias("value"), "covered")


_LOO = f"""{STATIONS}, nb AS (SELECT p.sid, s.sid AS nid, {_D} AS dist, nullif(s.value, 0) AS nv, p.value AS own, row_number() OVER (PARTITION BY p.sid ORDER BY {_D}, s.sid) AS rank FROM stations p, stations s WHERE p.sid <> s.sid)"""


@query("nearest_neighbours_loo", "J8", f"WITH {_LOO} SELECT sid, nid, rank, round(dist, 5) AS dist FROM nb WHERE rank <= 7")
def nearest_neighbours_loo(t):
    s = stations(t)
    k = sp.knn_join(s, s.select(F.col("sid").alias("nid"), "x", "y"), 7, "sid", "nid", exclude_self=True)
    return k.select("sid", "nid", "rank", r("dist", 5).alias("dist"))


@query("radius_neighbours", "J9", f"""
WITH {SITE_POINTS}, {STATIONS} SELECT p.id, count(s.sid) AS n, round(sum(s.value), 4) AS total FROM pts p LEFT JOIN stations s ON {_D} <= 120 GROUP BY 1""")
def radius_neighbours(t):
    d = sp.radius_sums(site_points(t), stations(t), 120.0, {"n": F.lit(1), "total": F.col("value")})
    return d.select("id", F.coalesce("n", F.lit(0)).alias("n"), r("total", 4).alias("total"))


@query("radius_pairs", "J9", f"WITH {SITE_POINTS}, {STATIONS} SELECT p.id, s.sid, round({_D}, 5) AS dist FROM pts p JOIN stations s ON {_D} <= 30")
def radius_pairs(t):
    return sp.radius_join(site_points(t), stations(t), 30.0).withColumn("dist", r("dist", 5))


# Unit octagon (cos, sin) shared by both engines.
OCTAGON = ((0.9239, 0.3827), (0.3827, 0.9239), (-0.3827, 0.9239), (-0.9239, 0.3827), (-0.9239, -0.3827), (-0.3827, -0.9239), (0.3827, -0.9239), (0.9239, -0.3827))


def zones(t):
    k = F.col("n_nationkey").cast("long") * 977 + 13
    rad = 0.8 + (F.col("n_nationkey") % 5) * 0.4
    ring = F.array(*[F.struct((lon_of(k) + rad * c).alias("lon"), (lat_of(k) + rad * 0.7 * s).alias("lat")) for c, s in OCTAGON])
    return t.nation.select(F.col("n_nationkey").alias("zid"), ring.alias("ring"), (F.col("n_nationkey") * 0.17).alias("sev"))


_K = "(n_nationkey::BIGINT * 977 + 13)"
_ZONES = f"""oct(i, c, s) AS (VALUES {', '.join(f'({i}, {c}e0, {s}e0)' for i, (c, s) in enumerate(OCTAGON))}),
 vx AS (SELECT n_nationkey AS zid, i, {lon_sql(_K)} + (0.8e0 + (n_nationkey % 5) * 0.4e0) * c AS lon, {lat_sql(_K)} + (0.8e0 + (n_nationkey % 5) * 0.4e0) * 0.7e0 * s AS lat FROM nation, oct),
 ed AS (SELECT a.zid, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS b_y FROM vx a JOIN vx b ON a.zid = b.zid AND b.i = (a.i + 1) % 8),
 ar AS (SELECT zid, abs(sum(ax * b_y - bx * ay)) / 2 AS area FROM ed GROUP BY 1),
 pe AS (SELECT id, zid, sum(CASE WHEN (ay > p.lat) <> (b_y > p.lat) AND p.lon < (bx - ax) * (p.lat - ay) / (b_y - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 AS inside,
   min(sqrt(pow(p.lon - ax - tt * (bx - ax), 2) + pow(p.lat - ay - tt * (b_y - ay), 2))) AS dist
   FROM (SELECT p.*, ed.*, least(greatest(((p.lon - ax) * (bx - ax) + (p.lat - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)), 0e0), 1e0) AS tt FROM pts p, ed) p GROUP BY 1, 2)"""


@query("point_in_polygon", "J10 S9", f"""
WITH {SITE_POINTS}, {_ZONES}, b AS (SELECT id, min(zid) FILTER (inside) AS zi, arg_min(zid, round(dist, 9) * 1000000 + zid) FILTER (NOT inside AND dist <= 1) AS zn FROM pe GROUP BY 1)
SELECT id, coalesce(zi, zn) AS zid, coalesce(zi, zn) * 0.17e0 AS sev, CASE WHEN zi IS NOT NULL THEN 'inside' WHEN zn IS NOT NULL THEN 'near' ELSE 'none' END AS how FROM b""")
def point_in_polygon(t):
    j = sp.polygon_join(site_points(t), zones(t), "zid", ["sev"])
    return j.select("id", "zid", "sev", "how")


@query("polygon_mask", "J22", f"""
WITH {SITE_POINTS}, {_ZONES}, b AS (SELECT id, bool_or(inside OR dist <= 0.25) AS ok FROM pe GROUP BY 1) SELECT id, CASE WHEN ok THEN id * 2 END AS v FROM b""")
def polygon_mask(t):
    return sp.polygon_mask(site_points(t).withColumn("v", F.col("id") * 2), zones(t), "zid", 0.25, ["v"]).select("id", "v")


@query("burned_cells", "A13", f"""
WITH c AS (SELECT DISTINCT floor(({lon_sql('c_custkey')} + 5) / 0.5e0)::INT AS ix, floor(({lat_sql('c_custkey')} - 41) / 0.5e0)::INT AS iy FROM customer),
 pts AS (SELECT ix * 1000 + iy AS id, -4.75e0 + ix * 0.5e0 AS lon, 41.25e0 + iy * 0.5e0 AS lat FROM c), {_ZONES}
SELECT id, arg_max(pe.zid, round(area, 9) * 1000 - pe.zid / 1e6) AS zid FROM pe JOIN ar ON pe.zid = ar.zid WHERE inside GROUP BY 1 UNION ALL SELECT id, NULL FROM pe GROUP BY 1 HAVING NOT bool_or(inside)""")
def burned_cells(t):
    c = site_points(t).select(F.floor((F.col("lon") + 5) / 0.5).cast("int").alias("ix"), F.floor((F.col("lat") - 41) / 0.5).cast("int").alias("iy")).distinct()
    c = c.select((F.col("ix") * 1000 + F.col("iy")).alias("id"), (-4.75 + F.col("ix") * 0.5).alias("lon"), (41.25 + F.col("iy") * 0.5).alias("lat"))
    return gr.burn(c, zones(t), "zid", []).select("id", "zid")


# One-degree climate grid filled from the suppliers; cells without a supplier are null.
CLIMATE = gr.Grid(-5.0, 41.5, 1.0, 1.0, 15, 10)


def climate_cells(t):
    ix, iy = CLIMATE.cell(lon_of("s_suppkey"), lat_of("s_suppkey"))
    agg = t.supplier.select(ix.alias("ix"), iy.alias("iy"), "s_acctbal").where(F.col("ix").isNotNull() & F.col("iy").isNotNull()).groupBy("ix", "iy").agg(
        F.avg("s_acctbal").alias("v"))
    keep = (F.col("ix") * 7 + F.col("iy") * 3) % 11 != 0
    return CLIMATE.table(t.spark).join(agg, ["ix", "iy"], "left").withColumn("v", F.when(keep, F.col("v"))).select(
        (F.col("iy") * 15 + F.col("ix")).alias("cell"), "ix", "iy", F.col("x").alias("lon"), F.col("y").alias("lat"), "v")


_CLIMATE = f"""g AS (SELECT (k % 15)::INT AS ix, (k // 15)::INT AS iy, k::INT AS cell, -5e0 + k % 15 AS lon, 41.5e0 + k // 15 AS lat FROM range(150) t(k)),
 ga AS (SELECT floor({lon_sql('s_suppkey')} + 5 + 0.5e0)::INT AS ix, floor({lat_sql('s_suppkey')} - 41.5e0 + 0.5e0)::INT AS iy, avg(s_acctbal) AS v FROM supplier GROUP BY 1, 2),
 cl AS (SELECT g.*, CASE WHEN (g.ix * 7 + g.iy * 3) % 11 <> 0 THEN v END AS v FROM g LEFT JOIN ga ON g.ix = ga.ix AND g.iy = ga.iy)"""


@query("cell_sampling", "J11 S8", f"""
WITH {_CLIMATE}, {SITE_POINTS} SELECT id, round(v, 5) AS v FROM pts LEFT JOIN cl ON cl.ix = floor(pts.lon + 5 + 0.5e0)::INT AND cl.iy = floor(pts.lat - 41.5e0 + 0.5e0)::INT""")
def cell_sampling(t):
    return gr.sample_cells(site_points(t), climate_cells(t), CLIMATE, ["v"], "lon", "lat").select("id", r("v", 5).alias("v"))


_BIL = f"""{_CLIMATE}, {SITE_POINTS}, b AS (SELECT id, lon + 5 AS fx, lat - 41.5e0 AS fy FROM pts), i AS (SELECT *, least(floor(fx), 13)::INT AS i, least(floor(fy), 8)::INT AS j FROM b WHERE fx BETWEEN 0 AND 14 AND fy BETWEEN 0 AND 9),
 c AS (SELECT id, i + a AS ix, j + d AS iy, (CASE a WHEN 1 THEN fx - i ELSE 1 - (fx - i) END) * (CASE d WHEN 1 THEN fy - j ELSE 1 - (fy - j) END) AS w FROM i, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(d)),
 s AS (SELECT id, sum(CASE WHEN v IS NULL THEN w ELSE 0 END) AS bad, sum(w * coalesce(v, 0)) AS tot FROM c LEFT JOIN cl ON c.ix = cl.ix AND c.iy = cl.iy WHERE w > 0 GROUP BY 1)"""


@query("bilinear_resample", "J13", f"""
WITH {_BIL} SELECT pts.id, round(CASE WHEN bad <= 0.01 + 1e-12 THEN tot END, 4) AS tolerant, round(CASE WHEN bad <= 2e-12 THEN tot END, 4) AS strict FROM pts LEFT JOIN s ON pts.id = s.id""")
def bilinear_resample(t):
    p, c = site_points(t), climate_cells(t)
    a = gr.bilinear(p.select("id", "lon", "lat"), c, CLIMATE, "v", x="lon", y="lat", out="tolerant")
    b = gr.bilinear(p.select("id", "lon", "lat"), c, CLIMATE, "v", x="lon", y="lat", tolerate=None, out="strict").select("id", "strict")
    return a.join(b, "id").select("id", r("tolerant", 4).alias("tolerant"), r("strict", 4).alias("strict"))


@query("gap_fill", "J14", f"""
WITH {_CLIMATE}, n AS (SELECT a.cell, b.v, row_number() OVER (PARTITION BY a.cell ORDER BY pow(a.ix - b.ix, 2) + pow(a.iy - b.iy, 2), b.cell) AS k FROM cl a, cl b WHERE a.v IS NULL AND b.v IS NOT NULL)
SELECT cl.cell, round(coalesce(cl.v, n.v), 5) AS v FROM cl LEFT JOIN n ON cl.cell = n.cell AND k = 1""")
def gap_fill(t):
    return gr.fill_nearest(climate_cells(t), "v").select("cell", r("v", 5).alias("v"))


@query("withdrawal_density", "A11 A12", f"""
WITH w AS (SELECT o_custkey, sum(o_totalprice) AS vol FROM orders GROUP BY 1),
 d AS (SELECT floor({lon_sql('o_custkey')} + 5.5e0)::INT AS ix, floor({lat_sql('o_custkey')} - 41.5e0 + 0.5e0)::INT AS iy, sum(vol) / 111e0 AS density FROM w GROUP BY 1, 2),
 g AS (SELECT (k % 15)::INT AS ix, (k // 15)::INT AS iy FROM range(150) t(k)), f AS (SELECT g.*, coalesce(density, 0) AS density FROM g LEFT JOIN d ON g.ix = d.ix AND g.iy = d.iy),
 q AS (SELECT quantile_cont(density, 0.95) AS c FROM f WHERE density > 0), m AS (SELECT max(density) AS t FROM f)
SELECT ix, iy, round(density, 3) AS density, round(least(density, c) / least(c, t), 7) AS stress FROM f, q, m""")
def withdrawal_density(t):
    vol = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("vol"))
    p = vol.select(lon_of("k").alias("x"), lat_of("k").alias("y"), "vol")
    d = gr.density(p, CLIMATE, "vol", CLIMATE.table(t.spark).select("ix", "iy"), area=111.0)
    return gr.capped_share(d).select("ix", "iy", r("density", 3).alias("density"), r("stress", 7).alias("stress"))


@query("coarse_blocks", "A14", f"""
WITH {_CLIMATE}, f AS (SELECT ix, iy, coalesce(v, 0) AS v FROM cl), p AS (SELECT f.* FROM f, range(4) a(i), range(4) b(j) WHERE i < CASE WHEN ix = 14 THEN 2 ELSE 1 END AND j < CASE WHEN iy = 9 THEN 3 ELSE 1 END)
SELECT ix // 4 AS ix, iy // 4 AS iy, round(avg(v), 5) AS mean, round(median(v), 5) AS med, round(max(v), 5) AS top FROM p GROUP BY 1, 2""")
def coarse_blocks(t):
    c = climate_cells(t).select("ix", "iy", F.coalesce("v", F.lit(0.0)).alias("v"))
    out = None
    for how, name in (("mean", "mean"), ("median", "med"), ("max", "top")):
        b = gr.coarsen(c, 4, CLIMATE.nx, CLIMATE.ny, "v", how).select("ix", "iy", r("v", 5).alias(name))
        out = b if out is None else out.join(b, ["ix", "iy"])
    return out


@query("median_smooth", "A15", f"""
WITH {_CLIMATE}, n AS (SELECT a.cell, a.v, b.v AS nv FROM cl a, (VALUES (-1), (0), (1)) x(i), (VALUES (-1), (0), (1)) y(j), cl b WHERE b.ix = least(greatest(a.ix + i, 0), 14) AND b.iy = least(greatest(a.iy + j, 0), 9))
SELECT cell, round(CASE WHEN any_value(v) IS NOT NULL THEN median(coalesce(nv, 0)) END, 5) AS smoothed FROM n GROUP BY 1""")
def median_smooth(t):
    m = gr.median3(climate_cells(t), "v", CLIMATE.nx, CLIMATE.ny)
    return m.select((F.col("iy") * 15 + F.col("ix")).alias("cell"), r("smoothed", 5).alias("smoothed"))


@query("coastal_reroute", "J12", f"""
WITH {_CLIMATE}, {SITE_POINTS}, s AS (SELECT id, floor(lon + 5.5e0)::INT AS cx, floor(lat - 41.5e0 + 0.5e0)::INT AS cy FROM pts WHERE floor(lon + 5.5e0) BETWEEN 0 AND 14 AND floor(lat - 41.5e0 + 0.5e0) BETWEEN 0 AND 9),
 j AS (SELECT id, cx, cy, cl.ix, cl.iy, abs(v) AS pet FROM s JOIN cl ON abs(cl.ix - cx) <= 1 AND abs(cl.iy - cy) <= 1),
 a AS (SELECT id, any_value(cx) AS cx, any_value(cy) AS cy, max(pet) FILTER (ix = cx AND iy = cy) AS c, max(pet) AS m FROM j GROUP BY 1), b AS (SELECT id, ix, iy, row_number() OVER (PARTITION BY id ORDER BY pet DESC NULLS LAST, ix, iy) AS k FROM j)
SELECT a.id, CASE WHEN c IS NULL OR c < 0.6e0 * m THEN b.ix ELSE cx END AS ix, CASE WHEN c IS NULL OR c < 0.6e0 * m THEN b.iy ELSE cy END AS iy, (c IS NULL OR c < 0.6e0 * m) AS rerouted FROM a JOIN b ON a.id = b.id AND k = 1""")
def coastal_reroute(t):
    cells = climate_cells(t).withColumn("pet", F.abs("v"))
    p = site_points(t).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return gr.land_cells(p, cells, CLIMATE, "pet")


@query("metric_grid_density", "S12 A11 P22", f"""
WITH v AS (SELECT c_custkey AS id, c_acctbal, {lon_sql('c_custkey')} AS lon, {lat_sql('c_custkey')} AS lat FROM customer),
 q AS (SELECT c_acctbal, {G._X0!r} + {G._C!r} * exp(-{G._N!r} * (atanh(sin(radians(lat))) - {G._E!r} * atanh({G._E!r} * sin(radians(lat))))) * sin({G._N!r} * radians(lon - 3e0)) AS x,
   {G._YS!r} - {G._C!r} * exp(-{G._N!r} * (atanh(sin(radians(lat))) - {G._E!r} * atanh({G._E!r} * sin(radians(lat))))) * cos({G._N!r} * radians(lon - 3e0)) AS y FROM v),
 i AS (SELECT floor((x - -697500e0) / 5000 + 0.5e0)::INT AS ix, floor((y - 7197500e0) / -5000 + 0.5e0)::INT AS iy, c_acctbal FROM q)
SELECT ix, iy, round(sum(c_acctbal) / 25e0, 5) AS density FROM i WHERE ix BETWEEN 0 AND 399 AND iy BETWEEN 0 AND 239 GROUP BY 1, 2""")
def metric_grid_density(t):
    x, y = to_lambert93(lon_of("c_custkey"), lat_of("c_custkey"))
    p = t.customer.select(x.alias("x"), y.alias("y"), "c_acctbal")
    return gr.density(p, gr.metric_grid(), "c_acctbal").withColumn("density", r("density", 5))


@query("lonlat_grid_counts", "S13 J11", """
WITH s AS (SELECT 15e0 / 111e0 AS st), v AS (SELECT floor((%s - (-5.2e0 + st / 2)) / st + 0.5e0)::INT AS ix, floor((%s - (41.2e0 + st / 2)) / st + 0.5e0)::INT AS iy, c_acctbal FROM customer, s)
SELECT ix, iy, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM v WHERE ix BETWEEN 0 AND 110 AND iy BETWEEN 0 AND 73 GROUP BY 1, 2""" % (lon_sql("c_custkey"), lat_sql("c_custkey")))
def lonlat_grid_counts(t):
    g = gr.lonlat_grid("15km")
    ix, iy = g.cell(lon_of("c_custkey"), lat_of("c_custkey"))
    v = t.customer.select(ix.alias("ix"), iy.alias("iy"), "c_acctbal").where(F.col("ix").isNotNull() & F.col("iy").isNotNull())
    return v.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"), r(F.sum("c_acctbal"), 4).alias("total"))


def _normal_sql(text: str) -> str:
    u = [f"((('0x' || substr(md5({text}), {1 + 16 * h}, 15))::BIGINT + 0.5e0) / {2**60}e0)" for h in (0, 1)]
    return f"sqrt(-2 * ln({u[0]})) * cos(2 * pi() * {u[1]})"


@query("synthetic_cube", "S11", f"""
WITH {SITE_POINTS}, c AS (SELECT DISTINCT floor((lon + 5) / 0.5e0)::INT AS ix, floor((lat - 41) / 0.5e0)::INT AS iy FROM pts), m AS (SELECT (DATE '2022-01-01' + to_months(k::INT))::DATE AS month FROM range(12) t(k))
SELECT ix, iy, month, round({_normal_sql("'42:' || ix || ':' || iy || ':' || month")}, 6) AS value FROM c, m""")
def synthetic_cube(t):
    cells = site_points(t).select(F.floor((F.col("lon") + 5) / 0.5).cast("int").alias("ix"), F.floor((F.col("lat") - 41) / 0.5).cast("int").alias("iy")).distinct()
    return gr.synthetic_cube(cells, "2022-01-01", "2022-12-01").select("ix", "iy", "month", r("value").alias("value"))


# --- interpolation ---------------------------------------------------------------------------

def readings(t):
    """Stations whose value is 0 (missing) by a fixed rule."""
    return stations(t).withColumn("value", F.when(F.col("sid") % 13 == 0, F.lit(0.0)).otherwise(F.col("value")))


_READ = f"{STATIONS.replace('s_acctbal / 20 + 50 AS value', 'CASE WHEN s_suppkey % 13 = 0 THEN 0 ELSE s_acctbal / 20 + 50 END AS value')}"
_NB = f"nb AS (SELECT p.sid, s.sid AS nid, {_D} AS dist, nullif(s.value, 0) AS nv, row_number() OVER (PARTITION BY p.sid ORDER BY {_D}, s.sid) AS rank FROM stations p, stations s WHERE p.sid <> s.sid)"
_NS = f"ns AS (SELECT p.id, s.sid, {_D} AS dist, nullif(s.value, 0) AS nv, s.cap, row_number() OVER (PARTITION BY p.id ORDER BY {_D}, s.sid) AS rank FROM pts p, stations s)"


@query("idw_sites", "M1 J15", f"""
WITH {SITE_POINTS}, {_READ}, {_NS} SELECT id, round(sum(nv / pow(greatest(dist, 3), 2)) / sum(CASE WHEN nv IS NOT NULL THEN 1 / pow(greatest(dist, 3), 2) END), 5) AS pred FROM ns WHERE rank <= 7 GROUP BY 1""")
def idw_sites(t):
    return ip.idw(site_points(t), readings(t), "value").withColumn("pred", r("pred", 5))


@query("voronoi_sites", "M2", f"WITH {SITE_POINTS}, {_READ}, {_NS} SELECT id, round(nv, 5) AS pred FROM ns WHERE rank = 1")
def voronoi_sites(t):
    return ip.voronoi(site_points(t), readings(t), "value").withColumn("pred", r("pred", 5))


_KS, _DS, _PS = (3, 5, 7, 10, 15), (1.0, 3.0, 5.0), (1.5, 2.0, 2.5)


@query("idw_parameter_search", "M3 J19 A28 K1", f"""
WITH {_READ}, {_NB}, c(method, k, d0, p) AS (VALUES {', '.join(f"('idw', {k}, {d}e0, {p}e0)" for k in _KS for d in _DS for p in _PS)}, ('voronoi', 1, 0e0, 0e0)),
 pr AS (SELECT sid, method, k, d0, p, sum(nv * pow(greatest(dist, d0, 1e-10), -p)) / sum(CASE WHEN nv IS NOT NULL THEN pow(greatest(dist, d0, 1e-10), -p) END) AS pred FROM nb JOIN c ON rank <= k GROUP BY ALL),
 j AS (SELECT pr.*, s.value AS tv FROM pr JOIN stations s ON pr.sid = s.sid WHERE pred > 0 AND s.value >= 5)
SELECT method, k, d0, p, count(*) AS n, round(avg(abs(tv - pred)), 5) AS mae, round(100 * sum(abs(tv - pred)) / sum(tv), 5) AS wmape, round(1 - sum(pow(tv - pred, 2)) / (var_pop(tv) * count(*)), 6) AS r2 FROM j GROUP BY ALL""")
def idw_parameter_search(t):
    g = ip.loo_grid(readings(t), "value", _KS, _DS, _PS)
    return g.select("method", "k", "d0", "p", "n", r("mae", 5).alias("mae"), r("wmape", 5).alias("wmape"), r("r2").alias("r2"))


@query("idw_adaptive", "M4", f"""
WITH {SITE_POINTS}, {_READ}, {_NS}, v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS pos FROM ns WHERE rank <= 12 AND nv IS NOT NULL),
 q AS (SELECT id, (quantile_cont(nv, 0.9) - quantile_cont(nv, 0.1)) / (quantile_cont(nv, 0.5) + 1e-6) AS g, arg_min(nv, rank) AS v1, min(dist) AS d1 FROM v GROUP BY 1),
 k AS (SELECT *, CASE WHEN v1 < 15 AND d1 < 4 AND g > 1.2 THEN 3 WHEN g > 0.8 THEN 5 ELSE 12 END AS k, CASE WHEN v1 < 15 AND d1 < 4 AND g > 1.2 THEN 2.2e0 WHEN g > 0.8 THEN 2e0 ELSE 2.5e0 END AS p FROM q)
SELECT v.id, round(sum(nv * pow(greatest(dist, 3), -p)) / sum(pow(greatest(dist, 3), -p)), 5) AS pred FROM v JOIN k ON v.id = k.id WHERE pos <= k GROUP BY 1""")
def idw_adaptive(t):
    return ip.idw_adaptive(site_points(t), readings(t), "value").withColumn("pred", r("pred", 5))


_RC = ip.RCAP


def _rcap_sql() -> str:
    vals = ", ".join(f"('{n}', {str(a).lower()}, {str(c).lower()}, {k})" for n, (a, c, k) in ip.RCAP_VARIANTS.items())
    return f"""{_READ}, {_NB}, v(config, ad, co, k) AS (VALUES {vals}),
 a AS (SELECT sid, config, ad, co, greatest(dist, 3) + 1e-6 AS d, nv AS y, pow(greatest(dist, 3) + 1e-6, -2) AS w0 FROM nb JOIN v ON rank <= k WHERE nv IS NOT NULL),
 m AS (SELECT *, sum(w0 * y) OVER w / sum(w0) OVER w AS mu FROM a WINDOW w AS (PARTITION BY sid, config)),
 s AS (SELECT *, sqrt(greatest(sum(w0 * pow(y - mu, 2)) OVER w / sum(w0) OVER w, 0)) AS sd FROM m WINDOW w AS (PARTITION BY sid, config)),
 f AS (SELECT *, pow(d, -CASE WHEN ad THEN 1.5e0 + 2e0 * exp(-pow(mu - 60, 2) / 1250e0) * sd / (sd + 12) ELSE 2e0 END) * CASE WHEN co THEN exp(-1.2e0 / (1 + exp(-(100 - mu) / 15e0)) * abs(y - mu) / (sd + 10)) ELSE 1e0 END AS wt FROM s),
 pr AS (SELECT sid, config, sum(wt * y) / sum(wt) AS pred FROM f GROUP BY 1, 2)"""


@query("rcap_ablation", "M5", f"WITH {_rcap_sql()} SELECT sid, config, round(pred, 5) AS pred FROM pr")
def rcap_ablation(t):
    s = readings(t)
    near = sp.knn_join(s, s.select(F.col("sid").alias("nid"), "x", "y", F.col("value").alias("nv")), 10, "sid", "nid", exclude_self=True, carry=["nv"])
    return ip.rcap_from(near, "sid", "nv", ip.rcap_variants(t.spark)).withColumn("pred", r("pred", 5))


@query("rcap_objective", "M5 A29", f"""
WITH {_rcap_sql()}, j AS (SELECT pr.config, pr.pred, b.pred AS base, s.value AS tv FROM pr JOIN pr b ON pr.sid = b.sid AND b.config = 'baseline' JOIN stations s ON s.sid = pr.sid WHERE s.value > 0),
 d AS (SELECT config, 100 * sum(abs(tv - base) - abs(tv - pred)) / greatest(sum(tv), 1) AS d_all, 100 * coalesce(sum(abs(tv - base) - abs(tv - pred)) FILTER (tv >= 20 AND tv < 50), 0) / greatest(coalesce(sum(tv) FILTER (tv >= 20 AND tv < 50), 0), 1) AS d1,
  100 * coalesce(sum(abs(tv - base) - abs(tv - pred)) FILTER (tv >= 50 AND tv < 100), 0) / greatest(coalesce(sum(tv) FILTER (tv >= 50 AND tv < 100), 0), 1) AS d2, 100 * coalesce(sum(abs(tv - base) - abs(tv - pred)) FILTER (tv >= 100), 0) / greatest(coalesce(sum(tv) FILTER (tv >= 100), 0), 1) AS d3 FROM j GROUP BY 1)
SELECT config, round(d_all, 5) AS d_all, round(d_all + 1.5e0 * d1 + 1.5e0 * d2 - greatest(0, -d3), 5) AS objective FROM d""")
def rcap_objective(t):
    s = readings(t)
    near = sp.knn_join(s, s.select(F.col("sid").alias("nid"), "x", "y", F.col("value").alias("nv")), 10, "sid", "nid", exclude_self=True, carry=["nv"])
    p = ip.rcap_from(near, "sid", "nv", ip.rcap_variants(t.spark))
    w = p.groupBy("sid").agg(F.collect_list(F.struct("config", "pred")).alias("_p"), F.max(F.when(F.col("config") == "baseline", F.col("pred"))).alias("base"))
    j = w.join(s.where(F.col("value") > 0).select("sid", F.col("value").alias("true")), "sid").select("base", "true", F.inline("_p"))
    return ip.composite_gain(j, "true", "pred", "base", ["config"]).select("config", r("d_all", 5).alias("d_all"), r("objective", 5).alias("objective"))


_GRID_COLUMNS = list(ip.RCAP_GRID)


def _search_sql() -> str:
    grid = ", ".join(f"(SELECT unnest([{', '.join(f'{float(v)}e0' for v in vs)}]) AS {n})" for n, vs in ip.RCAP_GRID.items())
    keys = "sid, k, p0"
    gains = [("d_all", "true"), ("d1", "tv >= 20 AND tv < 50"), ("d2", "tv >= 50 AND tv < 100"), ("d3", "tv >= 100")]
    cols = ", ".join(f"100 * coalesce(sum(abs(tv - base) - abs(tv - pred)) FILTER ({c}), 0) / greatest(coalesce(sum(tv) FILTER ({c}), 0), 1) AS {n}" for n, c in gains)
    return f"""{_READ}, {_NB}, g AS (SELECT * FROM {grid}), kp AS (SELECT DISTINCT k, p0 FROM g),
 a AS (SELECT sid, k, p0, greatest(dist, 3) + 1e-6 AS d, nv AS y, pow(greatest(dist, 3) + 1e-6, -p0) AS w0 FROM nb JOIN kp ON rank <= k WHERE nv IS NOT NULL),
 m AS (SELECT {keys}, sum(w0 * y) / sum(w0) AS mu FROM a GROUP BY {keys}), s AS (SELECT {keys}, mu, sqrt(greatest(sum(w0 * pow(y - mu, 2)) / sum(w0), 0)) AS sd FROM a JOIN m USING ({keys}) GROUP BY {keys}, mu),
 h AS (SELECT s.*, g.* EXCLUDE (k, p0), 1.5e0 + (p_max - 1.5e0) * exp(-pow(mu - m, 2) / (2 * s_r * s_r)) * sd / (sd + 12) AS p, gamma0 / (1 + exp(-(100 - mu) / b_h)) AS gm FROM s JOIN g USING (k, p0)),
 f AS (SELECT h.*, y, pow(d, -p) * exp(-gm * abs(y - mu) / (sd + tau)) AS wt FROM h JOIN a USING ({keys})),
 pr AS (SELECT sid, {', '.join(_GRID_COLUMNS)}, sum(wt * y) / sum(wt) AS pred FROM f GROUP BY ALL),
 b0 AS (SELECT sid, sum(pow(greatest(dist, 3) + 1e-6, -2) * nv) / sum(pow(greatest(dist, 3) + 1e-6, -2)) AS base FROM nb WHERE rank <= 7 AND nv IS NOT NULL GROUP BY 1),
 j AS (SELECT pr.*, base, value AS tv FROM pr JOIN b0 USING (sid) JOIN stations USING (sid) WHERE value > 0), d AS (SELECT {', '.join(_GRID_COLUMNS)}, {cols} FROM j GROUP BY ALL),
 o AS (SELECT *, round(d_all + 1.5e0 * d1 + 1.5e0 * d2 - greatest(0, -d3), 5) AS objective FROM d)
SELECT {', '.join(_GRID_COLUMNS)}, round(d_all, 5) AS d_all, objective, objective = max(objective) OVER () AS best FROM o"""


@query("rcap_search", "M5 A29 K1", f"WITH {_search_sql()}")
def rcap_search(t):
    """All 2,916 configurations on all stations, and which have the largest objective."""
    s = readings(t)
    near = sp.knn_join(s, s.select(F.col("sid").alias("nid"), "x", "y", F.col("value").alias("nv")), 12, "sid", "nid", exclude_self=True, carry=["nv"])
    base = ip.rcap_from(near, "sid", "nv", ip.rcap_params(t.spark, [{"config": "baseline", "k": 7, "adaptive": False, "coherent": False}])).select("sid", F.col("pred").alias("base"))
    targets = s.where(F.col("value") > 0).join(base, "sid").select("sid", F.col("value").alias("true"), "base")
    found = ip.rcap_search(near, targets, "sid", "nv", "true", "base").withColumn("objective", r("objective", 5))
    top = found.agg(F.max("objective").alias("_top"))
    return found.crossJoin(F.broadcast(top)).select(*_GRID_COLUMNS, r("d_all", 5).alias("d_all"), "objective", (F.col("objective") == F.col("_top")).alias("best"))


@query("capacity_site_score", "M6", f"""
WITH {SITE_POINTS}, {STATIONS}, c AS (SELECT p.id, s.sid, s.value, s.cap / pow({_D} + 5, 2) AS sc FROM pts p, stations s), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sc DESC, sid) AS rk FROM c)
SELECT id, round(sum(sc * value) / sum(sc), 5) AS pred, count(*) AS n_nodes FROM k WHERE rk <= 10 GROUP BY 1""")
def capacity_site_score(t):
    return ip.capacity_score(site_points(t), stations(t), "value", "cap").withColumn("pred", r("pred", 5))


@query("bus_site_score", "M6 G2", f"""
WITH {LINES_SQL}, {SITE_POINTS}, {STATIONS}, bu AS (SELECT src AS id, sum(s_nom) AS s, CASE WHEN src % 4 = 0 THEN 90 ELSE max(voltage) END AS v FROM e GROUP BY 1),
 c AS (SELECT s.sid, p.id, nv.value, bu.s / pow({_D} + 5, 2) AS sc FROM stations s, pts p JOIN bu USING (id) JOIN nv USING (id) WHERE bu.v >= 200 AND bu.s > 0), k AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY sc DESC, id) AS rk FROM c)
SELECT sid, round(sum(sc * value) / sum(sc), 5) AS pred, count(*) AS n_nodes FROM k WHERE rk <= 10 GROUP BY 1""")
def bus_site_score(t):
    """Stations from the ten nodes of at least 200 kV with the most line capacity for their distance."""
    from territoria.plans.catalog.network import lines, node_values

    buses = ip.bus_importance(lines(t)).withColumn("voltage", F.when(F.col("id") % 4 == 0, 90).otherwise(F.col("voltage")))
    nodes = buses.join(node_values(t), "id").join(site_points(t).select("id", "x", "y"), "id")
    s = ip.capacity_score(stations(t), nodes, "value", "importance", site_id="sid", node_id="id", least_voltage=200.0)
    return s.withColumn("pred", r("pred", 5))


@query("influence_mean", "M7", f"""
WITH {_READ}, w AS (SELECT p.sid, sum(s.cap * pow(greatest({_D}, 1), -1.5e0) * s.value) / sum(s.cap * pow(greatest({_D}, 1), -1.5e0)) AS m FROM stations p JOIN stations s ON {_D} <= 50 AND s.value <> 0 GROUP BY 1)
SELECT stations.sid, round(coalesce(m, value), 5) AS pred FROM stations LEFT JOIN w ON w.sid = stations.sid""")
def influence_mean(t):
    return ip.influence_mean(readings(t), "value", "cap").withColumn("pred", r("pred", 5))


@query("soft_knn", "M7 J8", f"""
WITH {STATIONS}, n AS (SELECT p.sid, {_D} AS d, s.value, row_number() OVER (PARTITION BY p.sid ORDER BY {_D}, s.sid) AS k FROM stations p, stations s) SELECT sid, round(sum(value / pow(d + 1, 2)) / sum(1 / pow(d + 1, 2)), 5) AS pred FROM n WHERE k <= 15 GROUP BY 1""")
def soft_knn(t):
    return ip.soft_knn(stations(t), "value").withColumn("pred", r("pred", 5))


@query("kernel_smoothing", "M8", f"""
WITH {STATIONS}, sg(sg) AS (VALUES (0e0), (5e0), (10e0), (15e0), (20e0), (40e0)), a AS (SELECT sg, p.sid, any_value(p.value) AS raw, sum(exp(-0.5e0 * pow({_D} / sg, 2)) * s.value) / sum(exp(-0.5e0 * pow({_D} / sg, 2))) AS m, count(*) AS k FROM stations p, sg, stations s WHERE {_D} <= 3 * sg GROUP BY 1, 2),
 f AS (SELECT sg, raw, CASE WHEN sg > 0 AND k >= 2 THEN m ELSE raw END AS sm FROM a) SELECT sg AS sigma, round(1 - var_pop(sm) / greatest(var_pop(raw), 1e-6), 6) AS signal_loss, round(stddev_pop(sm), 5) AS std, round(avg(sm), 5) AS mean FROM f GROUP BY 1""")
def kernel_smoothing(t):
    out = None
    for sigma in (0.0, 5.0, 10.0, 15.0, 20.0, 40.0):
        v = ip.variance_loss(ip.kernel_smooth(stations(t), "value", sigma)).select(F.lit(sigma).alias("sigma"), r("signal_loss").alias("signal_loss"), r("std", 5).alias("std"), r("mean", 5).alias("mean"))
        out = v if out is None else out.unionByName(v)
    return out


@query("colocated_pairs", "J21", f"""
WITH {SITE_POINTS}, q AS (SELECT id, x, y, id % 3 AS g FROM pts), b AS (SELECT p.id, s.id AS o, {_D} AS d, row_number() OVER (PARTITION BY p.id ORDER BY {_D}, s.id) AS k FROM q p JOIN q s ON p.g <> s.g AND abs(p.x - s.x) <= 25 AND abs(p.y - s.y) <= 25 AND {_D} <= 25)
SELECT DISTINCT least(id, o) AS a, greatest(id, o) AS b, round(d, 6) AS dist FROM b WHERE k = 1""")
def colocated_pairs(t):
    return sp.other_level_pairs(site_points(t).withColumn("g", F.col("id") % 3), "g", 25.0).withColumn("dist", r("dist"))


@query("enriched_site_scores", "E5 J7 P30d W5 P50", f"""
WITH {_NEAR}, s AS (SELECT p.id, CASE WHEN d <= 100 THEN value / 5.5e0 ELSE 50e0 END AS ws FROM pts p JOIN nn ON p.id = nn.id AND rank = 1),
 f AS (SELECT id, round((0.25e0 * (id % 101) + 0.2e0 * ws + 0.2e0 * (id * 7 % 101)) / 0.65e0, 5) AS score FROM s)
SELECT id, score, rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS rank FROM f""")
def enriched_site_scores(t):
    from territoria.functions.combine import site_score

    st = stations(t).withColumn("water_score", F.col("value") / 5.5)
    j = sp.nearest_join(site_points(t), st, max_km=100, carry=["water_score"], fallback={"water_score": 50.0})
    j = j.withColumn("score_temperature", (F.col("id") % 101).cast("double")).withColumn("score_carbon", (F.col("id") * 7 % 101).cast("double"))
    s = j.select("id", r(site_score(["score_temperature", "water_score", "score_carbon"]), 5).alias("score"))
    return with_rank(s, "score", "rank", descending=True)


@query("point_monthly_series", "E2 E1", f"""
WITH {_NEAR}, m AS (SELECT l_suppkey AS sid, month(l_shipdate) AS m, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT nn.id, CASE WHEN d <= 50 THEN nn.sid END AS sid, count(q) AS n_months, round(avg(q), 5) AS annual, round(avg(q) FILTER (m BETWEEN 6 AND 9), 5) AS summer, round(min(q), 5) AS worst, string_agg(round(q, 2)::DECIMAL(10, 2)::VARCHAR, ',' ORDER BY m) AS series
FROM nn LEFT JOIN m ON nn.sid = m.sid AND d <= 50 WHERE rank = 1 GROUP BY 1, 2""")
def point_monthly_series(t):
    """A row for each site; beyond 50 km all but the id is null or 0."""
    near = sp.nearest_join(site_points(t), stations(t), max_km=50.0)
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("sid"), F.month("l_shipdate").alias("m")).agg(F.avg("l_quantity").alias("q"))
    prof = m.groupBy("sid").agg(F.count("q").alias("n_months"), r_binary(F.avg("q"), 5).alias("annual"), r_binary(F.avg(F.when(F.col("m").between(6, 9), F.col("q"))), 5).alias("summer"), r_binary(F.min("q"), 5).alias("worst"),
                                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("m", "q"))), lambda s: r_binary(s["q"], 2).cast("decimal(10,2)").cast("string")), ",").alias("series"))
    return near.join(prof, "sid", "left").select("id", "sid", F.coalesce("n_months", F.lit(0)).alias("n_months"), "annual", "summer", "worst", "series")
