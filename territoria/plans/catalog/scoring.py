"""Scalar functions, composite indices, banding and parsing over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from territoria.functions import combine as C
from territoria.functions import distributions as D
from territoria.functions import geo as G
from territoria.functions import scalars as S
from territoria.functions import special
from territoria.functions import text as X
from territoria.operators import ranking, series
from territoria.plans.inputs import (
    NATION_MONTH, SITES, c01, lat_of, lat_sql, lon_of, lon_sql, nation_month, sites,
)
from territoria.plans.registry import query


def r(c, d=6):
    return F.round(c, d)


def clip_sql(e: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN ({e}) IS NOT NULL THEN least(greatest(({e}), {lo}), {hi}) END)"


@query("nation_drought_bands", "S5 A1 W1 A8 P5 P8 P12b", f"""
WITH {NATION_MONTH},
 acc AS (SELECT *, CASE WHEN count(precip) OVER w = 3 THEN sum(precip) OVER w END AS acc3 FROM nm
         WINDOW w AS (PARTITION BY nation ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 st AS (SELECT nation, month(month) AS m, avg(acc3) AS mu, stddev_samp(acc3) AS sd, count(acc3) AS n FROM acc
        WHERE year(month) BETWEEN 1995 AND 1999 GROUP BY 1, 2),
 z AS (SELECT acc.nation, month, acc3, CASE WHEN sd > 0 AND n >= 2 THEN (acc3 - mu) / sd END AS z
       FROM acc LEFT JOIN st ON acc.nation = st.nation AND month(acc.month) = st.m),
 s AS (SELECT *, 1 / (1 + exp(0.8e0 * z)) AS stress FROM z)
SELECT nation, month, round(acc3, 2) AS acc3, round(z, 5) AS z, round(stress, 5) AS stress,
  round({c01('-z / 3')}, 5) AS drought,
  CASE WHEN stress < 0.33 THEN 'Faible' WHEN stress < 0.55 THEN 'Modere' WHEN stress < 0.75 THEN 'Fort'
       WHEN stress IS NOT NULL THEN 'Critique' END AS band FROM s""")
def nation_drought_bands(t):
    acc = nation_month(t).withColumn("acc3", series.rolling_sum("precip", ["nation"], "month", 3))
    z = series.baseline_z(acc, ["nation"], "month", "acc3", (1995, 1999))
    z = z.withColumn("stress", S.z_to_stress("z"))
    return z.select("nation", "month", r("acc3", 2).alias("acc3"), r("z", 5).alias("z"), r("stress", 5).alias("stress"),
                    r(S.linear_stress("z"), 5).alias("drought"), S.index_band("stress").alias("band"))


@query("stress_maps", "P2 P3 P4 P5 P6 P7 P8 P9", f"""
WITH {SITES}, v AS (SELECT *, x_bws * 6 AS raw FROM sites)
SELECT id, round({c01('raw', '5e0')}, 6) AS lin,
  round({clip_sql(f"(1 / (1 + exp(-6.4e0 * {clip_sql('raw / 5e0', '0.001e0', '0.999e0')} / (1 - {clip_sql('raw / 5e0', '0.001e0', '0.999e0')}))) - 0.5e0) / 0.5e0", '0e0', '1e0')}, 6) AS logistic,
  round(1 / (1 + exp(-0.8e0 * (raw - 2e0))), 6) AS sigmoid, round(1 / (1 + exp(0.8e0 * spei3)), 6) AS z_stress,
  round(CASE WHEN x_aridity * 2 - 0.2e0 <= 0 THEN 1e0 ELSE 1 / (1 + pow((x_aridity * 2 - 0.2e0) / 0.65e0, 3)) END, 6) AS arid,
  round(CASE WHEN spei3 >= 0 THEN 0e0 WHEN spei3 < 0 THEN -spei3 / (2 + abs(spei3)) END, 6) AS asym,
  round({c01('-spei12', '3e0')}, 6) AS linear_drought, round({c01('-spei12', '2e0')}, 6) AS capped_drought,
  round(CASE WHEN id % 9 = 0 THEN NULL ELSE {clip_sql('greatest(x_sv - 0.3e0, 0e0) * 10', '0e0', '5e0')} END, 6) AS decline
FROM v""")
def stress_maps(t):
    v = sites(t).withColumn("raw", F.col("x_bws") * 6)
    v = v.withColumn("gtd", F.when(F.col("id") % 9 == 0, F.lit(-9999.0)).otherwise(F.col("x_sv") - 0.3))
    return v.select(
        "id", r(S.clip01("raw", 5)).alias("lin"), r(S.logistic_withdrawal("raw")).alias("logistic"),
        r(S.sigmoid_withdrawal("raw")).alias("sigmoid"), r(S.z_to_stress("spei3")).alias("z_stress"),
        r(S.aridity_stress(F.col("x_aridity") * 2 - 0.2)).alias("arid"), r(S.asymptotic_stress("spei3")).alias("asym"),
        r(S.linear_stress("spei12")).alias("linear_drought"), r(S.linear_stress("spei12", 2)).alias("capped_drought"),
        r(S.decline_score("gtd")).alias("decline"))


@query("unit_conversions", "P1 P1b P1c", f"""
WITH {NATION_MONTH}, v AS (SELECT *, precip / 1e9 AS rate, -pet / 1e9 AS flux, day(last_day(month)) AS d FROM nm)
SELECT nation, month, round(rate * d * 24 * 1000, 4) AS mm_hourly, round(greatest((rate - 0.0002e0) * d * 1000, 0e0), 4) AS mm_daily,
  round(greatest(-flux * d * 1000, 0e0), 4) AS pet_daily, round(abs(flux) * 1000, 4) AS pet_plain,
  round(280 + rate * 1000 - 273.15e0, 4) AS celsius FROM v""")
def unit_conversions(t):
    v = nation_month(t).withColumn("rate", F.col("precip") / 1e9).withColumn("flux", -F.col("pet") / 1e9)
    return v.select(
        "nation", "month", r(S.hourly_rate_to_mm("rate", "month"), 4).alias("mm_hourly"),
        r(S.daily_rate_to_mm(F.col("rate") - 0.0002, "month"), 4).alias("mm_daily"),
        r(S.upward_flux_to_mm("flux", "month"), 4).alias("pet_daily"), r(S.upward_flux_to_mm("flux"), 4).alias("pet_plain"),
        r(S.kelvin_to_celsius(280 + F.col("rate") * 1000), 4).alias("celsius"))


def _map_sql(name: str, m: dict) -> str:
    return f"{name}(k, v) AS (VALUES " + ", ".join(f"('{k}', {v}e0)" for k, v in m.items()) + ")"


@query("coded_aquifer_stress", "P10 J3", f"""
WITH {_map_sql('ms', S.MEDIUM_SCORE)}, {_map_sql('sf', S.SETTING_FACTOR)}, {_map_sql('ty', S.LEGACY_TYPE_SCORE)}, {_map_sql('st', S.LEGACY_STATE_FACTOR)},
 p AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'X' ELSE (p_size % 7)::VARCHAR END AS code,
         CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE (p_partkey % 6)::VARCHAR END AS theme,
         CASE p_type WHEN 'ECONOMY' THEN 'Domaine à aquifère karstique' WHEN 'PROMO' THEN 'Domaine à aquifère fissuré discontinu' ELSE p_type END AS lt,
         CASE WHEN p_partkey % 3 = 0 THEN 'Médiocre' ELSE 'Bon état' END AS ls FROM part)
SELECT p_partkey, round({c01('coalesce(ms.v, 0.5e0) * coalesce(sf.v, 1e0)')}, 6) AS score,
  round({c01('coalesce(ty.v, 0.5e0) * coalesce(st.v, 1e0)')}, 6) AS legacy
FROM p LEFT JOIN ms ON code = ms.k LEFT JOIN sf ON theme = sf.k LEFT JOIN ty ON lt = ty.k LEFT JOIN st ON ls = st.k""")
def coded_aquifer_stress(t):
    size = F.col("p_size") % 7
    p = t.part.select(
        "p_partkey", F.when(size == 0, "X").otherwise(size.cast("string")).alias("code"),
        F.when(F.col("p_partkey") % 6 != 0, (F.col("p_partkey") % 6).cast("string")).alias("theme"),
        F.when(F.col("p_type") == "ECONOMY", "Domaine à aquifère karstique")
        .when(F.col("p_type") == "PROMO", "Domaine à aquifère fissuré discontinu").otherwise(F.col("p_type")).alias("lt"),
        F.when(F.col("p_partkey") % 3 == 0, "Médiocre").otherwise("Bon état").alias("ls"))
    return p.select("p_partkey", r(S.coded_stress("code", "theme")).alias("score"),
                    r(S.coded_stress("lt", "ls", S.LEGACY_TYPE_SCORE, S.LEGACY_STATE_FACTOR)).alias("legacy"))


_BAND = "CASE WHEN {0} < 35 THEN '{1[0]}' WHEN {0} < 50 THEN '{1[1]}' WHEN {0} < 65 THEN '{1[2]}' WHEN {0} < 80 THEN '{1[3]}' ELSE '{1[4]}' END"


@query("score_from_components", "P11 P12 P12b P36 P37 P45 P49", f"""
WITH {SITES},
 v AS (SELECT id, x_bws AS b, coalesce(x_gws, 0.4e0) AS g, {c01('-coalesce(spei12, 0)', '3e0')} AS d FROM sites),
 w AS (SELECT *, {c01('0.60e0 * b + 0.25e0 * g + 0.15e0 * d')} AS wsi,
   least(sqrt(pow(0.60e0 * 0.12e0 * b, 2) + pow(0.25e0 * 0.18e0 * g, 2) + pow(0.15e0 * 0.22e0 * d, 2)), 1e0) AS sg FROM v),
 s AS (SELECT *, 100 * (1 - wsi) AS score FROM w)
SELECT id, round(wsi, 3) AS wsi, round(score, 4) AS score, round(least(100 * sg, 20e0), 4) AS sigma_points,
  {_BAND.format('score', [b[0] for b in S.SCORE_BANDS])} AS level, {_BAND.format('score', [b[1] for b in S.SCORE_BANDS])} AS color,
  CASE WHEN wsi < 0.33 THEN 'Faible' WHEN wsi < 0.55 THEN 'Modere' WHEN wsi < 0.75 THEN 'Fort' ELSE 'Critique' END AS band,
  CASE WHEN score < 50 THEN 'low' WHEN score < 200 THEN 'mid' ELSE 'high' END AS regime FROM s""")
def score_from_components(t):
    v = sites(t).select("id", F.col("x_bws").alias("b"), F.coalesce("x_gws", F.lit(0.4)).alias("g"),
                        S.linear_stress(F.coalesce("spei12", F.lit(0.0))).alias("d"))
    v = v.withColumn("wsi", C.stress_index("b", "g", "d")).withColumn("score", S.stress_to_score("wsi"))
    band = S.score_band("score")
    return v.select("id", r("wsi", 3).alias("wsi"), r("score", 4).alias("score"),
                    r(S.uncertainty_points(C.index_sigma("b", "g", "d")), 4).alias("sigma_points"),
                    band["level"].alias("level"), band["color"].alias("color"), S.index_band("wsi").alias("band"),
                    S.regime_band("score").alias("regime"))


@query("sentinel_cleaning", "P13 P14", """
WITH v AS (SELECT l_suppkey, CASE WHEN l_linenumber = 7 THEN -9999.4e0 WHEN l_quantity = 50 THEN 9999.0e0 ELSE l_extendedprice / 100 END AS q FROM lineitem),
 c AS (SELECT l_suppkey, CASE WHEN NOT (abs(q + 9999) <= 1 + 1e-5 * 9999 OR abs(q - 9999) <= 1 + 1e-5 * 9999) THEN q END AS q FROM v)
SELECT l_suppkey AS station, count(*) AS n, count(q) AS n_valid, count(*) FILTER (q < 50 OR q > 900) AS n_out,
  round(avg(CASE WHEN q IS NOT NULL THEN least(greatest(q, 50e0), 900e0) END), 4) AS mean_clamped FROM c GROUP BY 1""")
def sentinel_cleaning(t):
    q = F.when(F.col("l_linenumber") == 7, F.lit(-9999.4)).when(F.col("l_quantity") == 50, F.lit(9999.0)).otherwise(F.col("l_extendedprice") / 100)
    v = t.lineitem.select(F.col("l_suppkey").alias("station"), S.drop_sentinels(q).alias("q"))
    return v.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.count("q").alias("n_valid"),
                                    F.count_if(S.out_of_range("q", 50, 900)).alias("n_out"), r(F.avg(S.clip("q", 50.0, 900.0)), 4).alias("mean_clamped"))


@query("safe_casts", "P15 P16", """
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE o_totalprice::VARCHAR END AS amount,
   CASE WHEN o_orderkey % 8 = 0 THEN '1997-13-45' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
   lower(substr(o_orderpriority, 3)) AS city, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS cat,
   (o_orderkey % 120)::VARCHAR AS code FROM orders)
SELECT o_orderkey, TRY_CAST(amount AS DOUBLE) AS amount, TRY_CAST(day AS DATE) AS day,
  CASE city WHEN 'urgent' THEN 'Urgent' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' WHEN 'not specified' THEN 'Not Specified' ELSE city END AS city,
  coalesce(cat, 'Non classe') AS cat, CASE WHEN length(code) >= 2 THEN code ELSE lpad(code, 2, '0') END AS code FROM v""")
def safe_casts(t):
    k = F.col("o_orderkey")
    amount = F.when(k % 10 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    day = F.when(k % 8 == 0, "1997-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select(
        "o_orderkey", X.safe_double(amount).alias("amount"), X.safe_date(day, "yyyy-MM-dd").alias("day"),
        F.initcap(F.lower(F.substr("o_orderpriority", F.lit(3)))).alias("city"),
        F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.lit("Non classe")).alias("cat"),
        X.zero_pad(k % 120).alias("code"))


@query("validity_filters", "P17 P18 P39", f"""
WITH v AS (SELECT c_custkey AS id, {lon_sql('c_custkey')} AS lon, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE {lat_sql('c_custkey')} END AS lat, c_acctbal AS volume FROM customer),
 n AS (SELECT o_custkey, count(*) AS n, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1)
SELECT id, lon, lat, n, last, 0.2e0 AS uncertainty, volume >= 5000 AS critical FROM v JOIN n ON id = o_custkey
WHERE lat IS NOT NULL AND volume > 0 AND n >= 6 AND last >= DATE '2000-06-01' AND lon BETWEEN -4 AND 8 AND lat BETWEEN 42 AND 50""")
def validity_filters(t):
    k = F.col("c_custkey")
    v = t.customer.select(k.alias("id"), lon_of(k).alias("lon"), F.when(k % 23 != 0, lat_of(k)).alias("lat"), F.col("c_acctbal").alias("volume"))
    n = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").cast("date").alias("last"))
    kept = v.dropna(subset=["lon", "lat", "volume"]).where((F.col("volume") > 0) & G.bbox("lon", "lat", -4, 42, 8, 50))
    return kept.join(n, "id").where((F.col("n") >= 6) & (F.col("last") >= F.lit("2000-06-01").cast("date"))).select(
        "id", "lon", "lat", "n", "last", F.lit(0.2).alias("uncertainty"), (F.col("volume") >= 5000).alias("critical"))


@query("season_means", "P19 A18", f"""
WITH {NATION_MONTH}
SELECT nation, round(avg(precip) FILTER (month(month) BETWEEN 6 AND 9), 6) AS summer, round(avg(precip) FILTER (month(month) IN (6, 7, 8)), 6) AS jja,
  round(avg(precip) FILTER (month(month) IN (12, 1, 2)), 6) AS djf, round(min(precip), 6) AS worst FROM nm GROUP BY 1""")
def season_means(t):
    m = F.month("month")
    return nation_month(t).groupBy("nation").agg(
        r(F.avg(F.when(m.between(6, 9), F.col("precip"))), 6).alias("summer"), r(F.avg(F.when(m.isin(6, 7, 8), F.col("precip"))), 6).alias("jja"),
        r(F.avg(F.when(m.isin(12, 1, 2), F.col("precip"))), 6).alias("djf"), r(F.min("precip"), 6).alias("worst"))


@query("guarded_weights", "P20", """
WITH s AS (SELECT l_suppkey AS station, l_returnflag AS f, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
 p AS (SELECT station, sum(q) FILTER (f = 'A') / sum(q) AS a, sum(q) FILTER (f = 'N') / sum(q) AS n, sum(q) FILTER (f = 'R') / sum(q) AS r FROM s GROUP BY 1)
SELECT station, round(a + n + r, 6) AS total, round(a, 6) AS a FROM p""")
def guarded_weights(t):
    q = F.col("l_quantity")
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("station")).agg(
        *[(F.sum(F.when(F.col("l_returnflag") == f.upper(), q)) / F.sum(q)).alias(f) for f in "anr"])
    return p.select("station", r(S.guard_weights(["a", "n", "r"])).alias("total"), r("a").alias("a"))


@query("code_normalisation", "P21 P48", """
WITH v AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 220 WHEN 1 THEN 380 WHEN 2 THEN 63 ELSE 400 END AS volt FROM part),
 n AS (SELECT p_partkey, CASE volt WHEN 220 THEN 225 WHEN 380 THEN 400 ELSE volt END AS volt FROM v),
 w AS (SELECT n.volt, count(*) AS parts, sum(l_quantity) FILTER (l_returnflag = 'A') AS exchange_a, sum(l_quantity) FILTER (l_returnflag = 'R') AS exchange_r,
   sum(l_quantity) FILTER (l_returnflag = 'N') AS local_n FROM n JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)
SELECT volt, carrier, value, net FROM (SELECT volt, coalesce(exchange_a, 0) + coalesce(exchange_r, 0) AS net, unnest(['exchange_a', 'exchange_r', 'local_n']) AS carrier,
  unnest([exchange_a, exchange_r, local_n]) AS value FROM w)""")
def code_normalisation(t):
    volt = {0: 220, 1: 380, 2: 63, 3: 400}
    n = t.part.select("p_partkey", S.lookup(S.lookup(F.col("p_size") % 4, volt, 0), {220: 225, 380: 400, 63: 63, 400: 400}, 0).alias("volt"))
    per_part = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(c)
          for c, f in (("exchange_a", "A"), ("exchange_r", "R"), ("local_n", "N"))])
    cols = ["exchange_a", "exchange_r", "local_n"]
    wide = per_part.join(n, "p_partkey").groupBy("volt").agg(*[F.sum(c).alias(c) for c in cols])
    wide = wide.withColumn("net", S.sum_by_prefix(cols, "exchange"))
    return wide.unpivot(["volt", "net"], cols, "carrier", "value").select("volt", "carrier", "value", "net")


_ISO = f"(atanh(sin(radians(lat))) - {G._E!r} * atanh({G._E!r} * sin(radians(lat))))"


@query("projected_coordinates", "P22", f"""
WITH v AS (SELECT c_custkey AS id, {lon_sql('c_custkey')} AS lon, {lat_sql('c_custkey')} AS lat FROM customer)
SELECT id, round({G._X0!r} + {G._C!r} * exp(-{G._N!r} * {_ISO}) * sin({G._N!r} * radians(lon - 3e0)), 3) AS x,
  round({G._YS!r} - {G._C!r} * exp(-{G._N!r} * {_ISO}) * cos({G._N!r} * radians(lon - 3e0)), 3) AS y,
  round(lon, 7) AS lon, round(lat, 7) AS lat FROM v""")
def projected_coordinates(t):
    k = F.col("c_custkey")
    x, y = G.to_lambert93(lon_of(k), lat_of(k))
    p = t.customer.select(k.alias("id"), x.alias("x"), y.alias("y"))
    lon, lat = G.from_lambert93("x", "y")
    return p.select("id", r("x", 3).alias("x"), r("y", 3).alias("y"), r(lon, 7).alias("lon"), r(lat, 7).alias("lat"))


@query("site_distances", "P23 P24", f"""
WITH v AS (SELECT o_orderkey, o_custkey, {lon_sql('o_custkey')} AS lon1, {lat_sql('o_custkey')} AS lat1, {lon_sql('l_suppkey')} AS lon2, {lat_sql('l_suppkey')} AS lat2
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
 d AS (SELECT *, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2) AS a,
   sqrt(pow(lon1 * 111 * cos(radians(lat1)) - lon2 * 111 * cos(radians(lat2)), 2) + pow((lat1 - lat2) * 111, 2)) AS p FROM v)
SELECT o_custkey AS id, count(*) AS n, round(avg(2 * 6371e0 * atan2(sqrt(a), sqrt(1 - a))), 4) AS km, round(avg(p), 4) AS plane FROM d GROUP BY 1""")
def site_distances(t):
    o = t.orders.select("o_orderkey", "o_custkey")
    v = o.join(t.lineitem.select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    a, b = F.col("o_custkey"), F.col("l_suppkey")
    (x1, y1), (x2, y2) = G.plane_km(lon_of(a), lat_of(a)), G.plane_km(lon_of(b), lat_of(b))
    return v.select(a.alias("id"), G.haversine_km(lon_of(a), lat_of(a), lon_of(b), lat_of(b)).alias("h"), F.hypot(x1 - x2, y1 - y2).alias("p")
                    ).groupBy("id").agg(F.count(F.lit(1)).alias("n"), r(F.avg("h"), 4).alias("km"), r(F.avg("p"), 4).alias("plane"))


def _poly_sql(coefs, x: str) -> str:
    out = f"{coefs[-1]!r}::DOUBLE"
    for c in reversed(coefs[:-1]):
        out = f"(({out}) * {x} + {c!r}::DOUBLE)"
    return out


def ppf_sql(p: str, clamp: str) -> str:
    """The same quantile in SQL; ``p`` must be a column name."""
    pc = f"least(greatest({p}, {clamp}), 1 - {clamp})"
    q, tail = f"({pc} - 0.5e0)", f"sqrt(-ln(least({pc}, 1 - {pc})))"
    r0 = f"(0.180625e0 - {q} * {q})"

    def ratio(t, x):
        return f"{_poly_sql(t[0], x)} / {_poly_sql(t[1], x)}"

    return (f"CASE WHEN {p} IS NULL THEN NULL WHEN abs({q}) <= 0.425 THEN {q} * {ratio(D.AS241_CENTRAL, r0)} "
            f"ELSE sign({q}) * CASE WHEN {tail} <= 5 THEN {ratio(D.AS241_NEAR, f'({tail} - 1.6e0)')} ELSE {ratio(D.AS241_FAR, f'({tail} - 5e0)')} END END")


@query("normal_quantiles", "P25 P26", f"""
WITH v AS (SELECT o_custkey AS id, avg(o_totalprice) AS x FROM orders GROUP BY 1),
 c AS (SELECT id, x, 1 / (1 + pow(x / 250000e0, -3.5e0)) AS p, CASE WHEN id % 50 = 0 THEN 1e-9 ELSE 1 / (1 + pow(x / 250000e0, -12e0)) END AS p2 FROM v)
SELECT id, round(p, 8) AS p, round({ppf_sql('p', '1e-6')}, 6) AS z, round({ppf_sql('p2', '1e-4')}, 6) AS z_tail FROM c""")
def normal_quantiles(t):
    v = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("x"))
    p = D.loglogistic_cdf("x", F.lit(3.5), F.lit(250000.0))
    p2 = F.when(F.col("id") % 50 == 0, F.lit(1e-9)).otherwise(D.loglogistic_cdf("x", F.lit(12.0), F.lit(250000.0)))
    return v.select("id", r(p, 8).alias("p"), r(D.norm_ppf(p)).alias("z"), r(D.norm_ppf(p2, 1e-4)).alias("z_tail"))


def gamma_cdf_sql(a: str, x: str) -> str:
    """A sum of positive terms, as many as the place needs, with the engine's own lgamma."""
    terms = f"(greatest({x} - {a}, 0) + 14 * sqrt({x} + 1) + 80)::INT"
    return f"(CASE WHEN {x} <= 0 THEN 0e0 ELSE least(list_sum(list_transform(range({terms}), lambda n: exp(({a} + n) * ln({x}) - {x} - lgamma({a} + n + 1)))), 1e0) END)"


_PX = "greatest(2 / 0.6e0 * ((x - 250000e0) / 80000e0 + 2 / 0.6e0), 0e0)"


@query("gamma_probabilities", "P27 P28", f"""
WITH v AS (SELECT o_custkey AS id, CASE WHEN o_custkey % 40 <> 0 THEN avg(o_totalprice) ELSE 0e0 END AS x FROM orders GROUP BY 1)
SELECT id, round(CASE WHEN x <= 0 THEN 0.025e0 ELSE 0.025e0 + 0.975e0 * {gamma_cdf_sql('9e0', '(x / 28000e0)')} END, 8) AS gamma_p, round({gamma_cdf_sql(str(4 / 0.36) + 'e0', _PX)}, 8) AS pearson_p FROM v""")
def gamma_probabilities(t):
    v = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("x"))
    v = v.withColumn("x", F.when(F.col("id") % 40 != 0, F.col("x")).otherwise(F.lit(0.0)))
    return v.select("id", r(special.gamma_cdf_with_zeros("x", F.lit(0.025), F.lit(9.0), F.lit(28000.0)), 8).alias("gamma_p"),
                    r(special.pearson3_cdf("x", F.lit(0.6), F.lit(250000.0), F.lit(80000.0)), 8).alias("pearson_p"))


@query("modulated_stress", "P29 P38 P39", f"""
WITH {SITES}
SELECT id, round({c01('x_bws + (1 - x_bws) * 0.5e0 * x_sv')}, 6) AS raised,
  round({c01(f"0.30e0 * x_aridity + 0.25e0 * (0.5e0 * (spei3 IS NULL)::INT + 0.5e0 * (x_gws IS NULL)::INT) + 0.25e0 * {c01('1 - 10 * x_sv')} + 0.20e0 * {c01('(id % 30) / 14e0')}")}, 6) AS u
FROM sites""")
def modulated_stress(t):
    return sites(t).select("id", r(S.withdrawal_modulation("x_bws", "x_sv")).alias("raised"),
                           r(C.reliability("x_aridity", "spei3", "x_gws", "x_sv", F.col("id") % 30)).alias("u"))


def _wmean_sql(ws: dict) -> str:
    num = " + ".join(f"coalesce({w}e0 * {c}, 0)" for c, w in ws.items())
    return f"(({num}) / ({_live_sql(ws)}))"


def _live_sql(ws: dict) -> str:
    return " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w}e0 ELSE 0e0 END" for c, w in ws.items())


def _wgeo_sql(ws: dict) -> str:
    num = " + ".join(f"coalesce({w}e0 * ln({c} + 0.05e0), 0)" for c, w in ws.items())
    return clip_sql(f"exp(({num}) / ({_live_sql(ws)})) - 0.05e0", "0e0", "1e0")


_ASYM = "CASE WHEN {0} >= 0 THEN 0e0 WHEN {0} < 0 THEN -{0} / (2 + abs({0})) END"
_BOLTZ = "coalesce((d3 * exp(5 * d3) + d12 * exp(5 * d12)) / (exp(5 * d3) + exp(5 * d12)), d3, d12)"
_H = "coalesce(least(greatest(0.7e0 * (1 - {c}) * {s} + (1 - 0.7e0 * (1 - {c})) * {c}, CASE WHEN {c} IS NULL THEN NULL ELSE 0e0 END), CASE WHEN {c} IS NULL THEN NULL ELSE 1e0 END), {s}, {c})"

SITE_INDEX = f"""{SITES},
 dd AS (SELECT *, {_ASYM.format('spei3')} AS d3, {_ASYM.format('spei12')} AS d12 FROM sites),
 sc AS (SELECT *, {_wmean_sql(C.WEIGHTS_ARITH)} AS s2, {_wgeo_sql(C.WEIGHTS_GEOM)} AS s3, {_BOLTZ} AS cb, greatest(d3, d12) AS cm FROM dd),
 idx AS (SELECT *, {_H.format(s='s2', c='cb')} AS h2, {_H.format(s="s3", c="cm")} AS h3 FROM sc)"""


def site_index_frame(t):
    s = sites(t).withColumn("d3", S.asymptotic_stress("spei3")).withColumn("d12", S.asymptotic_stress("spei12"))
    s = s.withColumn("s2", C.wmean(C.WEIGHTS_ARITH)).withColumn("s3", C.wgeo(C.WEIGHTS_GEOM))
    s = s.withColumn("cb", C.boltzmann("d3", "d12")).withColumn("cm", C.hard_max("d3", "d12"))
    return s.withColumn("h2", C.assemble("s2", "cb")).withColumn("h3", C.assemble("s3", "cm"))


_AM = {"x_bws": 0.5, "x_aridity": 0.36, "x_gws": 0.14}


@query("site_index", "P7 P30 P31 P31b P32 P33 P34 P35 J1", f"""
WITH {SITE_INDEX}, m AS (SELECT *, {' + '.join(f"coalesce({w}e0 * pow({c} - s2, 2), 0)" for c, w in _AM.items())} AS ss, {_live_sql(_AM)} AS lw FROM idx),
 b AS (SELECT *, 0.7e0 * (1 - cb) AS be FROM m)
SELECT id, level, round(s2, 6) AS s2, round(s3, 6) AS s3, round({clip_sql('s2 + CASE WHEN s2 > 0 THEN ss / lw / s2 ELSE 0 END', '0e0', '1e0')}, 6) AS ampi,
  round(cb, 6) AS conj_boltz, round(cm, 6) AS conj_max, round(coalesce(0.6e0 * d3 + 0.4e0 * d12, d3, d12), 6) AS conj_mix,
  round(h2, 6) AS h2, round(h3, 6) AS h3, round(coalesce({clip_sql('0.7e0 * s3 + 0.3e0 * cb', '0e0', '1e0')}, s3, cb), 6) AS h_fixed,
  round(CASE WHEN be * s2 + (1 - be) * cb <> 0 THEN 100 * be * s2 / (be * s2 + (1 - be) * cb) END, 4) AS pct_struct FROM b""")
def site_index(t):
    s = site_index_frame(t)
    return s.select("id", "level", r("s2").alias("s2"), r("s3").alias("s3"), r(C.ampi(C.WEIGHTS_ARITH)).alias("ampi"), r("cb").alias("conj_boltz"),
                    r("cm").alias("conj_max"), r(C.fixed_mix("d3", "d12")).alias("conj_mix"), r("h2").alias("h2"), r("h3").alias("h3"),
                    r(C.assemble("s3", "cb", dynamic=False)).alias("h_fixed"), r(C.contribution_shares("s2", "cb")[0], 4).alias("pct_struct"))


_L = {"b": "x_bws", "g": "x_gws", "d": "spei3", "s": "x_sv", "v": "x_aridity", "u": "spei12"}


@query("local_index", "P30b P30c", f"""
WITH {SITES}, v AS (SELECT id, x_bws AS b, x_gws AS g, {c01('-spei3', '3e0')} AS d, x_sv AS s, x_aridity AS v, {c01('-spei12', '3e0')} AS u FROM sites),
 w AS (SELECT *, {_live_sql(C.WEIGHTS_LOCAL)} AS lw FROM v)
SELECT id, round({c01(_wmean_sql(C.WEIGHTS_LOCAL))}, 8) AS index, round(coalesce(0.25e0 * b, 0) / lw, 8) AS b_contrib, round(coalesce(0.15e0 * g, 0) / lw, 8) AS g_contrib,
  (b IS NULL OR g IS NULL OR d IS NULL OR s IS NULL OR v IS NULL OR u IS NULL) AS redistributed, round({c01(_wmean_sql({'b': 0.5, 'g': 0.3}))}, 8) AS two_layers FROM w""")
def local_index(t):
    v = sites(t).select("id", F.col("x_bws").alias("b"), F.col("x_gws").alias("g"), S.linear_stress("spei3").alias("d"), F.col("x_sv").alias("s"),
                        F.col("x_aridity").alias("v"), S.linear_stress("spei12").alias("u"))
    i = v.withColumn("i", C.local_index({k: k for k in C.WEIGHTS_LOCAL}))
    return i.select("id", r("i.index", 8).alias("index"), r("i.b_contrib", 8).alias("b_contrib"), r("i.g_contrib", 8).alias("g_contrib"),
                    "i.redistributed", r(C.layered_mean({"b": 0.5, "g": 0.3, "piezo": 0.2}, ["b", "g"]), 8).alias("two_layers"))


@query("site_score_rank", "P30d W5", f"""
WITH {SITES}, v AS (SELECT id, 100 * x_bws AS a, 100 * x_gws AS w, 100 * x_sv AS c, 100 * x_aridity AS e, level * 20e0 AS f FROM sites),
 s AS (SELECT id, (coalesce(a, 0) * 0.25e0 + coalesce(w, 0) * 0.2e0 + coalesce(c, 0) * 0.2e0 + coalesce(e, 0) * 0.1e0 + coalesce(f, 0) * 0.1e0) / 0.85e0 AS score FROM v),
 q AS (SELECT id, round(score, 4) AS score FROM s)
SELECT id, score, rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS rank FROM q""")
def site_score_rank(t):
    v = sites(t).select("id", (100 * F.col("x_bws")).alias("score_temperature"), (100 * F.col("x_gws")).alias("water_score"),
                        (100 * F.col("x_sv")).alias("score_carbon"), (100 * F.col("x_aridity")).alias("score_environnement"),
                        (F.col("level") * 20.0).alias("score_technique"))
    s = v.select("id", r(C.site_score(v.columns), 4).alias("score"))
    return ranking.with_rank(s, "score", "rank", descending=True)


@query("zone_mixes", "P40 W13 F3 A22", f"""
WITH {SITES}, v AS (SELECT id, c_nationkey AS zone, 20 + 400 * x_bws AS loc, 1 + level AS w, 30 + 100 * x_sv AS gr FROM sites),
 z AS (SELECT zone, sum(w * loc) / sum(w) AS zv, quantile_cont(loc, 0.25) AS p25, quantile_cont(loc, 0.75) AS p75 FROM v GROUP BY 1),
 j AS (SELECT v.*, zv, p25, p75, least(greatest(loc, zv / 2), zv * 2) AS c2, least(greatest(loc, zv / 2.5e0), zv * 2.5e0) AS c25 FROM v JOIN z USING (zone))
SELECT id, round(zv, 7) AS zone, round(loc, 7) AS raw, round(0.3e0 * loc + 0.7e0 * zv, 7) AS linear, round(0.1e0 * c2 + 0.9e0 * zv, 7) AS clip,
  round(0.2e0 * exp(-abs(loc - zv) / greatest(zv, 1)) * loc + (1 - 0.2e0 * exp(-abs(loc - zv) / greatest(zv, 1))) * zv, 7) AS adaptive,
  round(0.2e0 * exp(-0.5e0 * abs(c25 - zv) / greatest(zv, 1)) * c25 + (1 - 0.2e0 * exp(-0.5e0 * abs(c25 - zv) / greatest(zv, 1))) * zv, 7) AS clip_adaptive,
  round(exp(0.1e0 * ln(greatest(loc, 1)) + 0.9e0 * ln(greatest(zv, 1))), 7) AS log,
  round(0.15e0 * least(greatest(loc, p25), p75) + 0.85e0 * zv, 7) AS winsor, round(0.2e0 * loc + 0.2e0 * gr + 0.6e0 * zv, 7) AS hybrid, round(0.5e0 * loc + 0.5e0 * (SELECT sum(w * loc) / sum(w) FROM v), 7) AS national FROM j""")
def zone_mixes(t):
    v = sites(t).select("id", F.col("c_nationkey").alias("zone_id"), (20 + 400 * F.col("x_bws")).alias("loc"), (1 + F.col("level")).alias("w"),
                        (30 + 100 * F.col("x_sv")).alias("gr"))
    z = v.groupBy("zone_id").agg((F.sum(F.col("w") * F.col("loc")) / F.sum("w")).alias("zv")).join(
        ranking.quantiles(v, "loc", [0.25, 0.75], ["zone_id"]), "zone_id")
    nation = v.agg((F.sum(F.col("w") * F.col("loc")) / F.sum("w")).alias("nat"))
    j = v.join(z, "zone_id").crossJoin(F.broadcast(nation))
    return j.select("id", r(C.mix_national("loc", "nat"), 7).alias("national"), *[r(f("loc", "zv"), 7).alias(n) for n, f in C.STRATEGIES.items()],
                    r(C.mix_winsor("loc", "zv", "p25", "p75"), 7).alias("winsor"), r(C.mix_hybrid("loc", "gr", "zv"), 7).alias("hybrid"))


@query("limited_corrections", "P41", f"""
WITH {SITES}, v AS (SELECT id, 200 * x_bws AS b, (x_sv - 0.5e0) * 900 AS c FROM sites), s AS (SELECT *, greatest(abs(b), 5) AS sc FROM v)
SELECT id, round(greatest(b + least(greatest(c, -2 * sc), 2 * sc), 0), 5) AS sym, round(greatest(b + least(greatest(c, -0.5e0 * sc), 2 * sc), 0), 5) AS asym,
  round(greatest(b + least(greatest(CASE WHEN b > 100 AND c < 0 THEN c * 0.5e0 ELSE c END, -2 * sc), 2 * sc), 0), 5) AS halved FROM s""")
def limited_corrections(t):
    v = sites(t).select("id", (200 * F.col("x_bws")).alias("b"), ((F.col("x_sv") - 0.5) * 900).alias("c"))
    return v.select("id", r(C.limit_correction("b", "c"), 5).alias("sym"), r(C.limit_correction("b", "c", 0.5, 2.0), 5).alias("asym"),
                    r(C.limit_correction("b", "c", halve_above=100), 5).alias("halved"))


_LV = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'crise' WHEN '2' THEN 'alerte_renforcee' WHEN '3' THEN 'alerte' WHEN '4' THEN 'vigilance' ELSE 'unknown' END"
_RK = "CASE {0} WHEN 'vigilance' THEN 1 WHEN 'alerte' THEN 2 WHEN 'alerte_renforcee' THEN 3 WHEN 'crise' THEN 4 END"


def restriction_orders(t):
    """Orders as restriction orders: level cell scalar or JSON list, zone ids, comma-separated communes, a validity interval."""
    k = F.col("o_orderkey")
    lv = S.lookup(F.substr("o_orderpriority", F.lit(1), F.lit(1)), {"1": "crise", "2": "alerte_renforcee", "3": "alerte", "4": "vigilance"}, "unknown")
    start = F.col("o_orderdate").cast("date")
    return t.orders.select(
        k.alias("order_id"), X.zero_pad(F.col("o_custkey") % 96).alias("dept"), start.alias("start"),
        F.date_add(start, (k % 90).cast("int")).alias("end"),
        F.when(k % 3 == 0, F.concat(F.lit('["'), lv, F.lit('", "vigilance", "bad"]'))).when(k % 3 == 1, lv).otherwise(F.lit("[broken")).alias("levels"),
        F.array(k * 2, k * 2 + 1).alias("zones"),
        F.when(k % 4 != 0, F.concat_ws(",", F.lit("a"), F.lit(" "), F.lit("b"), F.when(k % 2 == 0, F.lit("")), lv)).alias("communes"))


@query("order_levels", "P42 P43", f"""
WITH v AS (SELECT o_orderkey, {_LV} AS lv FROM orders)
SELECT o_orderkey AS order_id, CASE o_orderkey % 3 WHEN 0 THEN greatest(coalesce({_RK.format('lv')}, 1), 1) WHEN 1 THEN coalesce({_RK.format('lv')}, 0) ELSE 0 END AS severity,
  CASE o_orderkey % 3 WHEN 0 THEN 1 + (lv <> 'unknown')::INT WHEN 1 THEN (lv <> 'unknown')::INT ELSE 0 END AS n_levels,
  CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 3 END AS n_communes FROM v""")
def order_levels(t):
    return restriction_orders(t).select("order_id", X.severity_max("levels").alias("severity"), F.size(X.known_levels("levels")).alias("n_levels"),
                                        X.item_count("communes").alias("n_communes"))


@query("zone_rows", "P44 F4 A3", f"""
WITH v AS (SELECT o_orderkey, o_custkey, {_LV} AS lv FROM orders),
 z AS (SELECT o_orderkey, o_custkey % 500 * 2 + i AS zone_id, CASE i WHEN 0 THEN lv WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'vigilance' END END AS level FROM v, (VALUES (0), (1)) t(i)),
 k AS (SELECT zone_id, level, {_RK.format('level')} AS rk, o_orderkey FROM z WHERE {_RK.format('level')} IS NOT NULL)
SELECT zone_id, level, rk, o_orderkey AS order_id FROM (SELECT *, row_number() OVER (PARTITION BY zone_id ORDER BY rk DESC, o_orderkey) AS rn FROM k) WHERE rn = 1""")
def zone_rows(t):
    k = F.col("o_orderkey")
    lv = S.lookup(F.substr("o_orderpriority", F.lit(1), F.lit(1)), {"1": "crise", "2": "alerte_renforcee", "3": "alerte", "4": "vigilance"}, "unknown")
    base = F.col("o_custkey") % 500 * 2
    v = t.orders.select(k.alias("order_id"), F.array(base, base + 1).alias("ids"), F.when(k % 2 == 0, F.array(lv, F.lit("vigilance"))).otherwise(F.array(lv)).alias("lvs"))
    z = v.select("order_id", F.inline_outer(X.zip_lists(zone_id="ids", level="lvs")))
    z = z.withColumn("rk", S.lookup("level", X.LEVELS, 0)).where(F.col("rk") > 0)
    best = F.max_by(F.struct("level", "rk", "order_id"), F.struct("rk", -F.col("order_id")))
    return z.groupBy("zone_id").agg(best.alias("b")).select("zone_id", "b.level", "b.rk", "b.order_id")


@query("site_quadrants", "P46 P47", f"""
WITH {SITES}, m AS (SELECT quantile_cont(lat, 0.5) AS mlat, quantile_cont(lon, 0.5) AS mlon FROM sites), v AS (SELECT *, {c01('-spei3', '3e0')} AS d FROM sites)
SELECT id, (CASE WHEN lat >= mlat THEN 'N' ELSE 'S' END) || (CASE WHEN lon >= mlon THEN 'E' ELSE 'W' END) AS quadrant,
  round(0.5e0 * d + 0.5e0 * x_aridity, 6) AS mix_50, round(0.7e0 * d + 0.3e0 * x_aridity, 6) AS mix_70, round(d * (1 - x_bws), 6) AS d_damped,
  round((0.5e0 * d + 0.5e0 * x_aridity) * (1 + x_bws), 6) AS mix_amplified FROM v, m""")
def site_quadrants(t):
    v = sites(t).withColumn("d", S.linear_stress("spei3"))
    m = ranking.quantiles(v, "lat", [0.5], prefix="lat").crossJoin(F.broadcast(ranking.quantiles(v, "lon", [0.5], prefix="lon")))
    x = C.interaction_features("d", "x_aridity", "x_bws")
    return v.crossJoin(F.broadcast(m)).select(
        "id", F.concat(F.when(F.col("lat") >= F.col("lat50"), "N").otherwise("S"), F.when(F.col("lon") >= F.col("lon50"), "E").otherwise("W")).alias("quadrant"),
        *[r(x[k]).alias(k) for k in ("mix_50", "mix_70", "d_damped", "mix_amplified")])


@query("resolution_fallback", "P50", """
WITH g AS (SELECT c_nationkey AS zone, CASE WHEN c_mktsegment = 'BUILDING' THEN '5km' WHEN c_mktsegment = 'MACHINERY' THEN '15km' ELSE '30km' END AS res, count(*) AS n, avg(c_acctbal) AS v
  FROM customer GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY CASE res WHEN '5km' THEN 1 WHEN '15km' THEN 2 ELSE 3 END) AS rn FROM g WHERE n >= 8)
SELECT zone, res, n, round(v, 4) AS v FROM q WHERE rn = 1""")
def resolution_fallback(t):
    res = F.when(F.col("c_mktsegment") == "BUILDING", "5km").when(F.col("c_mktsegment") == "MACHINERY", "15km").otherwise("30km")
    g = t.customer.groupBy(F.col("c_nationkey").alias("zone"), res.alias("res")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("v"))
    order = S.lookup("res", {"5km": 1, "15km": 2, "30km": 3}, 9)
    return g.where(F.col("n") >= 8).groupBy("zone").agg(F.min_by(F.struct("res", "n", "v"), order).alias("b")).select("zone", "b.res", "b.n", r("b.v", 4).alias("v"))
