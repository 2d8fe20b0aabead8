"""Energy and network operators: hourly production by event type, plants from parts, a line network between customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from territoria.functions.scalars import clip
from territoria.operators import energy as en
from territoria.operators import graph as gh
from territoria.operators import joins, stats
from territoria.plans.catalog.network_sql import LINES_SQL as _LINES
from territoria.plans.inputs import FACTORS, FACTORS_SQL, PRODUCTION, STATIONS, factors, lat_of, lat_sql, lon_of, lon_sql, production, site_points, stations
from territoria.plans.registry import query


def r(c, d=6):
    return F.round(c, d)


CARRIERS = ("click", "view", "purchase", "signup", "error")


def plants(t):
    """Parts as plants: carrier by size, capacity by price, zone by brand."""
    table = F.array(*[F.lit(c) for c in CARRIERS])
    return t.part.select(F.col("p_partkey").alias("gen"), F.element_at(table, F.col("p_size") % 5 + 1).alias("carrier"), (F.col("p_retailprice") / 10).alias("cap"), F.col("p_brand").alias("zone"))


_PLANTS = "pl AS (SELECT p_partkey AS gen, ['click', 'view', 'purchase', 'signup', 'error'][p_size % 5 + 1] AS carrier, p_retailprice / 10 AS cap, p_brand AS zone FROM part)"


@query("hourly_emission_mix", "A23 J3", f"""
WITH {PRODUCTION}, {FACTORS_SQL} SELECT ts, round(sum(mw), 4) AS total_mw, round(sum(ef * mw) / sum(mw), 5) AS intensity FROM prod LEFT JOIN ef ON prod.carrier = ef.carrier GROUP BY 1""")
def hourly_emission_mix(t):
    m = en.emission_mix(production(t), factors(t).where(F.lit(True)), ["ts"])
    return m.select("ts", r("total_mw", 4).alias("total_mw"), r("intensity", 5).alias("intensity"))


@query("user_emission_mix", "A23", f"""
WITH {FACTORS_SQL}, v AS (SELECT user_id, event_type, CASE WHEN event_id % 17 <> 0 THEN value END AS mw FROM events), e AS (SELECT * FROM ef WHERE carrier <> 'error')
SELECT user_id, round(sum(mw), 4) AS total_mw, round(sum(CASE WHEN mw IS NOT NULL THEN coalesce(ef, 300e0) * mw END) / sum(mw), 5) AS intensity FROM v LEFT JOIN e ON event_type = carrier GROUP BY 1""")
def user_emission_mix(t):
    v = t.events.select("user_id", F.col("event_type").alias("carrier"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("mw"))
    m = en.emission_mix(v, factors(t).where(F.col("carrier") != "error"), ["user_id"])
    return m.select("user_id", r("total_mw", 4).alias("total_mw"), r("intensity", 5).alias("intensity"))


@query("national_weighted_intensity", "A22", f"""
WITH {PRODUCTION}, {FACTORS_SQL} SELECT date_trunc('day', ts)::DATE AS day, round(sum(n * ef) / sum(n), 6) AS load_weighted, round(sum(CASE WHEN mw IS NOT NULL THEN mw * ef END) / sum(mw), 6) AS generation_weighted FROM prod JOIN ef ON prod.carrier = ef.carrier GROUP BY 1""")
def national_weighted_intensity(t):
    p = production(t).join(factors(t), "carrier")
    return p.groupBy(F.col("ts").cast("date").alias("day")).agg(r(stats.weighted_mean("ef", "n")).alias("load_weighted"), r(stats.weighted_mean("ef", "mw")).alias("generation_weighted"))


@query("plant_dispatch", "A24 A27", f"""
WITH {PRODUCTION}, {_PLANTS}, sh AS (SELECT gen, zone, pl.carrier, cap / t AS share FROM pl JOIN (SELECT carrier, sum(cap) AS t FROM pl GROUP BY 1) q ON q.carrier = pl.carrier)
SELECT zone, prod.carrier, count(*) AS n, round(sum(mw * share), 5) AS mw FROM prod JOIN sh ON prod.carrier = sh.carrier GROUP BY 1, 2""")
def plant_dispatch(t):
    d = en.disaggregate(production(t), plants(t))
    return d.groupBy("zone", "carrier").agg(F.count(F.lit(1)).alias("n"), r(F.sum("mw"), 5).alias("mw"))


@query("dispatch_conservation", "A24 A27", f"""
WITH {PRODUCTION} SELECT carrier, round(sum(mw), 4) AS before, round(sum(mw), 4) AS after, 100e0 AS kept_pct FROM prod GROUP BY 1""")
def dispatch_conservation(t):
    p = production(t)
    c = en.conservation(p, en.disaggregate(p, plants(t)), ["carrier"])
    return c.select("carrier", r("before", 4).alias("before"), r("after", 4).alias("after"), r("kept_pct").alias("kept_pct"))


@query("storage_split", "A25 P48", f"""
WITH {PRODUCTION}, v AS (SELECT date_trunc('day', ts)::DATE AS day, coalesce(mw, 0) - 150 AS s FROM prod WHERE carrier = 'signup')
SELECT day, round(sum(greatest(s, 0)), 4) AS generation, round(sum(greatest(-s, 0)), 4) AS pumping, round(sum(s), 4) AS net FROM v GROUP BY 1""")
def storage_split(t):
    v = production(t).where(F.col("carrier") == "signup").select(F.col("ts").cast("date").alias("day"), (F.coalesce("mw", F.lit(0.0)) - 150).alias("s"))
    gen, pump = en.signed_split("s")
    return v.groupBy("day").agg(r(F.sum(gen), 4).alias("generation"), r(F.sum(pump), 4).alias("pumping"), r(F.sum("s"), 4).alias("net"))


_CITY = " + ".join(f"{p} / pow(greatest(111 * sqrt(pow(lat - {a}e0, 2) + pow(lon - {b}e0, 2)), 5), 2)" for a, b, p in en.CITIES)


@query("population_weights", "A26", f"WITH {STATIONS}, w AS (SELECT sid, {_CITY} AS w FROM stations) SELECT sid, round(w / sum(w) OVER (), 9) AS weight FROM w")
def population_weights(t):
    return en.load_weights(stations(t)).withColumn("weight", r("weight", 9))


@query("zone_weighted_mean", "A22 A46", f"""
WITH {_PLANTS} SELECT zone, count(*) AS n, round(sum(cap) / 1000, 6) AS capacity, round(sum((cap + 1) * (gen % 97)) / sum(cap + 1), 6) AS zone_value FROM pl GROUP BY 1""")
def zone_weighted_mean(t):
    p = plants(t).withColumn("v", (F.col("gen") % 97).cast("double"))
    return en.category_capacity(p, "zone", "cap").join(en.zone_mean(p, "zone", "v", "cap"), "zone").select("zone", "n", r("capacity").alias("capacity"), r("zone_value").alias("zone_value"))


@query("energy_shares", "A47", f"""
WITH {PRODUCTION}, s AS (SELECT carrier, sum(mw) / 1e6 AS e FROM prod GROUP BY 1) SELECT carrier, round(e, 9) AS energy, round(100 * e / sum(e) OVER (), 6) AS share_pct FROM s""")
def energy_shares(t):
    return en.mix_shares(production(t), []).select("carrier", r("energy", 9).alias("energy"), r("share_pct").alias("share_pct"))


def user_output(t):
    return t.events.groupBy(F.date_trunc("day", "ts").cast("date").alias("ts"), F.col("user_id").alias("gen")).agg(F.sum("value").alias("mw"))


@query("zone_pooling", "M28 A27", """
WITH f AS (SELECT date_trunc('day', ts)::DATE AS ts, user_id AS gen, sum(value) AS mw FROM events GROUP BY 1, 2), c AS (SELECT DISTINCT user_id AS gen, user_id % 7 AS zone, (user_id % 11 + 1)::DOUBLE AS cap FROM events),
 s AS (SELECT gen, zone, cap / sum(cap) OVER (PARTITION BY zone) AS s FROM c), z AS (SELECT f.*, zone, s, sum(mw) OVER (PARTITION BY ts, zone) AS zt FROM f JOIN s ON f.gen = s.gen)
SELECT gen, ts, zone, round(mw, 5) AS mw, round(0.3e0 * mw + 0.7e0 * s * zt, 5) AS pooled FROM z""")
def zone_pooling(t):
    cap = t.events.select(F.col("user_id").alias("gen")).distinct().select("gen", (F.col("gen") % 7).alias("zone"), (F.col("gen") % 11 + 1).cast("double").alias("cap"))
    p = en.pool_within(user_output(t), cap, 0.3)
    return p.select("gen", "ts", "zone", r("mw", 5).alias("mw"), r("pooled", 5).alias("pooled"))


# --- line network ----------------------------------------------------------------------------

def lines(t):
    """Every order is a line of its customer: to one of the next three keys or, for one in seven, up a tree of keys.

    Customers with a key of 24 modulo 25 are joined in pairs, a tail of small components beside the giant one. Lines to
    a customer that does not exist have no end and go.
    """
    k, a = F.col("o_orderkey"), F.col("o_custkey")
    pair = F.when(F.floor(a / 25) % 2 == 0, a + 25).otherwise(a - 25)
    other = F.when((k % 7 == 0) & (a >= 8), F.floor(a / 8)).otherwise(a + 1 + k % 3)
    end = F.when(a % 25 == 24, pair).otherwise(other + F.when(other % 25 == 24, 1).otherwise(0))
    raw = t.orders.select(a.alias("src"), end.alias("dst"), (0.2 + (k % 50) / 25.0).alias("x"), (F.col("o_totalprice") / 100000).alias("s"),
                          F.when((k % 2 == 0) == (a < end), 1.0).otherwise(-1.0).alias("sign"), F.when(k % 5 == 0, 400).otherwise(225).alias("v"))
    raw = raw.join(t.customer.select(F.col("c_custkey").alias("dst")), "dst", "left_semi")
    e = gh.simple_edges(raw, [F.min("x").alias("impedance"), F.sum("s").alias("s_nom"), F.sum(F.col("s") * F.col("sign")).alias("flow"), F.max("v").alias("voltage")])
    return e.withColumn("admittance", 1 / F.col("impedance"))


def node_values(t):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("id"), F.when(k % 19 == 0, F.lit(0.0)).otherwise((20 + k * 31 % 380).cast("double")).alias("value"))


def nodes(t):
    return t.customer.select(F.col("c_custkey").alias("id"))


@query("network_components", "G1", f"""
WITH RECURSIVE {_LINES}, rc(s, v) AS (SELECT id, id FROM nv UNION SELECT rc.s, e.dst FROM rc JOIN e ON rc.v = e.src), l AS (SELECT v AS id, min(s) AS component FROM rc GROUP BY 1)
SELECT l.id, component, count(*) OVER (PARTITION BY component) AS n_nodes, NOT EXISTS (SELECT 1 FROM e WHERE e.src = l.id) AS is_isolated FROM l""")
def network_components(t):
    e = lines(t)
    lab = gh.components(nodes(t), e)
    iso = gh.isolated(nodes(t), e).withColumn("_i", F.lit(True))
    return lab.join(gh.component_sizes(lab), "component").join(iso, "id", "left").select("id", "component", "n_nodes", F.coalesce("_i", F.lit(False)).alias("is_isolated"))


@query("component_bridges", "G9 G1", f"""
WITH RECURSIVE {_LINES}, rc(s, v) AS (SELECT id, id FROM nv UNION SELECT rc.s, e.dst FROM rc JOIN e ON rc.v = e.src), l AS (SELECT v AS id, min(s) AS c FROM rc GROUP BY 1),
 mc AS (SELECT c FROM l GROUP BY 1 ORDER BY count(*) DESC, c LIMIT 1), p AS (SELECT id, c, {lon_sql('id')} * 111e0 * cos(radians({lat_sql('id')})) AS x, {lat_sql('id')} * 111e0 AS y FROM l),
 b AS (SELECT a.c, a.id, m.id AS o, sqrt(pow(a.x - m.x, 2) + pow(a.y - m.y, 2)) AS d FROM p a, p m WHERE a.c <> (SELECT c FROM mc) AND m.c = (SELECT c FROM mc)),
 k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d, id, o) AS rn FROM b WHERE d < 150)
SELECT c AS component, id AS src, o AS dst, round(d, 6) AS length, round(greatest(d * 0.001e0, 0.001e0), 6) AS impedance FROM k WHERE rn = 1""")
def component_bridges(t):
    b = gh.bridge_components(site_points(t), lines(t), max_km=150.0)
    return b.select("component", "src", "dst", r("length").alias("length"), r("impedance").alias("impedance"))


@query("node_degrees", "G2 A44", f"""
WITH {_LINES} SELECT src AS id, count(*) AS degree, round(sum(admittance), 8) AS weighted_degree, round(sum(s_nom), 8) AS total_rating, round(avg(admittance), 8) AS mean_weight, max(voltage) AS max_voltage FROM e GROUP BY 1""")
def node_degrees(t):
    d = gh.degree_features(lines(t), voltage="voltage")
    return d.select("id", "degree", r("weighted_degree", 8).alias("weighted_degree"), r("total_rating", 8).alias("total_rating"), r("mean_weight", 8).alias("mean_weight"), "max_voltage")


def _pagerank_sql(iters: int) -> str:
    steps = "r0 AS MATERIALIZED (SELECT id, 1e0 / (SELECT count(*) FROM nv) AS r FROM nv)"
    for i in range(1, iters + 1):
        steps += f""", r{i} AS MATERIALIZED (SELECT nv.id, 0.15e0 / (SELECT count(*) FROM nv) + 0.85e0 * (coalesce(i, 0) + (SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM nv)) AS r
          FROM nv LEFT JOIN (SELECT p.dst, sum(p.p * q.r) AS i FROM pr p JOIN r{i - 1} q ON p.src = q.id GROUP BY 1) z ON z.dst = nv.id)"""
    return f"WITH {_LINES}, pr AS MATERIALIZED (SELECT src, dst, admittance / sum(admittance) OVER (PARTITION BY src) AS p FROM e), {steps} SELECT id, round(r * 1000, 7) AS pagerank FROM r{iters}"


@query("node_pagerank", "G3", _pagerank_sql(20))
def node_pagerank(t):
    return gh.pagerank(nodes(t), lines(t), iters=20).select("id", r(F.col("pagerank") * 1000, 7).alias("pagerank"))


@query("node_clustering", "G4", f"""
WITH {_LINES}, d AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY 1), tr AS (SELECT a.src AS id, count(*) / 2 AS n FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src GROUP BY 1)
SELECT d.id, degree, coalesce(n, 0)::BIGINT AS triangles, round(CASE WHEN degree > 1 THEN 2e0 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END, 7) AS clustering FROM d LEFT JOIN tr ON d.id = tr.id""")
def node_clustering(t):
    return gh.clustering(lines(t)).withColumn("clustering", r("clustering", 7))


_RINGS = """h1 AS (SELECT DISTINCT src AS id, dst AS o FROM e), h2 AS (SELECT DISTINCT h1.id, e.dst AS o FROM h1 JOIN e ON h1.o = e.src WHERE e.dst <> h1.id AND (h1.id, e.dst) NOT IN (SELECT (id, o) FROM h1)),
 h3 AS (SELECT DISTINCT h2.id, e.dst AS o FROM h2 JOIN e ON h2.o = e.src WHERE e.dst <> h2.id AND (h2.id, e.dst) NOT IN (SELECT (id, o) FROM h1) AND (h2.id, e.dst) NOT IN (SELECT (id, o) FROM h2)),
 rg AS (SELECT id, o, 1 AS hop FROM h1 UNION ALL SELECT id, o, 2 FROM h2 UNION ALL SELECT id, o, 3 FROM h3)"""


@query("hop_statistics", "G5", f"""
WITH {_LINES}, {_RINGS} SELECT rg.id, hop, round(sum(coalesce(admittance, 1) * value) / sum(coalesce(admittance, 1)), 6) AS wmean, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n, max(value) - min(value) AS spread
FROM rg JOIN nv ON nv.id = rg.o AND value <> 0 LEFT JOIN e ON hop = 1 AND e.src = rg.id AND e.dst = rg.o GROUP BY 1, 2""")
def hop_statistics(t):
    h = gh.hop_stats(lines(t), node_values(t), "admittance")
    return h.select("id", "hop", r("wmean").alias("wmean"), r("mean").alias("mean"), r("std").alias("std"), "n", "spread")


@query("hop_gradients", "G5", f"""
WITH {_LINES}, {_RINGS}, s AS (SELECT rg.id, hop, sum(coalesce(admittance, 1) * value) / sum(coalesce(admittance, 1)) AS w, avg(value) AS m FROM rg JOIN nv ON nv.id = rg.o AND value <> 0 LEFT JOIN e ON hop = 1 AND e.src = rg.id AND e.dst = rg.o GROUP BY 1, 2),
 p AS (SELECT id, max(w) FILTER (hop = 1) AS a, max(m) FILTER (hop = 2) AS b, max(m) FILTER (hop = 3) AS c FROM s GROUP BY 1)
SELECT nv.id, value, round(value - a, 6) AS gradient1, round(value - b, 6) AS gradient2, round(value - c, 6) AS gradient3, round(value / 62.4e0, 6) AS national_ratio FROM nv LEFT JOIN p ON nv.id = p.id""")
def hop_gradients(t):
    v = node_values(t)
    g = gh.hop_gradients(gh.hop_stats(lines(t), v, "admittance"), v, 62.4)
    return g.select("id", "value", *[r(c).alias(c) for c in ("gradient1", "gradient2", "gradient3", "national_ratio")])


def _relax_sql(cutoff: float, rounds: int) -> str:
    steps = "d0 AS MATERIALIZED (SELECT id AS s, id AS v, 0e0 AS d FROM nv WHERE id IN (SELECT src FROM e))"
    for i in range(1, rounds + 1):
        steps += f", d{i} AS MATERIALIZED (SELECT s, v, min(d) AS d FROM (SELECT * FROM d{i - 1} UNION ALL SELECT s, e.dst, d + impedance FROM d{i - 1} JOIN e ON e.src = v WHERE d + impedance <= {cutoff}e0) GROUP BY 1, 2)"
    return f"{_LINES}, {steps}, ds AS (SELECT s AS source, v AS id, d AS dist FROM d{rounds})"


@query("impedance_reach", "G6", f"""
WITH {_relax_sql(2.0, 10)}, k AS (SELECT source, id, dist, row_number() OVER (PARTITION BY source ORDER BY dist, id) AS rank FROM ds WHERE source <> id),
 c AS (SELECT source, count(*) FILTER (dist < 0.5) AS within_05, count(*) FILTER (dist < 1) AS within_1, count(*) FILTER (dist < 2) AS within_2 FROM ds WHERE source <> id GROUP BY 1)
SELECT k.source, k.id, rank, round(dist, 6) AS dist, within_05, within_1, within_2 FROM k JOIN c ON k.source = c.source WHERE rank <= 5""")
def impedance_reach(t):
    d = gh.bounded_distances(lines(t), "impedance", 2.0)
    c = gh.reach_counts(d, (0.5, 1.0, 2.0)).withColumnRenamed("within_0.5", "within_05")
    return gh.nearest_by_distance(d, 5).join(c, "source").select("source", "id", "rank", r("dist").alias("dist"), "within_05", "within_1", "within_2")


@query("impedance_diffusion", "G7", f"""
WITH {_relax_sql(2.0, 10)}, a AS (SELECT source, sum(value / (dist + 0.01e0)) / sum(1 / (dist + 0.01e0)) AS diffused, count(*) AS n_reached FROM ds JOIN nv ON ds.id = nv.id WHERE source <> ds.id AND value <> 0 GROUP BY 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dist, id) AS rn FROM ds), iw AS (SELECT src AS id, sum(admittance) AS inf FROM e GROUP BY 1),
 b AS (SELECT source, sum(inf * value / pow(dist + 0.5e0, 2)) / sum(inf / pow(dist + 0.5e0, 2)) AS influence_mean FROM k JOIN nv ON k.id = nv.id JOIN iw ON iw.id = k.id WHERE rn <= 30 AND value <> 0 GROUP BY 1)
SELECT a.source, round(diffused, 6) AS diffused, n_reached, round(influence_mean, 6) AS influence_mean FROM a JOIN b ON a.source = b.source""")
def impedance_diffusion(t):
    e, v = lines(t), node_values(t)
    d = gh.bounded_distances(e, "impedance", 2.0)
    inf = gh.degree_features(e).select("id", F.col("weighted_degree").alias("inf"))
    a = gh.diffuse(d, v)
    b = gh.diffuse(d, v.join(inf, "id"), eps=0.5, power=2.0, influence="inf", k=30).select("source", F.col("diffused").alias("influence_mean"))
    return a.join(b, "source").select("source", r("diffused").alias("diffused"), "n_reached", r("influence_mean").alias("influence_mean"))


@query("graph_filter", "G8", f"""
WITH {_LINES}, p AS (SELECT src, dst, admittance / sum(admittance) OVER (PARTITION BY src) AS p FROM e), g1 AS (SELECT nv.id, coalesce(sum(p * b.value), 0) AS g FROM nv LEFT JOIN p ON nv.id = p.src LEFT JOIN nv b ON b.id = p.dst GROUP BY 1),
 g2 AS (SELECT g1.id, coalesce(sum(p * b.g), 0) AS g FROM g1 LEFT JOIN p ON g1.id = p.src LEFT JOIN g1 b ON b.id = p.dst GROUP BY 1), g3 AS (SELECT g2.id, coalesce(sum(p * b.g), 0) AS g FROM g2 LEFT JOIN p ON g2.id = p.src LEFT JOIN g2 b ON b.id = p.dst GROUP BY 1)
SELECT nv.id, round(g1.g, 6) AS g1, round(g2.g, 6) AS g2, round(g3.g, 6) AS g3, round(0.6e0 * value + 0.25e0 * g1.g + 0.1e0 * g2.g + 0.05e0 * g3.g, 6) AS g_mix, round(g1.g - g2.g, 6) AS delta_12, round(g2.g - g3.g, 6) AS delta_23
FROM nv JOIN g1 ON nv.id = g1.id JOIN g2 ON nv.id = g2.id JOIN g3 ON nv.id = g3.id""")
def graph_filter(t):
    g = gh.graph_filter(lines(t), node_values(t), "admittance")
    return g.select("id", *[r(c).alias(c) for c in ("g1", "g2", "g3", "g_mix", "delta_12", "delta_23")])


def node_production(t):
    return t.customer.select(F.col("c_custkey").alias("id"), clip(F.col("c_acctbal") / 1000, 0.0).alias("prod"))


@query("inflow_mix", "G10", f"""
WITH {_LINES}, f AS (SELECT CASE WHEN flow > 0 THEN src ELSE dst END AS frm, CASE WHEN flow > 0 THEN dst ELSE src END AS tt, abs(flow) AS mw FROM ln WHERE flow <> 0),
 i AS (SELECT tt AS id, sum(mw) AS inn, sum(mw * value) AS inv FROM f JOIN nv ON frm = nv.id GROUP BY 1), p AS (SELECT c_custkey AS id, greatest(c_acctbal / 1000, 0) AS prod FROM customer)
SELECT nv.id, value, round(CASE WHEN prod + coalesce(inn, 0) < 0.1 THEN value ELSE (prod * value + coalesce(inv, 0)) / (prod + coalesce(inn, 0)) END, 6) AS mixed FROM nv JOIN p ON p.id = nv.id LEFT JOIN i ON i.id = nv.id""")
def inflow_mix(t):
    return gh.inflow_mix(lines(t), node_production(t), node_values(t)).withColumn("mixed", r("mixed"))


@query("traced_mix", "G11")
def traced_mix(t):
    p = node_production(t).join(node_values(t), "id").select("id", "prod", (F.col("prod") * F.col("value")).alias("co2"))
    m = gh.trace_mix(lines(t), p, tol=1e-5)
    return m.select("id", r("throughput", 5).alias("throughput"), r("mix", 3).alias("mix"))


@query("sampled_centrality", "G12")
def sampled_centrality(t):
    from territoria.operators.sampling import stable_sample

    e = lines(t)
    s = stable_sample(nodes(t), "id", 200, 42)
    c = gh.sampled_closeness(e, "impedance", s, 5.0)
    every = nodes(t).join(c, "id", "left").join(gh.sampled_betweenness(e, s), "id", "left")
    return every.select("id", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), r("closeness").alias("closeness"), r(F.coalesce("betweenness", F.lit(0.0))).alias("betweenness"))


@query("angle_differences", "J23", f"""
WITH {_LINES} SELECT ln.src, ln.dst, a.value - b.value AS difference, round({lon_sql('ln.src')}, 4) AS lon0, round({lat_sql('ln.dst')}, 4) AS lat1 FROM ln JOIN nv a ON a.id = ln.src JOIN nv b ON b.id = ln.dst""")
def angle_differences(t):
    v = node_values(t).withColumn("lon", lon_of("id")).withColumn("lat", lat_of("id"))
    j = lines(t).select("src", "dst").join(v.select(F.col("id").alias("src"), F.col("value").alias("v0"), F.col("lon").alias("lon0")), "src").join(
        v.select(F.col("id").alias("dst"), F.col("value").alias("v1"), F.col("lat").alias("lat1")), "dst")
    return j.select("src", "dst", (F.col("v0") - F.col("v1")).alias("difference"), r("lon0", 4).alias("lon0"), r("lat1", 4).alias("lat1"))


@query("line_loading", "A44", """
WITH f AS (SELECT o_custkey % 300 AS line, o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS flow, 300000e0 AS s_nom FROM orders)
SELECT line, round(max(abs(flow) / s_nom), 6) AS peak, round(avg(abs(flow) / s_nom), 6) AS mean_use, count(*) FILTER (abs(flow) / s_nom > 1) AS n_over, count(*) FILTER (abs(flow) > 1e-6) AS n_active FROM f GROUP BY 1""")
def line_loading(t):
    k = F.col("o_orderkey")
    f = t.orders.select((F.col("o_custkey") % 300).alias("line"), (F.col("o_totalprice") * F.when(k % 2 == 0, 1).otherwise(-1)).alias("flow"), F.lit(300000.0).alias("s_nom"))
    d = en.line_loading(f)
    return d.select("line", r("peak").alias("peak"), r("mean_use").alias("mean_use"), "n_over", "n_active")


_USES = (0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


@query("line_use_distribution", "A44", f"""
WITH f AS (SELECT o_custkey % 300 AS line, max(o_totalprice / 300000e0) AS peak FROM orders GROUP BY 1)
SELECT count(*) AS n_lines, {', '.join(f"round(quantile_cont(peak, {p}), 6) AS p{format(100 * p, 'g')}" for p in _USES)}, round(avg((peak > 1.0)::INT), 6) AS share_over, count(*) FILTER (peak > 1.0) AS n_over, count(*) FILTER (peak > 0.8) AS n_high FROM f""")
def line_use_distribution(t):
    """Quantiles of the lines' largest use, and how many go beyond 1.0 and 0.8 of their rating."""
    f = t.orders.select((F.col("o_custkey") % 300).alias("line"), F.col("o_totalprice").alias("flow"), F.lit(300000.0).alias("s_nom"))
    d = en.use_distribution(en.line_loading(f), _USES)
    return d.select("n_lines", *[r(c).alias(c) for c in d.columns if c.startswith("p")], r("share_over").alias("share_over"), "n_over", "n_high")


@query("pure_node_counts", "A45", f"""
WITH {_LINES} SELECT count(value) AS n, {', '.join(f"count(*) FILTER (abs(value - {v}) < 5) AS near_{k}" for k, v in FACTORS.items())}, count(*) FILTER ({' OR '.join(f'abs(value - {v}) < 5' for v in FACTORS.values())}) AS n_pure,
 count(*) FILTER ({' AND '.join(f'abs(value - {v}) > 20' for v in FACTORS.values())}) AS n_mixed FROM nv""")
def pure_node_counts(t):
    return stats.pure_counts(node_values(t), "value", FACTORS, 5, 20)
