"""Resampling, sensitivity and model queries over the customer sites and supplier stations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from territoria.functions import combine as C
from territoria.operators import inference as inf
from territoria.operators import interpolate as ip
from territoria.operators import learning as ml
from territoria.operators.ranking import quantiles
from territoria.operators.sampling import stratified_split
from territoria.operators.spatial import knn_join
from territoria.plans.catalog.climate import rank_sql
from territoria.plans.catalog.network import lines, node_values
from territoria.plans.catalog.scoring import _live_sql, _wmean_sql, SITE_INDEX, site_index_frame
from territoria.plans.catalog.spatial import _D, _READ, readings
from territoria.plans.inputs import SITES, sites
from territoria.plans.registry import query


def r(c, d=6):
    return F.round(c, d)


def _word(text: str, half: str = "0") -> str:
    return f"('0x' || substr(md5({text}), 1 + 16 * ({half}), 15))::BIGINT"


def _uniform(text: str, half: int = 0) -> str:
    return f"(({_word(text, str(half))} + 0.5e0) / {2**60}e0)"


_DRAWN = _word("'42:' || rep || ':' || j // 2", "j % 2")
_OK = "ok AS (SELECT row_number() OVER (ORDER BY id) - 1 AS j, round(h2, 12) AS h2, round(h3, 12) AS h3, level FROM idx WHERE h2 IS NOT NULL AND h3 IS NOT NULL)"
_BOOT = f"""{SITE_INDEX}, {_OK}, p AS (SELECT rep, {_DRAWN} % (SELECT count(*) FROM ok) AS i FROM ok, range(5000) r(rep)),
 w AS (SELECT rep, i, count(*) AS w FROM p GROUP BY ALL), b AS (SELECT rep, w, h2, h3, level, count(*) OVER (PARTITION BY rep) AS apart FROM w JOIN ok ON ok.j = w.i),
 v AS (SELECT rep, w, level, unnest(['h2', 'h3']) AS model, unnest([h2, h3]) AS value FROM b WHERE apart >= 5),
 x AS (SELECT rep, model, value, sum(sum(w)) OVER (PARTITION BY rep, model ORDER BY value) - sum(w) / 2e0 AS a FROM v GROUP BY 1, 2, 3),
 y AS (SELECT rep, model, level, sum(sum(w)) OVER (PARTITION BY rep, model ORDER BY level) - sum(w) / 2e0 AS b FROM v GROUP BY 1, 2, 3),
 m AS (SELECT v.rep, v.model, sum(w) AS n, sum(w * a) AS sa, sum(w * b) AS sb, sum(w * a * b) AS ab, sum(w * a * a) AS aa, sum(w * b * b) AS bb FROM v JOIN x USING (rep, model, value) JOIN y USING (rep, model, level) GROUP BY 1, 2),
 rho AS (SELECT rep, model, (ab - sa * sb / n) / sqrt((aa - sa * sa / n) * (bb - sb * sb / n)) AS rho FROM m)"""
_CUTS = "round(quantile_cont({0}, 0.025), 6) AS low, round(quantile_cont({0}, 0.5), 6) AS median, round(quantile_cont({0}, 0.975), 6) AS high"


def _ranked_models(t):
    return site_index_frame(t).withColumn("h2", F.round("h2", 12)).withColumn("h3", F.round("h3", 12))


@query("bootstrap_interval", "M17", f"WITH {_BOOT} SELECT model, {_CUTS.format('rho')} FROM rho GROUP BY model")
def bootstrap_interval(t):
    b = inf.bootstrap_rho(_ranked_models(t), "id", ["h2", "h3"], "level")
    return inf.interval(b, "rho", ["model"]).select("model", *[r(c).alias(c) for c in ("low", "median", "high")])


@query("paired_bootstrap", "M18", f"""WITH {_BOOT}, d AS (SELECT rep, max(rho) FILTER (model = 'h2') - max(rho) FILTER (model = 'h3') AS delta FROM rho GROUP BY rep)
SELECT {_CUTS.format('delta')} FROM d""")
def paired_bootstrap(t):
    d = inf.paired_bootstrap(_ranked_models(t), "id", "h2", "h3", "level")
    return inf.interval(d, "delta").select(*[r(c).alias(c) for c in ("low", "median", "high")])


@query("permutation_test", "M19", f"""WITH {SITE_INDEX}, ok AS (SELECT row_number() OVER (ORDER BY id) - 1 AS j, {rank_sql('round(h2, 12)')} AS a, {rank_sql('level')} AS b FROM idx WHERE h2 IS NOT NULL),
 p AS (SELECT rep, j, a, row_number() OVER (PARTITION BY rep ORDER BY {_DRAWN}, j) - 1 AS i FROM ok, range(1000) r(rep)), o AS (SELECT corr(a, b) AS observed FROM ok),
 rho AS (SELECT rep, corr(p.a, ok.b) AS rho FROM p JOIN ok ON ok.j = p.i GROUP BY rep)
SELECT round(observed, 6) AS observed, {_CUTS.format('rho')}, round(avg(CASE WHEN round(rho, 12) >= round(observed, 12) THEN 1e0 ELSE 0e0 END), 6) AS p_value, count(*) AS n FROM rho, o GROUP BY observed""")
def permutation_test(t):
    p = inf.permutation_null(_ranked_models(t), "id", "h2", "level")
    return p.select(*[r(c).alias(c) for c in ("observed", "low", "median", "high", "p_value")], "n")


def _normal(name: str) -> str:
    text = f"'42:{name}:' || s"
    return f"sqrt(-2 * ln({_uniform(text)})) * cos(2 * pi() * {_uniform(text, 1)})"


_NOISY = " + ".join(f"{w}e0 * least(greatest({c} + z_{c} * {C.RELATIVE_SIGMA[c]}e0 * greatest({c}, 1e-6), 0e0), 1e0)" for c, w in C.WEIGHTS_INDEX.items())


@query("monte_carlo_index", "M20", f"""WITH {SITES}, s AS (SELECT id, x_bws AS bws, coalesce(x_gws, 0.4e0) AS gws, x_sv AS drought FROM sites),
 d AS (SELECT {', '.join(f'{_normal(c)} AS z_{c}' for c in C.WEIGHTS_INDEX)} FROM range(5000) r(s)), x AS (SELECT id, least(greatest({_NOISY}, 0e0), 1e0) AS w FROM s, d)
SELECT id, round(avg(w), 6) AS mc_mean, round(stddev_pop(w), 6) AS mc_std, round(quantile_cont(w, 0.1), 6) AS mc_p10, round(quantile_cont(w, 0.9), 6) AS mc_p90 FROM x GROUP BY id""")
def monte_carlo_index(t):
    s = sites(t).select("id", F.col("x_bws").alias("bws"), F.coalesce("x_gws", F.lit(0.4)).alias("gws"), F.col("x_sv").alias("drought"))
    m = inf.monte_carlo(s, "id")
    return m.select("id", *[r(c).alias(c) for c in m.columns[1:]])


_ABL = {"no_gws": {"x_bws": 0.5, "x_aridity": 0.36}, "no_aridity": {"x_bws": 0.5, "x_gws": 0.14}, "no_bws": {"x_aridity": 0.36, "x_gws": 0.14}, "with_sv": {"x_bws": 0.5, "x_aridity": 0.36, "x_gws": 0.14, "x_sv": 0.1}}
_ABLW = {"full": C.WEIGHTS_ARITH, **_ABL}


@query("component_ablation", "M21 A35", f"""
WITH {SITES}, l AS (SELECT level, unnest([{', '.join(f"'{n}'" for n in _ABLW)}]) AS scenario, unnest([{', '.join(f'round(CASE WHEN ({_live_sql(w)}) > 0 THEN {_wmean_sql(w)} END, 12)' for w in _ABLW.values())}]) AS v FROM sites),
 k AS (SELECT scenario, v, {rank_sql('v', 'scenario')} AS a, {rank_sql('level', 'scenario')} AS b FROM l WHERE v IS NOT NULL)
SELECT scenario, count(*) AS n, round(corr(a, b), 7) AS rho, round(avg(v), 7) AS mean FROM k GROUP BY 1""")
def component_ablation(t):
    a = inf.ablate(sites(t), {n: F.round(C.wmean(w), 12) for n, w in _ABLW.items()}, "level")
    return a.select("scenario", "n", r("rho", 7).alias("rho"), r("mean", 7).alias("mean"))


_CONF = [("b05", 0.5, 5.0), ("b06", 0.6, 5.0), ("ref", 0.7, 5.0), ("b08", 0.8, 5.0), ("t1", 0.7, 1.0), ("t10", 0.7, 10.0)]


_SWEPT = "coalesce((d3 * exp(tau * d3) + d12 * exp(tau * d12)) / (exp(tau * d3) + exp(tau * d12)), d3, d12)"
_MIX = "coalesce(CASE WHEN {s} IS NOT NULL AND {c} IS NOT NULL THEN least(greatest({b} * (1 - {c}) * {s} + (1 - {b} * (1 - {c})) * {c}, 0e0), 1e0) END, {s}, {c})"


@query("parameter_sweep", "M22 J19", f"""
WITH {SITE_INDEX}, c(config, b0, tau) AS (VALUES {', '.join(f"('{n}', {b}e0, {u}e0)" for n, b, u in _CONF)}), x AS (SELECT id, config, s2, b0, {_SWEPT} AS cj FROM idx, c),
 h AS (SELECT id, config, round({_MIX.format(s='s2', c='cj', b='b0')}, 12) AS h FROM x), j AS (SELECT h.*, f.h AS ref FROM h JOIN h f ON f.id = h.id AND f.config = 'ref'),
 k AS (SELECT *, {rank_sql('h', 'config')} AS a, {rank_sql('ref', 'config')} AS b FROM j)
SELECT config, round(avg(h), 7) AS mean, round(min(h), 7) AS min, round(max(h), 7) AS max, round(avg(h - ref), 7) AS shift, round(corr(a, b), 7) AS rank_rho FROM k GROUP BY 1""")
def parameter_sweep(t):
    """Every site, those with one window through the index's own fallback."""
    base = site_index_frame(t).select("id", "s2", "d3", "d12")

    def index():
        return F.round(C.assemble("s2", C.boltzmann("d3", "d12", F.col("tau")), F.col("b0")), 12)

    s = inf.sweep(base, "id", [{"config": n, "b0": x, "tau": u} for n, x, u in _CONF], index, "ref")
    return s.select("config", *[r(c, 7).alias(c) for c in ("mean", "min", "max", "shift", "rank_rho")])


def _dynamic(s, c, b0):
    beta = b0 * (1 - c)
    return F.least(F.greatest(beta * s + (1 - beta) * c, F.lit(0.0)), F.lit(1.0))


# Ranges of the parameters that the variance indices vary.
_BOUNDS = {"w_bws": (0.40, 0.65), "w_a": (0.10, 0.30), "w_gws": (0.10, 0.30), "w_sv": (0.05, 0.15), "b0": (0.5, 0.9), "shift": (-0.5, 0.5)}
_DESIGN = 256


def _sobol_sql() -> str:
    """Design rows and the number of the moved parameter: none for A, all for B."""
    def param(p: str, k: int) -> str:
        low, high = _BOUNDS[p]
        u = f"CASE WHEN m = {k} OR m = {len(_BOUNDS)} THEN {_uniform(f"'42:{p}:' || s", 1)} ELSE {_uniform(f"'42:{p}:' || s")} END"
        return f"{low}e0 + ({high}e0 - {low}e0) * {u} AS {p}"

    ws = {"x_bws": "w_bws", "x_aridity": "w_a", "x_gws": "w_gws", "x_sv": "w_sv"}
    live = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0e0 END" for c, w in ws.items())
    logs = " + ".join(f"coalesce({w} * ln({c} + 0.05e0), 0)" for c, w in ws.items())
    stress = [f"CASE WHEN {c} IS NOT NULL THEN least(greatest(-({c} + shift) / 3e0, 0e0), 1e0) END" for c in ("spei3", "spei12")]
    return f"""WITH {SITES}, d AS (SELECT s, m, {', '.join(param(p, k) for k, p in enumerate(_BOUNDS))} FROM range({_DESIGN}) a(s), range(-1, {len(_BOUNDS) + 1}) b(m)),
 x AS (SELECT id, s, m, b0, least(greatest(exp(({logs}) / ({live})) - 0.05e0, 0e0), 1e0) AS st, greatest({', '.join(stress)}) AS cy FROM sites, d),
 y AS (SELECT id, s, m, {_MIX.format(s='st', c='cy', b='b0')} AS y FROM x), v AS (SELECT id, (var_pop(y) FILTER (m = -1) + var_pop(y) FILTER (m = {len(_BOUNDS)})) / 2 AS v FROM y GROUP BY id),
 j AS (SELECT y.id, y.m, avg(pow(b.y - y.y, 2)) / 2 AS from_b, avg(pow(a.y - y.y, 2)) / 2 AS from_a FROM y JOIN y a ON a.id = y.id AND a.s = y.s AND a.m = -1 JOIN y b ON b.id = y.id AND b.s = y.s AND b.m = {len(_BOUNDS)} WHERE y.m BETWEEN 0 AND {len(_BOUNDS) - 1} GROUP BY 1, 2)
SELECT j.id, list_extract([{', '.join(f"'{p}'" for p in _BOUNDS)}], m::INT + 1) AS param, round(CASE WHEN v > 1e-12 THEN (v - from_b) / v END, 6) AS first_order, round(CASE WHEN v > 1e-12 THEN from_a / v END, 6) AS total FROM j JOIN v USING (id)"""


@query("variance_indices", "M23", _sobol_sql())
def variance_indices(t):
    """Per site, over the weights, the largest structural share and a shift of the drought index."""
    weights = {"x_bws": "w_bws", "x_aridity": "w_a", "x_gws": "w_gws", "x_sv": "w_sv"}

    def model(p, x):
        live = sum(np.where(np.isnan(x[c]), 0.0, p[w]) for c, w in weights.items())
        logs = sum(np.where(np.isnan(x[c]), 0.0, p[w] * np.log(x[c] + C.EPSILON)) for c, w in weights.items())
        structure = np.clip(np.exp(np.divide(logs, live, out=np.full(live.shape, np.nan), where=live > 0)) - C.EPSILON, 0.0, 1.0)
        state = np.fmax(*[np.clip(-(x[c] + p["shift"]) / 3.0, 0.0, 1.0) for c in ("spei3", "spei12")])
        beta = p["b0"] * (1 - state)
        mixed = np.clip(beta * structure + (1 - beta) * state, 0.0, 1.0)
        return np.where(np.isnan(structure), state, np.where(np.isnan(state), structure, mixed))

    out = inf.sobol(sites(t), "id", _BOUNDS, model, _DESIGN, reads=[*weights, "spei3", "spei12"])
    return out.select("id", "param", r("first_order").alias("first_order"), r("total").alias("total"))


_VARIED = ["x_bws", "x_aridity", "x_gws", "x_sv"]


def _full_sql(moved: str | None) -> str:
    b, a, g, c = (f"({v} + 0.01e0)" if v == moved else v for v in _VARIED)
    beta = f"(0.7e0 * (1 - {c}))"
    return f"least(greatest({beta} * pow({b}, 0.5e0) * pow({a}, 0.36e0) * pow({g}, 0.14e0) + (1 - {beta}) * {c}, 0e0), 1e0)"


@query("monotonicity", "M24", f"""
WITH {SITES}, q AS (SELECT unnest([{', '.join(f"'{v}'" for v in _VARIED)}]) AS variable, unnest([{', '.join(f'({_full_sql(v)} - {_full_sql(None)}) / 0.01e0' for v in _VARIED)}]) AS g FROM sites)
SELECT variable, count(*) AS checks, count(*) FILTER (g < -1e-9) AS violations, round(min(g), 6) AS min_gradient FROM q WHERE g IS NOT NULL GROUP BY 1""")
def monotonicity(t):
    """The whole index: geometric structure, a beta that falls with the current state, and that state itself."""
    def model(v):
        structure = F.pow(v["x_bws"], F.lit(0.5)) * F.pow(v["x_aridity"], F.lit(0.36)) * F.pow(v["x_gws"], F.lit(0.14))
        return _dynamic(structure, v["x_sv"], F.lit(0.7))

    return inf.monotone(sites(t), _VARIED, model).withColumn("min_gradient", r("min_gradient"))


@query("weight_calibration", "M25 K5", f"""
WITH {SITES}, k AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY substr(md5(id::VARCHAR || ':7'), 1, 12)) <= floor(count(*) OVER (PARTITION BY level) * 0.7e0) AS is_train FROM sites),
 g AS (SELECT i / 5e0 AS w_bws, j / 5e0 AS w_aridity, (5 - i - j) / 5e0 AS w_gws FROM range(6) a(i), range(6) b(j) WHERE i + j <= 5),
 h AS (SELECT w_bws, w_aridity, w_gws, is_train, level, round((w_bws * x_bws + w_aridity * x_aridity + coalesce(w_gws * x_gws, 0)) / (w_bws + w_aridity + CASE WHEN x_gws IS NOT NULL THEN w_gws ELSE 0 END), 12) AS h FROM k, g WHERE w_bws + w_aridity + CASE WHEN x_gws IS NOT NULL THEN w_gws ELSE 0 END > 0),
 rk AS (SELECT *, {rank_sql('h', 'w_bws, w_aridity, is_train')} AS a, {rank_sql('level', 'w_bws, w_aridity, is_train')} AS b FROM h), c AS (SELECT w_bws, w_aridity, w_gws, is_train, corr(a, b) AS rho FROM rk GROUP BY ALL)
SELECT w_bws, w_aridity, w_gws, round(max(rho) FILTER (is_train), 6) AS rho_train, round(max(rho) FILTER (NOT is_train), 6) AS rho_test FROM c GROUP BY ALL""")
def weight_calibration(t):
    s = stratified_split(sites(t).select("id", "level", "x_bws", "x_aridity", "x_gws"), "id", "level", 0.7, 7)

    def index():
        return C.wmean({c: F.col(f"w_{c[2:]}") for c in ("x_bws", "x_aridity", "x_gws")})

    c = inf.calibrate(s, ["bws", "aridity", "gws"], index, "level", "is_train", 0.2)
    return c.select("w_bws", "w_aridity", "w_gws", r("rho_train").alias("rho_train"), r("rho_test").alias("rho_test"))


_EXPERT = (0.5, 0.36, 0.14)
_INDEX3 = "round(({w0} * x_bws + {w1} * x_aridity + coalesce({w2} * x_gws, 0)) / ({w0} + {w1} + CASE WHEN x_gws IS NOT NULL THEN {w2} ELSE 0 END), 12)"


@query("calibrated_weights", "M25 K5", f"""
WITH {SITES}, k AS (SELECT sites.*, seed, row_number() OVER (PARTITION BY seed, level ORDER BY substr(md5(id::VARCHAR || ':' || seed), 1, 12)) <= floor(count(*) OVER (PARTITION BY seed, level) * 0.7e0) AS is_train FROM sites, range(5) s(seed)),
 g AS (SELECT i, j, i / 10e0 AS w0, j / 10e0 AS w1, (10 - i - j) / 10e0 AS w2 FROM range(11) a(i), range(11) b(j) WHERE i + j <= 10 UNION ALL SELECT -1, -1, {', '.join(f'{w}e0' for w in _EXPERT)}),
 h AS (SELECT seed, i, j, is_train, level, {_INDEX3.format(w0='w0', w1='w1', w2='w2')} AS h FROM k, g WHERE w0 + w1 + CASE WHEN x_gws IS NOT NULL THEN w2 ELSE 0 END > 0),
 rk AS (SELECT *, {rank_sql('h', 'seed, i, j, is_train')} AS a, {rank_sql('level', 'seed, i, j, is_train')} AS b FROM h), c AS (SELECT seed, i, j, corr(a, b) FILTER (is_train) AS tr, corr(a, b) FILTER (NOT is_train) AS te FROM rk GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(tr, 9) DESC, i, j) AS rn FROM c WHERE i >= 0), x AS (SELECT o.*, e.te AS ex FROM o JOIN c e ON e.seed = o.seed AND e.i = -1 WHERE rn = 1)
SELECT seed, i / 10e0 AS w_1, j / 10e0 AS w_2, (10 - i - j) / 10e0 AS w_3, round(tr, 6) AS rho_train, round(te, 6) AS rho_test, round(ex, 6) AS rho_expert, round(te - ex, 6) AS gain FROM x""")
def calibrated_weights(t):
    """The weights that each of five splits would choose, and what they gain on its test rows."""
    c = inf.calibrated(sites(t), "id", ["x_bws", "x_aridity", "x_gws"], "level", _EXPERT)
    return c.select("seed", *[r(f"w_{i}", 3).alias(f"w_{i}") for i in (1, 2, 3)], *[r(n).alias(n) for n in ("rho_train", "rho_test", "rho_expert", "gain")])


_COMPARED = (3.0, 3.0, 1.0)
_TRIAL = ", ".join(f"{v}e0 * (1 + 0.2e0 * (2 * {_uniform(f"'{42 + i}:' || s")} - 1)) AS {n}" for i, (v, n) in enumerate(zip(_COMPARED, ("ab", "ac", "bc"))))
_W3 = {"x_bws": "w0", "x_aridity": "w1", "x_gws": "w2"}


@query("comparison_weight_interval", "M26", f"""WITH {SITE_INDEX}, c AS (SELECT {_TRIAL} FROM range(1000) r(s)), g AS (SELECT pow(ab * ac, 1 / 3e0) AS a, pow(bc / ab, 1 / 3e0) AS b, pow(1 / (ac * bc), 1 / 3e0) AS c FROM c),
 w AS (SELECT a / (a + b + c) AS w0, b / (a + b + c) AS w1, c / (a + b + c) AS w2 FROM g),
 x AS (SELECT id, cb, ({' + '.join(f"coalesce({w} * {c}, 0)" for c, w in _W3.items())}) / ({' + '.join(f"CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0e0 END" for c, w in _W3.items())}) AS st FROM idx, w),
 h AS (SELECT id, {_MIX.format(s='st', c='cb', b='0.7e0')} AS h FROM x)
SELECT id, round(quantile_cont(h, 0.05), 6) AS h_p5, round(quantile_cont(h, 0.5), 6) AS h_median, round(quantile_cont(h, 0.95), 6) AS h_p95, round(stddev_pop(h), 6) AS h_std, round(quantile_cont(h, 0.95) - quantile_cont(h, 0.05), 6) AS width FROM h GROUP BY id""")
def comparison_weight_interval(t):
    s = site_index_frame(t).select("id", "x_bws", "x_aridity", "x_gws", "cb")
    a = inf.ahp_interval(s, "id", _COMPARED, lambda w: C.assemble(C.wmean(dict(zip(_W3, w))), "cb"))
    return a.select("id", *[r(c).alias(c) for c in a.columns[1:]])


_ORDERED = f"SELECT p.sid, s.sid AS nid, {_D} AS dist, nullif(s.value, 0) AS nv, row_number() OVER (PARTITION BY p.sid ORDER BY {_D}, s.sid) AS rank FROM stations p, stations s"


@query("leakage_audit", "M16", f"""
WITH {_READ}, held AS ({_ORDERED} WHERE p.sid <> s.sid), own AS ({_ORDERED}),
 near AS (SELECT 'held_out' AS predictor, * FROM held UNION ALL SELECT 'own_value', * FROM own),
 seen AS (SELECT predictor, sid, nv, CASE WHEN nid = sid THEN 99999 ELSE nv END AS bad, 1 / pow(greatest(dist, 3), 2) AS w FROM near WHERE rank <= 7),
 moved AS (SELECT predictor, sid, sum(w * nv) / sum(CASE WHEN nv IS NOT NULL THEN w END) AS a, sum(w * bad) / sum(CASE WHEN bad IS NOT NULL THEN w END) AS b FROM seen GROUP BY 1, 2)
SELECT predictor, count(*) AS n, round(coalesce(max(abs(a - b)), 0), 4) AS largest, coalesce(max(abs(a - b)), 0) > 1e-9 AS leaks FROM moved WHERE sid % 13 <> 0 GROUP BY 1""")
def leakage_audit(t):
    """A predictor that holds the row out, and one that reads its own value and must be caught."""
    s = readings(t)
    right = s.select(F.col("sid").alias("nid"), "x", "y", F.col("value").alias("nv"))

    def audit(name, exclude):
        def predict(seen):
            near = knn_join(s.select("sid", "x", "y"), right, 7, "sid", "nid", exclude_self=exclude, carry=["nv"])
            return ip.idw_from(near.withColumn("nv", seen(F.col("sid"), F.col("nid"), F.col("nv"))), ["sid"], "nv")

        return inf.leakage_audit(predict, s, "sid", F.col("sid") % 13 != 0).select(F.lit(name).alias("predictor"), "n", r("largest", 4).alias("largest"), "leaks")

    return audit("held_out", True).unionByName(audit("own_value", False))


FEATURES = ["x_bws", "x_aridity", "x_sv", "d3", "d12"]


def _table(t):
    s = site_index_frame(t).dropna(subset=FEATURES)
    return s.select("id", "lat", "lon", "level", *FEATURES)


@query("forest_regression", "M9 K5")
def forest_regression(t):
    s = stratified_split(_table(t), "id", "level", 0.7, 42)
    f = ml.fit_forest(s.where("is_train"), FEATURES, "level")
    return f.predict(s.where(~F.col("is_train"))).select("id", "level", r("pred").alias("pred"))


@query("permutation_importance", "M12")
def permutation_importance(t):
    s = stratified_split(_table(t), "id", "level", 0.7, 42)
    f = ml.fit_forest(s.where("is_train"), FEATURES, "level")
    p = ml.permutation_importance(f, s.where(~F.col("is_train")), "id", "level", repeats=30)
    return p.select("feature", r("importance").alias("importance"), r("std").alias("std"))


@query("spatial_zones", "M13")
def spatial_zones(t):
    z = ml.kmeans_zones(_table(t), 5)
    return z.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), r(F.avg("lat"), 4).alias("lat"), r(F.avg("lon"), 4).alias("lon"))


@query("leave_cluster_out", "M14 M13")
def leave_cluster_out(t):
    z = ml.kmeans_zones(_table(t), 5)
    sets = {"full": FEATURES, "no_bws": FEATURES[1:]}
    return ml.leave_group_out(z, "zone", [0, 1, 2, 3, 4], sets, "level").withColumn("rho", r("rho"))


def _features(t):
    return ml.neighbour_features(readings(t), "value")


@query("residual_correction", "M10 P41")
def residual_correction(t):
    p = ml.residual_correct(_features(t), "value", ["lat", "lon"])
    return p.select("sid", *[r(c, 4).alias(c) for c in ("true", "base", "pred")])


@query("neighbour_forest", "M11")
def neighbour_forest(t):
    return ml.neighbour_forest(readings(t), "value", ["lat", "lon"]).select("sid", r("true", 4).alias("true"), r("pred", 4).alias("pred"))


@query("block_validation", "M15 P46")
def block_validation(t):
    f = _features(t)
    m = quantiles(f, "lat", [0.5]).toDF("ml").crossJoin(F.broadcast(quantiles(f, "lon", [0.5]).toDF("mo")))
    f = f.crossJoin(F.broadcast(m)).withColumn("quadrant", F.concat(F.when(F.col("lat") >= F.col("ml"), "N").otherwise("S"), F.when(F.col("lon") >= F.col("mo"), "E").otherwise("W"))).drop("ml", "mo")
    b = ml.block_validation(f, "value", "quadrant", ["NE", "NW", "SE", "SW"])
    return b.select("block", "n", *[r(c, 4).alias(c) for c in ("wmape_base", "r2_base", "wmape", "r2")])


# The zone counts and shares of the published search.
ZONES, ALPHAS = [4, 6, 8, 10, 12, 14, 16, 18, 20, 24], [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0]


@query("zone_search", "M27 P40")
def zone_search(t):
    s = readings(t).withColumn("low", F.col("value") * 0.5).withColumn("high", F.col("value") * 1.5 + 50)
    return ml.zone_search(s.where(F.col("value") > 0), ZONES, ALPHAS, "value", "cap", "low", "high")


@query("laplacian_smoothing", "M29")
def laplacian_smoothing(t):
    return ml.local_laplacian(node_values(t), lines(t), "admittance").select("id", r("pred", 4).alias("pred"))
