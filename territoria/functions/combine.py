"""Null-aware composite indices: weights of missing components are shared among the others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from territoria.functions.scalars import ColumnLike, check_weights, clip, col, let

# Published component weights of the two structural indices and the local index.
WEIGHTS_ARITH = {"x_bws": 0.50, "x_aridity": 0.36, "x_gws": 0.14}
WEIGHTS_GEOM = {"x_bws": 0.532, "x_aridity": 0.185, "x_gws": 0.185, "x_sv": 0.097}
WEIGHTS_LOCAL = {"b": 0.25, "g": 0.15, "d": 0.25, "s": 0.15, "v": 0.10, "u": 0.10}
WEIGHTS_INDEX = {"bws": 0.60, "gws": 0.25, "drought": 0.15}
RELATIVE_SIGMA = {"bws": 0.12, "gws": 0.18, "drought": 0.22}
WEIGHTS_SITE_SCORE = {
    "score_temperature": 0.25, "water_score": 0.20, "score_carbon": 0.20, "score_environnement": 0.10,
    "score_technique": 0.10, "score_fiabilite": 0.10, "couverture_nappes_pct": 0.05,
}
EPSILON, TAU, BETA0 = 0.05, 5.0, 0.70


def total(parts: Sequence[Column]) -> Column:
    return reduce(add, parts)


def live_weight(weights: Mapping[str, float | Column]) -> Column:
    """Sum of the weights whose component is present."""
    return total([F.when(col(c).isNotNull(), w).otherwise(F.lit(0.0)) for c, w in weights.items()])


def live_sum(weights: Mapping[str, float | Column], value=lambda v: v) -> Column:
    return total([F.coalesce(value(col(c)) * w, F.lit(0.0)) for c, w in weights.items()])


def wmean(weights: Mapping[str, float | Column]) -> Column:
    den = live_weight(weights)
    return F.when(den > 0, live_sum(weights) / den)


def wgeo(weights: Mapping[str, float | Column], eps: float = EPSILON) -> Column:
    den = live_weight(weights)
    logs = live_sum(weights, lambda v: F.ln(v + eps))
    return F.when(den > 0, clip(F.exp(logs / den) - eps, 0.0, 1.0))


def ampi(weights: Mapping[str, float | Column]) -> Column:
    """Weighted mean plus dispersion penalty M + S*S/M."""
    den = live_weight(weights)
    mean = live_sum(weights) / den
    var = live_sum(weights, lambda v: (v - mean) * (v - mean)) / den
    return F.when(den > 0, clip(mean + F.when(mean > 0, var / mean).otherwise(F.lit(0.0)), 0.0, 1.0))


def layered_mean(layers: Mapping[str, float | Column], present: Sequence[str]) -> Column:
    """``wmean`` over the layers that exist at all; a single layer is returned as it is."""
    used = {c: w for c, w in layers.items() if c in present}
    if not used:
        return F.lit(None).cast("double")
    if len(used) == 1:
        return col(next(iter(used)))
    return clip(wmean(used), 0.0, 1.0)


def _pair(a: Column, b: Column, both) -> Column:
    """``both(a, b)`` where both exist, else the one that does; each input is evaluated once."""

    def pick(v: Column) -> Column:
        x, y = v["a"], v["b"]
        return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(both(x, y))

    return let(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")), pick)


def boltzmann(short: ColumnLike, long: ColumnLike, tau: float = TAU) -> Column:
    """Mean of the two stresses weighted by exp(tau * stress)."""
    return _pair(col(short), col(long), lambda a, b: (a * F.exp(tau * a) + b * F.exp(tau * b)) / (F.exp(tau * a) + F.exp(tau * b)))


def hard_max(short: ColumnLike, long: ColumnLike) -> Column:
    return F.greatest(col(short), col(long))


def fixed_mix(short: ColumnLike, long: ColumnLike, share: float = 0.6) -> Column:
    a, b = col(short), col(long)
    return F.coalesce(share * a + (1 - share) * b, a, b)


def assemble(structural: ColumnLike, cyclical: ColumnLike, beta0: float | Column = BETA0,
             dynamic: bool = True) -> Column:
    """beta*structural + (1-beta)*cyclical, where beta shrinks as the cyclical part grows."""

    def mix(s: Column, c: Column) -> Column:
        beta = beta0 * (1 - c) if dynamic else beta0
        return F.least(F.greatest(beta * s + (1 - beta) * c, F.lit(0.0)), F.lit(1.0))

    return _pair(col(structural), col(cyclical), mix)


def contribution_shares(structural: ColumnLike, cyclical: ColumnLike, beta0: float = BETA0) -> tuple[Column, Column]:
    """Percent of the assembled index that comes from each part; null where the index is 0."""
    s, c = col(structural), col(cyclical)
    beta = beta0 * (1 - c)
    whole = beta * s + (1 - beta) * c
    return (F.try_divide(100 * beta * s, whole), F.try_divide(100 * (1 - beta) * c, whole))


def local_index(components: Mapping[str, ColumnLike], weights: Mapping[str, float] = WEIGHTS_LOCAL) -> Column:
    """Struct: index, one contribution per component, and whether weights were redistributed."""
    check_weights(weights, 1e-3)
    cols = {k: col(components[k]) for k in weights}
    shares = {k: F.coalesce(c * weights[k], F.lit(0.0)) for k, c in cols.items()}
    live = total([F.when(c.isNotNull(), weights[k]).otherwise(F.lit(0.0)) for k, c in cols.items()])
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in cols.values()])

    def scaled(v: Column) -> Column:
        whole = F.least(F.greatest(v["sum"] * v["scale"], F.lit(0.0)), F.lit(1.0))
        return F.struct(whole.alias("index"), *[(v[k] * v["scale"]).alias(f"{k}_contrib") for k in weights], v["missing"].alias("redistributed"))

    def weighed(v: Column) -> Column:
        scale = F.when(v["missing"], 1 / v["live"]).otherwise(F.lit(1.0))
        return let(F.struct(*[v[k].alias(k) for k in weights], v["missing"].alias("missing"), scale.alias("scale"), total([v[k] for k in weights]).alias("sum")), scaled)

    # Each step is bound once: parts, then their scale and sum, then the result.
    return F.when(live > 0, let(F.struct(*[c.alias(k) for k, c in shares.items()], live.alias("live"), missing.alias("missing")), weighed))


def site_score(available: Sequence[str], weights: Mapping[str, float] = WEIGHTS_SITE_SCORE) -> Column:
    """Missing columns renormalise the weights; missing values count as 0."""
    used = {c: w for c, w in weights.items() if c in available}
    whole = sum(used.values())
    score = total([F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in used.items()]) if used else F.lit(0.0)
    return score / whole if 0 < whole < 1.0 - 1e-12 else score


def stress_index(bws: ColumnLike, gws: ColumnLike, drought: ColumnLike,
                 weights: Mapping[str, float] = WEIGHTS_INDEX) -> Column:
    check_weights(weights)
    return clip(weights["bws"] * col(bws) + weights["gws"] * col(gws) + weights["drought"] * col(drought), 0.0, 1.0)


def index_sigma(bws: ColumnLike, gws: ColumnLike, drought: ColumnLike, weights: Mapping[str, float] = WEIGHTS_INDEX,
                sigma: Mapping[str, float] = RELATIVE_SIGMA) -> Column:
    terms = [F.pow(weights[k] * sigma[k] * col(c), F.lit(2.0))
             for k, c in (("bws", bws), ("gws", gws), ("drought", drought))]
    return clip(F.sqrt(total(terms)), 0.0, 1.0)


def reliability(null_share: ColumnLike, bws_raw: ColumnLike, gws_raw: ColumnLike, fit_p: ColumnLike,
                distance_km: ColumnLike) -> Column:
    """0.30 completeness + 0.25 structural data + 0.25 fit quality + 0.20 grid distance (14 km = half a cell)."""
    structural = 0.5 * col(bws_raw).isNull().cast("int") + 0.5 * col(gws_raw).isNull().cast("int")
    fit = clip(1 - 10 * col(fit_p), 0.0, 1.0)
    spatial = clip(col(distance_km) / 14.0, 0.0, 1.0)
    return clip(0.30 * col(null_share) + 0.25 * structural + 0.25 * fit + 0.20 * spatial, 0.0, 1.0)


# --- local value against zone value ----------------------------------------------------------

def mix_national(local: ColumnLike, national: ColumnLike, alpha: float = 0.5) -> Column:
    """Half the local value, half that of the whole country."""
    return alpha * col(local) + (1 - alpha) * col(national)


def mix_linear(local: ColumnLike, zone: ColumnLike, alpha: float = 0.3) -> Column:
    return alpha * col(local) + (1 - alpha) * col(zone)


def mix_clip(local: ColumnLike, zone: ColumnLike, alpha: float = 0.1, factor: float = 2.0) -> Column:
    zone = col(zone)
    bounded = F.least(F.greatest(col(local), zone / factor), zone * factor)
    return mix_linear(bounded, zone, alpha)


def _adaptive(local: Column, zone: Column, alpha: float, rate: float) -> Column:
    ratio = F.abs(local - zone) / F.greatest(zone, F.lit(1.0))
    a = alpha * F.exp(-rate * ratio)
    return a * local + (1 - a) * zone


def mix_adaptive(local: ColumnLike, zone: ColumnLike, alpha: float = 0.2) -> Column:
    return _adaptive(col(local), col(zone), alpha, 1.0)


def mix_clip_adaptive(local: ColumnLike, zone: ColumnLike, alpha: float = 0.2, factor: float = 2.5) -> Column:
    zone = col(zone)
    return _adaptive(F.least(F.greatest(col(local), zone / factor), zone * factor), zone, alpha, 0.5)


def mix_log(local: ColumnLike, zone: ColumnLike, alpha: float = 0.1) -> Column:
    a, z = F.greatest(col(local), F.lit(1.0)), F.greatest(col(zone), F.lit(1.0))
    return F.exp(alpha * F.ln(a) + (1 - alpha) * F.ln(z))


def mix_winsor(local: ColumnLike, zone: ColumnLike, p25: ColumnLike, p75: ColumnLike, alpha: float = 0.15) -> Column:
    return mix_linear(F.least(F.greatest(col(local), col(p25)), col(p75)), zone, alpha)


def mix_hybrid(local: ColumnLike, graph: ColumnLike, zone: ColumnLike, a_local: float = 0.2,
               a_graph: float = 0.2) -> Column:
    return a_local * col(local) + a_graph * col(graph) + (1 - a_local - a_graph) * col(zone)


# Strategies by name, each (local, zone) -> Column, run over all rows by ``apply_strategies``.
STRATEGIES = {
    "raw": lambda local, zone: col(local),
    "zone": lambda local, zone: col(zone),
    "linear": mix_linear,
    "clip": mix_clip,
    "adaptive": mix_adaptive,
    "clip_adaptive": mix_clip_adaptive,
    "log": mix_log,
}


def limit_correction(base: ColumnLike, correction: ColumnLike, down: float = 2.0, up: float = 2.0,
                     halve_above: float | None = None) -> Column:
    """base + correction, the correction bounded by multiples of max(|base|, 5), result at least 0."""
    base, corr = col(base), col(correction)
    if halve_above is not None:
        corr = F.when((base > halve_above) & (corr < 0), corr * 0.5).otherwise(corr)
    scale = F.greatest(F.abs(base), F.lit(5.0))
    bounded = F.least(F.greatest(corr, -down * scale), up * scale)
    return clip(base + bounded, 0.0)


def interaction_features(drought: ColumnLike, aridity: ColumnLike, bws: ColumnLike) -> dict[str, Column]:
    d, a, b = col(drought), col(aridity), col(bws)
    half = 0.5 * d + 0.5 * a
    return {
        "mix_50": half,
        "mix_70": 0.7 * d + 0.3 * a,
        "mix_30": 0.3 * d + 0.7 * a,
        "d_damped": d * (1 - b),
        "a_damped": a * (1 - b),
        "mix_damped": half * (1 - b),
        "mix_amplified": half * (1 + b),
    }
