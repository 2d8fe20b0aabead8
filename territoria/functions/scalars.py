"""Column builders for normalisation, stress maps, unit conversion, banding and rounding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: ColumnLike, low: float | None = None, high: float | None = None) -> Column:
    """Bounds a value; null stays null (greatest/least alone would skip it)."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def let(value: Column, body) -> Column:
    """Binds a value once, so a long expression over it is not repeated inside the generated code."""
    return F.transform(F.array(value), body)[0]


def clip01(c: ColumnLike, maximum: float = 1.0) -> Column:
    return clip(col(c) / F.lit(float(maximum)), 0.0, 1.0)


def finite(c: ColumnLike) -> Column:
    """NaN to null, applied once at ingestion."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def wall_micros(ts: ColumnLike) -> Column:
    """Microseconds of a wall-clock timestamp since 1970, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), col(ts).cast("timestamp_ntz"))


def wall_time(micros: ColumnLike) -> Column:
    return F.timestamp_add("MICROSECOND", col(micros), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


# --- units -----------------------------------------------------------------------------------

def days_in_month(ts: ColumnLike) -> Column:
    return F.dayofmonth(F.last_day(col(ts)))


def hourly_rate_to_mm(rate: ColumnLike, ts: ColumnLike) -> Column:
    """Mean m/h over a month to mm in that month."""
    return col(rate) * days_in_month(ts) * 24 * 1000


def daily_rate_to_mm(rate: ColumnLike, ts: ColumnLike) -> Column:
    """Mean m/day over a month to mm in that month, never negative."""
    return clip(col(rate) * days_in_month(ts) * 1000, 0.0)


def upward_flux_to_mm(flux: ColumnLike, ts: ColumnLike | None = None) -> Column:
    """Evaporation is stored negative. With a date: floored at 0 and scaled by days; without: absolute value."""
    if ts is None:
        return F.abs(col(flux)) * 1000
    return daily_rate_to_mm(-col(flux), ts)


def kelvin_to_celsius(t: ColumnLike) -> Column:
    return col(t) - 273.15


# --- normalisation and stress maps -----------------------------------------------------------

def logistic_withdrawal(raw: ColumnLike, maximum: float = 5.0) -> Column:
    """Logistic in wta/(1-wta), rescaled so that 0.5..1 becomes 0..1."""
    wta = clip(col(raw) / F.lit(float(maximum)), 0.001, 0.999)
    return clip((1 / (1 + F.exp(-6.4 * wta / (1 - wta))) - 0.5) / 0.5, 0.0, 1.0)


def sigmoid_withdrawal(raw: ColumnLike, maximum: float = 5.0, k: float = 0.8) -> Column:
    return 1 / (1 + F.exp(-k * (col(raw) - maximum / 2.5)))


def z_to_stress(z: ColumnLike, k: float = 0.8) -> Column:
    return 1 / (1 + F.exp(k * col(z)))


def aridity_stress(index: ColumnLike, k: float = 3.0, pivot: float = 0.65) -> Column:
    index = col(index)
    return F.when(index <= 0, F.lit(1.0)).otherwise(1 / (1 + F.pow(index / pivot, F.lit(float(k)))))


def asymptotic_stress(index: ColumnLike, c: float = 2.0) -> Column:
    index = col(index)
    return F.when(index >= 0, F.lit(0.0)).when(index < 0, -index / (c + F.abs(index)))


def linear_stress(index: ColumnLike, cap: float = 3.0) -> Column:
    return clip(-col(index) / F.lit(float(cap)), 0.0, 1.0)


def decline_score(trend: ColumnLike) -> Column:
    """Table decline in m/yr to 0-5; the -9999 sentinel (anything below -9000) is missing."""
    trend = col(trend)
    return F.when(trend >= -9000, clip(F.greatest(trend, F.lit(0.0)) * 10, 0.0, 5.0))


def lookup(key: ColumnLike, mapping: Mapping, default) -> Column:
    """Literal map lookup with a default; the map is a handful of fixed entries."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(key)), F.lit(default))


# Storage-medium score and setting factor per code, default 0.5 and 1.0.
MEDIUM_SCORE = {"1": 0.15, "2": 0.50, "3": 0.35, "4": 0.55, "5": 0.85, "X": 0.50}
SETTING_FACTOR = {"1": 0.85, "2": 0.95, "3": 1.15, "4": 1.00, "5": 1.10}
# The older labels for the same two roles.
LEGACY_TYPE_SCORE = {
    "Domaine à aquifère poreux continu libre": 0.15,
    "Domaine à aquifère poreux continu captif": 0.20,
    "Domaine à aquifère poreux discontinu": 0.35,
    "Domaine à aquifère fissuré continu": 0.45,
    "Domaine à aquifère fissuré discontinu": 0.60,
    "Domaine à aquifère karstique": 0.55,
    "Domaine à socle peu perméable en petit fond": 0.80,
    "Domaine à socle peu perméable en grand fond": 0.85,
    "Non renseigné": 0.50,
}
LEGACY_STATE_FACTOR = {"Bon état": 1.0, "Médiocre": 1.5, "Inconnu": 1.0, "Non évalué": 1.0}


def coded_stress(code: ColumnLike, factor_code: ColumnLike, scores: Mapping = MEDIUM_SCORE,
                 factors: Mapping = SETTING_FACTOR) -> Column:
    return clip(lookup(code, scores, 0.5) * lookup(factor_code, factors, 1.0), 0.0, 1.0)


def withdrawal_modulation(base: ColumnLike, pressure: ColumnLike, weight: float = 0.5) -> Column:
    """Raises the base towards 1 by the withdrawal pressure; never lowers it."""
    base = col(base)
    return clip(base + (1 - base) * weight * col(pressure), 0.0, 1.0)


# --- scores ----------------------------------------------------------------------------------

def stress_to_score(stress: ColumnLike) -> Column:
    return clip(100 * (1 - col(stress)), 0.0, 100.0)


def uncertainty_points(sigma: ColumnLike) -> Column:
    return clip(100 * col(sigma), 0.0, 20.0)


def banded(value: ColumnLike, cuts: Sequence[float], labels: Sequence, strict: bool = False) -> Column:
    """labels[i] for the first cut the value is below (``<``), last label above all cuts."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one more label than cuts")
    value = col(value)
    out = F
    for cut, label in zip(cuts, labels):
        out = out.when((value <= cut) if strict else (value < cut), F.lit(label))
    return F.when(value.isNotNull(), out.otherwise(F.lit(labels[-1])))


# Score bands from worst to best, with their map colour and advice.
SCORE_CUTS = (35.0, 50.0, 65.0, 80.0)
SCORE_BANDS = (
    ("Critique", "#d73027", "Severe shortage: air cooling or closed circuit only."),
    ("Défavorable", "#f46d43", "Significant pressure: avoid evaporative cooling in dry spells."),
    ("Modéré", "#fdae61", "Notable stress in summer: free or adiabatic cooling."),
    ("Bon", "#a6d96a", "Good availability, moderate pressure."),
    ("Excellent", "#1a9641", "Abundant resource, very low stress."),
)
# Index bands and intensity regimes.
INDEX_CUTS, INDEX_BANDS = (0.33, 0.55, 0.75), ("Faible", "Modere", "Fort", "Critique")
REGIME_CUTS, REGIMES = (50.0, 200.0), ("low", "mid", "high")


def score_band(score: ColumnLike) -> Column:
    """Struct (level, color, description) of a 0-100 score."""
    parts = zip(("level", "color", "description"), zip(*SCORE_BANDS))
    return F.struct(*[banded(score, SCORE_CUTS, labels).alias(name) for name, labels in parts])


def index_band(index: ColumnLike) -> Column:
    return banded(index, INDEX_CUTS, INDEX_BANDS)


def regime_band(intensity: ColumnLike) -> Column:
    return banded(intensity, REGIME_CUTS, REGIMES)


# --- cleaning --------------------------------------------------------------------------------

def drop_sentinels(value: ColumnLike, sentinels: Sequence[float] = (-9999.0, 9999.0), tol: float = 1.0,
                   rtol: float = 1e-5) -> Column:
    value = col(value)
    hit = reduce(lambda a, b: a | b, [F.abs(value - s) <= tol + rtol * abs(s) for s in sentinels])
    return F.when(~hit, value)


def out_of_range(value: ColumnLike, low: float, high: float) -> Column:
    value = col(value)
    return F.coalesce((value < low) | (value > high), F.lit(False))


def sum_by_prefix(columns: Sequence[str], prefix: str) -> Column:
    """Row total over the columns whose name starts with ``prefix``; missing counts as 0."""
    picked = [F.coalesce(F.col(c), F.lit(0.0)) for c in columns if c.startswith(prefix)]
    return reduce(add, picked, F.lit(0.0))


def check_weights(weights: Mapping[str, float] | Sequence[float], tol: float = 1e-6) -> None:
    values = list(weights.values()) if isinstance(weights, Mapping) else list(weights)
    if abs(sum(values) - 1.0) > tol:
        raise ValueError(f"weights must sum to 1, got {sum(values):.6f}")


def guard_weights(columns: Sequence[ColumnLike], tol: float = 1e-6) -> Column:
    """In-plan guard for weights that are data: the sum, or an error in the task."""
    total = reduce(add, [col(c) for c in columns])
    return F.when(F.abs(total - 1) <= tol, total).otherwise(
        F.raise_error(F.concat(F.lit("weights must sum to 1, got "), total.cast("string"))).cast("double")
    )


def rounded(df_columns: Mapping[str, int]) -> list[Column]:
    return [F.round(F.col(c), d).alias(c) for c, d in df_columns.items()]
