"""Time-series operators over (entity, month) rows: rolling sums, baselines, runs, lags, drought indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territoria.functions.distributions import loglogistic_cdf, norm_ppf
from territoria.functions.scalars import ColumnLike, clip, col
from territoria.functions.special import fit_loglogistic, gamma_cdf_with_zeros, gamma_shape, pearson3_cdf


def monthly(df: DataFrame, keys: Sequence[str], ts: str, how: Column, out: str) -> DataFrame:
    """One row per entity and calendar month; partial aggregation happens before the shuffle."""
    return df.groupBy(*keys, F.trunc(F.col(ts).cast("date"), "month").alias("month")).agg(how.alias(out))


def resample(df: DataFrame, ts: str, unit: str, aggs: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Mean or other aggregates per ``date_trunc`` unit: hour, day, week, month."""
    return df.groupBy(*keys, F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("bucket")).agg(*aggs)


def trailing(keys: Sequence[str], order: str, n: int):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(-n + 1, 0)


def rolling_sum(value: ColumnLike, keys: Sequence[str], order: str, n: int) -> Column:
    """Null until n rows exist and wherever one of the n is null."""
    w = trailing(keys, order, n)
    return F.when(F.count(col(value)).over(w) == n, F.sum(col(value)).over(w))


def rolling_mean(value: ColumnLike, keys: Sequence[str], order: str, n: int = 3) -> Column:
    w = trailing(keys, order, n)
    return F.when(F.count(col(value)).over(w) == n, F.avg(col(value)).over(w))


def rolling_variability(value: ColumnLike, keys: Sequence[str], order: str, n: int = 12, minimum: int = 6,
                        scale: float = 0.5) -> Column:
    w = trailing(keys, order, n)
    return F.when(F.count(col(value)).over(w) >= minimum, clip(F.stddev_samp(col(value)).over(w) / scale, 0.0, 1.0))


def null_share(value: ColumnLike, keys: Sequence[str], order: str, n: int = 12) -> Column:
    w = trailing(keys, order, n)
    return F.avg(col(value).isNull().cast("double")).over(w)


def lagged(value: str, keys: Sequence[str], order: str, lags: Sequence[int] = (1, 2)) -> dict[str, Column]:
    w = W.partitionBy(*keys).orderBy(order)
    return {f"{value}_lag{k}": F.lag(value, k).over(w) for k in lags}


def memory_features(now: str, lag1: str, lag2: str) -> dict[str, Column]:
    a, b, c = F.col(now), F.col(lag1), F.col(lag2)
    return {"mem_mean": (a + b + c) / 3, "mem_min": F.when((a + b + c).isNotNull(), F.least(a, b, c)), "mem_trend": a - c}


def baseline_z(df: DataFrame, keys: Sequence[str], month: str, value: str, years: tuple[int, int],
               minimum: int = 2, out: str = "z") -> DataFrame:
    """z against the entity's calendar-month mean and sample deviation over the baseline years.

    The statistics are a window over (entity, calendar month), a group of one row per year, so the row
    and its baseline meet without a second shuffle.
    """
    cal = F.month(month)
    w = W.partitionBy(*keys, cal)
    base = F.when(F.year(month).between(*years), F.col(value))
    mu, sd, n = F.avg(base).over(w), F.stddev_samp(base).over(w), F.count(base).over(w)
    return df.withColumn(out, F.when((sd > 0) & (n >= minimum), (F.col(value) - mu) / sd))


def decimal_round(value: ColumnLike, digits: int = 2) -> Column:
    """Rounds at six decimals first, so a half cent does not depend on the order of a floating sum."""
    return F.round(col(value).cast("decimal(28,6)"), digits).cast("double")


def station_anomaly(df: DataFrame, key: str, ts: str, value: str, recent: Column, baseline: Column,
                    min_recent: int = 6, min_baseline: int = 120) -> DataFrame:
    """Recent mean against baseline mean and sample deviation, one aggregation pass; near-constant stations drop out."""
    r, b = F.when(recent, F.col(value)), F.when(baseline, F.col(value))
    agg = df.groupBy(key).agg(
        F.avg(r).alias("_r"), F.avg(b).alias("_b"), F.stddev_samp(b).alias("_s"),
        F.count(r).alias("n_recent"), F.count(b).alias("n_baseline"))
    kept = agg.where((F.col("n_recent") >= min_recent) & (F.col("n_baseline") >= min_baseline) & (F.col("_s") >= 0.01))
    z = (F.col("_r") - F.col("_b")) / F.col("_s")
    return kept.select(
        key, decimal_round("_r").alias("recent_mean"), decimal_round("_b").alias("baseline_mean"),
        decimal_round("_s").alias("baseline_std"), F.round(z, 3).alias("zscore"), "n_recent", "n_baseline",
        clip(1 / (1 + F.exp(0.8 * F.round(z, 3))), 0.0, 1.0).alias("stress"))


def aridity(df: DataFrame, keys: Sequence[str], month: str, precip: str, pet: str, years: tuple[int, int]) -> DataFrame:
    """Mean annual totals over the baseline and the index P/PET; stress 0 where PET is not positive."""
    n = years[1] - years[0] + 1
    base = F.year(month).between(*years)
    agg = df.groupBy(*keys).agg(
        (F.sum(F.when(base, F.col(precip))) / n).alias("p_year"), (F.sum(F.when(base, F.col(pet))) / n).alias("pet_year"))
    ai = F.try_divide(F.col("p_year"), F.when(F.col("pet_year") > 0, F.col("pet_year")))
    return agg.withColumn("aridity", ai).withColumn(
        "aridity_stress", F.when(F.col("pet_year") <= 0, F.lit(0.0)).when(ai <= 0, F.lit(1.0))
        .otherwise(1 / (1 + F.pow(ai / 0.65, F.lit(3.0)))))


def run_lengths(df: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """One row per maximal run of consecutive true rows: start, end, length."""
    w = W.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn(
        "_island", F.row_number().over(w) - F.sum(F.col("_f").cast("int")).over(w))
    return marked.where("_f").groupBy(*keys, "_island").agg(
        F.min(order).alias("run_start"), F.max(order).alias("run_end"), F.count(F.lit(1)).alias("run_length")).drop("_island")


def mean_run_length(df: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Mean run length per entity, 0 for an entity that has rows but no run."""
    w = W.partitionBy(*keys).orderBy(order)
    f = F.coalesce(flag, F.lit(False)).cast("int")
    starts = df.withColumn("_f", f).withColumn(
        "_start", (F.col("_f") == 1) & (F.coalesce(F.lag("_f").over(w), F.lit(0)) == 0))
    return starts.groupBy(*keys).agg(
        F.sum("_f").alias("_n"), F.count_if("_start").alias("n_runs")).select(
        *keys, "n_runs", F.coalesce(F.try_divide(F.col("_n"), F.col("n_runs")), F.lit(0.0)).alias("mean_run"))


def critical_years(df: DataFrame, keys: Sequence[str], month: str, z: str, below: float = -2.0) -> DataFrame:
    """Number of years whose lowest monthly z falls below the limit."""
    yearly = df.groupBy(*keys, F.year(month).alias("_y")).agg(F.min(z).alias("_m"))
    return yearly.groupBy(*keys).agg(F.count_if(F.col("_m") < below).alias("critical_years"))


def decadal_trend(df: DataFrame, keys: Sequence[str], month: str, z: str, min_years: int = 5) -> DataFrame:
    """Least-squares slope of the yearly mean z, per decade; 0 with fewer than ``min_years`` years."""
    yearly = df.groupBy(*keys, F.year(month).cast("double").alias("_y")).agg(F.avg(z).alias("_z"))
    yearly = yearly.where(F.col("_z").isNotNull() & ~F.isnan("_z"))
    agg = yearly.groupBy(*keys).agg(F.regr_slope("_z", "_y").alias("_s"), F.count(F.lit(1)).alias("n_years"))
    return agg.select(*keys, "n_years", F.when(F.col("n_years") < min_years, F.lit(0.0)).otherwise(F.col("_s") * 10).alias("trend"))


def hot_dry_months(z: DataFrame, daily: DataFrame, keys: Sequence[str], month: str, day: str, temp: str,
                   z_col: str = "z", hot: float = 35.0, run: int = 3, months: Sequence[int] = (6, 7, 8),
                   dry: float = -1.0) -> DataFrame:
    """Summer months that are dry and hold a run of hot days; entities of ``z`` without one count 0.

    A run is over the days that have a reading, and never crosses a month.
    """
    d = daily.where(F.col(temp).isNotNull() & F.month(day).isin(*months)).withColumn(month, F.trunc(day, "month"))
    runs = run_lengths(d, [*keys, month], day, F.col(temp) > hot)
    hot_months = runs.where(F.col("run_length") >= run).select(*keys, month).distinct().withColumn("_hot", F.lit(True))
    dry_months = z.withColumn("_dry", F.coalesce((F.col(z_col) < dry) & F.month(month).isin(*months), F.lit(False)))
    return dry_months.join(hot_months, [*keys, month], "left").groupBy(*keys).agg(
        F.count_if(F.col("_dry") & F.coalesce(F.col("_hot"), F.lit(False))).alias("hot_dry_months"))


def window_delta(short: ColumnLike, long: ColumnLike, acute: float = -0.5) -> tuple[Column, Column]:
    d = col(short) - col(long)
    return d, F.coalesce(d < acute, F.lit(False))




def minmax_scale(df: DataFrame, columns: dict[str, bool], suffix: str = "_norm") -> DataFrame:
    """0 best … 1 worst per column (``True`` = higher is worse), 0.5 when constant. Bounds are one broadcast row."""
    bounds = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(bounds))
    for c, worse in columns.items():
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        scaled = (F.col(c) - lo) / (hi - lo) if worse else (hi - F.col(c)) / (hi - lo)
        out = out.withColumn(c + suffix, F.when(lo == hi, F.lit(0.5)).otherwise(scaled))
    return out.drop(*[f"_lo_{c}" for c in columns], *[f"_hi_{c}" for c in columns])


# --- standardised indices --------------------------------------------------------------------

def spi_gamma(df: DataFrame, keys: Sequence[str], value: str, baseline: Column, out: str = "spi",
              min_values: int = 10, min_positive: int = 4, clamp: float = 1e-6) -> DataFrame:
    """Gamma index with zero mass. The fit needs only mean(x), mean(ln x) and the zero share: native aggregates."""
    base = F.when(baseline, F.col(value))
    pos = F.when(base > 0, base)
    fit = df.groupBy(*keys).agg(
        F.count(base).alias("_n"), F.count(pos).alias("_np"), F.avg((base == 0).cast("double")).alias("_q0"),
        F.avg(pos).alias("_m"), F.avg(F.ln(pos)).alias("_lm"))
    fit = fit.withColumn("_a", gamma_shape(F.ln("_m") - F.col("_lm"))).withColumn("_b", F.col("_m") / F.col("_a"))
    joined = df.join(fit, list(keys), "left")
    prob = gamma_cdf_with_zeros(F.col(value), F.col("_q0"), F.col("_a"), F.col("_b"))
    index = (F.when(F.col("_n") < min_values, F.lit(None).cast("double"))
             .when(F.col("_np") < min_positive, F.lit(0.0))
             .when(F.col(value).isNotNull(), norm_ppf(prob, clamp)))
    return joined.withColumn(out, index).drop("_n", "_np", "_q0", "_m", "_lm", "_a", "_b")


def thom_gamma(mean: ColumnLike, mean_log: ColumnLike) -> tuple[Column, Column]:
    """Closed-form (shape, scale) estimate from mean and mean log."""
    a = F.ln(col(mean)) - col(mean_log)
    shape = (1 + F.sqrt(1 + 4 * a / 3)) / (4 * a)
    return shape, col(mean) / shape


def loglogistic_params(df: DataFrame, keys: Sequence[str], value: str, baseline: Column, min_values: int = 10) -> DataFrame:
    """(keys, shape, scale, shift): maximum likelihood on value - min + 1. Groups are one entity's baseline months."""
    x = F.col(value).cast("double")
    base = df.where(baseline & x.isNotNull()).groupBy(*keys).agg(F.collect_list(x).alias("_x")).where(F.size("_x") >= min_values)
    fit = base.withColumn("shift", 1 - F.array_min("_x")).withColumn("_f", fit_loglogistic(F.transform("_x", lambda v: v + F.col("shift"))))
    return fit.where(F.col("_f").isNotNull()).select(*keys, "_f.shape", "_f.scale", "shift")


def spei_loglogistic(df: DataFrame, keys: Sequence[str], value: str, baseline: Column, out: str = "spei",
                     min_values: int = 10, clamp: float = 1e-6) -> DataFrame:
    """``keys`` usually end in the calendar month; leave it out for the whole-series variant."""
    params = loglogistic_params(df, keys, value, baseline, min_values)
    joined = df.join(params, list(keys), "left")
    index = F.when(F.col("shape").isNotNull() & F.col(value).isNotNull(),
                   norm_ppf(loglogistic_cdf(F.col(value) + F.col("shift"), "shape", "scale"), clamp))
    return joined.withColumn(out, index).drop("shape", "scale", "shift")


def pearson3_params(df: DataFrame, keys: Sequence[str], value: str, baseline: Column, min_values: int = 10) -> DataFrame:
    """(keys, skew, loc, scale) by moments, native aggregates; ours in place of a generic three-parameter search."""
    base = F.when(baseline, F.col(value))
    agg = df.groupBy(*keys).agg(F.count(base).alias("_n"), F.skewness(base).alias("skew"), F.avg(base).alias("loc"),
                                F.stddev_pop(base).alias("scale"))
    return agg.where((F.col("_n") >= min_values) & (F.col("scale") > 0)).drop("_n")


def spei_pearson3(df: DataFrame, keys: Sequence[str], value: str, baseline: Column, out: str = "spei",
                  min_values: int = 10, clamp: float = 1e-4) -> DataFrame:
    joined = df.join(pearson3_params(df, keys, value, baseline, min_values), list(keys), "left")
    prob = pearson3_cdf(value, "skew", "loc", "scale")
    index = F.when(F.col("scale").isNotNull() & F.col(value).isNotNull(), norm_ppf(prob, clamp))
    return joined.withColumn(out, index).drop("skew", "loc", "scale")


def spei_ecdf(df: DataFrame, keys: Sequence[str], value: str, baseline: Column, out: str = "spei",
              min_values: int = 10, clamp: float = 1e-4) -> DataFrame:
    """Empirical index: baseline values at or below, plus half, over n+1. Groups are one entity's months."""
    base = F.when(baseline, F.col(value))
    upto = W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_first()).rangeBetween(W.unboundedPreceding, 0)
    below, n = F.count(base).over(upto), F.count(base).over(W.partitionBy(*keys))
    index = F.when((n >= min_values) & F.col(value).isNotNull(), norm_ppf((below + 0.5) / (n + 1), clamp))
    return df.withColumn(out, index)


def index_sanity(df: DataFrame, value: str, keys: Sequence[str] = (), limit: float = 3.5) -> DataFrame:
    """Mean, population deviation, range and saturation percentages of an index; medians come from ``quantiles``."""
    v = F.col(value)
    aggs = [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
            (100 * F.avg((v <= -limit).cast("double"))).alias("sat_low_pct"),
            (100 * F.avg((v >= limit).cast("double"))).alias("sat_high_pct")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def ks_test(df: DataFrame, keys: Sequence[str], value: str, cdf: Column) -> DataFrame:
    """Kolmogorov-Smirnov distance of each group to ``cdf`` and its asymptotic p-value (100-term series)."""
    w = W.partitionBy(*keys).orderBy(value)
    n = F.count(value).over(W.partitionBy(*keys))
    i = F.row_number().over(w)
    d = df.where(F.col(value).isNotNull() & cdf.isNotNull()).select(
        *keys, F.greatest(i / n - cdf, cdf - (i - 1) / n).alias("_d"), n.alias("_n"))
    agg = d.groupBy(*keys).agg(F.max("_d").alias("ks"), F.max("_n").alias("n"))
    root = F.sqrt(F.col("n").cast("double"))
    x = F.col("ks") * (root + 0.12 + 0.11 / root)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * x * x))
    return agg.withColumn("p_value", F.when(x < 0.2, F.lit(1.0)).otherwise(clip(series, 0.0, 1.0)))
