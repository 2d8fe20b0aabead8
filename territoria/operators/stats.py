"""Aggregations: dataset summaries, error metrics, weighted means, rank correlation, screening."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.functions.scalars import ColumnLike, col
from territoria.operators.ranking import _running, quantiles
from territoria.session import cut_lineage


def share(cond: Column) -> Column:
    """Fraction of rows where the condition is true; null counts as false."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def share_of_valid(cond: Column, value: ColumnLike) -> Column:
    return F.avg(F.when(col(value).isNotNull(), cond.cast("double")))


def dataset_stats(df: DataFrame, value: str, lon: str, lat: str) -> DataFrame:
    """One row: counts, moments, exact quantiles and the bounding box of the valid rows."""
    v = F.col(value)
    ok = v.isNotNull()
    base = df.agg(
        F.count(F.lit(1)).alias("n_total"), F.count(v).alias("n_valid"), F.avg(v).alias("mean"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.stddev_pop(v).alias("std"),
        F.min(F.when(ok, F.col(lon))).alias("west"), F.max(F.when(ok, F.col(lon))).alias("east"),
        F.min(F.when(ok, F.col(lat))).alias("south"), F.max(F.when(ok, F.col(lat))).alias("north"))
    q = quantiles(df, value, [0.1, 0.5, 0.9]).withColumnRenamed("p50", "median")
    return base.crossJoin(F.broadcast(q))


def quality_report(df: DataFrame, value: str, probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    v = F.col(value)
    base = df.agg(
        F.count(F.lit(1)).alias("n_total"), F.count(v).alias("n_valid"), F.count_if(v.isNull()).alias("n_null"),
        (100 * F.avg(v.isNull().cast("double"))).alias("null_pct"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    return base.crossJoin(F.broadcast(quantiles(df, value, probs)))


def layer_summary(df: DataFrame, keys: Sequence[str], index: str, stress: str) -> DataFrame:
    """Dryness shares of an index and the share of high stress, with p5/p95 of the stress, per layer."""
    i, s = F.col(index), F.col(stress)
    base = df.groupBy(*keys).agg(
        F.avg(i).alias("index_mean"), F.stddev_pop(i).alias("index_std"),
        (100 * share_of_valid(i < -1, i)).alias("dry_pct"), (100 * share_of_valid(i < -2, i)).alias("very_dry_pct"),
        (100 * share_of_valid(s > 0.7, s)).alias("high_stress_pct"))
    return base.join(quantiles(df, stress, [0.05, 0.95], keys), list(keys), "left")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null, null_pct), one row per column, from one pass."""
    columns = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = one.unpivot("_n", columns, "column_name", "n_null")
    return long.select("column_name", "n_null", (100 * F.try_divide("n_null", "_n")).alias("null_pct"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns)


def describe(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max per column, long form."""
    long = df.select(*columns).unpivot([], list(columns), "column_name", "value")
    agg = long.groupBy("column_name").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return agg.join(quantiles(long, "value", probs, ["column_name"]), "column_name", "left")


def histogram(df: DataFrame, value: str, edges: Sequence[float], keys: Sequence[str] = (), aggs: Sequence[Column] = ()) -> DataFrame:
    """Counts per half-open bin [edge_i, edge_i+1), the last bin closed; rows outside are dropped."""
    v = F.col(value)
    bin_ = reduce(lambda acc, i: acc.when((v >= edges[i]) & ((v < edges[i + 1]) if i < len(edges) - 2 else (v <= edges[i + 1])), F.lit(i)),
                  range(len(edges) - 1), F.when(F.lit(False), F.lit(-1)))
    low = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin") + 1)
    out = df.withColumn("bin", bin_).where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), *aggs)
    return out.withColumn("low", low)


def weighted_mean(value: ColumnLike, weight: ColumnLike, default: ColumnLike | None = None) -> Column:
    """Aggregate Σwv/Σw over rows where both exist; ``default`` replaces an empty or zero total."""
    v, w = col(value), col(weight)
    ok = v.isNotNull() & w.isNotNull()
    out = F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))
    return out if default is None else F.coalesce(out, col(default))


def error_metrics(df: DataFrame, true: str, pred: str, keys: Sequence[str] = (), tails: bool = True) -> DataFrame:
    """MAE, RMSE, wMAPE, MAPE, SMAPE, MAAPE, bias, R2, centred R2/RMSE, correlation, and exact MedAE/P95/P99.

    Squared deviations come from the population variance, so one pass over the rows is enough.
    """
    t, p = F.col(true).cast("double"), F.col(pred).cast("double")
    ok = df.where(t.isNotNull() & p.isNotNull()).withColumn("_ae", F.abs(t - p)).withColumn("_e", p - t)
    ae, e = F.col("_ae"), F.col("_e")
    n = F.count(F.lit(1))
    sse, sst = F.sum(e * e), F.var_pop(t) * n
    aggs = [
        n.alias("n"), F.avg(ae).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.try_divide(100 * F.sum(ae), F.sum(t)).alias("wmape"),
        (100 * F.avg(F.try_divide(ae, F.abs(t)))).alias("mape"),
        F.avg(200 * ae / (F.abs(t) + F.abs(p) + 1e-10)).alias("smape"),
        F.degrees(F.avg(F.atan(ae / (F.abs(t) + 1e-10)))).alias("maape"),
        F.avg(e).alias("bias"), (1 - F.try_divide(sse, sst)).alias("r2"),
        (1 - F.try_divide(F.var_pop(e) * n, sst)).alias("r2_centred"), F.stddev_pop(e).alias("rmse_centred"),
        F.corr(t, p).alias("corr"),
    ]
    base = ok.groupBy(*keys).agg(*aggs) if keys else ok.agg(*aggs)
    if not tails:
        return base
    q = quantiles(ok, "_ae", [0.5, 0.95, 0.99], keys, prefix="ae_p")
    q = q.withColumnRenamed("ae_p50", "medae")
    return base.join(q, list(keys), "left") if keys else base.crossJoin(F.broadcast(q))


def regime_errors(df: DataFrame, true: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Severe-miss counts and regime misclassification of a prediction."""
    t, p = F.col(true), F.col(pred)
    ae = F.abs(p - t)
    high = t >= 100
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [(100 * share(ae > x)).alias(f"over_{x}_pct") for x in (20, 50, 100)]
    aggs += [
        F.count_if(high).alias("n_high"), F.count_if(high & (p < t)).alias("n_high_under"),
        F.avg(F.when(high & (p < t), p - t)).alias("high_under_bias"),
        F.count_if((t > 100) & (p < 50)).alias("high_as_low"), F.count_if((t < 20) & (p > 100)).alias("low_as_high"),
        F.count_if((t > 200) & (p < 100)).alias("very_high_as_mid")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


# --- correlation -----------------------------------------------------------------------------

def pearson_pairs(df: DataFrame, columns: Sequence[str], flag: float = 0.7) -> DataFrame:
    """(a, b, r, flagged) for every unordered pair of the given columns, one aggregation."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"c{i}")
                   for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r"))
                     for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows)).withColumn("flagged", F.coalesce(F.abs("r") > flag, F.lit(False)))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(keys, n, rho): Pearson of average-tie ranks over rows where both exist; ``weight`` repeats a row that many times."""
    times = F.col(weight).cast("double") if weight else F.lit(1.0)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), times.alias("_n"))
    # Rows only matter through the counts of (x, y): collapsing them first removes hot values.
    both = both.groupBy(*keys, "_x", "_y").agg(F.sum("_n").alias("_w"))
    both = cut_lineage(both)
    ranked = _weighted_rank(both, both, "_x", "_rx", keys)
    ranked = _weighted_rank(ranked, both, "_y", "_ry", keys)
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    n = F.sum(w)
    cov = F.sum(w * a * b) - F.sum(w * a) * F.sum(w * b) / n
    va = F.sum(w * a * a) - F.sum(w * a) * F.sum(w * a) / n
    vb = F.sum(w * b * b) - F.sum(w * b) * F.sum(w * b) / n
    aggs = [n.cast("long").alias("n"), F.try_divide(cov, F.sqrt(va * vb)).alias("rho")]
    return ranked.groupBy(*keys).agg(*aggs) if keys else ranked.agg(*aggs)


def _weighted_rank(df: DataFrame, base: DataFrame, value: str, out: str, keys: Sequence[str]) -> DataFrame:
    """Adds the rank of ``value`` counted over ``base``."""
    keys = list(keys)
    vc = base.groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.sum("_w").alias("n"))
    r = _running(vc, keys, ["n"])
    # Ranks are centred on the group's middle to keep the sums of squares small.
    rank = F.col("below_n") + (F.col("n") + 1) / 2 - (F.col("all_n") + 1) / 2
    r = r.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("value").alias("_v"), rank.alias(out))
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(value).cast("double") == F.col("_v")]
    return df.join(r, cond, "inner").drop("_v", *[f"_k{i}" for i in range(len(keys))])


def spearman_p(rho: ColumnLike, n: ColumnLike) -> Column:
    """Two-sided p of rho by the Student approximation with n-2 degrees of freedom."""
    from territoria.functions.special import student_two_sided

    rho, n = col(rho), col(n)
    t = rho * F.sqrt((n - 2) / F.greatest(1 - rho * rho, F.lit(1e-300)))
    return student_two_sided(t, (n - 2).cast("double"))


def screen_features(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, n, rho, strength, flip): rank correlation of each feature with the target, strongest first."""
    long = df.select(target, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [target], list(features), "feature", "value")
    rho = spearman(long, "value", target, ["feature"])
    return rho.withColumn("strength", F.abs("rho")).withColumn("flip", F.coalesce(F.col("rho") < 0, F.lit(False)))


def concordant_pairs(df: DataFrame, score: str, level: str, levels: Sequence[int]) -> DataFrame:
    """Share of pairs ordered the same way by a score and a small set of levels, without forming pairs.

    For each score value, running counts per level give the concordant partners below it.
    ``pct`` counts ties as 0, ``pct_ties_half`` gives pairs tied on the level one half.
    """
    ok = df.where(F.col(score).isNotNull() & F.col(level).isin(*levels))
    names = [f"l{i}" for i in range(len(levels))]
    vc = ok.groupBy(F.col(score).cast("double").alias("value")).agg(
        *[F.sum((F.col(level) == v).cast("long")).alias(n) for n, v in zip(names, levels)])
    vc = vc.withColumn("n", reduce(add, [F.col(n) for n in names]))
    r = _running(vc, [], ["n", *names])
    order = sorted(range(len(levels)), key=lambda i: levels[i])
    conc = reduce(add, [F.col(names[j]) * F.col(f"below_{names[i]}") for a, j in enumerate(order) for i in order[:a]], F.lit(0))
    one = r.agg(F.sum(conc.cast("double")).alias("concordant"), F.max("all_n").cast("double").alias("n"),
                *[F.max(f"all_{n}").cast("double").alias(f"t_{n}") for n in names])
    pairs = F.col("n") * (F.col("n") - 1) / 2
    tied = reduce(add, [F.col(f"t_{n}") * (F.col(f"t_{n}") - 1) / 2 for n in names])
    return one.select(F.col("n").cast("long").alias("n"), F.try_divide(100 * F.col("concordant"), pairs).alias("pct"),
                      F.try_divide(100 * (F.col("concordant") + 0.5 * tied), pairs).alias("pct_ties_half"))


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna())


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation per column: diagonal of the inverse of the (columns x columns) correlation matrix."""
    m = Correlation.corr(_vectors(df, columns), "features").head()[0].toArray()
    inverse = np.linalg.inv(m) if abs(np.linalg.det(m)) > 1e-12 else np.linalg.pinv(m)
    return df.sparkSession.createDataFrame(
        [(c, float(v), bool(v > 5)) for c, v in zip(columns, np.diag(inverse))], "feature string, vif double, flagged boolean")


def pca_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(component, explained, loadings) on standardised columns; all-null columns and partial rows dropped first."""
    filled = df.agg(*[F.count(c).alias(c) for c in columns]).head()
    used = [c for c in columns if filled[c] > 0]
    v = _vectors(df, used)
    scaled = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(v).transform(v)
    model = PCA(k=len(used), inputCol="z", outputCol="pc").fit(scaled)
    pc, ev = model.pc.toArray(), model.explainedVariance.toArray()
    rows = []
    for i in range(len(used)):
        sign = 1.0 if pc[np.argmax(np.abs(pc[:, i])), i] >= 0 else -1.0
        rows.append((i + 1, float(ev[i]), {c: float(sign * pc[j, i]) for j, c in enumerate(used)}))
    return df.sparkSession.createDataFrame(rows, "component int, explained double, loadings map<string,double>")


# --- completeness ----------------------------------------------------------------------------

def completeness(df: DataFrame, keys: Sequence[str], ts: str, step: str, unit: str) -> DataFrame:
    """Per entity and ``unit``: distinct ``step`` buckets seen between the data's first and last bucket, and missing."""
    b = F.date_trunc(step, F.col(ts))
    seen = df.select(*keys, b.alias("bucket")).distinct()
    span = df.agg(F.date_trunc(step, F.min(ts)).alias("_a"), F.date_trunc(step, F.max(ts)).alias("_b"))
    interval = F.expr(f"interval 1 {step}")
    expected = span.select(F.explode(F.sequence("_a", "_b", interval)).alias("bucket"))
    per_unit = expected.groupBy(F.date_trunc(unit, "bucket").cast("date").alias("period")).agg(F.count(F.lit(1)).alias("n_expected"))
    got = seen.groupBy(*keys, F.date_trunc(unit, "bucket").cast("date").alias("period")).agg(F.count(F.lit(1)).alias("n_seen"))
    if keys:
        # The calendar (one struct per period) rides along as one row and is expanded per entity.
        periods = per_unit.agg(F.collect_list(F.struct("period", "n_expected")).alias("_p"))
        grid = seen.select(*keys).distinct().crossJoin(F.broadcast(periods)).select(*keys, F.inline("_p"))
    else:
        grid = per_unit
    out = grid.join(got, [*keys, "period"], "left").withColumn("n_seen", F.coalesce("n_seen", F.lit(0)))
    return out.withColumn("n_missing", F.col("n_expected") - F.col("n_seen")).withColumn(
        "coverage_pct", 100 * F.col("n_seen") / F.col("n_expected"))


def mad_outliers(df: DataFrame, value: str, limit: float = 5.0, minimum: int = 4, out: str = "cleaned") -> DataFrame:
    """Values further than ``limit`` robust deviations from the median become null; skipped when n or MAD is too small."""
    med = quantiles(df, value, [0.5], prefix="_m").withColumnRenamed("_m50", "_med")
    dev = df.crossJoin(F.broadcast(med)).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = quantiles(dev, "_dev", [0.5], prefix="_d").withColumnRenamed("_d50", "_mad")
    n = df.agg(F.count(value).alias("_n"))
    full = dev.crossJoin(F.broadcast(mad)).crossJoin(F.broadcast(n))
    bad = (F.col("_n") >= minimum) & (F.col("_mad") >= 1e-10) & (F.col("_dev") / (1.4826 * F.col("_mad")) > limit)
    return full.withColumn(out, F.when(~F.coalesce(bad, F.lit(False)), F.col(value))).drop("_med", "_dev", "_mad", "_n")


def pure_counts(df: DataFrame, value: str, factors: Mapping[str, float], tol: float, far: float) -> DataFrame:
    """Rows whose value sits within ``tol`` of each factor, and rows further than ``far`` from every one."""
    v = F.col(value)
    near = [F.count_if(F.abs(v - f) < tol).alias(f"near_{k}") for k, f in factors.items()]
    any_near = reduce(lambda a, b: a | b, [F.abs(v - f) < tol for f in factors.values()])
    mixed = reduce(lambda a, b: a & b, [F.abs(v - f) > far for f in factors.values()])
    return df.agg(F.count(v).alias("n"), *near, F.count_if(any_near).alias("n_pure"), F.count_if(mixed).alias("n_mixed"))
