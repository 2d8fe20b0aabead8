"""Data-quality checks as rows, and scorecards over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.operators.ranking import quantiles


@dataclass(frozen=True)
class Rule:
    """``value`` is an aggregate; ``passed`` gets the computed value column and returns a boolean column."""

    name: str
    value: Column
    passed: object
    threshold: float = 0.0
    unit: str = ""
    soft: bool = False
    module: str = "main"


def expect(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows (module, name, passed, value, threshold, unit, message, warning), all rules from one aggregation."""
    one = df.agg(*[r.value.cast("double").alias(f"v{i}") for i, r in enumerate(rules)])
    structs = []
    for i, r in enumerate(rules):
        v = F.col(f"v{i}")
        ok = F.coalesce(r.passed(v), F.lit(False))
        structs.append(F.struct(
            F.lit(r.module).alias("module"), F.lit(r.name).alias("name"), ok.alias("passed"), v.alias("value"),
            F.lit(float(r.threshold)).alias("threshold"), F.lit(r.unit).alias("unit"),
            F.format_string("%s: %.3f (%s)", F.lit(r.name), v, F.when(ok, F.lit("ok")).otherwise(F.lit("out of bounds"))).alias("message"),
            (~ok & F.lit(r.soft)).alias("warning")))
    return one.select(F.inline(F.array(*structs)))


def scorecard(checks: DataFrame) -> DataFrame:
    """Per module: PASS with no failure, WARN with at most two and 70 % passing, else FAIL; score 0-100."""
    agg = checks.groupBy("module").agg(F.count_if("passed").alias("n_pass"), F.count(F.lit(1)).alias("n_total"))
    ratio, fails = F.col("n_pass") / F.col("n_total"), F.col("n_total") - F.col("n_pass")
    pct = F.floor(ratio * 100).cast("int")
    return agg.withColumn("status", F.when(fails == 0, "PASS").when((fails <= 2) & (ratio >= 0.7), "WARN").otherwise("FAIL")).withColumn(
        "score", F.when(fails == 0, F.greatest(F.lit(85), pct)).otherwise(pct))


def go_no_go(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if("passed").alias("n_passed"), F.bool_and("passed").alias("go"))


def integrity_gate(df: DataFrame, mean: str = "wsi_mean", p10: str = "wsi_p10", p90: str = "wsi_p90") -> DataFrame:
    """One row of the facts the gate needs; ``enforce_gate`` turns it into errors."""
    valid = F.col(mean).isNotNull()
    gap = F.abs(F.col(p90) - F.col(p10))
    return df.agg(
        F.count_if(valid).alias("n_valid"), F.max(F.when(valid, gap)).alias("max_gap"),
        (100 * F.avg(F.when(valid, (gap < 1e-6).cast("double")))).alias("equal_pct"),
        F.min(mean).alias("lowest"), F.max(mean).alias("highest")).withColumn(
        "halt", (F.col("n_valid") == 0) | (F.coalesce("max_gap", F.lit(0.0)) < 1e-6) | (F.col("lowest") < -0.01) | (F.col("highest") > 1.01)
    ).withColumn("warn", F.coalesce(F.col("equal_pct") > 10, F.lit(False)))


def enforce_gate(df: DataFrame, **columns: str) -> None:
    facts = integrity_gate(df, **columns).head()
    if facts["halt"]:
        raise ValueError(f"integrity gate: outputs are not publishable: {facts.asDict()}")


def validation_rules(index: str = "spi", bws: str = "bws_norm", mean: str = "wsi_mean", score: str = "score",
                     sigma: str = "wsi_uncertainty", lon: str = "lon", lat: str = "lat") -> list[Rule]:
    """The six plausibility checks of a scored grid."""
    south = (F.col(lon) > 4) & (F.col(lat) < 44)
    west = (F.col(lon) < -1) & (F.col(lat) > 47)
    alps = (F.col(lon) > 5) & (F.col(lat) > 44.5) & (F.col(lat) < 47.5)
    s = F.col(score)
    med, bret = F.avg(F.when(south, F.col(bws))), F.avg(F.when(west, F.col(bws)))
    spread = F.when((F.avg(F.when(s.isNotNull(), s.between(0, 100).cast("double"))) >= 0.999)
                    & (F.max(s) - F.min(s) >= 5), F.stddev_pop(s)).otherwise(F.lit(0.0))
    gradient = F.when(F.coalesce(bret <= 0.10 * 1.2, F.lit(False)), med).otherwise(F.lit(-1.0))
    plausible = F.when(F.stddev_pop(index).between(0.2, 2.0) & (F.count(index) >= 30), F.avg(index))
    return [
        Rule("index_plausible", plausible, lambda v: F.abs(v) < 2.5, 2.5, "index mean"),
        Rule("regional_gradient", gradient, lambda v: v >= 0.04 * 0.8, 0.04, "mean demand stress", soft=True),
        Rule("national_range", F.avg(mean), lambda v: v.between(0.10, 0.50), 0.50, "mean index", soft=True),
        Rule("score_range", spread, lambda v: v >= 1.0, 1.0, "standard deviation"),
        Rule("uncertainty_bounds", F.avg(sigma), lambda v: v.between(0.02, 0.30), 0.30, "mean sigma"),
        Rule("alpine_score", F.avg(F.when(alps, s)), lambda v: v >= 60.0, 60.0, "mean score", soft=True),
    ]


def structure_rules(columns: Sequence[str], required: Sequence[str], ranges: dict[str, tuple[float, float]]) -> list[Rule]:
    """Required columns exist and stay in range (tolerance 0.01)."""
    out = [Rule(f"has_{c}", F.lit(1.0 if c in columns else 0.0), lambda v: v == 1, 1.0, "column", module="structure") for c in required]
    for c, (low, high) in ranges.items():
        worst = F.greatest(F.coalesce(low - F.min(c), F.lit(1e9)), F.coalesce(F.max(c) - high, F.lit(1e9)))
        out.append(Rule(f"range_{c}", worst, lambda v: v <= 0.01, 0.01, "excess", module="ranges"))
    return out


def grid_checks(cells: DataFrame, months: DataFrame, cell: str, known: dict[int, bool]) -> DataFrame:
    """Rows of ``expect``: a scored grid against its own months, over every cell.

    ``cells``: cell, water_score, wsi_mean, wsi_p10, wsi_p90, worst_month_score, summer_mean_score; ``months``: cell, m,
    water_score, wsi. Twelve months a cell, mean and percentiles computed again, the worst month, worst <= summer <= annual,
    months that differ, and points that are known to have a score or none.
    """
    again = months.groupBy(cell).agg(F.count_distinct("m").alias("_months"), F.avg("wsi").alias("_mean"), F.min("water_score").alias("_worst"))
    q = quantiles(months, "wsi", [0.1, 0.9], [cell], prefix="_p")
    j = cells.join(again, cell, "left").join(q, cell, "left")
    c = F.col
    gap = lambda a, b: F.max(F.abs(c(a) - c(b)))
    rules = [
        Rule("twelve_months", F.count_if(F.coalesce(c("_months"), F.lit(0)) != 12), lambda v: v == 0, 0, "cells", module="structure"),
        Rule("mean_again", gap("_mean", "wsi_mean"), lambda v: v < 0.001, 0.001, "gap", module="percentiles"),
        Rule("p10_again", gap("_p10", "wsi_p10"), lambda v: v < 0.002, 0.002, "gap", module="percentiles"),
        Rule("p90_again", gap("_p90", "wsi_p90"), lambda v: v < 0.002, 0.002, "gap", module="percentiles"),
        Rule("widest_spread", F.max(c("wsi_p90") - c("wsi_p10")), lambda v: v > 0.01, 0.01, "spread", module="variation"),
        Rule("spread_share", 100 * F.avg((c("wsi_p90") - c("wsi_p10") > 1e-6).cast("double")), lambda v: v > 90, 90, "%", module="variation"),
        Rule("worst_again", gap("_worst", "worst_month_score"), lambda v: v < 0.1, 0.1, "points", module="seasons"),
        Rule("worst_over_summer", F.count_if(c("worst_month_score") > c("summer_mean_score") + 0.1), lambda v: v == 0, 0, "cells", module="seasons"),
        Rule("summer_over_annual", F.count_if(c("summer_mean_score") > c("water_score") + 0.1), lambda v: v == 0, 0, "cells", module="seasons"),
    ]
    for k, scored in known.items():
        rules.append(Rule(f"point_{k}_{'scored' if scored else 'masked'}", F.count_if((c(cell) == k) & c("water_score").isNotNull()), (lambda v: v == 1) if scored else (lambda v: v == 0), float(scored), "rows", module="mask"))
    return expect(j, rules)


def plausible_ranges(df: DataFrame, key: str, value: str, ranges: DataFrame) -> DataFrame:
    """Share of rows per class inside the class's (low, high)."""
    return df.join(ranges, key, "inner").groupBy(key).agg(
        F.count(value).alias("n"), F.avg(F.col(value).between(F.col("low"), F.col("high")).cast("double")).alias("share_ok"))
