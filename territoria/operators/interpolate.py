"""Inverse-distance interpolation family over the k-nearest and radius joins."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territoria.operators.spatial import knn_join, radius_pairs
from territoria.operators.stats import error_metrics


def live(value: str) -> Column:
    """A reading of zero means missing."""
    return F.nullif(F.col(value), F.lit(0.0))


def idw_weight(dist: Column, p: Column | float, d0: Column | float) -> Column:
    return F.pow(F.greatest(dist, d0 if isinstance(d0, Column) else F.lit(float(d0))), -(p if isinstance(p, Column) else F.lit(float(p))))


def idw_from(neighbours: DataFrame, keys: Sequence[str], value: str, p: float = 2.0, d0: float = 3.0, out: str = "pred") -> DataFrame:
    """Weighted mean over ready neighbour rows; missing neighbours drop out and the rest renormalise."""
    v = live(value)
    w = F.when(v.isNotNull(), idw_weight(F.col("dist"), p, d0))
    return neighbours.groupBy(*keys).agg(F.try_divide(F.sum(w * v), F.sum(w)).alias(out))


def idw(targets: DataFrame, points: DataFrame, value: str, k: int = 7, p: float = 2.0, d0_km: float = 3.0, target_id: str = "id",
        point_id: str = "sid", leave_one_out: bool = False) -> DataFrame:
    near = knn_join(targets, points, k, target_id, point_id, exclude_self=leave_one_out, carry=[value])
    return idw_from(near, [target_id], value, p, d0_km)


def voronoi(targets: DataFrame, points: DataFrame, value: str, target_id: str = "id", point_id: str = "sid", leave_one_out: bool = False) -> DataFrame:
    near = knn_join(targets, points, 1, target_id, point_id, exclude_self=leave_one_out, carry=[value])
    return near.select(target_id, live(value).alias("pred"))


def loo_grid(points: DataFrame, value: str, ks: Sequence[int], d0s: Sequence[float], ps: Sequence[float], point_id: str = "sid",
             floor: float = 5.0) -> DataFrame:
    """Leave-one-out error of every (k, d0, p) and of the nearest neighbour, from one neighbour search.

    Ranked by R2 among wMAPE < 20, then < 30, then the rest.
    """
    right = points.select(F.col(point_id).alias("nid"), "x", "y", live(value).alias("_nv"))
    near = knn_join(points, right, max(ks), point_id, "nid", exclude_self=True, carry=["_nv"])
    grid = [F.struct(F.lit("idw").alias("method"), F.lit(k).alias("k"), F.lit(float(d)).alias("d0"), F.lit(float(p)).alias("p"))
            for k in ks for d in d0s for p in ps]
    grid.append(F.struct(F.lit("voronoi").alias("method"), F.lit(1).alias("k"), F.lit(0.0).alias("d0"), F.lit(0.0).alias("p")))
    rows = near.select(point_id, "dist", "rank", "_nv", F.explode(F.array(*grid)).alias("c")).where(F.col("rank") <= F.col("c.k"))
    w = F.when(F.col("_nv").isNotNull(), idw_weight(F.col("dist"), F.col("c.p"), F.greatest(F.col("c.d0"), F.lit(1e-10))))
    pred = rows.groupBy(point_id, "c").agg(F.try_divide(F.sum(w * F.col("_nv")), F.sum(w)).alias("pred"))
    truth = points.select(point_id, live(value).alias("true")).where(F.col("true") >= floor)
    scored = pred.where(F.col("pred") > 0).join(truth, point_id).select("c.*", "true", "pred")
    m = error_metrics(scored, "true", "pred", ["method", "k", "d0", "p"], tails=False)
    tier = F.when(F.col("wmape") < 20, 0).when(F.col("wmape") < 30, 1).otherwise(2)
    return m.withColumn("tier", tier).orderBy("tier", F.desc("r2"), "method", "k", "d0", "p")


def idw_adaptive(targets: DataFrame, points: DataFrame, value: str, target_id: str = "id", point_id: str = "sid", d0_km: float = 3.0,
                 leave_one_out: bool = False) -> DataFrame:
    """k and p chosen from the spread of the 12 nearest valid values; groups hold at most 12 rows."""
    near = knn_join(targets, points, 12, target_id, point_id, exclude_self=leave_one_out, carry=[value])
    near = near.withColumn("_v", live(value)).where(F.col("_v").isNotNull())
    here = W.partitionBy(target_id)
    q = F.percentile("_v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    stats = near.groupBy(target_id).agg(q.alias("_q"), F.min_by("_v", "rank").alias("_v1"), F.min("dist").alias("_d1"))
    n = near.withColumn("_pos", F.row_number().over(here.orderBy("rank"))).join(stats, target_id)
    g = (F.col("_q")[2] - F.col("_q")[0]) / (F.col("_q")[1] + 1e-6)
    tight = (F.col("_v1") < 15) & (F.col("_d1") < 4) & (g > 1.2)
    k = F.when(tight, 3).when(g > 0.8, 5).otherwise(12)
    p = F.when(tight, 2.2).when(g > 0.8, 2.0).otherwise(2.5)
    w = F.when(F.col("_pos") <= k, idw_weight(F.col("dist"), p, d0_km))
    return n.groupBy(target_id).agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("pred"))


# Defaults of the regime-coherence interpolator and its four ablation variants.
RCAP = {"p0": 2.0, "p_min": 1.5, "p_max": 3.5, "m": 60.0, "s_r": 25.0, "kappa": 12.0, "gamma0": 1.2, "b_h": 15.0, "tau": 10.0, "d0": 3.0}
RCAP_VARIANTS = {"baseline": (False, False, 7), "power_only": (True, False, 10), "coherence_only": (False, True, 10), "full": (True, True, 10)}


def rcap_from(neighbours: DataFrame, key: str, value: str, params: DataFrame) -> DataFrame:
    """(key, config, pred) for every row of ``params``: config, k, adaptive, coherent and the columns of ``RCAP``.

    A first weighted mean and deviation per target set the exponent and the coherence penalty of the final weights.
    """
    rows = neighbours.withColumn("_y", live(value)).where(F.col("_y").isNotNull()).select(key, "dist", "rank", "_y").crossJoin(F.broadcast(params))
    rows = rows.where(F.col("rank") <= F.col("k"))
    here = W.partitionBy(key, "config")
    d = F.greatest("dist", "d0") + 1e-6
    w0 = F.pow(d, -F.col("p0"))
    rows = rows.withColumn("_w0", w0).withColumn("_mu", F.sum(F.col("_w0") * F.col("_y")).over(here) / F.sum("_w0").over(here))
    var = F.sum(F.col("_w0") * F.pow(F.col("_y") - F.col("_mu"), 2)).over(here) / F.sum("_w0").over(here)
    rows = rows.withColumn("_sd", F.sqrt(F.greatest(var, F.lit(0.0))))
    gate = F.exp(-F.pow(F.col("_mu") - F.col("m"), 2) / (2 * F.pow("s_r", F.lit(2.0)))) * F.col("_sd") / (F.col("_sd") + F.col("kappa"))
    p = F.when(F.col("adaptive"), F.col("p_min") + (F.col("p_max") - F.col("p_min")) * gate).otherwise(F.col("p0"))
    gamma = F.col("gamma0") / (1 + F.exp(-(100 - F.col("_mu")) / F.col("b_h")))
    coh = F.when(F.col("coherent"), F.exp(-gamma * F.abs(F.col("_y") - F.col("_mu")) / (F.col("_sd") + F.col("tau")))).otherwise(F.lit(1.0))
    w = F.pow(d, -p) * coh
    return rows.groupBy(key, "config").agg(F.coalesce(F.try_divide(F.sum(w * F.col("_y")), F.sum(w)), F.first("_mu")).alias("pred"))


def rcap_params(spark, configs: Sequence[dict]) -> DataFrame:
    """Parameter rows: each dict names its ``config`` and overrides defaults."""
    cols = ["config", "k", "adaptive", "coherent", *RCAP]
    rows = [tuple({"k": 10, "adaptive": True, "coherent": True, **RCAP, **c}[n] for n in cols) for c in configs]
    return spark.createDataFrame(rows, "config string, k int, adaptive boolean, coherent boolean, " + ", ".join(f"{n} double" for n in RCAP))


def rcap_variants(spark) -> DataFrame:
    return rcap_params(spark, [{"config": n, "adaptive": a, "coherent": c, "k": k} for n, (a, c, k) in RCAP_VARIANTS.items()])


# The grid of the published configuration search.
RCAP_GRID = {"k": (8, 10, 12), "p0": (1.5, 2.0, 2.5), "p_max": (3.0, 3.5, 4.0), "m": (50.0, 60.0, 70.0), "s_r": (20.0, 30.0), "gamma0": (0.8, 1.2, 1.6), "b_h": (10.0, 20.0), "tau": (5.0, 10.0, 15.0)}
#: Rows whose configurations are computed together.
SEARCH_ROWS = 32


def rcap_search(neighbours: DataFrame, targets: DataFrame, key: str, value: str, true: str, base: str, grid: Mapping[str, Sequence[float]] = RCAP_GRID) -> DataFrame:
    """All combinations of ``grid`` over every row of ``targets`` (key, true, base): the grid's columns, the band gains and the objective.

    ``neighbours``: key, rank, dist and value, as many as the largest k. Each row meets all configurations in its own task, over
    its own array of neighbours, and a task returns sums only: the rows are never multiplied by the configurations. A row
    without a live neighbour keeps its base.
    """
    names = list(grid)
    configs = np.array(list(product(*grid.values())))
    c = {n: configs[:, i] for i, n in enumerate(names)} | {n: np.full(len(configs), v) for n, v in RCAP.items() if n not in names}
    bands = ((-math.inf, math.inf), (20, 50), (50, 100), (100, math.inf))
    most = int(c["k"].max())

    def predictions(dist: np.ndarray, y: np.ndarray, base_: np.ndarray) -> np.ndarray:
        """Rows x configurations. ``y`` is not a number where there is no live neighbour of that rank."""
        d = (np.maximum(dist[:, None, :], c["d0"][None, :, None]) + 1e-6)
        use = ~np.isnan(y)[:, None, :] & (np.arange(most)[None, None, :] < c["k"][None, :, None])
        y = np.where(use, y[:, None, :], 0.0)
        w = np.where(use, d ** -c["p0"][None, :, None], 0.0)
        total = w.sum(2)
        mu = (w * y).sum(2) / total
        sd = np.sqrt(np.maximum((w * (y - mu[:, :, None]) ** 2).sum(2) / total, 0.0))
        gate = np.exp(-((mu - c["m"]) ** 2) / (2 * c["s_r"] ** 2)) * sd / (sd + c["kappa"])
        p = c["p_min"] + (c["p_max"] - c["p_min"]) * gate
        gamma = c["gamma0"] / (1 + np.exp(-(100 - mu) / c["b_h"]))
        w = np.where(use, d ** -p[:, :, None] * np.exp(-gamma[:, :, None] * np.abs(y - mu[:, :, None]) / (sd + c["tau"])[:, :, None]), 0.0)
        total = w.sum(2)
        return np.where(total > 0, (w * y).sum(2) / np.where(total > 0, total, 1.0), np.where(np.isnan(mu), base_[:, None], mu))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, gain = np.zeros(len(bands)), np.zeros((len(bands), len(configs)))
        for b in batches:
            t, base_ = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
            for at in range(0, b.num_rows, SEARCH_ROWS):
                part = b.column(2)[at:at + SEARCH_ROWS].to_pylist()
                dist, y = np.ones((len(part), most)), np.full((len(part), most), np.nan)
                for i, near in enumerate(part):
                    for n in near or ():
                        if n["rank"] <= most and n["y"] is not None:
                            dist[i, n["rank"] - 1], y[i, n["rank"] - 1] = n["dist"], n["y"]
                rows = slice(at, at + SEARCH_ROWS)
                with np.errstate(all="ignore"):
                    gains = np.abs(t[rows] - base_[rows])[:, None] - np.abs(t[rows][:, None] - predictions(dist, y, base_[rows]))
                for k, (low, high) in enumerate(bands):
                    inside = (t[rows] >= low) & (t[rows] < high)
                    weight[k] += t[rows][inside].sum()
                    gain[k] += gains[inside].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(configs))), *[pa.array(g) for g in gain], *[pa.array(np.full(len(configs), w)) for w in weight]],
                                         names=["config", *[f"g{k}" for k in range(len(bands))], *[f"w{k}" for k in range(len(bands))]])

    parts = [f"{x}{k}" for x in "gw" for k in range(len(bands))]
    near = neighbours.where(F.col("rank") <= most).groupBy(key).agg(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "dist", live(value).cast("double").alias("y"))).alias("_near"))
    rows = targets.select(key, F.col(true).cast("double").alias("_t"), F.col(base).cast("double").alias("_b")).where(F.col("_t").isNotNull() & F.col("_b").isNotNull())
    rows = rows.join(near, key, "left").select("_t", "_b", "_near")
    total = rows.mapInArrow(sums, "config long, " + ", ".join(f"{p} double" for p in parts)).groupBy("config").agg(*[F.sum(p).alias(p) for p in parts])
    gains = [100 * F.col(f"g{k}") / F.greatest(F.col(f"w{k}"), F.lit(1.0)) for k in range(len(bands))]
    out = total.select("config", *[g.alias(n) for g, n in zip(gains, ("d_all", "d_20_50", "d_50_100", "d_100"))])
    out = out.withColumn("objective", F.col("d_all") + 1.5 * F.col("d_20_50") + 1.5 * F.col("d_50_100") - F.greatest(F.lit(0.0), -F.col("d_100")))
    table = neighbours.sparkSession.createDataFrame([(i, *map(float, r)) for i, r in enumerate(configs)], "config long, " + ", ".join(f"{n} double" for n in names))
    return table.join(out, "config")


def composite_gain(scored: DataFrame, true: str, pred: str, base: str, keys: Sequence[str]) -> DataFrame:
    """Objective J per config: wMAPE gains over the base overall and on the 20-50 and 50-100 bands, minus losses above 100."""
    t = F.col(true)

    def gain(cond: Column) -> Column:
        total = F.greatest(F.sum(F.when(cond, t).otherwise(0.0)), F.lit(1.0))
        return 100 * F.sum(F.when(cond, F.abs(t - F.col(base)) - F.abs(t - F.col(pred))).otherwise(0.0)) / total

    d = scored.groupBy(*keys).agg(gain(F.lit(True)).alias("d_all"), gain((t >= 20) & (t < 50)).alias("d_20_50"),
                                  gain((t >= 50) & (t < 100)).alias("d_50_100"), gain(t >= 100).alias("d_100"))
    objective = F.col("d_all") + 1.5 * F.col("d_20_50") + 1.5 * F.col("d_50_100") - F.greatest(F.lit(0.0), -F.col("d_100"))
    return d.withColumn("objective", objective)


def bus_importance(lines: DataFrame, src: str = "src", dst: str = "dst", rating: str = "s_nom", voltage: str = "voltage") -> DataFrame:
    """(id, importance, voltage): the ratings of all lines that end at a node, and the highest voltage among them."""
    ends = F.explode(F.array_distinct(F.array(src, dst))).alias("id")
    return lines.select(ends, rating, voltage).groupBy("id").agg(F.sum(rating).alias("importance"), F.max(voltage).alias("voltage"))


def capacity_score(sites: DataFrame, nodes: DataFrame, value: str, capacity: str, k: int = 10, p: float = 2.0, d0: float = 5.0,
                   site_id: str = "id", node_id: str = "sid", least_voltage: float | None = None) -> DataFrame:
    """Mean value of the k nodes with the highest capacity/(d+d0)^p, weighted by that score; of ``least_voltage`` and more, if given."""
    live_nodes = nodes.where(F.col(capacity) > 0)
    live_nodes = live_nodes if least_voltage is None else live_nodes.where(F.col("voltage") >= least_voltage)
    near = knn_join(sites, live_nodes, k, site_id, node_id, carry=[value, capacity], weight=capacity,
                    cost=lambda d, w: -w / F.pow(d + d0, F.lit(p)))
    w = F.col(capacity) / F.pow(F.col("dist") + d0, F.lit(p))
    return near.groupBy(site_id).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("pred"), F.count(F.lit(1)).alias("n_nodes"))


def influence_mean(nodes: DataFrame, value: str, influence: str, radius_km: float = 50.0, power: float = 1.5, node_id: str = "sid") -> DataFrame:
    """Mean within the radius weighted by influence / max(d, 1)^power; a node's own value when nothing weighs in.

    Right rows are summed per location first: the weight depends on the location only.
    """
    v = live(value)
    per_spot = nodes.where(v.isNotNull()).groupBy("x", "y").agg(F.sum(F.col(influence) * v).alias("_iv"), F.sum(influence).alias("_i"))
    p = radius_pairs(nodes, per_spot, radius_km, ["_iv", "_i"])
    g = F.pow(F.greatest("dist", F.lit(1.0)), F.lit(-power))
    agg = p.groupBy("x", "y").agg(F.try_divide(F.sum(g * F.col("_iv")), F.sum(g * F.col("_i"))).alias("_m"))
    return nodes.join(agg, ["x", "y"], "left").select(node_id, F.coalesce("_m", value).alias("pred"))


def soft_knn(nodes: DataFrame, value: str, k: int = 15, node_id: str = "sid") -> DataFrame:
    """Mean of the k nearest nodes, itself included, weighted by 1/(d+1)^2."""
    right = nodes.select(F.col(node_id).alias("nid"), "x", "y", F.col(value).alias("_nv"))
    near = knn_join(nodes, right, k, node_id, "nid", carry=["_nv"])
    w = F.when(F.col("_nv").isNotNull(), F.pow(F.col("dist") + 1, F.lit(-2.0)))
    return near.groupBy(node_id).agg((F.sum(w * F.col("_nv")) / F.sum(w)).alias("pred"))


def kernel_smooth(points: DataFrame, value: str, sigma_km: float, point_id: str = "sid") -> DataFrame:
    """Gaussian smoothing over 3 sigma; a point with no other neighbour keeps its value, and with sigma 0 all do."""
    if sigma_km == 0:
        return points.select(point_id, F.col(value).alias("raw"), F.col(value).alias("smoothed"))
    per_spot = points.groupBy("x", "y").agg(F.sum(value).alias("_s"), F.count(value).alias("_c"), F.count(F.lit(1)).alias("_n"))
    p = radius_pairs(points, per_spot, 3 * sigma_km, ["_s", "_c", "_n"])
    w = F.exp(-0.5 * F.pow(F.col("dist") / sigma_km, F.lit(2.0)))
    agg = p.groupBy("x", "y").agg(F.try_divide(F.sum(w * F.coalesce("_s", F.lit(0.0))), F.sum(w * F.col("_c"))).alias("_m"), F.sum("_n").alias("_k"))
    out = F.when((F.col("_k") >= 2) & F.col("_m").isNotNull(), F.col("_m")).otherwise(F.col(value))
    return points.join(agg, ["x", "y"], "left").select(point_id, F.col(value).alias("raw"), out.alias("smoothed"))


def variance_loss(smoothed: DataFrame) -> DataFrame:
    return smoothed.agg((1 - F.var_pop("smoothed") / F.greatest(F.var_pop("raw"), F.lit(1e-6))).alias("signal_loss"),
                        F.stddev_pop("smoothed").alias("std"), F.avg("smoothed").alias("mean"))
