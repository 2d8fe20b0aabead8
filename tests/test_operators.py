import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from territoria.operators import energy, graph, grid, inference, interpolate, joins, learning, quality, ranking, series, spatial, stats
from territoria.session import cut_lineage


@pytest.fixture(scope="module")
def hot_points(spark):
    """A third of all points sits in one tiny area, some on the very same spot."""
    rng = np.random.default_rng(5)
    spread = rng.uniform(0, 900, (160, 2))
    tight = 450 + rng.uniform(0, 0.5, (60, 2))
    stack = np.repeat([[450.25, 450.25]], 20, axis=0)
    pts = np.vstack([spread, tight, stack])
    return pts, spark.createDataFrame([(i, float(x), float(y), float(i % 7 + 1)) for i, (x, y) in enumerate(pts)], "sid long, x double, y double, v double")


def brute_knn(pts, i, k, skip_self):
    d = np.hypot(*(pts - pts[i]).T)
    order = sorted((round(float(d[j]), 9), j) for j in range(len(pts)) if not (skip_self and j == i))
    return [j for _, j in order[:k]]


@pytest.mark.parametrize("leaf", [2, 32])
def test_knn_is_exact_with_a_hot_area(spark, hot_points, leaf):
    pts, df = hot_points
    got = spatial.knn_join(df, df.select(F.col("sid").alias("nid"), "x", "y"), 5, "sid", "nid", exclude_self=True, leaf=leaf).collect()
    near = {}
    for r in got:
        near.setdefault(r["sid"], {})[r["rank"]] = (r["nid"], r["dist"])
    assert len(near) == len(pts)
    for i in range(len(pts)):
        expected = brute_knn(pts, i, 5, True)
        want = sorted(np.hypot(*(pts[j] - pts[i])) for j in expected)
        assert [near[i][k][1] for k in range(1, 6)] == pytest.approx(want, abs=1e-9)


def test_radius_sums_match_pairs(spark, hot_points):
    pts, df = hot_points
    got = {r["sid"]: (r["n"], r["s"]) for r in spatial.radius_sums(df, df, 30.0, {"n": F.lit(1), "s": F.col("v")}, "sid", leaf=2).collect()}
    for i in range(len(pts)):
        inside = np.hypot(*(pts - pts[i]).T) <= 30
        assert got[i] == (inside.sum(), sum(j % 7 + 1 for j in np.where(inside)[0]))


def test_weighted_cost_search_is_exact(spark, hot_points):
    pts, df = hot_points
    sites = spark.createDataFrame([(0, 10.0, 10.0), (1, 450.0, 451.0)], "id long, x double, y double")
    got = interpolate.capacity_score(sites, df, "v", "v", k=4, p=2.0, d0=5.0).collect()
    for r in got:
        x, y = [(10.0, 10.0), (450.0, 451.0)][r["id"]]
        sc = [((j % 7 + 1) / (math.hypot(pts[j][0] - x, pts[j][1] - y) + 5) ** 2, j) for j in range(len(pts))]
        top = sorted(sc, key=lambda s: (-s[0], s[1]))[:4]
        assert r["pred"] == pytest.approx(sum(s * (j % 7 + 1) for s, j in top) / sum(s for s, _ in top))


def test_nearest_join_falls_back(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 900.0)], "id long, x double, y double")
    right = spark.createDataFrame([(7, 3.0, 4.0, 12.0)], "sid long, x double, y double, score double")
    rows = {r["id"]: r for r in spatial.nearest_join(left, right, max_km=100, carry=["score"], fallback={"score": 50.0}).collect()}
    assert (rows[1]["score"], rows[1]["dist"], rows[1]["covered"]) == (12.0, 5.0, True)
    assert (rows[2]["score"], rows[2]["covered"]) == (50.0, False)


def test_surrogate_key_keeps_large_keys_apart(spark):
    keys = [2**53 + i for i in range(20)]
    out = ranking.surrogate_key(spark.createDataFrame([(k,) for k in reversed(keys)], "k long"), "k").collect()
    assert {r["k"]: r["sk"] for r in out} == {k: i + 1 for i, k in enumerate(keys)}


def test_rank_blocks_agree_with_one_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vals = np.concatenate([np.full(300, 7.0), rng.integers(0, 50, 300).astype(float), rng.normal(size=300)])
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", float(v)) for i, v in enumerate(vals)], "id long, g string, v double")
    plain = sorted(map(tuple, ranking.value_ranks(df, "v", ["g"]).collect()))
    q1 = ranking.quantiles(df, "v", [0.1, 0.5, 0.95]).head()
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, ranking.value_ranks(df, "v", ["g"]).collect())) == plain
    q2 = ranking.quantiles(df, "v", [0.1, 0.5, 0.95]).head()
    assert tuple(q2) == pytest.approx(tuple(q1))
    assert tuple(q1) == pytest.approx(tuple(np.percentile(vals, [10, 50, 95])))
    sk = [r["sk"] for r in ranking.surrogate_key(df, "v", "id").orderBy("v", "id").collect()]
    assert sk == list(range(1, len(vals) + 1))


def test_spearman_concordance_and_metrics(spark):
    rng = np.random.default_rng(4)
    h, lv = rng.integers(0, 30, 200).astype(float), rng.integers(1, 5, 200)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(h, lv)], "h double, lv int")

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    assert stats.spearman(df, "h", "lv").head()["rho"] == pytest.approx(np.corrcoef(ranks(h), ranks(lv))[0, 1], abs=1e-12)
    pairs = list(itertools.combinations(range(200), 2))
    c = sum((h[i] - h[j]) * (lv[i] - lv[j]) > 0 for i, j in pairs)
    assert stats.concordant_pairs(df, "h", "lv", [1, 2, 3, 4]).head()["pct"] == pytest.approx(100 * c / len(pairs))
    m = stats.error_metrics(df.select((F.col("h") + 1).alias("t"), F.col("lv").cast("double").alias("p")), "t", "p").head()
    e = lv - h - 1
    assert m["rmse"] == pytest.approx(math.sqrt((e**2).mean())) and m["r2"] == pytest.approx(1 - (e**2).sum() / ((h - h.mean()) ** 2).sum())
    assert m["ae_p95"] == pytest.approx(np.percentile(np.abs(e), 95))


def test_nearest_in_time(spark):
    rng = np.random.default_rng(8)
    base = np.datetime64("2024-01-01T00:00:00")
    lt, rt = np.sort(rng.integers(0, 400000, 60)), np.unique(rng.integers(0, 400000, 25))
    left = spark.createDataFrame([(i, 1, (base + np.timedelta64(int(s), "s")).item()) for i, s in enumerate(lt)], "id long, k int, ts timestamp_ntz")
    right = spark.createDataFrame([(1, (base + np.timedelta64(int(s), "s")).item(), float(s)) for s in rt], "k int, ts timestamp_ntz, v double")
    got = {r["id"]: r["nearest"] for r in joins.nearest_in_time(left, right, ["k"], "ts", "v", 3600).collect()}
    for i, s in enumerate(lt):
        assert abs(got[i] - s) == min(abs(rt - s))


def test_run_lengths_and_rolling(spark):
    flags = [1, 1, 0, 1, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([("a", i, float(f), None if i == 4 else 1.0) for i, f in enumerate(flags)], "k string, t int, f double, v double")
    m = series.mean_run_length(df, ["k"], "t", F.col("f") == 1).head()
    assert (m["n_runs"], m["mean_run"]) == (3, 2.0)
    s = [r["s"] for r in df.select("t", series.rolling_sum("v", ["k"], "t", 3).alias("s")).orderBy("t").collect()]
    assert s == [None, None, 3.0, 3.0, None, None, None, 3.0, 3.0]


def test_drought_index_edge_rules(spark):
    zeros = [("dry", i, 0.0) for i in range(12)] + [("short", i, float(i)) for i in range(5)] + [("ok", i, float(i + 1)) for i in range(24)]
    df = spark.createDataFrame(zeros, "c string, i int, p double")
    rows = series.spi_gamma(df, ["c"], "p", F.lit(True)).collect()
    assert {r["spi"] for r in rows if r["c"] == "dry"} == {0.0}
    assert {r["spi"] for r in rows if r["c"] == "short"} == {None}
    ok = [r["spi"] for r in sorted(rows, key=lambda r: r["p"]) if r["c"] == "ok"]
    assert ok == sorted(ok) and abs(np.mean(ok)) < 0.1
    for f in (series.spei_loglogistic, series.spei_pearson3, series.spei_ecdf):
        z = [r["spei"] for r in f(df.where("c = 'ok'"), ["c"], "p", F.lit(True)).orderBy("p").collect()]
        assert z == sorted(z) and abs(np.mean(z)) < 0.3


def test_grid_tools(spark):
    g = grid.metric_grid()
    assert (g.nx, g.ny, g.x0, g.y0) == (400, 240, -697500.0, 7197500.0)
    assert grid.lonlat_grid("30km").nx == len(np.arange(-5.2 + 15 / 111, 9.8, 30 / 111))
    small = grid.Grid(0.0, 0.0, 1.0, 1.0, 5, 3)
    cells = small.table(spark).withColumn("v", (F.col("ix") + 10 * F.col("iy")).cast("double"))
    assert cells.count() == 15
    t = spark.createDataFrame([(1, 1.25, 0.5), (2, 9.0, 0.0), (3, 4.0, 2.0)], "id long, x double, y double")
    b = {r["id"]: r["value"] for r in grid.bilinear(t, cells, small, "v").collect()}
    assert b[1] == pytest.approx(1.25 + 5) and b[2] is None and b[3] == pytest.approx(24)
    c = {(r["ix"], r["iy"]): r["v"] for r in grid.coarsen(cells, 2, 5, 3, "v").collect()}
    a = np.pad(np.add.outer(10 * np.arange(3), np.arange(5)).astype(float), ((0, 1), (0, 1)), mode="edge")
    assert c == {(i, j): pytest.approx(a[2 * j:2 * j + 2, 2 * i:2 * i + 2].mean()) for i in range(3) for j in range(2)}
    holes = cells.withColumn("cell", F.col("iy") * 5 + F.col("ix")).withColumn("v", F.when(F.col("ix") != 2, F.col("v")))
    filled = {r["cell"]: r["v"] for r in grid.fill_nearest(holes, "v").collect()}
    assert filled[2] == 1.0 and filled[7] == 11.0 and None not in filled.values()


def test_synthetic_cube_is_seeded(spark):
    cells = spark.range(20).select(F.col("id").cast("int").alias("ix"))
    a = grid.synthetic_cube(cells, "2022-01-01", "2022-12-01").orderBy("ix", "month").collect()
    assert len(a) == 240 and a == grid.synthetic_cube(cells, "2022-01-01", "2022-12-01").orderBy("ix", "month").collect()


@pytest.fixture(scope="module")
def net(spark):
    rng = np.random.default_rng(11)
    e = sorted({tuple(sorted(map(int, p))) for p in rng.integers(0, 24, (40, 2)) if p[0] != p[1]} | {(30, 31), (31, 32)})
    w = {p: float(rng.uniform(0.3, 2)) for p in e}
    edges = spark.createDataFrame([(a, b, w[(a, b)], 1 / w[(a, b)]) for a, b in e], "src long, dst long, impedance double, admittance double")
    nodes = spark.createDataFrame([(i,) for i in sorted({x for p in e for x in p} | {40})], "id long")
    return e, w, nodes, edges


def test_components_and_pagerank(spark, net):
    e, w, nodes, edges = net
    lab = {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()}
    parent = {i: i for i in lab}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in e:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    assert lab == {i: min(j for j in lab if root(j) == root(i)) for i in lab}
    ids = sorted(lab)
    n = len(ids)
    m = np.zeros((n, n))
    for (a, b), z in w.items():
        m[ids.index(a), ids.index(b)] = m[ids.index(b), ids.index(a)] = 1 / z
    p = np.full(n, 1 / n)
    tot = m.sum(1)
    for _ in range(12):
        p = 0.15 / n + 0.85 * ((m / np.where(tot > 0, tot, 1)[:, None]).T @ p + p[tot == 0].sum() / n)
    got = {r["id"]: r["pagerank"] for r in graph.pagerank(nodes, edges, iters=12).collect()}
    assert [got[i] for i in ids] == pytest.approx(list(p), abs=1e-12)


@pytest.mark.parametrize(("block", "cells", "joined"), [(1 << 20, 1 << 22, 400), (1 << 20, 1, 400), (100, 1 << 22, 5000)])
def test_bounded_distances_in_blocks(spark, monkeypatch, block, cells, joined):
    """All sources as arrays by block, a few at a time, or by joins where a block is large, give what sources by joins give; a node without short lines reaches itself."""
    rounds, cut = [], graph.cut_lineage

    def counted(df):
        out = cut(df)
        if "_new" in out.columns:
            rounds.append(out.count())
        return out

    for name, x in (("SOURCES", 50), ("BLOCK_LINES", block), ("CELLS", cells), ("cut_lineage", counted)):
        monkeypatch.setattr(graph, name, x)
    edges = spark.createDataFrame([(i, i + 1, 0.1 + i % 7 / 10) for i in range(200)] + [(i, i // 2, 0.3 + i % 3 / 10) for i in range(190, 200)] + [(900, 901, 9.0)], "src long, dst long, z double")
    got = {(r["source"], r["id"], r["dist"]) for r in graph.bounded_distances(edges, "z", 2.0).collect()}
    assert max(rounds) <= joined
    every = spark.range(1000).select("id").where("id <= 200 OR id IN (900, 901)")
    want = {(r["source"], r["id"], r["dist"]) for r in graph.bounded_distances(edges, "z", 2.0, every).collect()}
    assert got == want and (900, 900, 0.0) in got and len(got) > 1000


def test_bounded_distances_and_betweenness(spark, net):
    e, w, nodes, edges = net
    ids = sorted({x for p in e for x in p})
    d = {(a, b): (0.0 if a == b else math.inf) for a in ids for b in ids}
    hop = dict(d)
    for (a, b), z in w.items():
        d[a, b] = d[b, a] = z
        hop[a, b] = hop[b, a] = 1
    for k in ids:
        for a in ids:
            for b in ids:
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
                hop[a, b] = min(hop[a, b], hop[a, k] + hop[k, b])
    got = {(r["source"], r["id"]): r["dist"] for r in graph.bounded_distances(edges, "impedance", 2.5).collect()}
    assert got == {k: pytest.approx(v) for k, v in d.items() if v <= 2.5}
    adj = {a: [b for b in ids if hop[a, b] == 1] for a in ids}

    def paths(s):
        sigma = {s: 1}
        for v in sorted((v for v in ids if hop[s, v] < math.inf), key=lambda v: hop[s, v])[1:]:
            sigma[v] = sum(sigma[u] for u in adj[v] if hop[s, u] == hop[s, v] - 1)
        return sigma

    sig = {s: paths(s) for s in ids}
    want = {v: 0.0 for v in ids}
    for s in ids:
        for t in sig[s]:
            for v in sig[s]:
                if v not in (s, t) and t != s and hop[s, v] + hop[v, t] == hop[s, t]:
                    want[v] += sig[s][v] * sig[v][t] / sig[s][t]
    b = {r["id"]: r["betweenness"] for r in graph.sampled_betweenness(edges, nodes.where("id != 40")).collect()}
    for v in ids:
        assert b.get(v, 0.0) == pytest.approx(want[v], abs=1e-9)


def test_traced_mix_solves_the_balance(spark):
    flows = spark.createDataFrame([(0, 1, 4.0), (1, 2, 2.0), (0, 2, -1.0), (2, 3, 2.0)], "src long, dst long, flow double")
    prod = spark.createDataFrame([(0, 5.0, 50.0), (1, 1.0, 400.0), (2, 2.0, 0.0), (3, 0.0, 0.0)], "id long, prod double, co2 double")
    got = {r["id"]: r["mix"] for r in graph.trace_mix(flows, prod, tol=1e-12).collect()}
    a = np.diag([6.0, 5.0, 4.0, 2.0])
    a[1, 0], a[2, 1], a[0, 2], a[3, 2] = -4, -2, -1, -2
    assert [got[i] for i in range(4)] == pytest.approx(list(np.linalg.solve(a, [50, 400, 0, 0])), abs=1e-6)


def test_traced_mix_settles_in_blocks(spark, monkeypatch):
    """A chain of 200 nodes takes few rounds, as a block settles in one; blocks and snapshots keep the balance."""
    monkeypatch.setattr(graph, "MIX_NODES", 64, raising=False)
    rows = [(k, i, i + 1, 10.0) for k in (0, 1) for i in range(200)] + [(k, 190, 3, 2.0 + k) for k in (0, 1)]
    flows = spark.createDataFrame(rows, "ts int, src long, dst long, flow double")
    made = [(k, i, 10.0 if i == 0 else 1.0, 300.0 * (k + 1) if i == 0 else 7.0 * (i % 5)) for k in (0, 1) for i in range(201)]
    prod = spark.createDataFrame(made, "ts int, id long, prod double, co2 double")
    got = {(r["ts"], r["id"]): r["mix"] for r in graph.trace_mix(flows, prod, ["ts"], iters=30, tol=1e-10).collect()}
    assert len(got) == 402
    for k in (0, 1):
        a, e = np.zeros((201, 201)), np.zeros(201)
        for t, i, p, c in made:
            if t == k:
                a[i, i], e[i] = a[i, i] + p, c
        for t, i, j, mw in rows:
            if t == k:
                a[j, j], a[j, i] = a[j, j] + mw, a[j, i] - mw
        assert [got[k, i] for i in range(201)] == pytest.approx(list(np.linalg.solve(a, e)), abs=1e-7)


def test_laplacian_matches_a_dense_solve(spark, net):
    e, w, nodes, edges = net
    ids = sorted({x for p in e for x in p})
    vals = {i: float(10 + i * 7 % 50) for i in ids}
    v = spark.createDataFrame(list(vals.items()), "id long, value double")
    got = {r["id"]: r["pred"] for r in learning.local_laplacian(v, edges, "admittance", hops=30, tol=1e-11).collect()}
    ball = [i for i in ids if i not in (30, 31, 32) and i in got]
    t = ball[0]
    comp = {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()}
    ball = [i for i in ids if comp[i] == comp[t]]
    m = np.array([[1 / w[tuple(sorted((a, b)))] if tuple(sorted((a, b))) in w else 0.0 for b in ball] for a in ball])
    s = 1 / np.sqrt(m.sum(1))
    lap = np.eye(len(ball)) - s[:, None] * m * s[None, :]
    seen = np.array([i != t for i in ball], float)
    u = np.linalg.solve(np.diag(seen) + lap, seen * np.array([vals[i] for i in ball]))
    assert got[t] == pytest.approx(max(0, u[ball.index(t)]), abs=1e-9)


def test_dispatch_keeps_totals(spark):
    prod = spark.createDataFrame([(1, "a", 10.0), (1, "b", 5.0), (2, "a", 4.0)], "ts int, carrier string, mw double")
    plants = spark.createDataFrame([(1, "a", 1.0, "z"), (2, "a", 3.0, "y"), (3, "b", 2.0, "z")], "gen int, carrier string, cap double, zone string")
    d = energy.disaggregate(prod, plants)
    assert {(r["ts"], r["gen"]): r["mw"] for r in d.collect()} == {(1, 1): 2.5, (1, 2): 7.5, (1, 3): 5.0, (2, 1): 1.0, (2, 2): 3.0}
    assert {r["kept_pct"] for r in energy.conservation(prod, d, ["carrier"]).collect()} == {100.0}
    pooled = energy.pool_within(d.select("ts", "gen", "mw"), plants, 0.3)
    for r in pooled.groupBy("ts", "zone").agg(F.sum("mw").alias("a"), F.sum("pooled").alias("b")).where("ts = 1").collect():
        assert r["a"] == pytest.approx(r["b"])


def test_dispatch_repeats_the_hours_not_the_plants(spark):
    """Repeated plants are broadcast by their size before the repeats, which fills the driver."""
    prod = spark.createDataFrame([(1, "a", 10.0), (1, "b", 10.0)], "ts int, carrier string, mw double")
    plants = spark.range(200).selectExpr("id AS gen", "if(id % 2 = 0, 'a', 'b') AS carrier", "1D AS cap")
    d = energy.disaggregate(prod, plants)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [carrier" in plan and plan.count("Generate explode") == 1 and plan.index("Generate explode") < plan.index("Range (0, 200")
    assert d.count() == 200 and d.agg(F.sum("mw")).first()[0] == pytest.approx(20.0)


def test_resampling_inference(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=150)
    y = x + rng.normal(size=150)
    df = spark.createDataFrame([(i, float(a), float(-a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, neg double, y double")
    ci = {r["model"]: r for r in inference.interval(inference.bootstrap_rho(df, "id", ["x", "neg"], "y", 40), "rho", ["model"]).collect()}
    rho = stats.spearman(df, "x", "y").head()["rho"]
    assert ci["x"]["low"] < rho < ci["x"]["high"] and ci["neg"]["median"] == pytest.approx(-ci["x"]["median"])
    p = inference.permutation_null(df, "id", "x", "y", 40).head()
    assert p["observed"] == pytest.approx(rho) and p["p_value"] == 0 and abs(p["median"]) < 0.15
    perm = inference.permutations(df, "id", 3, 1)
    assert perm.groupBy("rep").agg(F.count_distinct("_i")).collect()[0][1] == 150
    mc = inference.monte_carlo(spark.createDataFrame([(1, 0.5, 0.4, 0.3)], "id long, bws double, gws double, drought double"), "id", 4000).head()
    sd = math.sqrt((0.6 * 0.12 * 0.5) ** 2 + (0.25 * 0.18 * 0.4) ** 2 + (0.15 * 0.22 * 0.3) ** 2)
    assert mc["mc_mean"] == pytest.approx(0.445, abs=0.005) and mc["mc_std"] == pytest.approx(sd, rel=0.06)


def test_variance_indices_of_an_additive_model(spark):
    df = spark.createDataFrame([(1,)], "id long")
    s = {r["param"]: r for r in inference.sobol(df, "id", {"a": (0.0, 1.0), "b": (0.0, 2.0), "c": (0.0, 1.0)}, lambda p: p["a"] + p["b"], 4000).collect()}
    assert s["a"]["total"] == pytest.approx(0.2, abs=0.03) and s["b"]["total"] == pytest.approx(0.8, abs=0.05)
    assert s["b"]["first_order"] == pytest.approx(0.8, abs=0.06) and s["c"]["total"] == pytest.approx(0, abs=1e-9)


def test_checks_and_gate(spark):
    good = spark.createDataFrame([(0.4, 0.3, 0.5), (0.2, 0.1, 0.3)], "wsi_mean double, wsi_p10 double, wsi_p90 double")
    quality.enforce_gate(good)
    with pytest.raises(ValueError):
        quality.enforce_gate(good.withColumn("wsi_p90", F.col("wsi_p10")))
    rules = [quality.Rule(f"r{i}", F.lit(float(i)), lambda v: v < 3, 3.0) for i in range(4)]
    card = quality.scorecard(quality.expect(good, rules)).head()
    assert (card["status"], card["score"]) == ("WARN", 75)


def test_forest_learns_and_importance_finds_the_signal(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, float(a), float(b), float(3 * a)) for i, (a, b) in enumerate(rng.uniform(size=(300, 2)))], "id long, a double, b double, y double")
    f = learning.fit_forest(df, ["a", "b"], "y", trees=10)
    imp = {r["feature"]: r["importance"] for r in learning.permutation_importance(f, df, "id", "y", repeats=2).collect()}
    assert imp["a"] > 0.5 > abs(imp["b"])


def test_arrays_and_tables_draw_the_same(spark, monkeypatch):
    """Replicates from one row of arrays, and from joined and ranked tables beyond the bound, with ties in every column."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(3 * i), float(a), float(b), int(c)) for i, (a, b, c) in enumerate(rng.integers(0, 9, (60, 3)))], "id long, a double, b double, y int")
    runs = []
    for bound in (inference.ARRAY_ROWS, 0):
        monkeypatch.setattr(inference, "ARRAY_ROWS", bound)
        boot = {(r["model"], r["rep"]): r["rho"] for r in inference.bootstrap_rho(df, "id", ["a", "b"], "y", 7).collect()}
        runs.append((boot, {r["rep"]: r["rho"] for r in inference.permutation_rho(df, "id", "a", "y", 5).collect()}))
    assert runs[0][0] == pytest.approx(runs[1][0]) and len(runs[0][0]) == 14 and runs[0][1] == pytest.approx(runs[1][1]) and len(runs[0][1]) == 5
    assert inference.bootstrap_rho(df.limit(0), "id", ["a"], "y", 3).count() == 0 and inference.permutation_rho(df.limit(0), "id", "a", "y", 3).where("rho IS NOT NULL").count() == 0


def test_permutations_stay_one_to_one_when_draws_tie(spark, monkeypatch):
    monkeypatch.setattr(inference, "drawn", lambda seed, rep, draw: F.col(draw) % 3)
    df = spark.createDataFrame([(5 * i, i) for i in range(40)], "id long, y long")
    perm = [tuple(r) for r in inference.permutations(df, "id", 2, 1).select("rep", "id", "_i").collect()]
    want = {5 * i: k for k, i in enumerate(sorted(range(40), key=lambda i: (i % 3, i)))}
    assert sorted(perm) == sorted((rep, i, k) for rep in range(2) for i, k in want.items())


def test_words_are_the_same_in_both_engines(spark):
    got = [r["w"] for r in spark.range(9).select(inference.drawn(7, "id", "id").alias("w")).collect()]
    assert got == [int(inference.words(7, rep, 9)[rep]) for rep in range(9)]


def test_array_statistics(spark):
    x = np.random.default_rng(1).normal(size=50)
    row = spark.createDataFrame([(x.tolist(),), ([2.0],), ([],)], "x array<double>").select(
        inference.array_mean(F.col("x")).alias("m"), inference.array_variance(F.col("x")).alias("v"), inference.array_quantile(F.sort_array("x"), 0.1).alias("q")).collect()
    assert tuple(row[0]) == pytest.approx((x.mean(), x.var(), np.quantile(x, 0.1))) and tuple(row[1]) == (2.0, 0.0, 2.0) and row[2]["q"] is None


def ring_facts(x, y, ring):
    """Even-odd containment and distance to the edges."""
    inside, far = False, []
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
        ux, uy = bx - ax, by - ay
        t = min(max(((x - ax) * ux + (y - ay) * uy) / (ux * ux + uy * uy), 0), 1)
        far.append(math.hypot(x - ax - t * ux, y - ay - t * uy))
    return inside, min(far)


def city(rng):
    """Stars of every size, most of them over one city, and points that lie there too, some on corners."""
    rings = {}
    for k in range(60):
        cx, cy = (10.2, 45.1) + rng.normal(size=2) * (0.05 if k < 45 else 3)
        angles = np.sort(rng.uniform(0, 2 * math.pi, 9))
        rings[k] = [(float(cx + r * math.cos(a)), float(cy + r * math.sin(a))) for a, r in zip(angles, rng.uniform(0.01, 0.04 if k < 45 else 2.5, 9))]
    points = [tuple(map(float, p)) for p in np.vstack([(10.2, 45.1) + rng.normal(size=(150, 2)) * 0.06, rng.uniform((2, 38), (18, 52), (80, 2))])] + [rings[3][0], rings[50][4], rings[3][0]]
    return rings, points


@pytest.mark.parametrize(("near", "largest", "few", "depth"), [(1.0, False, 4, 6), (0.02, False, 1, 6), (None, True, 2, 3), (0.3, True, 0, 0)])
def test_polygon_join_over_a_city(spark, near, largest, few, depth):
    rings, points = city(np.random.default_rng(6))
    polys = spark.createDataFrame([(k, [{"lon": x, "lat": y} for x, y in r], k * 1.5) for k, r in rings.items()], "zid long, ring array<struct<lon:double,lat:double>>, sev double")
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)] + [(900, None, 1.0)], "id long, lon double, lat double")
    got = {r["id"]: (r["zid"], r["sev"], r["how"]) for r in spatial.polygon_join(df, polys, "zid", ["sev"], near=near, largest=largest, few=few, depth=depth).collect()}
    area = {k: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))) / 2 for k, r in rings.items()}
    want = {900: (None, None, "none")}
    for i, (x, y) in enumerate(points):
        facts = {k: ring_facts(x, y, r) for k, r in rings.items()}
        hit = min((k for k, f in facts.items() if f[0]), key=lambda k: ((-round(area[k], 9)) if largest else 0, k), default=None)
        close = min((k for k, f in facts.items() if near is not None and f[1] <= near), key=lambda k: (round(facts[k][1], 9), k), default=None)
        k = close if hit is None else hit
        want[i] = (k, None if k is None else k * 1.5, "inside" if hit is not None else "near" if close is not None else "none")
    assert got == want


def test_polygon_tests_stay_few_in_a_city(spark):
    """45 polygons within a tenth of a degree and 20,000 points among them: a point meets a few rings, not all."""
    rng = np.random.default_rng(6)
    rings, _ = city(rng)
    polys = spark.createDataFrame([(k, [{"lon": x, "lat": y} for x, y in r]) for k, r in rings.items()], "zid long, ring array<struct<lon:double,lat:double>>")
    polys = polys.withColumn("_order", F.struct(F.col("zid").alias("k")))
    spots = spark.createDataFrame([tuple(map(float, p)) for p in (10.2, 45.1) + rng.normal(size=(20_000, 2)) * 0.06], "lon double, lat double")
    n = spatial.polygon_tests(spots, polys, "zid", 1.0, 1.0, spatial.FEW_POLYGONS, spatial.CELL_SPLITS).groupBy("lon", "lat").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).head()
    assert n["all"] < 4 * 20_000 and n["most"] <= 15


@pytest.mark.parametrize("most", [2048, 7])
def test_radius_pairs_of_a_dense_cell(spark, hot_points, most):
    pts, df = hot_points
    got = spatial.radius_pairs(df, df, 2.0, ["sid"], most).collect()
    spots = {tuple(p) for p in pts}
    want = sorted((x, y, j) for x, y in spots for j in range(len(pts)) if math.hypot(*(pts[j] - (x, y))) <= 2.0)
    assert sorted((r["x"], r["y"], r["sid"]) for r in got) == want


def test_all_points_in_one_cell_meet_in_bounded_slices(spark):
    df = spark.range(3000).select(F.col("id").alias("sid"), (F.col("id") / 3000).alias("x"), F.lit(0.5).alias("y"))
    sides = spatial.radius_cells(df, df, 100.0, ["sid"], 200)
    for side in sides:
        assert side.groupBy("cx", "cy", "_ls", "_rs").count().agg(F.max("count")).head()[0] < 2 * 200
    assert spatial.radius_pairs(df, df, 100.0, ["sid"], 200).count() == 9_000_000


@pytest.mark.parametrize(("leaf", "max_km"), [(2, None), (32, 40.0), (2, 0.02)])
def test_nearest_of_another_group(spark, hot_points, leaf, max_km):
    """Copies of one spot in several groups, and a dense area that is of one group but for a node."""
    pts, _ = hot_points
    group = [0 if 160 <= i < 239 else i % 3 for i in range(len(pts))]
    df = spark.createDataFrame([(i, float(x), float(y), g) for i, ((x, y), g) in enumerate(zip(pts, group))] + [(900, None, 1.0, 1), (901, 5.0, 5.0, None)], "id long, x double, y double, g int")
    got = {(r["x"], r["y"], r["g"]): (r["_b"], r["dist"]) for r in spatial.nearest_of_another_group(df, "g", max_km=max_km, leaf=leaf).collect()}
    want = {}
    for i, p in enumerate(pts):
        d = np.hypot(*(pts - p).T)
        near = [(d[j], j) for j in range(len(pts)) if group[j] != group[i] and (max_km is None or d[j] <= max_km)]
        if near:
            want[(*p, group[i])] = min(near)[::-1]
    assert got.keys() == want.keys() and all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    assert all(got[k][0] == want[k][0] or abs(np.hypot(*(pts[got[k][0]] - k[:2])) - want[k][1]) < 1e-9 for k in want)
    one = spatial.nearest_of_another_group(df.where("g = 1"), "g")
    assert one.count() == 0


def test_configuration_search_matches_the_plain_plan(spark, monkeypatch):
    """Dead and missing neighbours, rows without any, in chunks of two rows."""
    monkeypatch.setattr(interpolate, "SEARCH_ROWS", 2)
    rng = np.random.default_rng(8)
    rows = [(i, rank, float(rng.uniform(0.1, 80)), None if rng.random() < 0.1 else 0.0 if rng.random() < 0.1 else float(rng.uniform(5, 180))) for i in range(15) for rank in range(1, 13) if (i, rank) != (3, 2)]
    near = spark.createDataFrame([r for r in rows if r[0] != 4], "sid long, rank int, dist double, nv double")
    targets = spark.createDataFrame([(i, float(rng.uniform(10, 160)), float(rng.uniform(10, 160))) for i in range(15)] + [(99, None, 1.0)], "sid long, true double, base double")
    grid = {"k": (3, 12), "p0": (1.5, 2.0), "p_max": (3.0,), "m": (50.0, 70.0), "s_r": (20.0,), "gamma0": (0.8, 1.6), "b_h": (10.0,), "tau": (5.0,)}
    got = {tuple(r[n] for n in grid): r for r in interpolate.rcap_search(near, targets, "sid", "nv", "true", "base", grid).collect()}
    configs = [dict(zip(grid, c)) for c in itertools.product(*grid.values())]
    params = interpolate.rcap_params(spark, [{**c, "config": str(i)} for i, c in enumerate(configs)])
    pred = interpolate.rcap_from(near, "sid", "nv", params)
    scored = targets.where("true IS NOT NULL").join(spark.createDataFrame([(str(i),) for i in range(len(configs))], "config string")).join(pred, ["sid", "config"], "left").withColumn("pred", F.coalesce("pred", "base"))
    want = {r["config"]: r for r in interpolate.composite_gain(scored, "true", "pred", "base", ["config"]).collect()}
    assert len(got) == len(configs) == 16
    for i, c in enumerate(configs):
        for name in ("d_all", "d_20_50", "d_50_100", "d_100", "objective"):
            assert got[tuple(c.values())][name] == pytest.approx(want[str(i)][name], abs=1e-9)


def test_calibrated_weights_by_arrays_and_by_tables(spark, monkeypatch):
    """The same choice from arrays and from ranked tables, with missing components and a target of three levels."""
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), None if i % 4 == 0 else float(c), 1 + int(2.999 * (0.2 * a + 0.7 * b + 0.1 * c))) for i, (a, b, c) in enumerate(rng.uniform(size=(90, 3)).round(2))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    runs = []
    for bound in (inference.ARRAY_ROWS, 0):
        monkeypatch.setattr(inference, "ARRAY_ROWS", bound)
        runs.append({r["seed"]: tuple(r)[1:] for r in inference.calibrated(df, "id", ["a", "b", "c"], "y", (0.4, 0.3, 0.3), (0, 1), 0.25).collect()})
    assert runs[0].keys() == runs[1].keys() == {0, 1}
    for seed in runs[0]:
        assert runs[0][seed] == pytest.approx(runs[1][seed], abs=1e-9)
        assert runs[0][seed][1] >= 0.5  # the second component carries the target


def test_dealt_radius_join(spark):
    """The joined rows are many times the rows that are shuffled: they stay dealt to all shuffle partitions."""
    df = spark.range(300).selectExpr("id", "id AS sid", "CAST(id % 20 AS double) AS x", "CAST(id % 15 AS double) AS y")
    out = spatial.radius_join(df, df, 3.0)
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    pts = [(i % 20, i % 15) for i in range(300)]
    assert out.count() == sum(math.hypot(a[0] - b[0], a[1] - b[1]) <= 3 for a in pts for b in pts)


def test_dealt_knn(spark):
    """Candidates of every level and the last pairs are dealt to all shuffle partitions, not merged into one task."""
    rng = np.random.default_rng(11)
    pts = rng.uniform(0, 900, (400, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "sid long, x double, y double")
    out = spatial.knn_join(df, df.select(F.col("sid").alias("nid"), "x", "y"), 3, "sid", "nid", exclude_self=True, leaf=4)
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 3
    near = {(r["sid"], r["rank"]): r["nid"] for r in out.collect()}
    assert all([near[i, k] for k in (1, 2, 3)] == brute_knn(pts, i, 3, True) for i in range(400))


@pytest.mark.parametrize("rows", [7, 16384])
def test_digests_by_columns_are_md5(monkeypatch, rows):
    import hashlib

    monkeypatch.setattr(inference, "MD5_ROWS", rows)
    for prefix in ("42:7:", "42:drought:", "x" * 60):
        want = [[int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[k:k + 15], 16) for k in (0, 16)] for i in range(1203)]
        assert inference.halves(prefix, 1203).tolist() == want
    assert inference.halves("42:7:", 0).shape == (0, 2) and len(inference.words(42, 7, 9)) == 9


def test_betweenness_reads_two_levels_a_round(spark, monkeypatch):
    """On a path of ten nodes each round reads the edges and the levels next to it, however many lie behind."""
    read, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: (read.append(df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")), cut(df))[1])
    edges = spark.range(9).selectExpr("id AS src", "id + 1 AS dst")
    b = {r["id"]: r["betweenness"] for r in graph.sampled_betweenness(edges, spark.range(1)).collect()}
    assert b == {i: 9.0 - i for i in range(1, 10)}
    assert max(read) <= 6


def test_laplacian_balls_are_smoothed_without_joins(spark, monkeypatch):
    """However many rounds it takes, no table is written between them; balls beyond the bound are smoothed by joins to the same values."""
    edges = spark.createDataFrame([(i, i + s, 1.0 + (i * s) % 3) for i in range(40) for s in (1, 7)], "src long, dst long, admittance double")
    values = spark.createDataFrame([(i, None if i % 11 == 5 else float(i * 13 % 31)) for i in range(45)], "id long, value double")

    def smooth(bound):
        written = []
        monkeypatch.setattr(learning, "BALL_EDGES", bound)
        monkeypatch.setattr(learning, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
        return {r["id"]: r["pred"] for r in learning.local_laplacian(values, edges, "admittance", tol=1e-9).collect()}, len(written)

    (arrays, few), (joins, many), (mixed, _) = smooth(1 << 18), smooth(0), smooth(60)
    assert few <= 3 < many and set(arrays) == set(joins) == set(mixed) and len(arrays) == 45
    for i, p in joins.items():
        assert arrays[i] == pytest.approx(p, abs=1e-7) and mixed[i] == pytest.approx(p, abs=1e-7)

    monkeypatch.setattr(learning, "EDGES_AT_ONCE", 1)
    assert smooth(1 << 18)[0] == arrays


def test_forest_rows_are_read_once_and_dealt(spark, monkeypatch):
    """The folds read a table, not the plan of their rows, and many rows are fitted by several tasks."""
    monkeypatch.setattr(learning, "TASK_ROWS", 50)
    rows = spark.range(200).select((F.col("id") % 4).alias("zone"), (F.col("id") * 37 % 101).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    rows = rows.coalesce(1).withColumn("y", F.col("a") * 2 + F.col("b"))
    seen, fit = [], learning.fit_forest

    def watched(train, feats):
        seen.append((train.rdd.getNumPartitions(), "Range" in train._jdf.queryExecution().optimizedPlan().toString()))
        return fit(train, feats, "y", trees=5, depth=4)

    got = learning.leave_group_out(rows, "zone", [0, 1, 2, 3], {"ab": ["a", "b"], "b": ["b"]}, "y", watched).collect()
    assert sorted((r["model"], r["fold"], r["n"]) for r in got) == [(m, str(g), 50) for m in ("ab", "b") for g in range(4)]
    assert min(r["rho"] for r in got if r["model"] == "ab") > 0.8
    assert seen == [(4, False)] * 8


def test_surrogate_keys_take_one_sort(spark):
    """Numbers go on from part to part and through hot keys, and no join of ranks is planned."""
    rows = [(i % 3 if i % 2 else i, i * 7 % 11, i) for i in range(300)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k long, tie long, x long").repartition(5)
    keyed = ranking.surrogate_key(df, "k", "tie", "n", ["x"])
    want = {r: i for i, r in enumerate(sorted(r for r in rows if r[0] is not None), 1)}
    assert {(r["k"], r["tie"], r["x"]): r["n"] for r in keyed.collect()} == want
    assert keyed._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_variance_indices_of_arrays_are_those_of_columns(spark):
    """A model of NumPy gives what the same model of columns does, null rows and rows that don't vary included."""
    df = spark.createDataFrame([(i, None if i % 9 == 4 else (i % 5) / 4.0) for i in range(70)], "id long, x double")
    bounds = {"a": (0.0, 1.0), "b": (0.0, 2.0)}
    columns = inference.sobol(df, "id", bounds, lambda p: F.col("x") * (p["a"] + p["b"] * p["b"]), 64).collect()
    arrays = inference.sobol(df, "id", bounds, lambda p, x: x["x"] * (p["a"] + p["b"] * p["b"]), 64, reads=["x"]).collect()
    want, got = ({(r["id"], r["param"]): (r["first_order"], r["total"]) for r in rows} for rows in (columns, arrays))
    assert set(got) == set(want) and len(arrays) == 140
    assert all(got[k] == (pytest.approx(w) if w[0] is not None else (None, None)) for k, w in want.items())


def test_betweenness_is_carried_by_blocks(spark, monkeypatch):
    """Blocks of few nodes and parts of few sources give the exact sums, and write less rows than there are pairs of a source and a node."""
    written = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: (lambda made: (written.append(made.count() if {"kind", "paths"} & set(made.columns) else 0), made)[1])(cut_lineage(df)))
    monkeypatch.setattr(graph, "CELLS", 160)
    monkeypatch.setattr(graph, "SOURCES", 16)
    pairs = {(5 * i, 5 * j) for i in range(60) for j in (i + 1, i + 2, i // 8) if i < j < 60 or j < i and i % 3} | {(1000, 1001), (7, 7)}
    adj = {}
    for a, b in pairs:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    sources = [5 * i for i in range(0, 60, 3)] + [1000, 9999]
    want = {}
    for s in sources:
        hop, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for u in adj.get(v, ()):
                if u not in hop:
                    hop[u], paths[u] = hop[v] + 1, 0.0
                    order.append(u)
                paths[u] += paths[v] * (hop[u] == hop[v] + 1)
        gain = dict.fromkeys(order, 0.0)
        for v in reversed(order[1:]):
            for u in adj[v]:
                gain[u] += (hop[u] == hop[v] - 1) * paths[u] / paths[v] * (1 + gain[v])
        for v in order[1:]:
            want[v] = want.get(v, 0.0) + gain[v]
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    got = {r["id"]: r["betweenness"] for r in graph.sampled_betweenness(edges, spark.createDataFrame([(s,) for s in sources], "id long")).collect()}
    assert got == {v: pytest.approx(x, abs=1e-9) for v, x in want.items()}
    assert 0 < sum(written) < len(sources) * 60


@pytest.mark.parametrize("levels", [3, 90])
def test_many_rows_are_resampled_without_listing_their_draws(spark, monkeypatch, levels):
    """Beyond the bound, rows pass by in blocks that cut through ties and replicates go in groups; nothing is ranked as a table of draws."""
    rng = np.random.default_rng(levels)
    df = spark.createDataFrame([(int(7 * i), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(rng.integers(0, 4, 120), rng.normal(size=120), rng.integers(0, levels, 120)))],
                               "id long, a double, y double, t double")
    want = {(r["model"], r["rep"]): r["rho"] for r in inference.bootstrap_rho(df, "id", ["a", "y"], "t", 11).collect()}
    monkeypatch.setattr(inference, "ARRAY_ROWS", 0)
    monkeypatch.setattr(inference, "spearman", lambda *args, **more: pytest.fail("draws are ranked as a table"))
    for name, value in (("STREAM_ROWS", 7), ("REPLICATES", 4), ("DRAWN_BYTES", 1 << 20)):
        monkeypatch.setattr(inference, name, value, raising=False)
    got = {(r["model"], r["rep"]): r["rho"] for r in inference.bootstrap_rho(df, "id", ["a", "y"], "t", 11).collect()}
    assert len(want) == 22 and got == pytest.approx(want, abs=1e-12)
    few = df.where("id < 28")
    assert inference.bootstrap_rho(few, "id", ["a"], "t", 11, min_distinct=5).count() == 0


def test_fits_of_many_rows_go_one_by_one(spark, monkeypatch):
    """A fit of many rows has the cores to itself, and its rows keep their nodes between levels."""
    import threading
    import time

    lock, running, most, models = threading.Lock(), [], [], []
    fit = learning.fit_forest

    def watched(train, feats):
        with lock:
            running.append(1)
            most.append(len(running))
        time.sleep(0.2)
        models.append(fit(train, feats, "y", trees=2, depth=2))
        with lock:
            running.pop()
        return models[-1]

    rows = cut_lineage(spark.range(120).selectExpr("id % 3 AS zone", "double(id * 37 % 101) AS a", "double(id % 7) AS y"))
    monkeypatch.setattr(learning, "TASK_ROWS", 10)
    assert learning.leave_group_out(rows, "zone", [0, 1, 2], {"a": ["a"], "b": ["a"]}, "y", watched).count() == 6
    assert max(most) == 1 and len(models) == 6
    assert all(m.model.stages[-1].getOrDefault("cacheNodeIds") for m in models)


def test_importance_predicts_a_row_once_for_all_shuffles(spark, monkeypatch):
    """The forest itself predicts each row once, and the figures are those of predicting every shuffled row."""
    rng = np.random.default_rng(3)
    rows = [(7 * i, float(a), float(b % 5), float(a > 0.4) + 0.3 * float(b % 5) + float(c)) for i, (a, b, c) in enumerate(zip(rng.uniform(size=160), range(160), rng.normal(0, 0.1, 160)))]
    df = cut_lineage(spark.createDataFrame(rows, "id long, a double, b double, y double"))
    f = learning.fit_forest(df, ["a", "b"], "y", trees=7, depth=5)
    data = {i: (a, b, y) for i, a, b, y in rows}
    ids = sorted(data)
    base, want = {r["id"]: r["pred"] for r in f.predict(df).collect()}, {}
    sst = 160 * np.var([data[i][2] for i in ids])
    for k, name in enumerate(["a", "b"]):
        moved = inference.permutations(df, "id", 3, 42 + k).collect()
        other = spark.createDataFrame([(r["rep"], r["id"], *[data[ids[r["_i"]] if j == k else r["id"]][j] for j in (0, 1)]) for r in moved], "rep long, id long, a double, b double")
        sse = {}
        for r in f.predict(other).collect():
            sse[r["rep"]] = sse.get(r["rep"], 0.0) + (data[r["id"]][2] - r["pred"]) ** 2
        loss = (np.array(list(sse.values())) - sum((data[i][2] - base[i]) ** 2 for i in ids)) / sst
        want[name] = (pytest.approx(loss.mean()), pytest.approx(loss.std()))
    predicted, predict = [], learning.Forest.predict
    monkeypatch.setattr(learning.Forest, "predict", lambda self, rows, out="pred": predicted.append(rows.count()) or predict(self, rows, out))
    monkeypatch.setattr(learning, "ANSWERED_ROWS", 50, raising=False)
    got = {r["feature"]: (r["importance"], r["std"]) for r in learning.permutation_importance(f, df, "id", "y", repeats=3).collect()}
    assert got == want and predicted == [160]
