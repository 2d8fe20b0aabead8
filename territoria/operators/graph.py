"""Graph operators over edge tables. ``edges`` hold every undirected edge once: src, dst and weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territoria.operators.ranking import surrogate_key
from territoria.operators.spatial import knn_join
from territoria.session import cut_lineage

#: Sources of a block, lines of a block that is solved as arrays, and distances that are held at a time there.
SOURCES, BLOCK_LINES, CELLS = 512, 1 << 20, 1 << 22
#: Nodes of a block whose mixes are traced as arrays, and the share of the tolerance to which a block settles in a round.
MIX_NODES, FINE = 2048, 1e-3


def both_ways(edges: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Every edge in both directions; self loops dropped."""
    e = edges.where(F.col("src") != F.col("dst"))
    return e.select("src", "dst", *columns).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns))


def simple_edges(edges: DataFrame, aggs: Sequence[Column]) -> DataFrame:
    """Parallel lines merged: one row per unordered pair."""
    return edges.where(F.col("src") != F.col("dst")).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(*aggs)


def components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """(node, component): smallest reachable id, by min-label exchange with pointer jumping until nothing changes."""
    e = cut_lineage(both_ways(edges).distinct())
    labels = nodes.select(F.col(node).alias("v")).distinct().withColumn("c", F.col("v"))
    while True:
        low = e.join(labels, e["src"] == labels["v"]).groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("m"))
        step = labels.join(low, "v", "left").select("v", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c"))
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        step = cut_lineage(step.join(jump, "c", "left").select("v", "old", F.least("c", F.coalesce("cc", "c")).alias("c")))
        labels = step.select("v", "c")
        if step.where(F.col("c") != F.col("old")).isEmpty():
            break
    return labels.select(F.col("v").alias(node), F.col("c").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


def isolated(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    return nodes.join(both_ways(edges).select(F.col("src").alias(node)).distinct(), node, "left_anti")


def bridge_components(nodes: DataFrame, edges: DataFrame, node: str = "id", max_km: float = 500.0) -> DataFrame:
    """One synthetic edge per minor component: its node nearest to the largest component, impedance max(km/1000, 0.001)."""
    lab = cut_lineage(nodes.select(node, "x", "y").join(components(nodes, edges, node), node))
    main = lab.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("_main"))
    flagged = lab.crossJoin(F.broadcast(main))
    core = flagged.where(F.col("component") == F.col("_main")).select(F.col(node).alias("_to"), "x", "y")
    rest = flagged.where(F.col("component") != F.col("_main")).select(node, "x", "y", "component")
    near = knn_join(rest, core, 1, node, "_to", max_km).join(rest.select(node, "component"), node)
    best = near.where(F.col("dist") < max_km).groupBy("component").agg(F.min_by(F.struct(F.col(node), "_to", "dist"), F.struct("dist", F.col(node))).alias("b"))
    z = F.greatest(F.col("b.dist") * 0.001, F.lit(0.001))
    return best.select("component", F.col(f"b.{node}").alias("src"), F.col("b._to").alias("dst"), F.col("b.dist").alias("length"), z.alias("impedance"), (1 / z).alias("admittance"))


def degree_features(edges: DataFrame, weight: str = "admittance", rating: str = "s_nom", voltage: str | None = None, node: str = "id") -> DataFrame:
    cols = [weight, rating] + ([voltage] if voltage else [])
    aggs = [F.count(F.lit(1)).alias("degree"), F.sum(weight).alias("weighted_degree"), F.sum(rating).alias("total_rating"), F.avg(weight).alias("mean_weight")]
    if voltage:
        aggs.append(F.max(voltage).alias("max_voltage"))
    return both_ways(edges, cols).groupBy(F.col("src").alias(node)).agg(*aggs)


def pagerank(nodes: DataFrame, edges: DataFrame, weight: str = "admittance", alpha: float = 0.85, iters: int = 20, node: str = "id", cut_every: int = 5) -> DataFrame:
    """Weighted PageRank on the undirected graph, ``iters`` power steps; ranks of isolated nodes are spread evenly."""
    e = both_ways(edges, [weight])
    out = e.groupBy("src").agg(F.sum(weight).alias("_o"))
    e = cut_lineage(e.join(out, "src").select("src", "dst", (F.col(weight) / F.col("_o")).alias("p")))
    n = nodes.select(F.col(node).alias("v")).distinct()
    n = cut_lineage(n.join(e.select(F.col("src").alias("v"), F.lit(1).alias("_l")).distinct(), "v", "left"))
    size = n.count()
    rank = n.withColumn("r", F.lit(1.0 / size))
    for i in range(iters):
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("_l").isNull(), F.col("r"))), F.lit(0.0)).alias("_d"))
        got = e.join(rank.select(F.col("v").alias("src"), "r"), "src").groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("p") * F.col("r")).alias("_in"))
        rank = n.join(got, "v", "left").crossJoin(F.broadcast(loose)).select(
            "v", "_l", ((1 - alpha) / size + alpha * (F.coalesce("_in", F.lit(0.0)) + F.col("_d") / size)).alias("r"))
        if (i + 1) % cut_every == 0:
            rank = cut_lineage(rank)
    return rank.select(F.col("v").alias(node), F.col("r").alias("pagerank"))


def clustering(edges: DataFrame, node: str = "id") -> DataFrame:
    """Triangles over possible pairs. Edges point from lower to higher degree, so a hub lists few neighbours of its own."""
    pairs = simple_edges(edges, [F.lit(1).alias("_")]).select("src", "dst")
    deg = both_ways(pairs).groupBy(F.col("src").alias(node)).agg(F.count(F.lit(1)).alias("degree"))
    d = pairs.join(deg.select(F.col(node).alias("src"), F.col("degree").alias("da")), "src").join(deg.select(F.col(node).alias("dst"), F.col("degree").alias("db")), "dst")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("src") < F.col("dst")))
    o = d.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    wedge = o.join(o.select("a", F.col("b").alias("c")), "a").where(F.col("b") < F.col("c"))
    tri = wedge.join(pairs.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"], "left_semi")
    per = tri.select(F.explode(F.array("a", "b", "c")).alias(node)).groupBy(node).agg(F.count(F.lit(1)).alias("triangles"))
    return deg.join(per, node, "left").select(
        node, "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"),
        F.coalesce(F.try_divide(2.0 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0)).alias("clustering"))


def hop_rings(edges: DataFrame, hops: int = 3) -> DataFrame:
    """(id, other, hop): nodes first reached at each hop, by frontier joins with earlier rings removed."""
    e = both_ways(edges).distinct()
    seen = e.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(1).alias("hop"))
    frontier = seen
    for h in range(2, hops + 1):
        nxt = frontier.select("id", F.col("other").alias("src")).join(e, "src").select("id", F.col("dst").alias("other")).where(
            F.col("id") != F.col("other")).distinct().join(seen.select("id", "other"), ["id", "other"], "left_anti").withColumn("hop", F.lit(h))
        frontier = cut_lineage(nxt)
        seen = seen.unionByName(frontier)
    return seen


def hop_stats(edges: DataFrame, values: DataFrame, weight: str, hops: int = 3, keys: Sequence[str] = (), node: str = "id", value: str = "value") -> DataFrame:
    """Per node and hop: mean, population deviation, count and range of the valid values (zero means missing).

    The first hop's mean is weighted. ``keys`` of ``values`` (for example the snapshot) carry through.
    """
    rings = hop_rings(edges, hops)
    w = both_ways(edges, [weight]).groupBy(F.col("src").alias("id"), F.col("dst").alias("other")).agg(F.sum(weight).alias("_w"))
    rings = rings.join(w, ["id", "other"], "left").withColumn("_w", F.coalesce("_w", F.lit(1.0)))
    v = values.select(F.col(node).alias("other"), *keys, F.nullif(F.col(value), F.lit(0.0)).alias("_v")).where(F.col("_v").isNotNull())
    return rings.join(v, "other").groupBy(F.col("id").alias(node), "hop", *keys).agg(
        (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("wmean"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"),
        F.count(F.lit(1)).alias("n"), (F.max("_v") - F.min("_v")).alias("spread"))


def hop_gradients(stats: DataFrame, base: DataFrame, national: float | Column, node: str = "id", value: str = "value") -> DataFrame:
    """Base value minus each ring's mean, and the ratio to the national mean."""
    p = stats.groupBy(node).agg(*[F.max(F.when(F.col("hop") == h, F.col("wmean" if h == 1 else "mean"))).alias(f"hop{h}") for h in (1, 2, 3)])
    b = F.col(value)
    nat = F.lit(national) if isinstance(national, float) else national
    return base.join(p, node, "left").select(node, value, *[(b - F.col(f"hop{h}")).alias(f"gradient{h}") for h in (1, 2, 3)], F.try_divide(b, nat).alias("national_ratio"))


def graph_filter(edges: DataFrame, values: DataFrame, weight: str, mix: Sequence[float] = (0.60, 0.25, 0.10, 0.05), node: str = "id", value: str = "value") -> DataFrame:
    """g1, g2, g3 = row-normalised neighbourhood means chained, their mix with the base value and the hop differences."""
    e = both_ways(edges, [weight])
    total = e.groupBy("src").agg(F.sum(weight).alias("_t"))
    e = e.join(total, "src").select("src", "dst", (F.col(weight) / F.col("_t")).alias("p"))
    out = values.select(F.col(node).alias("v"), F.coalesce(value, F.lit(0.0)).alias("g0"), F.col(value).alias("_base"))
    for h in (1, 2, 3):
        g = e.join(out.select(F.col("v").alias("dst"), f"g{h - 1}"), "dst").groupBy(F.col("src").alias("v")).agg(F.sum(F.col("p") * F.col(f"g{h - 1}")).alias(f"g{h}"))
        out = out.join(g, "v", "left").withColumn(f"g{h}", F.coalesce(f"g{h}", F.lit(0.0)))
    m = mix[0] * F.col("_base") + mix[1] * F.col("g1") + mix[2] * F.col("g2") + mix[3] * F.col("g3")
    return out.select(F.col("v").alias(node), "g1", "g2", "g3", m.alias("g_mix"), (F.col("_base") - F.col("g1")).alias("delta_1"),
                      (F.col("g1") - F.col("g2")).alias("delta_12"), (F.col("g2") - F.col("g3")).alias("delta_23"))


def _relaxed(start: DataFrame, e: DataFrame, cutoff: float) -> DataFrame:
    """(source, v, d): least distance up to the cutoff from the nodes v of ``start`` (source, v), by relaxing only the improved frontier."""
    best = start.select("source", "v", F.lit(0.0).alias("d"))
    frontier = best
    while True:
        step = frontier.join(e, frontier["v"] == e["src"]).select("source", F.col("dst").alias("v"), (F.col("d") + F.col("_w")).alias("d")).where(
            F.col("d") <= cutoff).groupBy("source", "v").agg(F.min("d").alias("nd"))
        merged = cut_lineage(best.join(step, ["source", "v"], "full_outer").select(
            "source", "v", F.least("d", "nd").alias("d"), (F.col("d").isNull() | F.coalesce(F.col("nd") < F.col("d"), F.lit(False))).alias("_new")))
        best, frontier = merged.select("source", "v", "d"), merged.where("_new").select("source", "v", "d")
        if frontier.isEmpty():
            return best


def _solved(t: pa.Table, cutoff: float) -> pa.Table:
    """source, v, d of a block: its nodes u, whether a node is a source of the block (own), and the ends and weights of its lines."""
    t = t.sort_by("u").combine_chunks()
    names, own = t.column("u").to_numpy(), np.flatnonzero(t.column("own").to_numpy())
    line, w = (t.column(c).combine_chunks() for c in ("dst", "w"))
    tail = np.repeat(np.arange(len(names)), pc.list_value_length(line).to_numpy(zero_copy_only=False))
    ends, w = line.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False)
    head = np.minimum(np.searchsorted(names, ends), len(names) - 1)
    inside = names[head] == ends
    tail, head, w = tail[inside], head[inside], w[inside]
    at, size, out = np.searchsorted(tail, np.arange(len(names) + 1)), len(names), []
    step = max(1, CELLS // size)
    for i in range(0, len(own), step):
        mine = own[i:i + step]
        best = np.full(len(mine) * size, np.inf)
        front = np.arange(len(mine)) * size + mine
        best[front] = 0.0
        while len(front):
            node = front % size
            n = at[node + 1] - at[node]
            k = np.repeat(at[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            d, to = np.repeat(best[front], n) + w[k], np.repeat(front - node, n) + head[k]
            less = (d <= cutoff) & (d < best[to])
            np.minimum.at(best, to[less], d[less])
            front = np.unique(to[less])
        hit = np.flatnonzero(np.isfinite(best))
        out.append(pa.table({"source": pa.array(names[mine[hit // size]], t.schema.field("u").type), "v": pa.array(names[hit % size], t.schema.field("u").type), "d": best[hit]}))
    return pa.concat_tables(out)


def _in_blocks(start: DataFrame, e: DataFrame, cutoff: float) -> DataFrame:
    """(source, v, d) of all sources, which are dealt by order of id into blocks of about SOURCES.

    Rounds of joins find the nodes that any source of a block reaches, far fewer than pairs where neighbours have near ids.
    They and their lines meet in one task, where the distances of each source are relaxed as arrays, in the same sums from the
    source outwards. Sources of blocks with more than BLOCK_LINES lines are relaxed by joins.
    """
    kind = start.schema["source"].dataType.simpleString()
    blocks = max(1, -(-start.count() // SOURCES))
    own = cut_lineage(start.repartitionByRange(blocks, "source").select(F.spark_partition_id().alias("block"), F.col("source").alias("u")))
    near = _relaxed(own.select(F.col("block").alias("source"), F.col("u").alias("v")), e, cutoff).select(F.col("source").alias("block"), F.col("v").alias("u"))
    lines = e.groupBy(F.col("src").alias("u")).agg(F.collect_list(F.struct("dst", F.col("_w").cast("double").alias("w"))).alias("_l"))
    size = near.join(lines.select("u", F.size("_l").alias("n")), "u").groupBy("block").agg(F.sum("n").alias("n"))
    large = cut_lineage(size.where(F.col("n") > BLOCK_LINES).select("block"))
    rows = near.join(large, "block", "left_anti").join(own.withColumn("own", F.lit(True)), ["block", "u"], "left").join(lines, "u", "left").select(
        "block", "u", F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("_l.dst", F.array().cast(f"array<{kind}>")).alias("dst"),
        F.coalesce("_l.w", F.array().cast("array<double>")).alias("w"))
    out = rows.groupBy("block").applyInArrow(lambda t: _solved(t, cutoff), f"source {kind}, v {kind}, d double")
    if not large.isEmpty():
        far = own.join(large, "block", "left_semi").select(F.col("u").alias("source"), F.col("u").alias("v"))
        out = out.unionByName(_relaxed(far, e, cutoff))
    return cut_lineage(out)


def bounded_distances(edges: DataFrame, weight: str, cutoff: float, sources: DataFrame | None = None, node: str = "id") -> DataFrame:
    """(source, node, dist): shortest weighted distances up to the cutoff, from ``sources`` by joins, from all nodes in blocks."""
    e = cut_lineage(both_ways(edges, [weight]).groupBy("src", "dst").agg(F.min(weight).alias("_w")))
    if sources is None:
        best = _in_blocks(e.select(F.col("src").alias("source")).distinct(), e.where(F.col("_w") <= cutoff), cutoff)
    else:
        start = sources.select(F.col(node).alias("source")).distinct()
        best = _relaxed(start.select("source", F.col("source").alias("v")), e, cutoff)
    return best.select("source", F.col("v").alias(node), F.col("d").alias("dist"))


def reach_counts(distances: DataFrame, limits: Sequence[float] = (1.0, 3.0, 5.0), node: str = "id") -> DataFrame:
    d = distances.where(F.col("source") != F.col(node))
    return d.groupBy("source").agg(*[F.count_if(F.col("dist") < x).alias(f"within_{format(x, 'g')}") for x in limits])


def nearest_by_distance(distances: DataFrame, k: int, node: str = "id") -> DataFrame:
    w = W.partitionBy("source").orderBy("dist", node)
    return distances.where(F.col("source") != F.col(node)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def diffuse(distances: DataFrame, values: DataFrame, eps: float = 0.01, power: float = 1.0, influence: str | None = None, k: int | None = None,
            node: str = "id", value: str = "value") -> DataFrame:
    """Mean of reachable values weighted by influence/(dist+eps)^power; the source itself is left out unless ``k`` is given.

    With ``k`` only the k electrically nearest nodes count, the source included.
    """
    cols = [F.col(node), F.nullif(F.col(value), F.lit(0.0)).alias("_v"), (F.col(influence) if influence else F.lit(1.0)).alias("_s")]
    d = distances
    if k is None:
        d = d.where(F.col("source") != F.col(node))
    else:
        w = W.partitionBy("source").orderBy("dist", node)
        d = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    j = d.join(values.select(*cols), node).where(F.col("_v").isNotNull())
    wt = F.col("_s") / F.pow(F.col("dist") + eps, F.lit(power))
    return j.groupBy("source").agg((F.sum(wt * F.col("_v")) / F.sum(wt)).alias("diffused"), F.count(F.lit(1)).alias("n_reached"))


def directed_flows(flows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Signed line flows (src, dst, flow) to positive flows (frm, to, mw), parallel lines summed."""
    pos = F.col("flow") > 0
    return flows.where(F.col("flow") != 0).select(
        *keys, F.when(pos, F.col("src")).otherwise(F.col("dst")).alias("frm"), F.when(pos, F.col("dst")).otherwise(F.col("src")).alias("to"),
        F.abs("flow").alias("mw")).groupBy(*keys, "frm", "to").agg(F.sum("mw").alias("mw"))


def inflow_mix(flows: DataFrame, production: DataFrame, values: DataFrame, node: str = "id", prod: str = "prod", value: str = "value", minimum: float = 0.1) -> DataFrame:
    """(prod·value + Σ inflow·source value)/(prod + Σ inflow); a node with almost no throughput keeps its value."""
    f = directed_flows(flows).join(values.select(F.col(node).alias("frm"), F.col(value).alias("_sv")), "frm", "left")
    inflow = f.groupBy(F.col("to").alias(node)).agg(F.sum("mw").alias("_in"), F.sum(F.col("mw") * F.coalesce("_sv", F.lit(0.0))).alias("_inv"))
    j = values.join(production.select(node, F.col(prod).alias("_p")), node, "left").join(inflow, node, "left")
    p, i = F.coalesce("_p", F.lit(0.0)), F.coalesce("_in", F.lit(0.0))
    mixed = (p * F.coalesce(value, F.lit(0.0)) + F.coalesce("_inv", F.lit(0.0))) / (p + i)
    return j.select(node, value, F.when(p + i < minimum, F.col(value)).otherwise(mixed).alias("mixed"))


def _mixed(held: pa.Table, sent: pa.Table, iters: int, tol: float, high: float) -> pa.Table:
    """id, mix and its move of a block's nodes ``held`` with the lines between them, after what was ``sent``: their last mixes and what flows in from other blocks."""
    # Ids of a block are numbered without gaps from its own first one.
    at = lambda x: (x.to_numpy() & ((1 << 33) - 1)).astype(np.int64)
    ids = held.column("id")
    n, node = len(ids), at(ids)
    t, e = np.zeros(n), np.zeros(n)
    t[node], e[node] = held.column("t").to_numpy(), held.column("e").to_numpy()
    line, mw = (held.column(c).combine_chunks() for c in ("s", "mw"))
    head = np.repeat(node, pc.list_value_length(line).to_numpy(zero_copy_only=False))
    tail, mw = at(line.flatten()), mw.flatten().to_numpy(zero_copy_only=False)
    last, come = sent.filter(pc.is_valid(sent.column("mix"))), sent.filter(pc.is_valid(sent.column("g")))
    first = np.zeros(n)
    first[at(last.column("id"))] = last.column("mix").to_numpy()
    e += np.bincount(at(come.column("id")), come.column("g").to_numpy(), n)
    through = ~(t <= 0.1)
    mix, fine = first, tol * FINE
    for _ in range(iters):
        was = mix
        mix = np.divide(e + np.bincount(head, mw * was[tail], n), t, out=np.zeros(n), where=through)
        mix = np.where(np.isnan(mix), high, np.clip(mix, 0.0, high))
        if np.abs(mix - was).max() <= max(fine, 8 * np.spacing(mix.max())):
            break
    return pa.table({"id": ids, "mix": mix[node], "move": np.abs(mix - first)[node]})


def trace_mix(flows: DataFrame, production: DataFrame, keys: Sequence[str] = (), node: str = "id", prod: str = "prod", emission: str = "co2",
              iters: int = 1000, tol: float = 1e-6, high: float = 800.0) -> DataFrame:
    """Proportional sharing: every node's mix is its own emissions plus inflows at the source's mix, over its throughput.

    Fixed-point rounds over (snapshot, node) for all snapshots at once, stopped when no mix moves more than ``tol``;
    not settling within ``iters`` rounds is an error. Nodes are dealt by order of id into blocks. In a round each block settles its own
    lines as arrays, in one task, so only mixes that flow to other blocks are joined; the lines of the blocks stay where they are.
    """
    keys = list(keys)
    f = directed_flows(flows, keys)
    inflow = f.groupBy(*keys, F.col("to").alias(node)).agg(F.sum("mw").alias("_in"))
    base = production.select(*keys, node, F.col(prod).alias("_p"), F.col(emission).alias("_e")).join(inflow, [*keys, node], "full_outer")
    p, e = F.coalesce("_p", F.lit(0.0)), F.coalesce("_e", F.lit(0.0))
    thru = p + F.coalesce("_in", F.lit(0.0))
    base = cut_lineage(base.select(*keys, node, thru.cast("double").alias("_t"), e.cast("double").alias("_e")))
    blocks = max(1, -(-base.count() // MIX_NODES))
    base = cut_lineage(base.repartitionByRange(blocks, *keys, node).withColumn("_id", F.monotonically_increasing_id()))
    names, block = base.select(*keys, node, "_id"), lambda c: F.shiftright(c, 33)
    f = f.join(names.withColumnsRenamed({node: "frm", "_id": "s"}), [*keys, "frm"]).join(names.withColumnsRenamed({node: "to", "_id": "d"}), [*keys, "to"])
    f = cut_lineage(f.select("s", "d", F.col("mw").cast("double").alias("mw")))
    cut = cut_lineage(f.where(block("s") != block("d")))
    lines = f.where(block("s") == block("d")).groupBy(F.col("d").alias("_id")).agg(F.collect_list(F.struct("s", "mw")).alias("_l"))
    held = base.join(lines, "_id", "left").select(
        block("_id").alias("block"), F.col("_id").alias("id"), F.col("_t").alias("t"), F.col("_e").alias("e"),
        F.coalesce("_l.s", F.array().cast("array<long>")).alias("s"), F.coalesce("_l.mw", F.array().cast("array<double>")).alias("mw"))
    # Stored as it is dealt, which a checkpoint does not tell the planner.
    held = held.repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").persist()
    state = base.select(F.col("_id").alias("id"), F.coalesce(F.try_divide("_e", "_t"), F.lit(0.0)).alias("mix"))
    try:
        for _ in range(iters):
            got = cut.join(state.select(F.col("id").alias("s"), "mix"), "s").groupBy(F.col("d").alias("id")).agg(F.sum(F.col("mw") * F.col("mix")).alias("g"))
            sent = state.select("id", "mix", F.lit(None).cast("double").alias("g")).unionByName(got, allowMissingColumns=True).withColumn("block", block("id"))
            made = held.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(lambda x, y: _mixed(x, y, iters, tol, high), "id long, mix double, move double")
            made = cut_lineage(made)
            state = made.select("id", "mix")
            if made.where(F.col("move") > tol).isEmpty():
                break
        else:
            raise RuntimeError(f"tracing has not settled within {iters} rounds")
    finally:
        held.unpersist()
    return base.join(state.withColumnRenamed("id", "_id"), "_id").select(*keys, node, F.col("_t").alias("throughput"), "mix")


def sampled_closeness(edges: DataFrame, weight: str, sources: DataFrame, cutoff: float, node: str = "id") -> DataFrame:
    """(node, n_sources, closeness): inverse mean distance to the sampled sources within the cutoff."""
    d = bounded_distances(edges, weight, cutoff, sources, node).where(F.col("source") != F.col(node))
    return d.groupBy(node).agg(F.count(F.lit(1)).alias("n_sources"), F.try_divide(F.lit(1.0), F.avg("dist")).alias("closeness"))


def _packed(block: int, kind: int, keys: np.ndarray, values: np.ndarray) -> tuple:
    """A row of cells: their keys (source << 33 | node) in ascending order, as steps, and their values."""
    keys, values = np.diff(keys, prepend=0).astype("<i8"), values.astype("<f8")
    return int(block), kind, len(keys), *(pa.compress(c.tobytes(), codec="zstd", asbytes=True) for c in (keys, values))


def _cells(t: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of all rows of a kind, by ascending key."""
    keys, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    for r in t.filter(pc.equal(t.column("kind"), kind)).to_pylist():
        keys.append(np.cumsum(np.frombuffer(pa.decompress(r["key"], 8 * r["n"], "zstd"), "<i8")))
        values.append(np.frombuffer(pa.decompress(r["value"], 8 * r["n"], "zstd"), "<f8"))
    key, value = np.concatenate(keys), np.concatenate(values)
    if len(keys) <= 2:
        return key, value
    order = np.argsort(key, kind="stable")
    return key[order], value[order]


#: Kinds of rows of cells: a block's own level, what comes from other blocks, the level before (outwards) or to come (back), sums by node.
OWN, SENT, NEXT, SUMS = range(4)
CELL_ROWS = "block long, kind int, n long, key binary, value binary"


def _level(held: pa.Table, got: pa.Table, back: bool) -> pa.Table:
    """The next level of a block's nodes ``held``, and what it sends to other blocks.

    Outwards, paths go on along the lines of the last level to cells of neither it nor the level before. Back, the cells of the
    level are given with their paths and sum what the level behind them sends.
    """
    held = held.sort_by("id").combine_chunks()
    ids, line = held.column("id").to_numpy(), held.column("dst").combine_chunks()
    low, n, home = (1 << 33) - 1, len(ids), ids[0] >> 33
    tail, head = np.repeat(np.arange(n), pc.list_value_length(line).to_numpy(zero_copy_only=False)), line.flatten().to_numpy(zero_copy_only=False)
    here = head >> 33 == home
    outer, to = np.unique(head[~here], return_inverse=True)
    near, far = (tail[here], head[here] & low, n), (tail[~here], to, max(1, len(outer)))
    starts = {id(x): np.searchsorted(x[0], np.arange(n + 1)) for x in (near, far)}

    def carried(source: np.ndarray, node: np.ndarray, value: np.ndarray, lines: tuple, size: int) -> np.ndarray:
        at, (_, ends, width) = starts[id(lines)], lines
        k = at[node + 1] - at[node]
        along = np.repeat(at[node] - np.cumsum(k) + k, k) + np.arange(k.sum())
        return np.bincount(np.repeat(source * width, k) + ends[along], np.repeat(value, k), size * width)

    last, sent, other = (_cells(got, kind) for kind in (OWN, SENT, NEXT))
    present = np.unique(np.concatenate([last[0], sent[0], other[0]]) >> 33)
    own, out, sums, step = [], [], np.zeros(n), max(1, CELLS // max(n, len(outer), len(tail)))
    touched = np.zeros(n, bool)
    for i in range(0, len(present), step):
        some = present[i:i + step]

        def part(cells: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b = np.searchsorted(cells[0], [some[0] << 33, (some[-1] + 1) << 33])
            return np.searchsorted(some, cells[0][a:b] >> 33), cells[0][a:b] & low, cells[1][a:b]

        (s, v, x), (ss, sv, sx), (os, ov, ox) = part(last), part(sent), part(other)
        total = carried(s, v, x, near, len(some)) + np.bincount(ss * n + sv, sx, len(some) * n)
        if back:
            found = os * n + ov
            gain = ox * total[found]
            sums += np.bincount(ov, gain, n)
            touched[ov] = True
            value = (1 + gain) / ox
        else:
            total[s * n + v] = total[os * n + ov] = 0.0
            found = np.flatnonzero(total)
            value = total[found]
        source, node = found // n, found % n
        own.append((some[source] << 33 | node, value))
        if len(outer) and len(found):
            sends = carried(source, node, value, far, len(some))
            hit = np.flatnonzero(sends)
            out.append((outer[hit % len(outer)], some[hit // len(outer)], sends[hit]))
    rows = []
    if any(len(k) for k, _ in own):
        rows.append(_packed(home, OWN, *map(np.concatenate, zip(*own))))
    if out:
        to, source, value = map(np.concatenate, zip(*out))
        order = np.argsort(to >> 33, kind="stable")
        to, key, value = to[order] >> 33, source[order] << 33 | to[order] & low, value[order]
        cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else []
        rows += [_packed(to[a], SENT, key[a:b], value[a:b]) for a, b in zip(cuts, cuts[1:])]
    if touched.any():
        nodes = np.flatnonzero(touched)
        rows.append(_packed(home, SUMS, nodes, sums[nodes]))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table({f.split()[0]: pa.array([r[k] for r in rows], types[k]) for k, f in enumerate(CELL_ROWS.split(", "))})


def _first_cells(t: pa.Table) -> pa.Table:
    """Sources of a block as cells that are sent to it, one path each."""
    keys = np.sort(t.column("s").to_numpy() << 33 | t.column("v").to_numpy())
    row = _packed(t.column("block")[0].as_py(), SENT, keys, np.ones(len(keys)))
    return pa.Table.from_pylist([dict(zip(("block", "kind", "n", "key", "value"), row))], pa.schema(
        [("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("key", pa.binary()), ("value", pa.binary())]))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            keys, values = _cells(pa.Table.from_batches([b.slice(i, 1)]), SUMS)
            yield pa.RecordBatch.from_arrays([pa.array(keys + (b.column("block")[i].as_py() << 33)), pa.array(values)], names=["_id", "d"])


def sampled_betweenness(edges: DataFrame, sources: DataFrame, node: str = "id") -> DataFrame:
    """Hop-count betweenness from sampled sources: path counts outwards by level, dependencies back by level.

    Nodes are dealt by order of id into blocks that keep their lines. A round is one level: a block carries it along its own lines
    as arrays, in one task, and only sums that go to other blocks travel besides the level itself, packed and compressed. A block has
    about CELLS pairs of a node and a source; sources go in parts of up to SOURCES.
    """
    e = cut_lineage(both_ways(edges).distinct())
    start = cut_lineage(surrogate_key(sources.select(F.col(node).alias("v")).distinct(), "v", None, "s"))
    n_sources = start.count()
    nodes = cut_lineage(e.select(F.col("src").alias("v")).distinct())
    blocks = max(1, -(-nodes.count() * min(n_sources, SOURCES) // CELLS))
    names = cut_lineage(nodes.repartitionByRange(blocks, "v").withColumn("_id", F.monotonically_increasing_id()))
    ends = e.join(names.withColumnsRenamed({"v": "src", "_id": "id"}), "src").join(names.withColumnsRenamed({"v": "dst", "_id": "to"}), "dst")
    block = lambda c: F.shiftright(c, 33)
    held = ends.groupBy("id").agg(F.collect_list("to").alias("dst")).select(block("id").alias("block"), "id", "dst")
    # Stored as it is dealt, which a checkpoint does not tell the planner.
    held = held.repartition(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").persist()
    first = start.join(names, "v").select(block("_id").alias("block"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("v"), "s")

    def step(got: DataFrame, back: bool) -> DataFrame:
        return cut_lineage(held.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(lambda x, y: _level(x, y, back), CELL_ROWS))

    kind = lambda rows, k, to=None: rows.where(F.col("kind") == k).withColumn("kind", F.lit(k if to is None else to))
    total = None
    try:
        for low in range(0, n_sources, SOURCES):
            mine = first.where(F.col("s").between(low + 1, low + SOURCES)).withColumn("s", F.col("s") - low - 1)
            levels = [step(mine.groupBy("block").applyInArrow(_first_cells, CELL_ROWS), False)]
            while not kind(levels[-1], OWN).isEmpty():
                # Edges go both ways, so a neighbour of a level lies on it, next to it on the way back, or is new.
                levels.append(step(levels[-1] if len(levels) == 1 else levels[-1].unionByName(kind(levels[-2], OWN, NEXT)), False))
            got = None
            for level in levels[-2:0:-1]:
                level = kind(level, OWN, NEXT)
                got = step(level if got is None else level.unionByName(got.where(F.col("kind") != SUMS)), True)
                part = kind(got, SUMS)
                total = part if total is None else total.unionByName(part)
    finally:
        held.unpersist()
    if total is None:
        return start.select(F.col("v").alias(node), F.lit(0.0).alias("betweenness"))
    sums = total.mapInArrow(_unpacked, "_id long, d double").groupBy("_id").agg(F.sum("d").alias("betweenness"))
    return names.join(sums, "_id").select(F.col("v").alias(node), "betweenness")
