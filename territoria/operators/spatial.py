"""Nearest, k-nearest and radius joins on the km plane, and point-in-polygon joins.

The k-nearest search walks a pyramid of cells (each a quarter of its parent's side). At every level the cells that
cannot hold one of the k best points are dropped, using only cell counts, so a dense cell is split instead of being
paired with everything in it. Both sides are first collapsed to distinct locations, so copies of one location are
searched once, and a location keeps only its k smallest ids.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territoria.functions.geo import inside_ring, ring_area, ring_bounds, ring_distance
from territoria.operators.ranking import top_per_group
from territoria.session import cut_lineage

ROOT_KM = 2048.0
LEAF_ROWS = 32
MAX_DEPTH = 12
MAX_ROOT_CELLS = 4096
#: Rows of one side that meet in one slice of a cell.
CELL_ROWS = 2048
#: Undecided polygons that a cell may hold before it is split, and splits at most.
FEW_POLYGONS, CELL_SPLITS = 4, 6


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def _box_distance(x: Column, y: Column, cx: Column, cy: Column, size: float) -> tuple[Column, Column]:
    """Smallest and largest distance from (x, y) to the square cell (cx, cy)."""
    x0, y0 = cx * size, cy * size
    nx = F.greatest(x0 - x, x - x0 - size, F.lit(0.0))
    ny = F.greatest(y0 - y, y - y0 - size, F.lit(0.0))
    fx = F.greatest(F.abs(x - x0), F.abs(x - x0 - size))
    fy = F.greatest(F.abs(y - y0), F.abs(y - y0 - size))
    return F.hypot(nx, ny), F.hypot(fx, fy)


def _dealt(spots: DataFrame) -> DataFrame:
    """``spots`` in all shuffle partitions: a few MB of locations grow a hundredfold, so they must not be merged into one task."""
    return spots.repartition(int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y")


def _levels(points: DataFrame, root: float, depth: int) -> list[DataFrame]:
    """Cell tables of every level, each rolled up from the next finer one: (cx, cy, n, wlo, whi)."""
    finest = root / 4**depth
    out = [points.groupBy(_cell("x", finest).alias("cx"), _cell("y", finest).alias("cy")).agg(
        F.count(F.lit(1)).alias("n"), F.min("w").alias("wlo"), F.max("w").alias("whi"))]
    for _ in range(depth):
        out.append(out[-1].groupBy(F.floor(F.col("cx") / 4).cast("long").alias("cx"), F.floor(F.col("cy") / 4).cast("long").alias("cy")).agg(
            F.sum("n").alias("n"), F.min("wlo").alias("wlo"), F.max("whi").alias("whi")))
    return out[::-1]


def pyramid_depth(points: DataFrame, root: float, leaf: int = LEAF_ROWS, limit: int = MAX_DEPTH) -> int:
    """Coarsest level whose fullest cell holds at most ``leaf`` points; also checks that root cells are few."""
    finest = root / 4**limit
    base = points.groupBy(_cell("x", finest).alias("cx"), _cell("y", finest).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    up = [F.struct(F.lit(d).alias("level"), F.floor(F.col("cx") / 4 ** (limit - d)).cast("long").alias("cx"),
                   F.floor(F.col("cy") / 4 ** (limit - d)).cast("long").alias("cy"), F.col("n")) for d in range(limit + 1)]
    per_cell = base.select(F.inline(F.array(*up))).groupBy("level", "cx", "cy").agg(F.sum("n").alias("n"))
    rows = {r["level"]: r for r in per_cell.groupBy("level").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("cells")).collect()}
    if rows and rows[0]["cells"] > MAX_ROOT_CELLS:
        raise ValueError(f"{rows[0]['cells']} root cells of {root}: coordinates are not on the expected plane, pass a larger root")
    return next((d for d in range(limit + 1) if not rows or rows[d]["most"] <= leaf), limit)


def knn_join(left: DataFrame, right: DataFrame, k: int, left_id: str = "id", right_id: str = "sid", max_km: float | None = None,
             exclude_self: bool = False, carry: Sequence[str] = (), weight: str | None = None,
             cost: Callable[[Column, Column], Column] | None = None, root: float = ROOT_KM, leaf: int = LEAF_ROWS) -> DataFrame:
    """(left_id, right_id, dist, rank, carry…): the k right points of lowest cost for every left row.

    Both frames carry plane coordinates ``x``, ``y``. ``cost(distance, weight)`` defaults to the distance; it must grow
    with the distance and fall with the weight. Ties go to the smaller right id. ``exclude_self`` drops the pair with
    equal ids (leave-one-out).
    """
    cost = cost or (lambda d, w: d)
    want = k + 1 if exclude_self else k
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pts = right.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col(right_id).alias("_rid"), "x", "y", w.alias("w"), *carry)
    # Read by the depth check, every level and the final join: computed once.
    pts = cut_lineage(top_per_group(pts, ["x", "y"], [F.col("w").desc(), F.col("_rid").asc()], want))
    slim = pts.select("x", "y", "w")
    depth = pyramid_depth(slim, root, leaf)
    levels = _levels(slim, root, depth)
    rows = left.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col(left_id), "x", "y")
    spots = _dealt(rows.select("x", "y").distinct())
    here = W.partitionBy("x", "y")
    cand = spots.crossJoin(F.broadcast(levels[0]))
    for d in range(depth + 1):
        size = root / 4**d
        if d:
            child = levels[d].select(F.floor(F.col("cx") / 4).cast("long").alias("px"), F.floor(F.col("cy") / 4).cast("long").alias("py"), "*")
            cand = cand.select("x", "y", F.col("cx").alias("px"), F.col("cy").alias("py")).join(child, ["px", "py"], "inner")
            cand = _dealt(cand)
        near, far = _box_distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), size)
        cand = cand.withColumn("_near", near).withColumn("_best", cost(near, F.col("whi"))).withColumn("_worst", cost(far, F.col("wlo")))
        if max_km is not None:
            cand = cand.where(F.col("_near") <= max_km * (1 + 1e-9))
        seen = F.sum("n").over(here.orderBy("_worst").rowsBetween(W.unboundedPreceding, 0))
        cand = cand.withColumn("_cum", seen)
        bound = F.min(F.when(F.col("_cum") >= want, F.col("_worst"))).over(here)
        cand = cand.withColumn("_bound", bound).where(
            F.col("_bound").isNull() | (F.col("_best") <= F.col("_bound") + 1e-9 * F.abs("_bound") + 1e-12)).select("x", "y", "cx", "cy")
    size = root / 4**depth
    cells = pts.select(_cell("x", size).alias("cx"), _cell("y", size).alias("cy"), F.col("x").alias("_rx"), F.col("y").alias("_ry"), "w", "_rid", *carry)
    pairs = cand.join(cells, ["cx", "cy"], "inner").withColumn("dist", F.hypot(F.col("x") - F.col("_rx"), F.col("y") - F.col("_ry")))
    pairs = pairs.where(F.col("dist") <= max_km) if max_km is not None else pairs
    pairs = pairs.withColumn("_cost", cost(F.col("dist"), F.col("w")))
    pairs = _dealt(pairs)
    best = W.partitionBy("x", "y").orderBy(F.col("_cost").asc(), F.col("_rid").asc())
    pairs = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= want)
    out = rows.join(pairs.select("x", "y", "_rid", "dist", "_cost", "rank", *carry), ["x", "y"], "inner")
    if exclude_self:
        own = W.partitionBy(left_id).orderBy("rank")
        out = out.where(F.col(left_id) != F.col("_rid")).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select(left_id, F.col("_rid").alias(right_id), "dist", "rank", *carry)


def nearest_join(left: DataFrame, right: DataFrame, left_id: str = "id", right_id: str = "sid", max_km: float | None = None,
                 carry: Sequence[str] = (), fallback: dict[str, object] | None = None, root: float = ROOT_KM) -> DataFrame:
    """Every left row with its nearest right point; rows without one within ``max_km`` get nulls or ``fallback``."""
    near = knn_join(left, right, 1, left_id, right_id, max_km, carry=carry, root=root).drop("rank")
    out = left.join(near, left_id, "left").withColumn("covered", F.col("dist").isNotNull())
    for c, v in (fallback or {}).items():
        out = out.withColumn(c, F.when(F.col("covered"), F.col(c)).otherwise(F.lit(v)))
    return out


def radius_cells(left: DataFrame, right: DataFrame, radius: float, right_cols: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Distinct left locations and right rows, each with the cell (cx, cy) and the slices (_ls, _rs) in which they meet.

    A left location visits the cells around it. Where more than ``most`` rows of a side come to one cell, that side is
    dealt into slices by hash and the other side goes to each, so no group holds more than about ``most`` of either.
    """
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    here = F.col("x").isNotNull() & F.col("y").isNotNull()
    spots = cut_lineage(left.where(here).select("x", "y").distinct())
    a = spots.select("x", "y", around.alias("o")).select("x", "y", (_cell("x", radius) + F.col("o.i")).alias("cx"), (_cell("y", radius) + F.col("o.j")).alias("cy"))
    b = cut_lineage(right.where(here).select(_cell("x", radius).alias("cx"), _cell("y", radius).alias("cy"), F.col("x").alias("_rx"), F.col("y").alias("_ry"), *right_cols))
    slices = lambda name: F.ceil(F.count(F.lit(1)) / most).alias(name)
    cells = a.groupBy("cx", "cy").agg(slices("_nl")).join(b.groupBy("cx", "cy").agg(slices("_nr")), ["cx", "cy"])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = a.join(cells, ["cx", "cy"]).withColumn("_ls", F.pmod(F.xxhash64("x", "y"), F.col("_nl"))).withColumn("_rs", every("_nr")).drop("_nl", "_nr")
    b = b.join(cells, ["cx", "cy"]).withColumn("_rs", F.pmod(F.xxhash64("_rx", "_ry", *right_cols), F.col("_nr"))).withColumn("_ls", every("_nl")).drop("_nl", "_nr")
    return a, b


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, right_cols: Sequence[str], most: int = CELL_ROWS) -> DataFrame:
    """(x, y, dist, right_cols…) for distinct left locations and right rows within the radius, by slices of cells."""
    a, b = radius_cells(left, right, radius, right_cols, most)
    d = F.hypot(F.col("x") - F.col("_rx"), F.col("y") - F.col("_ry"))
    return a.join(b, ["cx", "cy", "_ls", "_rs"], "inner").withColumn("dist", d).where(F.col("dist") <= radius).drop("cx", "cy", "_ls", "_rs", "_rx", "_ry")


def radius_join(left: DataFrame, right: DataFrame, radius: float, left_id: str = "id", right_cols: Sequence[str] = ("sid",)) -> DataFrame:
    """Left ids with every right row within the radius (the result itself is the list of pairs)."""
    return _dealt(left.select(left_id, "x", "y")).join(_dealt(radius_pairs(left, right, radius, right_cols)), ["x", "y"], "inner").drop("x", "y")


def radius_sums(left: DataFrame, right: DataFrame, radius: float, sums: dict[str, Column], left_id: str = "id",
                root: float = ROOT_KM, leaf: int = LEAF_ROWS) -> DataFrame:
    """Totals of the right rows within the radius, without forming the pairs of a dense area.

    Cells wholly inside the circle add their totals, cells outside are dropped, cut cells are split down the pyramid;
    only the points of the last cut cells are compared one by one.
    """
    names = list(sums)
    pts = cut_lineage(right.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("x", "y").agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    depth = pyramid_depth(pts.select("x", "y"), root, leaf)
    finest = root / 4**depth
    levels = [pts.groupBy(_cell("x", finest).alias("cx"), _cell("y", finest).alias("cy")).agg(*[F.sum(n).alias(n) for n in names])]
    for _ in range(depth):
        levels.append(levels[-1].groupBy(F.floor(F.col("cx") / 4).cast("long").alias("cx"), F.floor(F.col("cy") / 4).cast("long").alias("cy")).agg(
            *[F.sum(n).alias(n) for n in names]))
    levels = levels[::-1]
    rows = left.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    cand = rows.select("x", "y").distinct().crossJoin(F.broadcast(levels[0]))
    parts = []
    for d in range(depth + 1):
        size = root / 4**d
        if d:
            child = levels[d].select(F.floor(F.col("cx") / 4).cast("long").alias("px"), F.floor(F.col("cy") / 4).cast("long").alias("py"), "*")
            cand = cand.select("x", "y", F.col("cx").alias("px"), F.col("cy").alias("py")).join(child, ["px", "py"], "inner").drop("px", "py")
        near, far = _box_distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), size)
        cand = cand.withColumn("_near", near).withColumn("_far", far).where(F.col("_near") <= radius * (1 + 1e-9))
        whole = F.col("_far") <= radius * (1 - 1e-9)
        parts.append(cand.where(whole).select("x", "y", *names))
        cand = cand.where(~whole).select("x", "y", "cx", "cy")
    cells = pts.select(_cell("x", finest).alias("cx"), _cell("y", finest).alias("cy"), F.col("x").alias("_rx"), F.col("y").alias("_ry"), *names)
    last = cand.join(cells, ["cx", "cy"], "inner").where(F.hypot(F.col("x") - F.col("_rx"), F.col("y") - F.col("_ry")) <= radius)
    parts.append(last.select("x", "y", *names))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    per_spot = out.groupBy("x", "y").agg(*[F.sum(n).alias(n) for n in names])
    return left.select(left_id, "x", "y").join(per_spot, ["x", "y"], "left").drop("x", "y")


def nearest_of_another_group(nodes: DataFrame, group: str, node: str = "id", max_km: float | None = None, root: float = ROOT_KM, leaf: int = LEAF_ROWS) -> DataFrame:
    """(x, y, group, _b, dist): for each location and group the nearest node of another group, ties to the smaller id.

    The search walks the pyramid with the least and the greatest group of every cell: a cell that holds the own group only
    is dropped, any other one has a node to offer and bounds the distance by its far corner. So a dense area of one
    group is never searched from within.
    """
    known = nodes.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(group).isNotNull())
    one = known.groupBy("x", "y", F.col(group).alias("_g")).agg(F.min(node).alias("_b"))
    one = cut_lineage(one)
    spots = one.select("x", "y", F.col("_g").alias("_own"))
    pts = cut_lineage(top_per_group(one, ["x", "y"], [F.col("_b").asc()], 2))  # whatever the own group is, one of two is another
    depth = pyramid_depth(pts.select("x", "y"), root, leaf)
    finest = root / 4**depth
    levels = [pts.groupBy(_cell("x", finest).alias("cx"), _cell("y", finest).alias("cy")).agg(F.min("_g").alias("glo"), F.max("_g").alias("ghi"))]
    for _ in range(depth):
        up = levels[-1].groupBy(F.floor(F.col("cx") / 4).cast("long").alias("cx"), F.floor(F.col("cy") / 4).cast("long").alias("cy"))
        levels.append(up.agg(F.min("glo").alias("glo"), F.max("ghi").alias("ghi")))
    levels = levels[::-1]
    cand = spots.crossJoin(F.broadcast(levels[0]))
    here = W.partitionBy("x", "y", "_own")
    for d in range(depth + 1):
        size = root / 4**d
        if d:
            child = levels[d].select(F.floor(F.col("cx") / 4).cast("long").alias("px"), F.floor(F.col("cy") / 4).cast("long").alias("py"), "*")
            cand = cand.select("x", "y", "_own", F.col("cx").alias("px"), F.col("cy").alias("py")).join(child, ["px", "py"], "inner")
        near, far = _box_distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), size)
        cand = cand.where((F.col("glo") != F.col("_own")) | (F.col("ghi") != F.col("_own"))).withColumn("_near", near).withColumn("_far", far)
        if max_km is not None:
            cand = cand.where(F.col("_near") <= max_km * (1 + 1e-9))
        cand = cand.withColumn("_bound", F.min("_far").over(here)).where(F.col("_near") <= F.col("_bound") * (1 + 1e-9) + 1e-12).select("x", "y", "_own", "cx", "cy")
    cells = pts.select(_cell("x", finest).alias("cx"), _cell("y", finest).alias("cy"), F.col("x").alias("_rx"), F.col("y").alias("_ry"), "_g", "_b")
    met = cand.join(cells, ["cx", "cy"]).where(F.col("_g") != F.col("_own")).withColumn("dist", F.hypot(F.col("x") - F.col("_rx"), F.col("y") - F.col("_ry")))
    met = met if max_km is None else met.where(F.col("dist") <= max_km)
    return met.groupBy("x", "y", F.col("_own").alias(group)).agg(F.min_by("_b", F.struct("dist", "_b")).alias("_b"), F.min("dist").alias("dist"))


def other_level_pairs(nodes: DataFrame, group: str, max_km: float = 0.05, node: str = "id") -> DataFrame:
    """Unordered pairs (a, b) of each node with the nearest node of another group within ``max_km``."""
    best = nodes.select(node, group, "x", "y").join(nearest_of_another_group(nodes, group, node, max_km), ["x", "y", group])
    return best.select(F.least(node, "_b").alias("a"), F.greatest(node, "_b").alias("b"), "dist").dropDuplicates(["a", "b"])


# --- polygons --------------------------------------------------------------------------------

def _covering(polys: DataFrame, key: str, size: float, pad: float) -> DataFrame:
    """(cx, cy, key): the cells under each ring's box, widened by ``pad``."""
    b = ring_bounds("ring")
    xs = F.sequence(F.floor((b["west"] - pad) / size).cast("long"), F.floor((b["east"] + pad) / size).cast("long"))
    ys = F.sequence(F.floor((b["south"] - pad) / size).cast("long"), F.floor((b["north"] + pad) / size).cast("long"))
    return polys.select(key, F.explode(xs).alias("cx"), ys.alias("_ys")).select(key, "cx", F.explode("_ys").alias("cy"))


def _cover(cand: DataFrame, polys: DataFrame, key: str, size: float, near: float | None) -> DataFrame:
    """(cx, cy, key, whole, open) of the candidates (cx, cy, key) that can decide a point of their cell.

    The distance from a cell's centre to a ring bounds that of each of its points by half a diagonal more or less. So a
    cell lies wholly in a polygon, wholly outside, or is cut by the ring. A whole polygon rules out all that rank behind
    it, and those that are only near; among the near ones, those go that are farther away at best than another at worst.
    """
    mid = lambda c: (F.col(c) + 0.5) * size
    half = size * 2**0.5 / 2 * (1 + 1e-9)
    c = cand.join(polys.select(key, "ring", "_order"), key).withColumn("_d", ring_distance(mid("cx"), mid("cy"), "ring"))
    c = c.withColumn("_in", inside_ring(mid("cx"), mid("cy"), "ring")).drop("ring")
    clear = F.col("_d") > half
    c = c.withColumn("whole", clear & F.col("_in")).where(~clear | F.col("_in") | (F.lit(near is not None) & (F.col("_d") - half <= (near or 0.0))))
    here = W.partitionBy("cx", "cy")
    c = c.withColumn("_first", F.min(F.when(F.col("whole"), F.col("_order"))).over(here))
    c = c.withColumn("_reach", F.min(F.when(~F.col("whole"), F.col("_d") + half)).over(here))
    ranks = F.col("_first").isNull() | (F.col("_order") < F.col("_first"))
    cut = ~clear & ranks
    close = clear & ~F.col("_in") & F.col("_first").isNull() & (F.col("_d") - half <= F.col("_reach") + 1e-8)
    c = c.where((F.col("whole") & (F.col("_order") == F.col("_first"))) | cut | close)
    return c.select("cx", "cy", key, "whole", F.count_if(~F.col("whole")).over(here).alias("open"))


def polygon_tests(spots: DataFrame, polys: DataFrame, key: str, near: float | None, cell: float, few: int, depth: int) -> DataFrame:
    """(lon, lat, key, whole): the polygons (key, ring, _order) that each of the distinct ``spots`` is to be tested against."""
    open_spots, size, tests = spots, cell, []
    cand = _covering(polys, key, cell, near or 0.0)
    for level in range(depth + 1):
        at = lambda c, s=size: F.floor(F.col(c) / s).cast("long")
        placed = open_spots.select("lon", "lat", at("lon").alias("cx"), at("lat").alias("cy"))
        cells = placed.select("cx", "cy").distinct()
        if level:
            # Cells split on a grid of quarters, so a child's parent is its number over four.
            parent = lambda c: F.floor(F.col(c) / 4).cast("long")
            above = cand.select(F.col("cx").alias("px"), F.col("cy").alias("py"), key)
            cand = cells.withColumn("px", parent("cx")).withColumn("py", parent("cy")).join(above, ["px", "py"]).drop("px", "py")
        else:
            cand = cand.join(cells, ["cx", "cy"])
        cover = cut_lineage(_cover(cand, polys, key, size, near))
        tests.append(placed.join(cover.where(F.col("open") <= few) if level < depth else cover, ["cx", "cy"]).select("lon", "lat", key, "whole"))
        cand = cover.where(F.col("open") > few).select("cx", "cy", key)
        if level == depth or cand.isEmpty():
            break
        open_spots, size = placed.join(cand.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi").select("lon", "lat"), size / 4
    return reduce(DataFrame.unionByName, tests)


def polygon_join(points: DataFrame, polys: DataFrame, key: str, values: Sequence[str] = (), point_id: str = "id", near: float | None = 1.0,
                 largest: bool = False, cell: float = 1.0, few: int = FEW_POLYGONS, depth: int = CELL_SPLITS) -> DataFrame:
    """Left join of points to the polygon holding them (smallest key, or largest area), then nearest within ``near``.

    Coordinates are ``lon``/``lat`` in the units of the rings. Columns added: key, values, ``how`` (inside, near, none).
    Cells that hold points are covered top down: where more than ``few`` polygons are undecided, a cell is split in 16, up
    to ``depth`` times. Rings come back only for cells that they cut or nearly touch, so a point is tested against a few
    polygons, however many lie about its city.
    """
    order = F.struct((-F.round("_area", 9)).alias("a"), F.col(key).alias("k")) if largest else F.struct(F.col(key).alias("k"))
    polys = polys.withColumn("_area", ring_area("ring")).withColumn("_order", order)
    spots = cut_lineage(points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("lon", "lat").distinct())
    tested = polygon_tests(spots, polys, key, near, cell, few, depth)
    tested = tested.join(polys.select(key, "ring", "_order", *values), key)
    tested = tested.withColumn("_hit", F.col("whole") | inside_ring("lon", "lat", "ring"))
    pick = F.struct(key, *values)
    picks = [F.min_by(F.when(F.col("_hit"), pick), F.when(F.col("_hit"), F.col("_order"))).alias("_in")]
    if near is not None:
        tested = tested.withColumn("_d", F.when(~F.col("_hit"), ring_distance("lon", "lat", "ring")))
        close = F.col("_d") <= near
        picks.append(F.min_by(F.when(close, pick), F.when(close, F.struct(F.round("_d", 9).alias("d"), F.col(key).alias("k")))).alias("_nr"))
    found = tested.groupBy("lon", "lat").agg(*picks)
    best = F.coalesce("_in", "_nr") if near is not None else F.col("_in")
    how = F.when(F.col("_in").isNotNull(), "inside")
    how = how.when(F.col("_nr").isNotNull(), "near") if near is not None else how
    found = found.select("lon", "lat", best.alias("_p"), how.alias("how"))
    return points.join(found, ["lon", "lat"], "left").select(*[points[c] for c in points.columns], *[F.col("_p")[c].alias(c) for c in (key, *values)], F.coalesce("how", F.lit("none")).alias("how"))


def polygon_mask(points: DataFrame, polys: DataFrame, key: str, buffer: float, columns: Sequence[str], cell: float = 1.0) -> DataFrame:
    """Columns become null outside every polygon widened by ``buffer``."""
    j = polygon_join(points, polys, key, near=buffer, cell=cell) if key not in points.columns else polygon_join(points.drop(key), polys, key, near=buffer, cell=cell)
    return j.select(*[F.when(F.col("how") != "none", F.col(c)).alias(c) if c in columns else F.col(c) for c in points.columns])
