"""Exact top-k search by inner product: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

All vectors are sorted by descending length and dealt to bands of neighbouring lengths; the queries are dealt to blocks.
Each (query block, band) pair that the product of lengths doesn't rule out is one group. Inside it, the vectors come in
slices of falling length. Both sides are rotated by the right singular vectors of the whole table, so the first
coordinates carry most of a product: a partial sum over them plus the product of the lengths of the two rests bounds the
score from above, and a pair goes on only while that bound reaches the query's k-th best score so far. What is left is
scored exactly on the unrotated vectors. First thresholds come from the longest vectors of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territoria.llm.common import stored

#: Bytes of vectors of one band and of queries of one block: bound the memory of a group.
BAND_BYTES = 4 << 20
BLOCK_BYTES = 32 << 20
#: Longest vectors that give the first thresholds.
SEEDS = 1024
#: Queries and vectors of one slice, and pairs scored at once.
ROWS = 2048
SLICE = 512
PAIRS = 1 << 15
#: What rounding may add to a rotated product, as a share of the product of lengths.
SLACK = 1e-9
LONGEST = (1 << 63) - 1

VECTORS = pa.schema([("ord", pa.int64()), ("vec_id", pa.int64()), ("vec", pa.binary()), ("norm", pa.float64()), ("width", pa.int64())])


def length(m: np.ndarray) -> np.ndarray:
    """Euclidean length of each row; scaled, so that large components don't overflow."""
    top = np.abs(m).max(axis=1, initial=0)
    unit = m / np.where(top > 0, top, 1)[:, None]
    return top * np.sqrt((unit * unit).sum(axis=1))


def _scaled(vector: str, scale: float):
    """Arrow batches (ord, vec_id, vector) to rows of VECTORS; rows whose vector is null or not finite go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            ords, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            flat = np.asarray(col.values.cast(pa.float64()).to_numpy(zero_copy_only=False), float)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(scale * flat)
            ends, live, out = col.offsets.to_numpy(), col.is_valid().to_numpy(zero_copy_only=False), [[], [], [], [], []]
            for i in np.flatnonzero(live):
                v = flat[ends[i]:ends[i + 1]]
                if np.isfinite(v).all():
                    for part, x in zip(out, (ords[i], ids[i], v.tobytes(), float(length(v[None])[0]), len(v))):
                        part.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, VECTORS.types)], schema=VECTORS)

    return run


def scaled(df: DataFrame, key: str, vector: str, scale: float = 1024.0) -> DataFrame:
    """ord, vec_id, vec (float64 bytes of floor(scale * x)), norm, width of every row whose vector can be used."""
    rows = df.select(F.monotonically_increasing_id().alias("ord"), F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec_id").isNotNull()).mapInArrow(_scaled(vector, scale), "ord long, vec_id long, vec binary, norm double, width long")


def matrix(vecs, width: int) -> np.ndarray:
    """Rows of bytes as one float64 matrix; shorter vectors end in zeros."""
    out = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        out[i, :len(v) // 8] = np.frombuffer(v)
    return out


def _gram(width: int, top: float):
    """The sum of the outer products of a task's vectors over ``top``, in rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((width, width)), False
        for b in batches:
            vecs = b.column(0).to_pylist()
            for at in range(0, len(vecs), 4 * SLICE):
                m = matrix(vecs[at:at + 4 * SLICE], width) / top
                total, any_ = total + m.T @ m, True
        if any_:
            i, j = np.divmod(np.arange(width * width), width)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "x"])

    return run


def rotation(vectors: DataFrame, width: int, top: float) -> np.ndarray:
    """Right singular vectors of the whole table, largest singular value first: from width x width sums, whatever the number of rows."""
    sums = vectors.select("vec").mapInArrow(_gram(width, top or 1.0), "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram = np.zeros((width, width))
    for r in sums.toLocalIterator():
        gram[r["i"], r["j"]] = r["x"]
    _, vectors_ = np.linalg.eigh((gram + gram.T) / 2)
    return np.ascontiguousarray(vectors_[:, ::-1])


def scores(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of paired rows of whole numbers. ``bound``: the largest product of lengths among them.

    Below 2^53 every partial sum is a float64 whole number; beyond, Python's integers count, held to the range of a long.
    """
    if bound < 1 << 53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    exact = (sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist()))
    return np.array([max(-LONGEST - 1, min(LONGEST, s)) for s in exact], np.int64)


class Best:
    """The k best (score, id) of each query so far: highest score, then smallest id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.query, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = (np.concatenate(x) for x in ((self.query, query), (self.ids, ids), (self.score, score)))
        order = np.lexsort((ids, ~score, query))  # ~ turns the order of whole numbers round without overflow
        query, ids, score = query[order], ids[order], score[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = rank < self.k
        self.query, self.ids, self.score = query[keep], ids[keep], score[keep]
        full = rank == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full])


def search(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ords: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[Best, int]:
    """Best of each query among ``vectors`` (rows of descending length) with a score of ``floor`` at least; and the pairs scored.

    ``own``: the ord of each query's own row. A floor of minus infinity is none.
    """
    with np.errstate(all="ignore"):
        width = queries.shape[1]
        ends = sorted({max(1, width // 8), max(1, width // 4), max(1, width // 2), width} & set(range(1, width + 1)))
        q_len, v_len = length(queries), length(vectors)
        q_rot, best, scored = queries @ turn, Best(len(queries), k, floor.astype(float)), 0
        q_rest = [length(q_rot[:, e:]) for e in ends]
        for at in range(0, len(vectors), SLICE):
            part, part_len = vectors[at:at + SLICE], v_len[at:at + SLICE]
            slack = SLACK * q_len * part_len[0] + 1
            use = np.flatnonzero(~(q_len * part_len[0] + slack < best.floor))  # not-less keeps pairs whose bound is no number
            if not len(use):
                break  # all that follow are shorter
            rot = part @ turn
            bound = q_rot[use, :ends[0]] @ rot[:, :ends[0]].T + np.outer(q_rest[0][use], length(rot[:, ends[0]:]))
            a, b = np.nonzero(~(bound + slack[use, None] < best.floor[use, None]))
            a = use[a]
            for lo in range(0, len(a), PAIRS):
                x, y = a[lo:lo + PAIRS], b[lo:lo + PAIRS]
                total = np.einsum("ij,ij->i", q_rot[x, :ends[0]], rot[y, :ends[0]])
                for s, e in enumerate(ends[1:-1], 1):
                    total = total + np.einsum("ij,ij->i", q_rot[x, ends[s - 1]:e], rot[y, ends[s - 1]:e])
                    on = ~(total + q_rest[s][x] * length(rot[:, e:])[y] + slack[x] < best.floor[x])
                    x, y, total = x[on], y[on], total[on]
                other = own[x] != ords[at + y]
                x, y = x[other], y[other]
                scored += len(x)
                got = scores(queries[x], part[y], float((q_len[x] * part_len[y]).max(initial=0)))
                good = got >= best.floor[x]
                best.add(x[good], ids[at + y[good]], got[good])
        return best, scored


def _floors(seeds: tuple, turn: np.ndarray, width: int, k: int):
    """Adds to each query the k-th best score among the longest vectors, or minus infinity where they are fewer."""
    vecs, ords, ids = seeds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = matrix(vecs, width)
        for b in batches:
            out, all_ = [], b.column("vec").to_pylist()
            for at in range(0, len(all_), SLICE):
                queries = matrix(all_[at:at + SLICE], width)
                own = b.column("ord").to_numpy()[at:at + SLICE]
                out.append(search(queries, own, np.full(len(queries), -np.inf), longest, ords, ids, turn, k)[0].floor)
            yield b.append_column("floor", pa.array(np.concatenate([np.zeros(0), *out])))

    return run


def _group(turn: np.ndarray, width: int, k: int):
    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(-vectors["norm"].to_numpy(float), kind="stable")
        v = vectors.iloc[order]
        m, ords, ids = matrix(v["vec"].tolist(), width), v["ord"].to_numpy(np.int64), v["vec_id"].to_numpy(np.int64)
        out = [pd.DataFrame({"ord": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        for at in range(0, len(queries) if len(v) else 0, ROWS):
            q = queries.iloc[at:at + ROWS]
            own = q["ord"].to_numpy(np.int64)
            best, _ = search(matrix(q["vec"].tolist(), width), own, q["floor"].to_numpy(float), m, ords, ids, turn, k)
            out.append(pd.DataFrame({"ord": own[best.query], "query_id": q["vec_id"].to_numpy(np.int64)[best.query], "vec_id": best.ids, "score": best.score}))
        return pd.concat(out)

    return run


def top_inner(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0,
              band_bytes: int = BAND_BYTES, block_bytes: int = BLOCK_BYTES, seeds: int = SEEDS) -> DataFrame:
    """query_id, rank, vec_id, score: of every row where ``is_query`` (over the column vec_id) holds, the k highest inner
    products with the other rows of ``df``, ties to the smaller id. Exact.

    Components become floor(scale * x) in double. Rows without an id take no part, nor do vectors that are null or hold
    a component that is null or not finite (after scaling). Vectors of unequal width are compared as if the shorter
    ended in zeros; an empty vector has score 0 with all. A row is a candidate for every query but itself: rows that
    repeat an id are queries and candidates of their own, and their results repeat. Scores beyond a long are held at its
    ends. An empty table gives no rows; other columns are not read.

    Tasks hold one block of queries and one band of vectors. A third of all rows with one vector is dealt to many bands,
    because bands are cut by length and then row. What each query gathers is k rows a band at most, cut to k again before
    the last shuffle. The rotation is width x width numbers and comes from sums over all rows.
    """
    spark = df.sparkSession
    slim = stored(scaled(df, key, vector, scale), "vectors")
    size = slim.agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width"), F.max("norm").alias("top"), F.count_if(is_query).alias("queries")).first()
    n, width = size["n"], max(1, size["width"] or 1)
    bands, blocks = max(1, math.ceil(8 * n * width / band_bytes)), max(1, math.ceil(8 * size["queries"] * width / block_bytes))
    turn = rotation(slim, width, size["top"]) if n else np.eye(width)
    # Neighbours by length share a band; the row number parts vectors of one length.
    dealt = slim.repartitionByRange(bands, F.desc("norm"), F.col("ord")).withColumn("band", F.spark_partition_id())
    dealt = stored(dealt, "bands")
    longest = dealt.orderBy(F.desc("norm"), "ord").limit(seeds).collect()
    lead = ([r["vec"] for r in longest], np.array([r["ord"] for r in longest], np.int64), np.array([r["vec_id"] for r in longest], np.int64))
    asked = slim.where(is_query).select("ord", "vec_id", "vec", "norm").mapInArrow(_floors(lead, turn, width, k), "ord long, vec_id long, vec binary, norm double, floor double")
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("ord"), F.lit(blocks))), "queries")
    # A band is needed by a block if its longest vector can still reach some query's floor.
    reach = asked.groupBy("block").agg(F.min(F.when(F.col("norm") > 0, (F.col("floor") - 1) / F.col("norm") * (1 - SLACK)).otherwise(F.when(F.col("floor") > 1, F.lit(math.inf)).otherwise(F.lit(-math.inf)))).alias("least"))
    tops = dealt.groupBy("band").agg(F.max("norm").alias("top")).agg(F.collect_list(F.struct("band", "top")).alias("tops"))  # one row, a number a band
    needed = F.transform(F.filter("tops", lambda t: t["top"] >= F.col("least")), lambda t: t["band"])
    cells = stored(reach.crossJoin(F.broadcast(tops)).select("block", F.explode(needed).alias("band")), "cells")
    pairs = asked.join(cells, "block").groupBy("block", "band").cogroup(dealt.join(cells, "band").groupBy("block", "band"))
    found = pairs.applyInPandas(_group(turn, width, k), "ord long, query_id long, vec_id long, score long")
    order = W.partitionBy("ord").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 100, candidates all rows."""
    return top_inner(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


SQL = r"""
WITH v AS (SELECT row_number() OVER () AS ord, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.ord, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.ord <> c.ord)
SELECT query_id, row_number() OVER (PARTITION BY ord ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY ord ORDER BY score DESC, vec_id) <= 10
"""
