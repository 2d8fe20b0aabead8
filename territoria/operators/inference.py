"""Resampling inference and sensitivity: bootstrap, permutation, Monte Carlo, sweeps, variance indices, calibration.

Every random draw is made of 15 hexadecimal digits of an md5 of (seed, replicate, number of the draw): a recomputed task
draws the same numbers, and so does any other engine. Draws that all rows share are one row of arrays, as long as the
number of draws; the rows meet them in array functions, so nothing is exploded or shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache, reduce
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territoria.functions.combine import RELATIVE_SIGMA, WEIGHTS_INDEX
from territoria.functions.scalars import clip, let
from territoria.operators.ranking import quantiles, surrogate_key, value_ranks
from territoria.operators.stats import spearman
from territoria.session import cut_lineage

#: Rows whose columns travel to the replicates as one row of arrays; with more, draws and ranks are tables.
ARRAY_ROWS = 1 << 20
#: Replicates of one task.
REPLICATES = 50
#: With more rows: bytes of the draws that a task holds, and rows that pass by at a time.
DRAWN_BYTES, STREAM_ROWS = 1 << 27, 1 << 13
#: What md5 adds in each step and by how many bits it turns, and the digests that are made at a time.
MD5_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
MD5_ROWS = 10000
#: Rows of a Monte Carlo run whose draws are held at a time.
DRAWN_ROWS = 32


def word(text: Column, half: int | Column = 0) -> Column:
    """A whole number of 60 bits: the first 15 hexadecimal digits of one half of an md5."""
    start = F.lit(1) + F.lit(16) * (F.lit(half) if isinstance(half, int) else half)
    return F.conv(F.substr(F.md5(text), start.cast("int"), F.lit(15)), 16, 10).cast("long")


def uniform(text: Column, half: int = 0) -> Column:
    """Uniform in (0, 1)."""
    return (word(text, half).cast("double") + 0.5) / float(2**60)


def gaussian(text: Column) -> Column:
    """Standard normal by Box-Muller on both halves of one md5."""
    return F.sqrt(-2 * F.ln(uniform(text))) * F.cos(2 * pi * uniform(text, 1))


def labelled(*parts) -> Column:
    return F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


@lru_cache(maxsize=8)
def _digits(first: int, n: int, size: int) -> np.ndarray:
    """The last ``size`` digits of n numbers from ``first`` on, as text, a row each."""
    return (np.arange(first, first + n)[:, None] // 10 ** np.arange(size)[::-1] % 10 + 48).astype(np.uint8)


def _digests(prefix: bytes, first: int, last: int) -> np.ndarray:
    """The md5 of ``prefix`` and each of the numbers first..last-1, which have the same count of digits, as four words each (RFC 1321, a column at a time)."""
    n, size = last - first, len(prefix) + len(str(first))
    text = bytearray(prefix + str(first).encode() + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little")
    block = list(np.frombuffer(bytes(text), "<u4"))
    # Only the last digits differ, in one or a few words.
    differ = next((len(str(first)) - k for k, (x, y) in enumerate(zip(str(first), str(last - 1))) if x != y), 0)
    if differ:
        low, high = (size - differ) // 4, (size + 3) // 4
        part = np.empty((n, 4 * (high - low)), np.uint8)
        part[:] = text[4 * low:4 * high]
        part[:, size - differ - 4 * low:size - 4 * low] = _digits(first % 10 ** differ, n, differ)
        block[low:high] = np.ascontiguousarray(part.view("<u4").T)
    # Words that all texts share are added with the constant of the step; the rest is done in place.
    shared = [None if w.ndim else int(w) for w in block]
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, v, np.uint32) for v in start)
    f, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for r in range(64):
        if r < 16:
            g = r
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif r < 32:
            g = (5 * r + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif r < 48:
            g = (3 * r + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * r % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if shared[g] is None:
            f += block[g]
        f += np.uint32((int(MD5_ADDED[r]) + (shared[g] or 0)) & 0xFFFFFFFF)
        turn = MD5_TURNS[r // 16][r % 4]
        np.left_shift(f, np.uint32(turn), out=turned)
        f >>= np.uint32(32 - turn)
        f |= turned
        f += b
        a, d, c, b, f = d, c, b, f, a
    return np.stack([np.uint32(x) + y for x, y in zip(start, (a, b, c, d))], axis=1).astype("<u4", copy=False)


def halves(prefix: str, n: int) -> np.ndarray:
    """The numbers ``word`` gives for both halves of the md5 of ``prefix`` and each of 0..n-1, a row each."""
    head, out, low = prefix.encode(), np.empty((n, 4), "<u4"), 0
    if len(head) + len(str(n)) > 55:  # more than one block
        return np.frombuffer(b"".join(hashlib.md5(head + str(i).encode()).digest() for i in range(n)), ">u8").reshape(n, 2).astype(np.uint64) >> np.uint64(4)
    while low < n:
        high = min(n, low + MD5_ROWS - low % MD5_ROWS, 10 ** len(str(low)))
        out[low:high] = _digests(head, low, high)
        low = high
    return out.view(">u8").astype(np.uint64) >> np.uint64(4)


def words(seed: int, rep: int, n: int) -> np.ndarray:
    """The numbers ``word`` gives for the draws 0..n-1 of a replicate: two of each md5."""
    return halves(f"{seed}:{rep}:", (n + 1) // 2).reshape(-1)[:n]


def drawn(seed: int, rep: str, draw: str) -> Column:
    return word(labelled(seed, F.col(rep), F.floor(F.col(draw) / 2)), F.col(draw) % 2)


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Rows with a dense index 0..n-1 in key order (unique numeric key)."""
    return surrogate_key(df, key, None, "_i").withColumn("_i", F.col("_i") - 1)


def _arrays(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row: an array of each column, by ascending key."""
    row = F.struct(F.col(key).alias("_k"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    packed = df.agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return packed.select(*[F.col(f"_rows._{i}").alias(f"_c{i}") for i in range(len(columns))])


def _replicated(df: DataFrame, key: str, columns: Sequence[str], reps: int, prepare: Callable[[np.ndarray], np.ndarray], kernel: Callable[[list[np.ndarray], int], list[tuple]], schema: str) -> DataFrame:
    """The rows that ``kernel`` gives for the prepared columns and each replicate; a block of up to REPLICATES replicates is a task."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                values = [prepare(b.column(k + 1)[i].values.to_numpy(zero_copy_only=False)) for k in range(len(columns))]
                first = b.column(0)[i].as_py() * each
                out = [r for rep in range(first, min(reps, first + each)) for r in kernel(values, rep)]
                yield pa.RecordBatch.from_pydict({n: [r[k] for r in out] for k, n in enumerate(names)})

    each = max(1, min(REPLICATES, reps // 8))
    blocks = math.ceil(reps / each)
    return df.sparkSession.range(0, blocks, 1, blocks).crossJoin(F.broadcast(_arrays(df, key, columns))).mapInArrow(run, schema)


def _places(values: np.ndarray) -> np.ndarray:
    """The number of each row's value among the different ones, in ascending order."""
    return np.unique(values, return_inverse=True)[1]


def _centred_ranks(place: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Each row's average-tie rank less the mean rank, where row i occurs ``times[i]`` times and ``place`` numbers its value: one prefix sum."""
    at = np.bincount(place, times)
    return (np.cumsum(at) - at + (at + 1) / 2)[place] - (times.sum() + 1) / 2


def _correlation(a: np.ndarray, b: np.ndarray, times: np.ndarray | float = 1.0) -> float | None:
    scale = math.sqrt((times * a * a).sum() * (times * b * b).sum())
    return float((times * a * b).sum() / scale) if scale > 0 else None


def bootstrap_rho(df: DataFrame, key: str, models: Sequence[str], target: str, n_boot: int = 5000, seed: int = 42, min_distinct: int = 5) -> DataFrame:
    """(model, rep, rho): rank correlation of every model with the target on shared draws; degenerate draws are dropped.

    Up to ARRAY_ROWS rows, the columns are numbered once a task and each replicate is two prefix sums; beyond, a task holds what a
    few replicates draw of each row and the rows pass by in blocks. Both draw the same rows.
    """
    models = list(models)
    ok = df.dropna(subset=[*models, target]).select(key, *[F.col(m).cast("double").alias(m) for m in models], F.col(target).cast("double").alias(target))
    if ok.limit(ARRAY_ROWS + 1).count() > ARRAY_ROWS:
        return _streamed_rho(ok, key, models, target, n_boot, seed, min_distinct)

    def kernel(places: list[np.ndarray], rep: int) -> list[tuple]:
        *xs, y = places
        n = len(y)
        times = np.bincount((words(seed, rep, n) % np.uint64(n)).astype(np.int64), minlength=n).astype(float) if n else np.zeros(0)
        if (times > 0).sum() < min_distinct:
            return []
        b = _centred_ranks(y, times)
        found = [(m, rep, _correlation(_centred_ranks(x, times), b, times)) for m, x in zip(models, xs)]
        return [f for f in found if f[2] is not None]

    return _replicated(ok, key, [*models, target], n_boot, _places, kernel, "model string, rep long, rho double")


def _block(t: pa.Table) -> pa.Table:
    """The rows of a block in one: numbers of its rows, whether a value is new after the row before, codes of the target, first and last value."""
    t = t.sort_by("pos")
    i, v, y = (t.column(c).to_numpy() for c in ("_i", "v", "y"))
    packed = [pa.compress(a.tobytes(), codec="zstd", asbytes=True) for a in (i.astype("<i4" if i.max() < 1 << 31 else "<i8"), np.r_[True, v[1:] != v[:-1]], y.astype("<i4"))]
    return pa.table({"model": t.column("model")[:1], "block": t.column("block")[:1], "n": [len(i)], "wide": [bool(i.max() >= 1 << 31)], "i": pa.array(packed[:1], pa.binary()),
                     "fresh": pa.array(packed[1:2], pa.binary()), "y": pa.array(packed[2:], pa.binary()), "low": [float(v[0])], "high": [float(v[-1])]})


class _Ranked:
    """Sums of a model over its rows by ascending value, for some replicates at a time: ``at`` by target, ``cross`` of the rows' ranks by target, ``square``."""

    def __init__(self, rows: int, codes: int, reps: int):
        self.middle, self.below, self.square = (rows + 1) / 2, np.zeros(reps), np.zeros(reps)
        self.at, self.cross = np.zeros((codes, reps)), np.zeros((codes, reps))
        self.code, self.times, self.last = np.zeros(0, int), np.zeros((0, reps)), None  # of the last value, which may go on

    def add(self, times: np.ndarray, fresh: np.ndarray, code: np.ndarray, low: float, high: float) -> None:
        fresh = fresh.copy()
        fresh[0] = self.last is None or low != self.last
        first = np.flatnonzero(fresh | np.r_[True, code[1:] != code[:-1]])
        cells = times.astype(float) if len(first) == len(code) else np.add.reduceat(times, first, axis=0, dtype=float)
        code, place = np.r_[self.code, code[first]], np.r_[np.zeros(len(self.code), int), np.cumsum(fresh)[first]]
        cells = np.concatenate([self.times, cells])
        ended = int(np.searchsorted(place, place[-1]))
        self.settle(cells[:ended], code[:ended], place[:ended])
        self.code, group = np.unique(code[ended:], return_inverse=True)
        self.times = np.zeros((len(self.code), times.shape[1]))
        np.add.at(self.times, group, cells[ended:])
        self.last = high

    def settle(self, cells: np.ndarray, code: np.ndarray, place: np.ndarray) -> None:
        if not len(code):
            return
        starts = np.r_[True, place[1:] != place[:-1]]
        of = cells if starts.all() else np.add.reduceat(cells, np.flatnonzero(starts), axis=0)
        rank = np.cumsum(of, axis=0)
        total = rank[-1].copy()
        rank += self.below + 0.5 - self.middle
        rank -= of / 2
        self.below += total
        self.square += (of * rank * rank).sum(0)
        if not starts.all():
            rank = rank[np.cumsum(starts) - 1]
        order = np.argsort(code, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
        present = code[order][cut]
        cells = cells[order]
        self.at[present] += np.add.reduceat(cells, cut, axis=0)
        self.cross[present] += np.add.reduceat(cells * rank[order], cut, axis=0)

    def rho(self) -> list[float | None]:
        self.settle(self.times, self.code, np.zeros(len(self.code)))
        b = np.cumsum(self.at, axis=0) - self.at / 2 + 0.5 - self.middle
        scale = np.sqrt(self.square * (self.at * b * b).sum(0))
        return [float(c / x) if x > 0 else None for c, x in zip((self.cross * b).sum(0), scale)]


def _streamed_rho(ok: DataFrame, key: str, models: list[str], target: str, n_boot: int, seed: int, min_distinct: int) -> DataFrame:
    """As ``bootstrap_rho``, for any number of rows: a task draws up to REPLICATES replicates, as many as take DRAWN_BYTES, and keeps only how often each row
    is drawn, a byte each. The rows of a model pass by in order of its values, STREAM_ROWS at a time, and are summed by target."""
    ok = cut_lineage(numbered(ok, key).select("_i", F.col(target).alias("_t"), *[F.col(m).alias(f"_m{k}") for k, m in enumerate(models)]))
    rows = ok.count()
    codes = cut_lineage(surrogate_key(ok.select("_t").distinct(), "_t", None, "y").withColumn("y", F.col("y") - 1))
    n_codes = codes.count()
    coded = cut_lineage(ok.join(codes, "_t").drop("_t"))
    placed = None
    for k in range(len(models)):
        part = surrogate_key(coded.select("_i", "y", F.col(f"_m{k}").alias("v")), "v", "y", "pos", ["_i"])
        part = part.select(F.lit(k).alias("model"), F.floor((F.col("pos") - 1) / STREAM_ROWS).alias("block"), "pos", "_i", "v", "y")
        placed = part if placed is None else placed.unionByName(part)
    schema = "model int, block long, n long, wide boolean, i binary, fresh binary, y binary, low double, high double"
    blocks = cut_lineage(placed.groupBy("model", "block").applyInArrow(_block, schema))
    each = max(1, min(REPLICATES, DRAWN_BYTES // (rows + 16 * n_codes)))
    groups = -(-n_boot // each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, times, reps, sums = None, None, [], None

        def found() -> pa.RecordBatch:
            got = [(models[mine[1]], rep, x) for rep, x, good in zip(reps, sums.rho(), enough) if good and x is not None]
            return pa.RecordBatch.from_pydict({n: pa.array([g[k] for g in got], t) for k, (n, t) in enumerate((("model", pa.string()), ("rep", pa.int64()), ("rho", pa.float64())))})

        for b in batches:
            for r in b.to_pylist():
                if mine != (r["group"], r["model"]):
                    if mine is not None:
                        yield found()
                    if mine is None or mine[0] != r["group"]:
                        reps = list(range(r["group"] * each, min(n_boot, (r["group"] + 1) * each)))
                        times, enough = np.zeros((rows, len(reps)), np.uint8), []
                        for k in range(0, len(reps), 8):
                            some = [np.bincount((words(seed, rep, rows) % np.uint64(rows)).astype(np.int64), minlength=rows) for rep in reps[k:k + 8]]
                            enough += [np.count_nonzero(x) >= min_distinct for x in some]
                            if max(x.max() for x in some) > np.iinfo(times.dtype).max:
                                times = times.astype(np.uint32)
                            times[:, k:k + 8] = np.stack([x.astype(times.dtype) for x in some]).T
                    mine, sums = (r["group"], r["model"]), _Ranked(rows, n_codes, len(reps))
                i, fresh, y = (np.frombuffer(pa.decompress(r[c], r["n"] * np.dtype(t).itemsize, "zstd"), t) for c, t in (("i", "<i8" if r["wide"] else "<i4"), ("fresh", bool), ("y", "<i4")))
                sums.add(times[i], fresh, y, r["low"], r["high"])
        if mine is not None:
            yield found()

    dealt = blocks.crossJoin(ok.sparkSession.range(groups).withColumnRenamed("id", "group")).repartitionById(groups, F.col("group").cast("int")).sortWithinPartitions("group", "model", "block")
    return cut_lineage(dealt.mapInArrow(run, "model string, rep long, rho double"))


def interval(df: DataFrame, value: str, keys: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Median and central interval per group."""
    a = (1 - level) / 2
    q = quantiles(df, value, [a, 0.5, 1 - a], keys, prefix="_q")
    names = [c for c in q.columns if c not in keys]
    return q.select(*keys, F.col(f"`{names[0]}`").alias("low"), F.col(f"`{names[1]}`").alias("median"), F.col(f"`{names[2]}`").alias("high"))


def paired_bootstrap(df: DataFrame, key: str, a: str, b: str, target: str, n_boot: int = 5000, seed: int = 42) -> DataFrame:
    """(rep, delta): rho(a) - rho(b) on the same draw."""
    r = bootstrap_rho(df, key, [a, b], target, n_boot, seed)
    return r.groupBy("rep").agg(F.max(F.when(F.col("model") == a, F.col("rho"))).alias("_a"), F.max(F.when(F.col("model") == b, F.col("rho"))).alias("_b")).select(
        "rep", (F.col("_a") - F.col("_b")).alias("delta")).where(F.col("delta").isNotNull())


def permutations(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(rep, key, _i): a random one-to-one assignment of row indices per replicate, by block-wise ranks of draws; ties go by key."""
    h = numbered(df.select(key), key).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_h", drawn(seed, "rep", "_i")).drop("_i")
    pos = value_ranks(h, "_h", ["rep"]).select(F.col("rep"), F.col("value").alias("_h"), F.col("below_n").alias("_b"))
    tie = F.row_number().over(W.partitionBy("rep", "_h").orderBy(key)) - 1
    return h.join(pos, ["rep", "_h"]).withColumn("_i", F.col("_b") + tie).drop("_h", "_b")


def permutation_rho(df: DataFrame, key: str, model: str, target: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """(rep, rho) with the target dealt anew to the rows in each replicate, one to one."""
    ok = df.dropna(subset=[model, target]).select(key, F.col(model).cast("double").alias(model), F.col(target).cast("double").alias(target))
    if ok.limit(ARRAY_ROWS + 1).count() > ARRAY_ROWS:
        shuffled = permutations(ok, key, n, seed).join(numbered(ok.select(key, F.col(target).alias("_t")), key).drop(key), "_i").join(ok.select(key, model), key)
        return spearman(shuffled, model, "_t", ["rep"]).select("rep", "rho")

    def kernel(ranks: list[np.ndarray], rep: int) -> list[tuple]:
        a, b = ranks
        dealt = np.empty(len(b))
        dealt[np.argsort(words(seed, rep, len(b)), kind="stable")] = b  # stable: ties go by key
        return [(rep, _correlation(a, dealt))]

    return _replicated(ok, key, [model, target], n, lambda v: _centred_ranks(_places(v), np.ones(len(v))), kernel, "rep long, rho double")


def permutation_null(df: DataFrame, key: str, model: str, target: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """One row: observed rho, median and 95 % interval of the null, and the share of null values at or above it (to 12 decimals)."""
    null = permutation_rho(df, key, model, target, n, seed).select("rho").where(F.col("rho").isNotNull())
    real = spearman(df.dropna(subset=[model, target]), model, target).select(F.col("rho").alias("observed"))
    p = null.crossJoin(F.broadcast(real)).agg(F.avg((F.round("rho", 12) >= F.round("observed", 12)).cast("double")).alias("p_value"), F.count(F.lit(1)).alias("n"))
    return real.crossJoin(F.broadcast(interval(null, "rho"))).crossJoin(F.broadcast(p))


def with_draws(df: DataFrame, n: int, draw: Callable[[Column], Column], out: str = "_draws") -> DataFrame:
    """Adds an array of the ``n`` draws that ``draw`` makes of their numbers, the same for all rows: one row, broadcast.

    The rows are dealt out first, since a few narrow ones mean much work each.
    """
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = df.sparkSession.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw).alias(out))
    return df.crossJoin(F.broadcast(made))


def array_mean(a: Column) -> Column:
    return let(a, lambda x: F.try_divide(F.aggregate(x, F.lit(0.0), lambda t, v: t + v), F.size(x)))


def array_variance(a: Column) -> Column:
    """Population variance; null where a value is."""
    return let(a, lambda x: let(array_mean(x), lambda m: array_mean(F.transform(x, lambda v: (v - m) * (v - m)))))


def array_quantile(ordered: Column, p: float) -> Column:
    """Linear-interpolation quantile of an ascending array without nulls."""
    at = F.lit(p) * (F.size(ordered) - 1)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return low + (at - F.floor(at)) * (high - low)


def monte_carlo(df: DataFrame, key: str, n: int = 5000, seed: int = 42, weights: Mapping[str, float] = WEIGHTS_INDEX, sigma: Mapping[str, float] = RELATIVE_SIGMA) -> DataFrame:
    """Index under relative gaussian noise on each component: mean, population deviation, p10 and p90 per row.

    The figures of a row come from its own draws only, so all rows may share the same standard normal ones. They are
    those of ``gaussian``, a column of numbers for each component; a few rows meet them at a time.
    """
    names = list(weights)
    spread = df.select(key, *[F.col(c).cast("double").alias(c) for c in names], *[(sigma[c] * F.greatest(F.col(c), F.lit(1e-6))).cast("double").alias(f"_s_{c}") for c in names])
    kind = spread.schema[key].dataType.simpleString()

    def figures(x: np.ndarray, s: np.ndarray, z: list[np.ndarray]) -> list[np.ndarray]:
        w = 0.0
        for i, c in enumerate(names):  # of NaN and a limit Spark takes the limit if it is the upper one
            w = w + weights[c] * np.fmin(np.maximum(x[i][:, None] + z[i] * s[i][:, None], 0.0), 1.0)
        w = np.fmin(np.maximum(w, 0.0), 1.0)
        at = [p * (n - 1) for p in (0.1, 0.9)]
        w.partition(sorted({f(p) for p in at for f in (math.floor, math.ceil)}), axis=1)
        cuts = [w[:, math.floor(p)] + (p - math.floor(p)) * (w[:, math.ceil(p)] - w[:, math.floor(p)]) for p in at]
        return [w.mean(1), w.std(1), *cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = []
        for c in names:
            u = (halves(f"{seed}:{c}:", n).astype(float) + 0.5) / float(2**60)
            z.append(np.sqrt(-2 * np.log(u[:, 0])) * np.cos(2 * pi * u[:, 1]))
        for b in batches:
            whole = np.ones(b.num_rows, bool)
            for i in range(len(names)):
                whole &= b.column(1 + i).is_valid().to_numpy(zero_copy_only=False)
            x, s = (np.stack([b.column(k + i).to_numpy(zero_copy_only=False) for i in range(len(names))]) for k in (1, 1 + len(names)))
            out, rows = np.zeros((4, b.num_rows)), np.flatnonzero(whole)
            for at in range(0, len(rows), DRAWN_ROWS):
                some = rows[at:at + DRAWN_ROWS]
                out[:, some] = figures(x[:, some], s[:, some], z)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(o, mask=~whole) for o in out]], names=[key, "mc_mean", "mc_std", "mc_p10", "mc_p90"])

    # The rows are dealt out first, since a few narrow ones mean much work each.
    dealt = spread.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, f"`{key}` {kind}, mc_mean double, mc_std double, mc_p10 double, mc_p90 double")


def ablate(df: DataFrame, scenarios: Mapping[str, Column], target: str) -> DataFrame:
    """(scenario, n, rho, mean): every scenario's index against the target, from one unpivoted pass."""
    wide = df.select(target, *[c.cast("double").alias(n) for n, c in scenarios.items()])
    long = wide.unpivot([target], list(scenarios), "scenario", "value")
    return spearman(long, "value", target, ["scenario"]).join(long.groupBy("scenario").agg(F.avg("value").alias("mean")), "scenario")


def sweep(df: DataFrame, key: str, params: Sequence[Mapping[str, float | str]], index: Callable[[], Column], reference: str) -> DataFrame:
    """One-at-a-time configs: mean, range and rank correlation with the reference config. ``params`` rows carry ``config``."""
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in params]
    s = df.withColumn("_p", F.explode(F.array(*structs))).select("*", "_p.*").drop("_p").withColumn("_h", index()).select(key, "config", "_h")
    base = s.where(F.col("config") == reference).select(key, F.col("_h").alias("_ref"))
    j = s.join(base, key)
    stat = j.groupBy("config").agg(F.avg("_h").alias("mean"), F.min("_h").alias("min"), F.max("_h").alias("max"), F.avg(F.col("_h") - F.col("_ref")).alias("shift"))
    return stat.join(spearman(j, "_h", "_ref", ["config"]).select("config", F.col("rho").alias("rank_rho")), "config", "left")


def sobol(df: DataFrame, key: str, bounds: Mapping[str, tuple[float, float]], model: Callable[..., Column | np.ndarray], n: int = 256, seed: int = 42,
          reads: Sequence[str] | None = None) -> DataFrame:
    """(key, param, first_order, total): variance shares by the Jansen estimators on A, B and A-with-one-column-of-B rows.

    ``model`` takes a column for each parameter. Each row of ``df`` evaluates it on the n x (parameters + 2) rows of the
    design, as arrays. Rows whose output doesn't vary (variance up to 1e-12) have null shares.

    With ``reads`` the model is one of NumPy, for many rows: it takes the draws of each parameter and those columns of some
    rows, a row each, with NaN for null, and gives the outputs of these rows for all draws.
    """
    names = list(bounds)
    if reads is not None:
        return _sobol_arrays(df, key, bounds, model, n, seed, list(reads))

    def scaled(name: str, text: Column, half: int) -> Column:
        low, high = bounds[name]
        return low + (high - low) * uniform(text, half)

    both = with_draws(df, n, lambda s: F.struct(*[scaled(p, labelled(seed, p, s), half).alias(f"{side}_{p}") for p in names for half, side in enumerate("ab")]))

    def outputs(moved: Sequence[str]) -> Column:
        return F.transform("_draws", lambda d: model({p: d[f"{'b' if p in moved else 'a'}_{p}"] for p in names}))

    y = both.select(key, outputs([]).alias("_a"), outputs(names).alias("_b"), *[outputs([p]).alias(f"_y{i}") for i, p in enumerate(names)])
    y = y.withColumn("_var", (array_variance(F.col("_a")) + array_variance(F.col("_b"))) / 2).withColumn("_var", F.when(F.col("_var") > 1e-12, F.col("_var")))

    def half_square(side: str, i: int) -> Column:
        return array_mean(F.zip_with(side, f"_y{i}", lambda u, v: (u - v) * (u - v))) / 2

    shares = [F.struct(F.lit(p).alias("param"), ((F.col("_var") - half_square("_b", i)) / F.col("_var")).alias("first_order"), (half_square("_a", i) / F.col("_var")).alias("total")) for i, p in enumerate(names)]
    return y.select(key, F.inline(F.array(*shares)))


def _sobol_arrays(df: DataFrame, key: str, bounds: Mapping[str, tuple[float, float]], model: Callable[[Mapping[str, np.ndarray], Mapping[str, np.ndarray]], np.ndarray], n: int, seed: int, reads: list[str]) -> DataFrame:
    names = list(bounds)
    rows = df.select(F.col(key).alias("_k"), *[F.col(c).cast("double").alias(c) for c in reads])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = {}, {}
        for p, (low, high) in bounds.items():
            u = (halves(f"{seed}:{p}:", n).astype(float) + 0.5) / float(2**60)
            a[p], b[p] = low + (high - low) * u[:, 0], low + (high - low) * u[:, 1]
        for batch in batches:
            shares = np.empty((batch.num_rows, len(names), 2))
            columns = [batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(reads))]
            for at in range(0, batch.num_rows, DRAWN_ROWS):
                x = {c: v[at:at + DRAWN_ROWS, None] for c, v in zip(reads, columns)}
                ya, yb = model(a, x), model(b, x)
                var = (ya.var(1) + yb.var(1)) / 2
                var = np.where(var > 1e-12, var, np.nan)
                for i, p in enumerate(names):
                    y = model({**a, p: b[p]}, x)
                    shares[at:at + DRAWN_ROWS, i, 0] = (var - np.square(yb - y).mean(1) / 2) / var
                    shares[at:at + DRAWN_ROWS, i, 1] = np.square(ya - y).mean(1) / 2 / var
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), len(names))))
            first, total = (pa.array(shares[:, :, i].ravel(), from_pandas=True) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names * batch.num_rows, pa.string()), first, total], names=[key, "param", "first_order", "total"])

    # The rows are dealt out first, since a few narrow ones mean much work each.
    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, param string, first_order double, total double")


def monotone(df: DataFrame, variables: Sequence[str], model: Callable[[Mapping[str, Column]], Column], delta: float = 0.01) -> DataFrame:
    """(variable, checks, violations, min_gradient): forward differences of the model at every row."""
    base = {v: F.col(v) for v in variables}
    grads = df.select(*[((model({**base, v: F.col(v) + delta}) - model(base)) / delta).alias(v) for v in variables])
    return grads.unpivot([], list(variables), "variable", "g").where(F.col("g").isNotNull()).groupBy("variable").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("g") < -1e-9).alias("violations"), F.min("g").alias("min_gradient"))


def simplex(names: Sequence[str], step: float) -> list[dict[str, float]]:
    """All weight vectors of three components on a grid of the given step."""
    n = round(1 / step)
    return [dict(zip(names, (i / n, j / n, (n - i - j) / n))) for i in range(n + 1) for j in range(n + 1 - i)]


def calibrate(df: DataFrame, names: Sequence[str], index: Callable[[], Column], target: str, train: str, step: float = 0.1) -> DataFrame:
    """(weights, rho_train, rho_test) for every weight vector; ``index`` reads the weight columns ``w_<name>``."""
    vectors = F.array(*[F.struct(F.lit(i).alias("config"), *[F.lit(v).alias(f"w_{k}") for k, v in p.items()]) for i, p in enumerate(simplex(names, step))])
    s = df.withColumn("_p", F.explode(vectors)).select("*", "_p.*").withColumn("_h", F.round(index(), 12))
    rho = spearman(s, "_h", target, ["config", train])
    wide = rho.groupBy("config").agg(F.max(F.when(F.col(train), F.col("rho"))).alias("rho_train"), F.max(F.when(~F.col(train), F.col("rho"))).alias("rho_test"))
    table = df.sparkSession.range(1).select(F.explode(vectors).alias("p")).select("p.*")
    return wide.join(table, "config")


def calibrated(df: DataFrame, key: str, columns: Sequence[str], target: str, expert: Sequence[float], seeds: Sequence[int] = (0, 1, 2, 3, 4), step: float = 0.1, share: float = 0.7) -> DataFrame:
    """(seed, w_1, w_2, w_3, rho_train, rho_test, rho_expert, gain): per seed the weights with the largest rank correlation on the training rows.

    Rows are split within each target value by md5 of key and seed. The index is the mean of the three ``columns`` under the weights,
    those of missing ones shared out. ``gain`` is what the chosen weights add to the ``expert`` ones on the test rows. Correlations that
    agree to nine decimals tie, and the first vector of the grid wins. A seed is a task over arrays up to ARRAY_ROWS rows; beyond,
    every vector is ranked as tables.
    """
    from territoria.functions.combine import wmean
    from territoria.operators.sampling import stratified_split

    ok = df.where(F.col(target).isNotNull()).select(F.col(key).cast("long").alias(key), *columns, F.col(target).cast("double").alias(target))
    vectors = simplex(columns, step)
    names = "seed long, w_1 double, w_2 double, w_3 double, rho_train double, rho_test double, rho_expert double"
    if ok.limit(ARRAY_ROWS + 1).count() > ARRAY_ROWS:
        out = None
        for seed in seeds:
            split = stratified_split(ok, key, target, share, seed)
            scored = calibrate(split, columns, lambda: wmean({c: F.col(f"w_{c}") for c in columns}), target, "is_train", step)
            best = scored.where(F.col("rho_train").isNotNull()).orderBy(F.round("rho_train", 9).desc(), "config").limit(1)
            test = split.where(~F.col("is_train")).withColumn("_h", F.round(wmean(dict(zip(columns, expert))), 12))
            one = best.crossJoin(F.broadcast(spearman(test, "_h", target).select(F.col("rho").alias("rho_expert")))).select(
                F.lit(seed).cast("long").alias("seed"), *[F.col(f"w_{c}").alias(f"w_{i + 1}") for i, c in enumerate(columns)], "rho_train", "rho_test", "rho_expert")
            out = one if out is None else out.unionByName(one)
        return out.withColumn("gain", F.col("rho_test") - F.col("rho_expert"))
    seeds = list(seeds)

    def rho(x: np.ndarray, y: np.ndarray) -> float:
        use = ~np.isnan(x)
        found = _correlation(*(_centred_ranks(_places(v[use]), np.ones(use.sum())) for v in (x, y))) if use.any() else None
        return math.nan if found is None else found

    def index(values: Sequence[np.ndarray], weights: Sequence[float]) -> np.ndarray:
        live = sum(w * ~np.isnan(v) for w, v in zip(weights, values))
        total = sum(np.where(np.isnan(v), 0.0, v * w) for w, v in zip(weights, values))
        with np.errstate(all="ignore"):
            return np.where(live > 0, np.round(total / live, 12), np.nan)

    def kernel(columns_: list[np.ndarray], rep: int) -> list[tuple]:
        *values, y, keys = columns_
        seed = seeds[rep]
        drawn_ = [hashlib.md5(f"{int(k)}:{seed}".encode()).hexdigest()[:12] for k in keys]
        train = np.zeros(len(y), bool)
        for level in np.unique(y):
            rows = np.flatnonzero(y == level)
            rows = rows[np.argsort(np.array([drawn_[i] for i in rows], dtype="U12"), kind="stable")]
            train[rows[:math.floor(len(rows) * share)]] = True
        best = None
        for v in vectors:
            h = index(values, list(v.values()))
            r = rho(h[train], y[train])
            if not math.isnan(r) and (best is None or round(r, 9) > round(best[1], 9)):
                best = (v, r, rho(h[~train], y[~train]))
        if best is None:
            return []
        test = rho(index(values, list(expert))[~train], y[~train])
        return [(seed, *map(float, best[0].values()), best[1], best[2], test)]

    found = _replicated(ok, key, [*columns, target, key], len(seeds), lambda v: np.asarray(v, float), kernel, names)
    return found.withColumn("gain", F.col("rho_test") - F.col("rho_expert"))


def ahp_weights(ab: Column, ac: Column, bc: Column) -> list[Column]:
    """Weights of a 3x3 reciprocal comparison matrix: row geometric means, equal to its principal eigenvector."""
    rows = [F.pow(ab * ac, F.lit(1 / 3)), F.pow(bc / ab, F.lit(1 / 3)), F.pow(1 / (ac * bc), F.lit(1 / 3))]
    total = rows[0] + rows[1] + rows[2]
    return [r / total for r in rows]


def ahp_interval(df: DataFrame, key: str, matrix: tuple[float, float, float], index: Callable[[Sequence[Column]], Column], n: int = 1000, perturbation: float = 0.2, seed: int = 42) -> DataFrame:
    """p5, median, p95 and deviation of the index per row under perturbed comparisons (a vs b, a vs c, b vs c).

    ``index`` takes the three weights. All rows share the trials, and hold their outputs as one array.
    """
    def trial(s: Column) -> Column:
        cmp_ = [v * (1 + perturbation * (2 * uniform(labelled(seed + i, s)) - 1)) for i, v in enumerate(matrix)]
        return F.struct(*[w.alias(f"w{i}") for i, w in enumerate(ahp_weights(*cmp_))])

    t = with_draws(df, n, trial).select(key, F.sort_array(F.transform("_draws", lambda d: index([d["w0"], d["w1"], d["w2"]]))).alias("_h"))
    h = F.col("_h")
    low, mid, high = (array_quantile(h, p) for p in (0.05, 0.5, 0.95))
    return t.select(key, low.alias("h_p5"), mid.alias("h_median"), high.alias("h_p95"), F.sqrt(array_variance(h)).alias("h_std"), (high - low).alias("width"))


def leakage_audit(predict: Callable[[Callable[[Column, Column, Column], Column]], DataFrame], df: DataFrame, key: str, audited: Column, poison: float = 99999.0) -> DataFrame:
    """Audited rows, largest move and leak flag of a predictor when each row's own target is overwritten for that row alone.

    ``predict`` returns (key, pred) and reads every target through the function it is given, as
    ``seen(key of the predicted row, key of the row that is read, its target)``. So each audited row has a poisoned table
    of its own, while all other rows are predicted from plain ones.
    """
    plain = predict(lambda mine, other, v: v).select(key, F.col("pred").alias("_a"))
    dirty = predict(lambda mine, other, v: F.when(mine == other, F.lit(poison)).otherwise(v)).select(key, F.col("pred").alias("_b"))
    j = df.where(audited).select(key).join(plain, key).join(dirty, key)
    return j.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("largest")).withColumn("leaks", F.col("largest") > 1e-9)
