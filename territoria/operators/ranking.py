"""Exact ranks, quantiles and running totals that never sort a whole group in one task.

Rows are first collapsed to (keys, value, count), which removes hot values, and checkpointed, so nothing upstream runs
twice. The values are cut into ordered blocks at sketch quantiles, as many as it takes for about ``BLOCK_ROWS`` distinct
values in each; each block is summed on its own, and the block totals give every block its offset. Keys and values keep
their own types, so large whole numbers stay apart.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territoria.session import cut_lineage

FINE = 32
BLOCK_ROWS = 500_000


def _with_block(vc: DataFrame, coarse: int, fine: int) -> DataFrame:
    """Adds the ordered block number of ``value``; the edges are one row, so they are safe to broadcast."""
    if coarse * fine == 1:
        return vc.withColumn("_block", F.lit(0))
    probs = [(i + 1) / (coarse * fine) for i in range(coarse * fine - 1)]
    edges = vc.agg(F.percentile_approx("value", probs, 4 * coarse * fine).alias("_edges"), F.sum("n").alias("_all"))
    starts = F.array(*[F.lit(fine * (i + 1)) for i in range(coarse - 1)]).cast("array<int>")
    supers = F.transform(starts, lambda i: F.element_at("_edges", i))
    # Using the total keeps ``n`` in the edges branch, so both branches share one exchange (one scan of the input).
    out = vc.crossJoin(F.broadcast(edges)).where(F.col("_all") > 0).withColumn(
        "_hi", F.size(F.filter(supers, lambda e: e <= F.col("value"))))
    part = F.slice("_edges", F.col("_hi") * fine + 1, fine - 1)
    out = out.withColumn("_block", F.col("_hi") * fine + F.size(F.filter(part, lambda e: e <= F.col("value"))))
    return out.drop("_edges", "_all", "_hi")


def _running(vc: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """For each (keys, value): total of every ``sums`` column over strictly smaller values, and over the group."""
    keys = list(keys)
    vc = cut_lineage(vc)
    blocks = math.ceil(vc.count() / BLOCK_ROWS)  # of what the checkpoint holds
    fine = min(FINE, max(1, blocks))
    vc = _with_block(vc, math.ceil(blocks / fine) or 1, fine)
    inner = W.partitionBy(*keys, "_block").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    rows = vc.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_in_{c}") for c in sums])
    totals = vc.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_block",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(W.partitionBy(*keys)).alias(f"all_{c}") for c in sums],
    )
    cond = [rows[k].eqNullSafe(offsets[k]) for k in keys] + [rows["_block"] == offsets["_block"]]
    joined = rows.join(offsets, cond, "inner")
    return joined.select(
        *[rows[k] for k in keys], "value", *sums,
        *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"below_{c}") for c in sums],
        *[F.col(f"all_{c}") for c in sums],
    )


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, value, n, below_n, all_n): how many rows hold the value, lie below it, and exist in the group."""
    keys = list(keys)
    vc = (df.where(F.col(value).isNotNull())
          .groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")))
    return _running(vc, keys, ["n"])


def with_rank(df: DataFrame, value: str, out: str, keys: Sequence[str] = (), descending: bool = False,
              percentile: bool = False) -> DataFrame:
    """Average-tie rank of every row (1 = smallest, or largest if ``descending``); null value gives null."""
    keys = list(keys)
    r = value_ranks(df, value, keys)
    rank = F.col("below_n") + (F.col("n") + 1) / 2
    rank = (F.col("all_n") + 1 - rank) if descending else rank
    rank = rank / F.col("all_n") if percentile else rank
    r = r.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("value").alias("_v"), rank.alias(out))
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(value) == F.col("_v")]
    return df.join(r, cond, "left").drop("_v", *[f"_k{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), prefix: str = "p") -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column ``p10`` … per probability (a single row if unkeyed)."""
    keys = list(keys)
    r = value_ranks(df, value, keys)
    picks = []
    for p in probs:
        pos = F.lit(float(p)) * (F.col("all_n") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        name = quantile_name(p, prefix)

        def at(k):
            return F.max(F.when((F.col("below_n") <= k) & (k < F.col("below_n") + F.col("n")), F.col("value").cast("double")))

        picks += [at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}"), F.max(pos - low).alias(f"_f_{name}")]
    agg = r.groupBy(*keys).agg(*picks) if keys else r.agg(*picks)
    names = [quantile_name(p, prefix) for p in probs]
    return agg.select(*keys, *[
        (F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in names])


def quantile_name(p: float, prefix: str = "p") -> str:
    return f"{prefix}{format(100 * p, 'g').replace('.', '_')}"


def position(df: DataFrame, value: str, tie: str, keys: Sequence[str], out: str, descending: bool = False) -> DataFrame:
    """Row number of every row in its group by ``value``, then ascending ``tie`` (unique in the group), by block-wise ranks.

    Rows whose value is null are dropped. Only values that occur more than once need a second rank, within the value.
    """
    keys = list(keys)
    v = value_ranks(df, value, keys).select(*keys, F.col("value").alias(value), "n", ((F.col("all_n") - F.col("below_n") - F.col("n")) if descending else F.col("below_n")).alias("_first"))
    placed = df.join(v, [*keys, value])
    t = value_ranks(placed.where(F.col("n") > 1), tie, [*keys, value]).select(*keys, value, F.col("value").alias(tie), F.col("below_n").alias("_at"))
    return placed.join(t, [*keys, value, tie], "left").withColumn(out, F.col("_first") + F.coalesce("_at", F.lit(0)) + 1).drop("n", "_first", "_at")


def surrogate_key(df: DataFrame, order: str, tie: str | None = None, out: str = "sk", rest: Sequence[str] = ()) -> DataFrame:
    """Row numbers 1..n in ``order``, ``tie`` and ``rest``, nulls last, without the single-partition window.

    The rows are sorted once, over all tasks, and stored; a row's number is its place in its part of the table plus the rows
    of the parts before. Rows without ``order`` go.
    """
    by = [order, *([tie] if tie is not None else []), *rest]
    parts = cut_lineage(df.where(F.col(order).isNotNull()).orderBy(*[F.col(c).asc_nulls_last() for c in by])).select(
        "*", F.spark_partition_id().alias("_sk_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_sk_i"))
    before = W.orderBy("_sk_p").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.groupBy("_sk_p").agg(F.count(F.lit(1)).alias("_sk_n")).select("_sk_p", F.coalesce(F.sum("_sk_n").over(before), F.lit(0)).alias("_sk_b"))
    return parts.join(F.broadcast(starts), "_sk_p").withColumn(out, F.col("_sk_b") + F.col("_sk_i") + 1).drop("_sk_p", "_sk_i", "_sk_b")


def cumulative_share(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows in descending ``value`` with the running share of the total; equal values share one step."""
    keys = list(keys)
    vc = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value"))
          .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("amount")))
    r = _running(vc, keys, ["n", "amount"])
    return r.select(*keys, "value", "n", (F.col("all_n") - F.col("below_n") - F.col("n") + 1).alias("rank_desc"),
                    ((F.col("all_amount") - F.col("below_amount")) / F.col("all_amount")).alias("running_share"))


def top_k(df: DataFrame, by: Sequence[str], k: int, descending: bool = True) -> DataFrame:
    """First k rows; the sort keys should end in a unique column. Planned as a per-partition top-k."""
    first, *rest = by
    head = F.col(first).desc() if descending else F.col(first).asc()
    return df.orderBy(head, *[F.col(c).asc() for c in rest]).limit(k)


def top_per_group(df: DataFrame, keys: Sequence[str], order, k: int = 1) -> DataFrame:
    """First k rows of every group; Catalyst prunes to k per group before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
