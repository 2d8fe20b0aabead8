"""Exact de-duplication against a history: minimal perfect hash over the digests seen, byte-checked lookups.

The history is a table of distinct digests. It is cut into buckets of bounded size; each bucket becomes one row
holding a minimal perfect hash (levels of bit fields: a digest that meets no other at a level owns that bit, the rest
go on; the rank of the bit is the slot) and, slot by slot, the full digest, the locator of the winner and the number of
rows. A lookup computes the slot and compares all bytes of the digest; what is not a member is grouped on its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm.common import documents, mix, stored

#: Distinct digests of one bucket on average: bounds the memory of a build and of a lookup.
BUCKET = 4096
#: Bits of a level for each digest that reaches it.
GAMMA = 2
WIDTH = 32
INDEX = "bucket long, levels array<binary>, digests binary, winners array<long>, sizes array<long>"


def _numbers(digests: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit number of each 32-byte digest for a level."""
    parts = digests.view("<u8").reshape(-1, WIDTH // 8)
    with np.errstate(over="ignore"):
        return mix(parts[:, 0] ^ mix(parts[:, 1] + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)))


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, WIDTH)


def perfect_hash(digests: np.ndarray) -> list[np.ndarray]:
    """Bit fields, one a level, for distinct 32-byte digests."""
    levels, left = [], digests
    while len(left):
        size = max(64, GAMMA * len(left))
        at = (_numbers(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
        if len(levels) > 200:
            raise ValueError("digests of one bucket are not distinct")
    return levels


def slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 where no level has a bit for it. A digest that was never built in may get any slot."""
    out = np.full(len(digests), -1, np.int64)
    open_, before = np.arange(len(digests)), 0
    for k, bits in enumerate(levels):
        if not len(open_):
            break
        at = (_numbers(digests[open_], k) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        rank = np.cumsum(bits) - 1
        out[open_[hit]] = before + rank[at[hit]]
        open_, before = open_[~hit], before + int(bits.sum())
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(pdf["digest"])
    levels = perfect_hash(digests)
    order = np.argsort(slots(levels, digests))
    return pd.DataFrame({
        "bucket": [int(pdf["bucket"].iloc[0])],
        "levels": [[len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in levels]],
        "digests": [digests[order].tobytes()],
        "winners": [pdf["winner"].to_numpy(np.int64)[order]],
        "sizes": [pdf["n"].to_numpy(np.int64)[order]],
    })


def bucket_of(digest: str, buckets: int):
    return F.pmod(F.xxhash64(digest), F.lit(buckets))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """Index rows of ``history`` (digest binary, winner long, n long; digests distinct, nothing null)."""
    return history.withColumn("bucket", bucket_of("digest", buckets)).groupBy("bucket").applyInPandas(_build, INDEX)


def _resolve(key, batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(batch["digest"])
    winner, n = batch["winner"].astype(object).where(batch["winner"].notna(), None).tolist(), batch["n"].to_numpy(np.int64).copy()
    member = np.zeros(len(digests), bool)
    rest = pd.DataFrame({"digest": [], "keep_id": [], "group_size": [], "member": []})
    if len(index):
        row = index.iloc[0]
        held, winners, sizes = np.frombuffer(row["digests"], np.uint8).reshape(-1, WIDTH), np.asarray(row["winners"]), np.asarray(row["sizes"])
        levels = [np.unpackbits(np.frombuffer(b[8:], np.uint8))[:int.from_bytes(b[:8], "little")].astype(bool) for b in row["levels"]]
        at = slots(levels, digests)
        member[at >= 0] = (held[at[at >= 0]] == digests[at >= 0]).all(axis=1)  # all bytes, not only the slot
        for i in np.flatnonzero(member):
            winner[i] = int(winners[at[i]])
            n[i] += sizes[at[i]]
        other = np.ones(len(held), bool)
        other[at[member]] = False
        rest = pd.DataFrame({"digest": [held[i].tobytes() for i in np.flatnonzero(other)], "keep_id": winners[other], "group_size": sizes[other], "member": True})
    out = pd.DataFrame({"digest": list(batch["digest"]), "keep_id": winner, "group_size": n, "member": member})
    out = pd.concat([x for x in (out, rest) if len(x)] or [out])
    return out.astype({"keep_id": "Int64", "group_size": "int64", "member": "bool"})


def resolve(batch: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """digest, keep_id, group_size, member for every digest of ``batch`` (digest, winner, n; distinct) or of the index.

    Members get the winner of the history; the others keep their own.
    """
    return (
        batch.withColumn("bucket", bucket_of("digest", buckets)).groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInPandas(_resolve, "digest binary, keep_id long, group_size long, member boolean")
    )


def normal_digest(text: str):
    """SHA-256 of a text with each run of white space made one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " "), 256))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.sum("n").alias("n"))


def dedup(docs: DataFrame, split: int | None, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, from_history.

    ``split``: documents with a smaller doc_id are the history that is indexed, the others (and those without a
    doc_id) the batch that is looked up. Any split gives the same groups. Texts are equal when their normalised
    forms are; null is the empty text. The row with the smallest doc_id stays, one without an id only if no row
    of its group has one. Of rows that repeat both id and text, one stays. An empty table gives no rows.
    Hot texts are pre-aggregated before each shuffle; only the last join meets their rows, in an equi-join that
    Spark splits where it is skewed.
    """
    slim = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_digest("text").alias("digest")), "digests")
    slim = slim.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    past = F.coalesce(F.col("doc_id") < F.lit(split), F.lit(False)) if split is not None else F.lit(False)
    buckets = max(1, math.ceil(docs.count() / bucket))
    index = stored(build_index(_groups(slim.where(past)), buckets), "digest-index")
    found = resolve(_groups(slim.where(~past)), index, buckets)
    return (
        slim.join(found, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("from_history"),
        )
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower half of the id range is the history, the upper half the batch."""
    docs = documents(spark, sf_dir)
    ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    split = None if ends["a"] is None else (ends["a"] + ends["b"] + 1) // 2
    return dedup(docs, split).drop("from_history")


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
