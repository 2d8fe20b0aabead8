"""Trie of conversation prefixes: z-fast tries over ranges of conversations, joined where the ranges meet.

A conversation becomes the chain of digests of its prefixes, so a digest names a prefix and equal digests mean equal
beginnings. Equal conversations collapse to one; what is left is cut into ranges of the order of these chains. A range's
task inserts its conversations, batch by batch, into a compacted trie whose nodes stand in a hash table under their
handle, the prefix whose depth is the two-fattest number of the node's edge. A fat binary search asks that table at
most once for each bit of the depth and ends at the deepest node that the conversation runs through; from there the exit
node is one step away. At the end the edges are expanded to one row a depth. Only the nodes on the seam of two ranges are
in both tasks; their counts are parts of sums, and one small aggregation adds them up.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territoria.llm.common import stored

#: Bytes of a prefix digest.
D = 16
#: Bytes of digests and words of one range: bounds the memory of a task.
RANGE_BYTES = 8 << 20
#: Conversations located together before they are inserted.
BATCH = 4096
#: Ids in one piece of an id list.
PIECE = 256
#: No word at all: what a node where nothing ends has for its list of ids.
NOTHING = hashlib.sha256(b"").hexdigest()


def fattest(a: int, b: int) -> int:
    """The number in a+1..b that the largest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


def shared_depth(x: bytes, y: bytes, low: int = 0) -> int:
    """How many turns two chains share; the first ``low`` are known to agree."""
    high = min(len(x), len(y)) // D
    while low < high:
        mid = (low + high + 1) // 2
        if x[D * mid - D:D * mid] == y[D * mid - D:D * mid]:
            low = mid
        else:
            high = mid - 1
    return low


class ZFastTrie:
    """Compacted trie of chains. Node 0 is the root; node v's edge has the depths start[v]+1..stop[v]."""

    def __init__(self):
        self.strings: list[bytes] = []
        self.up, self.start, self.stop, self.string, self.down, self.ends = [0], [0], [0], [-1], [{}], [-1]
        self.handles: dict[bytes, int] = {}

    def _node(self, up: int, start: int, stop: int, string: int) -> int:
        v = len(self.up)
        for field, x in ((self.up, up), (self.start, start), (self.stop, stop), (self.string, string), (self.down, {}), (self.ends, -1)):
            field.append(x)
        s = self.strings[string]
        self.down[up][s[D * start:D * start + D]] = v
        self._hash(v)
        return v

    def _hash(self, v: int) -> None:
        f = fattest(self.start[v], self.stop[v])
        self.handles[self.strings[self.string[v]][D * f - D:D * f]] = v

    def above(self, x: bytes, v: int = 0) -> int:
        """The deepest node whose whole extent begins ``x``, by fat binary search below node ``v``, which is one."""
        a, b = self.stop[v], len(x) // D
        while a < b:
            f = fattest(a, b)
            found = self.handles.get(x[D * f - D:D * f])
            if found is None:
                b = f - 1
                continue
            s = self.stop[found]
            if D * s > len(x) or self.strings[self.string[found]][D * s - D:D * s] != x[D * s - D:D * s]:
                return self.up[found]  # x leaves within the edge of this node, so it holds all above
            v, a = found, s
        return v

    def insert(self, x: bytes, v: int = 0) -> int:
        """Adds a chain; returns the node where it ends. ``v``: a node whose extent begins ``x``."""
        v, n, string = self.above(x, v), len(x) // D, len(self.strings)
        self.strings.append(x)
        depth = self.stop[v]
        exit_ = self.down[v].get(x[D * depth:D * depth + D]) if depth < n else None
        if exit_ is not None:
            other = self.strings[self.string[exit_]][:D * self.stop[exit_]]
            cut = shared_depth(x, other, depth + 1)
            v = self._node(v, depth, cut, string)  # takes the upper part of the edge, and its handle where it lies there
            self.start[exit_], self.up[exit_] = cut, v
            self.down[v][other[D * cut:D * cut + D]] = exit_
            self._hash(exit_)
            depth = cut
        end = v if depth == n else self._node(v, depth, n, string)
        self.ends[end] = string
        return end

    def insert_batch(self, chains: list[bytes]) -> list[int]:
        """All are located first on the trie as it is, then inserted exit by exit, each from where it was located."""
        found = [self.above(x) for x in chains]
        ends = [0] * len(chains)
        for i in sorted(range(len(chains)), key=lambda i: (found[i], chains[i])):
            ends[i] = self.insert(chains[i], found[i])
        return ends

    def path(self, end: int) -> set[int]:
        out = {end}
        while end:
            end = self.up[end]
            out.add(end)
        return out


NODES = ("key binary, depth long, parent_key binary, parent_conv_id long, conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, shared boolean")


def _range_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """All nodes of one range, a row a depth, with the parts that this range adds to each."""
    chains, words = pdf["chain"].tolist(), pdf["words"].tolist()
    ids, sizes, texts = pdf["low"].tolist(), pdf["n"].tolist(), pdf["ends"].tolist()
    before, after = int(pdf["before"].iloc[0]), int(pdf["after"].iloc[0])
    trie, ends = ZFastTrie(), []
    for at in range(0, len(chains), BATCH):
        ends += trie.insert_batch(chains[at:at + BATCH])
    first, last = min(range(len(chains)), key=chains.__getitem__), max(range(len(chains)), key=chains.__getitem__)
    left, right = trie.path(ends[first]), trie.path(ends[last])
    nodes = len(trie.up)
    n, low, leaves, saved, ended, through = [0] * nodes, [None] * nodes, [0] * nodes, [0] * nodes, [None] * nodes, [0] * nodes
    for i, v in enumerate(ends):
        n[v], low[v], ended[v], through[v] = sizes[i], ids[i], texts[i], i
    out: list[tuple] = []

    def new(v: int, depth: int) -> bool:
        return not (depth <= before and v in left)

    def common(v: int, depth: int) -> bool:
        return depth == 0 or (depth <= before and v in left) or (depth <= after and v in right)

    for v in sorted(range(nodes), key=lambda v: -trie.stop[v]):  # children first
        below = trie.down[v].values()
        for c in below:
            n[v] += n[c]
            if low[v] is None or low[c] < low[v]:
                low[v] = low[c]
            leaves[v] += leaves[c]
            saved[v] += saved[c]
            if ended[v] is None:
                through[v] = through[c]
        if not below:
            goes_on = v == ends[last] and trie.stop[v] == after  # the next range begins with longer ones
            leaves[v] = 0 if goes_on else 1
        chain, count = chains[through[v]], words[through[v]]
        children = sum(new(c, trie.stop[v] + 1) for c in below)
        for depth in range(trie.stop[v], trie.start[v] if v else -1, -1):
            if depth:
                saved[v] += (n[v] - new(v, depth)) * int(count[depth - 1])
            out.append((v, depth, chain[D * depth - D:D * depth] if depth else b"", chain[D * depth - 2 * D:D * depth - D] if depth > 1 else b"",
                        low[v], n[v], children, leaves[v], saved[v], ended[v] if depth == trie.stop[v] else None, common(v, depth)))
            children = int(new(v, depth))
    rows = []
    for v, depth, key, parent_key, conv, members, children, leaf, tokens, text, seam in out:
        u = v if depth > trie.start[v] + 1 else trie.up[v]
        in_range = depth > 0 and not common(u, depth - 1)
        rows.append((key, depth, None if in_range or not depth else parent_key, low[u] if in_range else None, conv, members, children, leaf, tokens, text, seam))
    got = pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])
    return got.astype({"parent_conv_id": "Int64", "ends_sha256": object})


def rebuilt(df: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, turns (digest of role and text, words): the first h turns of the family's first conversation, then one's own after its first h.

    h is the unsigned crc32 of the decimal id modulo ``heads``. Turns go by turn (null first), ties by role and text.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = df.where(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    own = own.select("conv_id", F.transform("turns", lambda t: F.struct(
        F.unhex(F.substring(F.sha2(F.concat(F.char_length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]), 256), 1, 2 * D)).alias("digest"),
        F.regexp_count(t["text"], F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"))).alias("turns"))
    own = stored(own, "turns")
    first = own.select(F.col("conv_id").alias("family"), F.slice("turns", 1, heads - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    joined = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % family).withColumn("h", h).join(first, "family", "left")
    empty = F.slice("turns", 1, 0)
    own_rest = F.when(F.col("h") < F.size("turns"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(empty)
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), empty), own_rest).alias("turns"))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for digests in b.column(1).to_pylist():
            chain, last = [], b""
            for d in digests:
                last = hashlib.sha256(last + d).digest()[:D]
                chain.append(last)
            out.append(b"".join(chain))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], names=["conv_id", "chain", "words"])


def _id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of id lists, ordered by key and piece, to one row a key: members, smallest id, digest of the whole list."""
    key, low, n, sha = None, None, 0, None
    schema = pa.schema([("key", pa.binary()), ("low", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    for b in batches:
        out = []
        for k, first, count, text in zip(*(b.column(c).to_pylist() for c in ("key", "low", "n", "ids"))):
            if sha is not None and k == key:
                sha.update(b"," + text.encode())
                n += count
                continue
            if sha is not None:
                out.append((key, low, n, sha.hexdigest()))
            key, low, n, sha = k, first, count, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
    if sha is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (key, low, n, sha.hexdigest())))], schema=schema)


def distinct_chains(convs: DataFrame) -> DataFrame:
    """chain, words, low (smallest id), n (members), ends (SHA-256 of their ids) of each different conversation.

    Members meet in pieces of ``PIECE`` neighbouring ids first; a list of ids is hashed piece by piece, never held whole.
    """
    key = F.expr(f"substring(chain, greatest(length(chain) - {D} + 1, 1), {D})")
    pieces = convs.select(key.alias("key"), "conv_id").groupBy("key", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(
        F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    lists = pieces.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(_id_lists, "key binary, low long, n long, ends string")
    return lists.select("low", "n", "ends").join(convs.select(F.col("conv_id").alias("low"), "chain", "words"), "low")


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first, last, previous, following = (b.column(c).to_pylist() for c in ("first", "last", "previous", "following"))
        before = [-1 if p is None else shared_depth(p, x) for p, x in zip(previous, first)]
        after = [-1 if f is None else shared_depth(x, f) for f, x in zip(following, last)]
        yield pa.RecordBatch.from_arrays([b.column("range"), pa.array(before, pa.int64()), pa.array(after, pa.int64())], names=["range", "before", "after"])


def prefix_trie(convs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per distinct prefix of the conversations ``convs`` (conv_id, turns: array of digest, words; ids distinct).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Copies are one chain with a count, so a third of all rows with one conversation is one insertion; a third with one
    first turn is dealt to many ranges, whose seams are added up. A conversation is one row and its chain one value.
    """
    chains = convs.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    chains = stored(chains.mapInArrow(_chains, "conv_id long, chain binary, words array<long>"), "chains")
    distinct = stored(distinct_chains(chains), "distinct-chains")
    size = distinct.agg(F.coalesce(F.sum(F.length("chain") * 2 + 128), F.lit(0))).first()[0]
    ranges = max(1, math.ceil(size / range_bytes))
    dealt = stored(distinct.repartitionByRange(ranges, "chain").withColumn("range", F.spark_partition_id()), "chain-ranges")
    order = W.orderBy("range")  # one row a range
    seams = dealt.groupBy("range").agg(F.min("chain").alias("first"), F.max("chain").alias("last"))
    seams = seams.select("*", F.lag("last").over(order).alias("previous"), F.lead("first").over(order).alias("following"))
    seams = seams.mapInArrow(_seams, "range int, before long, after long")
    nodes = stored(dealt.join(seams, "range").groupBy("range").applyInPandas(_range_nodes, NODES), "trie-nodes")
    seam = nodes.where("shared").groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.max("parent_conv_id").alias("parent_conv_id"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256"))
    seam = stored(seam, "trie-seams")
    parents = seam.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("seam_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = nodes.where(~F.col("shared")).drop("shared")
    below = inner.where(F.col("parent_key").isNotNull()).unionByName(seam).join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("seam_conv_id"))
    whole = inner.where(F.col("parent_key").isNull()).select(columns).unionByName(below.select(columns))
    return whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations. Rows without conv_id take no part; an empty table gives no rows, not even a root.

    Null turns come first, null roles and texts are empty, rows that repeat are turns of their own; turns that tie go by
    role and text. Other columns are not read.
    """
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(table))


_TOKENS = "flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))"
_CRC = f"xor(list_reduce(list_concat([4294967295], {_TOKENS}), lambda a, t: CASE WHEN t >= 0 THEN xor(a, t) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"
SQL = rf"""
WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, ({_CRC} % 4)::INT AS h FROM t),
r AS (SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id - a.conv_id % 20),
q AS (SELECT conv_id, d AS depth, turns[1:d] AS prefix, d = len(turns) AS here FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (here), '') AS ends,
      (count(*) - 1) * CASE WHEN depth > 0 THEN len(regexp_extract_all(prefix[depth].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS tokens FROM q GROUP BY depth, prefix),
c AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
k AS (SELECT c.*, (SELECT count(*) FROM c x WHERE x.depth = c.depth + 1 AND x.parent_conv_id = c.conv_id AND x.prefix[1:c.depth] = c.prefix) AS n_children FROM c),
s AS (SELECT a, prefix[1:a] AS prefix, sum(tokens) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM (SELECT *, unnest(range(depth + 1)) AS a FROM k) GROUP BY 1, 2)
SELECT k.conv_id, k.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM k JOIN s ON s.a = k.depth AND s.prefix = k.prefix
"""
