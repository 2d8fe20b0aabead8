"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints within ``distance`` bits of each other are linked; a component is what links reach. The 64 bits are grouped
into partitions so that correlated bits lie together. If thresholds t_i of the partitions satisfy
sum(t_i + 1) = distance + 1, any linked pair is within t_i in some partition i. Each fingerprint gets its own thresholds
(-1: partition not probed), by dynamic programming on the candidates that a count of partition values lets expect:
where its value is common it probes elsewhere. Candidates are verified on all 64 bits where they meet, and a task
gives back a spanning forest of what it has found, never all pairs.

``one_of_each`` filters by likeness of texts: fingerprints of five words within ten bits put texts into components, and
within a component, in the order of doc_id, a document leads unless it shares 0.8 of its five-word shingles with a leader.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territoria.llm.common import column, documents, rows, stored
from territoria.session import cut_lineage

BITS, WORDS, DISTANCE, SEED = 64, 4, 4, 42
#: Filtering: words of a shingle, bits within which texts are compared, share of common shingles from which one goes.
LIKE_WORDS, LIKE_DISTANCE, LIKE = 5, 10, 0.8
#: Members of a component that meet its leader in one task, about; larger components are dealt over several.
DEAL = 4096
#: Members of a component that are settled in one round: at first, and at most.
FIRST_BLOCK, BLOCK = 16, 256
#: Cost of a probe that is shuffled, and of a candidate that is verified, in the same unit.
PROBE, VERIFY = 1.0, 0.02
#: Bits of a partition's value that its count table resolves: at most 2^16 counts a partition are collected.
COUNTED = 16
#: Rows of one value that meet in one task before they are dealt over several.
CHUNK = 1 << 20
#: Groups up to this size are compared by shifting the sorted column against itself.
SMALL = 64
#: Rows with texts or sets that a task turns into Python objects at a time.
FEW = 256


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The majority of each bit over the XXH64 of all shingles, repeats included; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change
    if not found:
        return 0
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    if len(found) <= words:
        return digest(joined, SEED)
    count, n = np.zeros(BITS, np.int64), len(found) - words + 1
    for a in range(0, n, 1 << 16):
        b = min(n, a + (1 << 16))
        h = np.fromiter((digest(joined[s:e - 1], SEED) for s, e in zip(starts[a:b], ends[a + words - 1:b + words - 1])), np.uint64, b - a)
        count += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            fp = np.array([fingerprint(t, words) for t in column(b, "text")], np.uint64).view(np.int64)
            yield rows(schema, [column(b, "doc_id"), fp])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, FEW):
            yield b.slice(i, FEW)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_correlation(distinct: DataFrame) -> np.ndarray:
    """Absolute correlations of the 64 bits over all distinct fingerprints; 4,096 sums reach the driver."""
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            x = _bits(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            both += np.rint(x.T @ x).astype(np.int64)
            n += len(x)
        yield rows(schema, [np.arange(BITS * BITS + 1, dtype=np.int32), np.append(both.ravel(), n)])

    got = distinct.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(BITS * BITS + 1)
    for r in got:
        sums[r["cell"]] = r["n"]
    n = max(1.0, sums[-1])
    both = sums[:-1].reshape(BITS, BITS) / n
    p = np.diag(both)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(spread, spread))


def grouped_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy: each partition starts at the bit with the strongest tie to another and takes in what correlates with it most."""
    left, out = list(range(BITS)), []
    c = correlation.copy()
    np.fill_diagonal(c, 0)
    for k in range(parts):
        width = len(left) // (parts - k)
        first = max(left, key=lambda b: c[b, left].max())
        own = [first]
        while len(own) < width:
            own.append(max((b for b in left if b not in own), key=lambda b: c[b, own].mean()))
        out.append(sorted(own))
        left = [b for b in left if b not in own]
    return out


def _choose(width: int, upto: int) -> list[float]:
    return list(accumulate(math.comb(width, k) for k in range(upto + 1)))


def parts_for(n: int, distance: int = DISTANCE) -> int:
    """The number of partitions with the least expected cost for ``n`` evenly spread fingerprints."""
    def cost(parts: int) -> float:
        width = BITS // parts
        one = [0.0] + [c * (PROBE + VERIFY * n / 2.0**width) for c in _choose(width, distance)]
        best = [0.0] + [math.inf] * (distance + 1)
        for _ in range(parts):
            best = [min(best[t - u] + one[u] for u in range(t + 1)) for t in range(distance + 2)]
        return best[-1]

    return min(range(2, 9), key=cost)


class Plan:
    """Bit groups, counts of their values, and from these the thresholds of each fingerprint."""

    def __init__(self, groups: list[list[int]], counts: list[np.ndarray], distance: int):
        self.groups, self.distance, self.counts = groups, distance, counts
        self.near = []  # expected candidates of each value within 0, 1, ... bits, on the bits counted
        for g, c in zip(groups, counts, strict=True):
            w, ring = min(COUNTED, len(g)), [c.astype(float)]
            at = np.arange(1 << w)
            for k in range(1, distance + 1):  # values at exactly k bits, by flipping one more bit
                flipped = sum(ring[-1][at ^ (1 << b)] for b in range(w))
                ring.append(np.maximum(0, flipped - (w - k + 2) * ring[-2]) / k if k > 1 else flipped)
            scale = [c1 / c0 for c1, c0 in zip(_choose(len(g), distance), _choose(w, distance))]
            wide = 2.0 ** (w - len(g))  # the bits not counted are taken as even
            self.near.append([x * s * wide for x, s in zip(np.cumsum(ring, axis=0), scale)])

    def values(self, fp: np.ndarray) -> np.ndarray:
        bits = _bits(fp).astype(np.int64)
        return np.stack([(bits[:, g] << np.arange(len(g))).sum(axis=1) for g in self.groups])

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """Units t_i + 1 for each partition and fingerprint, adding up to distance + 1 at the least expected cost."""
        parts, n = values.shape
        units = self.distance + 1
        best = np.full((units + 1, n), np.inf)
        best[0] = 0
        taken = np.zeros((parts, units + 1, n), np.int8)
        for i, g in enumerate(self.groups):
            low = values[i] & ((1 << min(COUNTED, len(g))) - 1)
            cost = [np.zeros(n)] + [PROBE * c + VERIFY * self.near[i][k][low] for k, c in enumerate(_choose(len(g), self.distance))]
            new = np.full_like(best, np.inf)
            for t in range(units + 1):
                for u in range(t + 1):
                    x = best[t - u] + cost[u]
                    less = x < new[t]
                    new[t][less], taken[i, t][less] = x[less], u
            best = new
        out, left, at = np.zeros((parts, n), np.int8), np.full(n, units), np.arange(n)
        for i in reversed(range(parts)):
            out[i] = taken[i, left, at]
            left = left - out[i]
        return out

    def chunks(self, i: int, value: np.ndarray) -> np.ndarray:
        return 1 + (self.counts[i][value & ((1 << min(COUNTED, len(self.groups[i]))) - 1)] // CHUNK).astype(np.int64)

    def emit(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, fingerprints, and whether the row probes (or is only there to be found).

        A value with many rows is dealt over chunks: what lies there to be found goes to one, a probe to all.
        """
        values, units = self.values(fp), self.thresholds(self.values(fp))
        keys, who, active = [], [], []

        def add(i, value, rows_, chunk, probes):
            keys.append((np.int64(i) << 56) | (chunk << 32) | value)
            who.append(rows_)
            active.append(np.full(len(rows_), probes))

        for i, g in enumerate(self.groups):
            own = self.chunks(i, values[i])
            mine = (fp.view(np.uint64) % own.view(np.uint64)).astype(np.int64)
            for probes in (False, True):
                sel = np.flatnonzero((units[i] > 0) == probes)
                add(i, values[i][sel], fp[sel], mine[sel], probes)
            for k in range(self.distance + 1):
                sel = np.flatnonzero(units[i] > k)
                for flips in combinations(range(len(g)), k) if len(sel) else ():
                    value = values[i][sel] ^ np.int64(sum(1 << b for b in flips))
                    many = self.chunks(i, value)
                    for c in range(int(many.max())):
                        to = (many > c) & ((mine[sel] != c) if k == 0 else True)
                        add(i, value[to], fp[sel][to], np.full(int(to.sum()), c, np.int64), True)
        return np.concatenate(keys), np.concatenate(who), np.concatenate(active)


def few_links(fp: np.ndarray, active: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All links of active rows, in blocks; None where a block holds more than four a row, a case for ``forest``."""
    todo, every = np.unique(fp[active]), np.unique(fp)
    a, b = [], []
    step = max(1, (1 << 18) // len(every))
    for i in range(0, len(todo), step):
        x = todo[i:i + step]
        at, to = np.nonzero(np.bitwise_count((x[:, None] ^ every[None, :]).view(np.uint64)) <= distance)
        if len(at) > 5 * len(x):
            return None
        other = x[at] != every[to]
        a.append(x[at][other])
        b.append(every[to][other])
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def forest(fp: np.ndarray, active: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of active rows connect: each row once in its tree, each meeting of two trees once."""
    a, b = [], []
    todo, passive = np.unique(fp[active]), np.setdiff1d(fp[~active], fp[active])
    tree_of, tree = np.full(len(passive), -1), -1
    while len(todo):
        tree, frontier, todo, met = tree + 1, [todo[0]], todo[1:], set()
        while frontier:
            x = frontier.pop()
            hit = np.bitwise_count((todo ^ x).view(np.uint64)) <= distance
            a += [x] * int(hit.sum())
            b += todo[hit].tolist()
            frontier += todo[hit].tolist()
            todo = todo[~hit]
            for p in np.flatnonzero((np.bitwise_count((passive ^ x).view(np.uint64)) <= distance) & (tree_of != tree)) if len(passive) else ():
                if tree_of[p] == -1:
                    tree_of[p] = tree
                elif tree_of[p] in met:
                    continue
                else:
                    met.add(tree_of[p])
                a.append(x)
                b.append(passive[p])
    return np.array(a, np.int64), np.array(b, np.int64)


def _verify(key: np.ndarray, fp: np.ndarray, active: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among rows of the same key; rows come sorted by key."""
    edge = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1)) if len(key) else np.zeros(1, np.int64)
    size = np.diff(edge)
    a, b = [], []
    big = size > SMALL
    for s, n in zip(edge[:-1][big], size[big]):
        x, y = few_links(fp[s:s + n], active[s:s + n], distance) or forest(fp[s:s + n], active[s:s + n], distance)
        a.append(x)
        b.append(y)
    small = ~np.repeat(big, size)
    key, fp, active = key[small], fp[small], active[small]
    for lag in range(1, int(size[~big].max(initial=1))):
        same = key[:-lag] == key[lag:]
        if not same.any():
            break
        x, y = fp[:-lag], fp[lag:]
        hit = same & (active[:-lag] | active[lag:]) & (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= distance)
        a.append(x[hit])
        b.append(y[hit])
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links between different fingerprints of ``distinct`` (fp) that connect exactly what all links connect."""
    n = distinct.count()
    groups = grouped_bits(bit_correlation(distinct), parts_for(max(1, n), distance))
    cells = pa.schema([("cell", pa.int32()), ("n", pa.int64())])
    widths = [1 << min(COUNTED, len(g)) for g in groups]
    blank = Plan(groups, [np.zeros(w, np.int64) for w in widths], distance)

    def count(batches):
        total = np.zeros(len(groups) << COUNTED, np.int64)
        for b in batches:
            v = blank.values(b.column(0).to_numpy(zero_copy_only=False)) & ((1 << COUNTED) - 1)
            total += np.bincount((v + (np.arange(len(groups)) << COUNTED)[:, None]).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield rows(cells, [at.astype(np.int32), total[at]])

    got = distinct.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(groups) << COUNTED, np.int64)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    plan = Plan(groups, [c[:w] for c, w in zip(counts.reshape(len(groups), -1), widths)], distance)
    probes = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("active", pa.bool_())])
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def probe(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 2048):
                yield rows(probes, list(plan.emit(fp[i:i + 2048])))

    def verify(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

        def out():
            a, b = _verify(*held, distance)
            for i in range(0, len(a), 1 << 16):
                yield rows(pairs, [np.minimum(a, b)[i:i + (1 << 16)], np.maximum(a, b)[i:i + (1 << 16)]])

        for b in batches:
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if len(new[0]) == 0:
                continue
            cut = int(np.searchsorted(new[0], new[0][-1]))  # the last key may go on in the next batch
            if cut or (len(held[0]) and held[0][-1] != new[0][-1]):
                held = [np.concatenate([h, x[:cut]]) for h, x in zip(held, new)]
                yield from out()
                held = [x[cut:] for x in new]
            else:
                held = [np.concatenate([h, x]) for h, x in zip(held, new)]
        yield from out()

    met = distinct.select("fp").mapInArrow(probe, "key long, fp long, active boolean").repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each component, by alternating large and small stars until nothing changes."""
    def state(e):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut_lineage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    A null or blank text has fingerprint zero and links like any other. component_id is the smallest doc_id of the
    component, null if none of its rows has an id. Equal fingerprints collapse before anything is compared, so copies,
    however many, cost one row. An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, distance))
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    labelled = stored(labelled, "labels")
    ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    final = labelled.join(ids, "root").select("fp", "component_id")
    return fps.join(final, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int = LIKE_WORDS) -> np.ndarray:
    """The different shingle numbers of a text, sorted."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(found) - words + 1) if found else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(found[i:i + words]), SEED) for i in range(n)), np.uint64, n))


def _texts(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp and a 128-bit digest of the lower-cased words of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            texts = column(b, "text")
            fp = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            same = [xxhash.xxh3_128_digest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())) for t in texts]
            yield rows(schema, [column(b, "doc_id"), fp, same])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, digest binary")


MEMBER = "root long, deal long, deals long, doc_id long, fp long, shingles binary"
_MEMBER = pa.schema([("root", pa.int64()), ("deal", pa.int64()), ("deals", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("shingles", pa.binary())])


def _sets(members: DataFrame, words: int) -> DataFrame:
    """The shingle sets of ``members`` (root, deal, deals, doc_id, fp, text), as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            yield rows(_MEMBER, [column(b, c) for c in _MEMBER.names[:5]] + [[shingles(t, words).tobytes() for t in column(b, "text")]])

    return members.select(*_MEMBER.names[:5], "text").mapInArrow(run, MEMBER)


def _alike(a: bytes, b: bytes, like: float) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(len(x), len(y)) < like * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= like * (len(x) + len(y) - both)


def _settled(block: DataFrame, within: int, like: float) -> DataFrame:
    """The members of ``block`` with column ``leads``; a component's come together, by doc_id, and are at most BLOCK."""
    schema = _MEMBER.append(pa.field("leads", pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held = None, []
        for b in _few(batches):
            leads = []
            for r, fp, mine in zip(column(b, "root"), column(b, "fp"), column(b, "shingles"), strict=True):
                if r != root:
                    root, held = r, []
                leads.append(not any(((fp ^ f) & (2**64 - 1)).bit_count() <= within and _alike(mine, other, like) for f, other in held))
                if leads[-1]:
                    held.append((fp, mine))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in _MEMBER.names], pa.array(leads, pa.bool_())], schema=schema)

    return block.select(*_MEMBER.names).repartition("root").sortWithinPartitions("root", "doc_id").mapInArrow(run, MEMBER + ", leads boolean")


def _led(met: DataFrame, like: float) -> DataFrame:
    """doc_id of the rows of ``met`` that are like their leader (column ``led``)."""
    schema = pa.schema([("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            yield rows(schema, [[d for d, x, y in zip(column(b, "doc_id"), column(b, "shingles"), column(b, "led"), strict=True) if _alike(x, y, like)]])

    return met.select("doc_id", "shingles", "led").mapInArrow(run, "doc_id long").distinct()


def leaders(members: DataFrame, within: int, like: float = LIKE) -> DataFrame:
    """The doc_ids of ``members`` that stay: in each component, by doc_id, all that are not like one that stays before them.

    Only members within ``within`` bits are compared. Each round settles the smallest members of every component among
    themselves and then compares the others with those of them that stay, so the outcome is that of going one by one.
    """
    out, size = None, FIRST_BLOCK
    while True:
        nth = F.row_number().over(W.partitionBy("root").orderBy("doc_id"))
        block = stored(_settled(members.withColumn("nth", nth).where(F.col("nth") <= size), within, like), "block")
        lead = block.where("leads")
        out = lead.select("doc_id") if out is None else out.union(lead.select("doc_id"))
        rest = stored(members.join(block.select("doc_id"), "doc_id", "left_anti").select(*_MEMBER.names), "rest")
        if rest.isEmpty():
            return out
        dealt = lead.select("root", F.col("fp").alias("lead_fp"), F.col("shingles").alias("led"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))
        small, large = F.least(F.length("shingles"), F.length("led")), F.greatest(F.length("shingles"), F.length("led"))
        met = rest.join(dealt, ["root", "deal"]).where((F.bit_count(F.col("fp").bitwiseXOR(F.col("lead_fp"))) <= within) & (small >= like * large))
        members = stored(rest.join(_led(met, like), "doc_id", "left_anti").select(*_MEMBER.names), "members")
        size = min(BLOCK, 4 * size)


def one_of_each(docs: DataFrame, words: int = LIKE_WORDS, distance: int = LIKE_DISTANCE, like: float = LIKE) -> DataFrame:
    """The rows of ``docs`` that stay, all columns untouched: none of them shares ``like`` of its shingles with another of its
    component (within twice ``distance`` bits), and every one that goes does so with one that stays and has a smaller doc_id.

    Texts of the same lower-cased words are copies; null and blank texts are copies of one another. doc_id identifies
    a document: of rows that repeat it one stays, and rows without it all stay. An empty table gives no rows.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    texts = stored(_texts(known, words).groupBy("fp", "digest").agg(F.min("doc_id").alias("doc_id")), "texts")
    roots = components(links(texts.select("fp").distinct(), distance))
    placed = stored(texts.join(roots, texts["fp"] == roots["node"], "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root")), "placed")
    size = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = placed.join(size.select("root", (F.floor(F.col("n") / DEAL) + 1).alias("deals")), "root").withColumn("deal", F.pmod(F.xxhash64("doc_id"), "deals"))
    shared = stored(shared.groupBy("doc_id").agg(*[F.min_by(c, "root").alias(c) for c in ("root", "deal", "deals", "fp")]), "shared")
    text = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropDuplicates(["doc_id"])
    members = stored(_sets(shared.join(text, "doc_id"), words), "members")
    keep = placed.select("doc_id").distinct().join(shared.select("doc_id"), "doc_id", "left_anti").union(leaders(members, 2 * distance, like))
    return known.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
