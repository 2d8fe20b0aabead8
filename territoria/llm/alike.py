"""Near-duplicates by SimHash, checked on the shingles, and an exact way for the rest: a join on equal parts of shingle sets.

SimHash fingerprints (``simhash.links``) name the near copies that are compared first. What they miss is found by the pigeonhole
principle. Two sets with a Jaccard similarity of ``like`` differ in at most h numbers. Dealt by hash into m > h parts, they
agree in m - h parts at least, so they share one among the first h + 1 parts of each, in any order of all parts. The order puts
parts first that hold many numbers which few texts of a sample hold: such parts are equal in texts that are much alike and
hardly in others, while a single number is met in a fixed share of any corpus.

Texts that have a passage in common share the parts of that passage, and are many if it is frequent. Where a part is crowded, the
numbers that are rarest among its texts stand in for it: of two sets that are alike, the smaller shares one of its first
(1 - like) / (1 + like) n + 1 numbers, in any order of all, with the first (1 - like) n + 1 of the larger. What is left of the near
copies of a text, once those like it are gone, differs from it in as many numbers, so it is not met through what they all copied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from territoria.llm.common import column, few, mix, rows, stored
from territoria.llm.simhash import DISTANCE, LIKE, LIKE_WORDS, _alike, components, fingerprints, links, shingles

#: Texts of the sample, about, texts of it that make a number frequent, and frequent numbers that are told apart at most.
SAMPLE, FREQUENT, TOLD = 4096, 3, 1 << 16
#: Other texts that a posting meets, on average, up to which pairs are listed; rounds of leaders after which they are listed anyway;
#: and pairs that are listed at once, as they are without further rounds if there are no more.
DENSE, ROUNDS, PAIRS = 8, 12, 20_000_000
#: Texts up to which a part is shared; those of a part that more share are met by their rarest numbers.
CROWD = 16
#: Least bits of a set's parity map, doubled up to twice the set; maps of two sets differ in at most as many bits as the sets in elements.
MAP = 1024
#: Pairs whose maps are compared at a time, and bytes of maps.
SLICE, MAPS = 1024, 8 << 20


def _digests(docs: DataFrame) -> DataFrame:
    """doc_id and a 128-bit digest of the lower-cased words of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            yield rows(schema, [column(b, "doc_id"), [xxhash.xxh3_128_digest(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())) for t in column(b, "text")]])

    return docs.mapInArrow(run, "doc_id long, digest binary")


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that several texts of the sample hold, sorted, and how many do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            for t in column(b, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, words).view(np.int64))], names=["token"])

    one_in = max(1, texts.count() // SAMPLE)
    found = (texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(TOLD).toArrow())
    token, n = found["token"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _differ(a: int, b: int, like: float) -> int:
    """The most numbers that only one of two sets of these sizes holds, if they are alike."""
    return math.floor((1 - like) / (1 + like) * (a + b) + 1e-9)


def _parts(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], like: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first parts of a sorted set, as the larger or equal one and as the smaller one of a pair of two classes.

    Class c holds the sizes from 2^(c-1) to 2^c - 1, and a set meets those of its class and of the classes above that a set
    like it may be in, each with the parts of that class. A fourth of the parts more than needed leaves out the small ones.
    """
    n, out = len(found), ([], [])
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rare = np.ones(n, bool)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], found), len(frequent[0]) - 1)
        rare = frequent[0][at] != found
    number, most = mix(found), math.floor(n / like + 1e-9)
    for c in range(n.bit_length(), most.bit_length() + 1):
        top = (1 << c) - 1
        differ = _differ(top, top, like)
        parts = differ + 1 + differ // 4
        part = ((found >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        key = np.zeros(parts, np.uint64)
        np.add.at(key, part, number)
        key = mix(key + mix(np.arange(parts, dtype=np.uint64) + np.uint64(c << 40)))
        first = np.lexsort((key, -np.bincount(part, minlength=parts), -np.bincount(part[rare], minlength=parts)))
        out[c > n.bit_length()].append(key[first[:_differ(n, min(most, top), like) + 1]])
    return np.concatenate(out[0]), np.concatenate([np.zeros(0, np.uint64), *out[1]])


def _rarest(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], like: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the rarest numbers of a sorted set: those that meet larger sets, and the further ones that smaller sets meet."""
    seen = np.zeros(len(found), np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], found), len(frequent[0]) - 1)
        seen = np.where(frequent[0][at] == found, frequent[1][at], 0)
    key = mix(mix(found))
    first = key[np.lexsort((key, seen))][:math.floor((1 - like) * len(found) + 1e-9) + 1]
    own = _differ(len(found), 0, like) + 1
    return first[:own], first[own:]


def _map(found: np.ndarray) -> bytes:
    width = MAP
    while width < 2 * len(found):
        width *= 2
    bits = np.bincount((found % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _postings(texts: DataFrame, words: int, like: float) -> DataFrame:
    """doc_id, n (size of its set), map and keys of every text: in its own class, and in those above it."""
    frequent = _frequent(texts, words)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("map", pa.binary()), ("own", pa.list_(pa.int64())), ("above", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            sets = [shingles(t, words) for t in column(b, "text")]
            keys = [[k.view(np.int64) for k in _parts(s, frequent, like)] for s in sets]
            yield rows(schema, [column(b, "doc_id"), [len(s) for s in sets], [_map(s) for s in sets], [k for k, _ in keys], [k for _, k in keys]])

    return texts.mapInArrow(run, "doc_id long, n long, map binary, own array<long>, above array<long>")


def _spread(post: DataFrame, texts: DataFrame, words: int, like: float) -> DataFrame:
    """The postings (doc_id, token, own) of tokens that at most CROWD texts share, and those of the rarest numbers of the other tokens' texts.

    A pair that shares a token of the first kind is met there; both texts of any other pair are among those of crowded tokens.
    """
    ids = stored(post.where(F.col("g") > CROWD).select("doc_id").distinct(), "crowded")
    if ids.isEmpty():
        return post.select("doc_id", "token", "own")
    held = stored(texts.join(ids, "doc_id", "left_semi"), "crowd")
    frequent = _frequent(held, words)
    schema = pa.schema([("doc_id", pa.int64()), ("token", pa.int64()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            for d, t in zip(column(b, "doc_id"), column(b, "text"), strict=True):
                own, more = _rarest(shingles(t, words), frequent, like)
                n = len(own) + len(more)
                yield pa.RecordBatch.from_arrays([pa.array([d] * n, pa.int64()), pa.array(np.concatenate([own, more]).view(np.int64)), pa.array(np.arange(n) < len(own))], schema=schema)

    return post.where(F.col("g") <= CROWD).select("doc_id", "token", "own").union(held.mapInArrow(run, "doc_id long, token long, own boolean"))


def _apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """The bits in which the maps of each pair differ; the longer map is folded to the shorter one."""
    out = np.zeros(len(x), np.int64)
    sizes = np.array([(len(m), len(n)) for m, n in zip(x, y, strict=True)])
    for wide in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == wide).all(1))
        m, n = (np.frombuffer(b"".join([z[i] for i in at]), np.uint64).reshape(len(at), -1) for z in (x, y))
        while m.shape[1] != n.shape[1]:
            if m.shape[1] < n.shape[1]:
                m, n = n, m
            half = m.shape[1] // 2
            m = m[:, :half] ^ m[:, half:]
        out[at] = np.bitwise_count(m ^ n).sum(1)
    return out


def _possible(pairs: DataFrame, about: DataFrame, like: float) -> DataFrame:
    """The pairs (a, b) whose sizes and maps allow a similarity of ``like``."""
    a, b = (about.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * like)
    near = stored(near.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("both_n")), "near")
    a, b = (about.select(F.col("doc_id").alias(x), F.col("map").alias(f"map_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in few(batches, SLICE, MAPS):
            n = r.column(r.schema.get_field_index("both_n")).to_numpy()
            ok = _apart(column(r, "map_a"), column(r, "map_b")) <= (1 - like) / (1 + like) * n + 1e-6
            yield r.select(["a", "b"]).filter(pa.array(ok))

    return near.join(a, "a").join(b, "b").select("a", "b", "both_n", "map_a", "map_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, about: DataFrame, texts: DataFrame, words: int, like: float) -> DataFrame:
    """The pairs (a, b) that share ``like`` of their shingles."""
    pairs = stored(_possible(pairs, about, like), "possible")
    held = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            yield rows(held, [column(b, "doc_id"), [shingles(t, words).tobytes() for t in column(b, "text")]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            ok = [_alike(x, y, like) for x, y in zip(column(b, "in_a"), column(b, "in_b"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    found = stored(texts.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, "doc_id long, shingles binary"), "sets")
    met = pairs.join(found.select(F.col("doc_id").alias("a"), F.col("shingles").alias("in_a")), "a")
    met = met.join(found.select(F.col("doc_id").alias("b"), F.col("shingles").alias("in_b")), "b")
    return stored(met.select("a", "b", "in_a", "in_b").mapInArrow(compare, "a long, b long"), "alike")


def _greedy(edges: DataFrame) -> DataFrame:
    """doc_id of the larger ends b of ``edges`` (a < b) that go: by doc_id, one goes if a smaller neighbour stays."""
    out = edges.select(F.col("b").alias("doc_id")).limit(0)
    while not edges.isEmpty():
        stay = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti")
        gone = stored(edges.join(stay, "a", "left_semi").select(F.col("b").alias("doc_id")).distinct(), "gone")
        out = out.union(gone)
        rest = edges.join(gone.select(F.col("doc_id").alias("a")), "a", "left_anti").join(gone.select(F.col("doc_id").alias("b")), "b", "left_anti")
        edges = stored(rest.select("a", "b"), "edges")
    return out


def _shared(post: DataFrame) -> DataFrame:
    """The postings (doc_id, token, own) of tokens that several texts hold, one of them in its own class; their least doc_id and number."""
    one = W.partitionBy("token")
    post = post.select("doc_id", "token", "own", F.min("doc_id").over(one).alias("least"), F.count(F.lit(1)).over(one).alias("g"), F.max("own").over(one).alias("any"))
    return stored(post.where("g > 1 AND any").drop("any"), "postings")


def _leads(post: DataFrame) -> DataFrame:
    """doc_id of those that are the least of each of their tokens, so that nothing before them is like them."""
    return stored(post.groupBy("doc_id").agg(F.max(F.col("doc_id") - F.col("least")).alias("over")).where("over = 0").select("doc_id"), "leads")


def _near_copies(texts: DataFrame, copies: DataFrame, leads: DataFrame, words: int) -> DataFrame:
    """Pairs (a, b) of the least of ``leads`` in a SimHash component and the later texts of that component."""
    fps = stored(fingerprints(texts, words).join(copies, "doc_id", "left_anti"), "fingerprints")
    linked = components(links(fps.select("fp").distinct(), DISTANCE))
    placed = fps.join(linked, fps["fp"] == linked["node"], "left").select("doc_id", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "placed")
    first = placed.join(leads, "doc_id", "left_semi").groupBy("root").agg(F.min("doc_id").alias("a"))
    return placed.join(first, "root").where("doc_id > a").select("a", F.col("doc_id").alias("b"))


def _gone(texts: DataFrame, copies: DataFrame, words: int, like: float) -> DataFrame:
    """The doc_ids of ``texts`` without ``copies`` that are like one that stays before them, by doc_id.

    Whoever is the least of each of its tokens stays, and what is like it goes: first what SimHash puts beside it, then, in rounds,
    all that shares a token with it. That thins dense groups without listing their pairs; once a posting meets few others on
    average, or after ROUNDS rounds, the pairs that are left are listed and compared, PAIRS at a time, and the alike ones settled.
    After the first round, crowded tokens give way to rare numbers, so a pair is not listed for what many texts have in common.
    All give the same outcome.
    """
    made = stored(_postings(texts.join(copies, "doc_id", "left_anti"), words, like), "parts")
    about = made.select("doc_id", "n", "map")
    post = _shared(made.select("doc_id", F.explode("own").alias("token"), F.lit(True).alias("own")).union(made.select("doc_id", F.explode("above"), F.lit(False))))
    if post.isEmpty():
        return texts.select("doc_id").limit(0)
    out = stored(_verified(_near_copies(texts, copies, _leads(post), words), about, texts, words, like).select(F.col("b").alias("doc_id")).distinct(), "gone")
    post = post.join(out, "doc_id", "left_anti")
    for turn in range(ROUNDS + 1):
        post = _shared(post)
        if turn == 1:
            post = _shared(_spread(post, texts, words, like))
        # Pairs are listed from the texts that hold a token in their own class.
        size = post.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("own"), F.col("g") - 1)), F.lit(0)).alias("cost")).first()
        if size["n"] == 0:
            return out
        if turn and size["cost"] <= max(2 * PAIRS, DENSE * size["n"]) or turn == ROUNDS:
            break
        leads = _leads(post)
        pairs = post.where("doc_id > least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
        pairs = pairs.join(leads.select(F.col("doc_id").alias("a")), "a", "left_semi")
        gone = stored(_verified(pairs, about, texts, words, like).select(F.col("b").alias("doc_id")).distinct(), "gone")
        out = out.union(gone)
        post = post.join(leads.union(gone), "doc_id", "left_anti")
    parts = max(1, math.ceil(size["cost"] / 2 / PAIRS))
    left = post.where("own").select(F.col("doc_id").alias("x"), "token").withColumn("part", F.pmod(F.xxhash64("x", "token"), F.lit(parts)))
    right, edges = post.select(F.col("doc_id").alias("y"), "token", "own"), None
    for part in range(parts):
        pairs = left.where(F.col("part") == part).join(right, "token").where("x < y OR x > y AND NOT own").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found = _verified(pairs, about, texts, words, like)
        edges = found if edges is None else edges.union(found)
    return out.union(_greedy(edges if parts == 1 else stored(edges.distinct(), "edges")))


def one_of_alike(docs: DataFrame, words: int = LIKE_WORDS, like: float = LIKE) -> DataFrame:
    """The rows of ``docs`` that stay, all columns untouched: no two share ``like`` of their shingles, and every one that goes
    does so with one that stays and has a smaller doc_id.

    Texts of the same lower-cased words are copies; null and blank texts are copies of one another. doc_id identifies
    a document: of rows that repeat it one stays, and rows without it all stay. An empty table gives no rows.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    plain = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    same = stored(_digests(plain).groupBy("doc_id").agg(F.min("digest").alias("digest"), F.count(F.lit(1)).alias("n")), "digests")
    first = stored(same.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "first")
    copies = stored(same.select("doc_id").join(first, "doc_id", "left_anti"), "copies")
    # Whole texts meet the few ids that go, not the many that stay: the short list spares a shuffle of the corpus.
    once = same.where("n > 1").isEmpty()
    plain = plain if once else stored(plain.dropDuplicates(["doc_id"]), "texts")
    drop = stored(copies.union(_gone(plain, copies, words, like)), "drop")
    kept = known.join(drop, "doc_id", "left_anti")
    kept = kept if once else kept.dropDuplicates(["doc_id"])
    return kept.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
