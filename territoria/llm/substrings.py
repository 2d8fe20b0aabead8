"""Substring de-duplication by fingerprints of word windows, in the place of prefix-partitioned suffix trees: no tree is built.

A suffix is a word position of a document, cut after ``window`` words: trees would be needed to that depth only, as each
node there with leaves in two documents is a repeat, and overlapping ones merge to the maximal repeats. A counting pass
gives the top of the tree, a trie over classes of the first words; every branch with more suffixes than a task should
hold is cut one word deeper, so prefixes vary in length and groups are memory-sized. Branches still too large at the
last word of the trie are cut by the whole prefix. Each group stands for one subtree: its suffixes are sorted by the
fingerprint of their path, equal runs stand for the deep nodes, and the least document of a node decides about its leaves.

Documents lie in blocks by hash of their id. A block sends each path once, with its least document, so a passage that
a third of all documents share reaches its subtree once a block and not once a document.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm.common import WordHasher, by_bytes, column, documents, mix, rows

WINDOW = 13
#: UTF-8 bytes of a block of documents, and suffixes of a subtree.
BLOCK, GROUP = 4 << 20, 1 << 20
#: The trie's words and the bits of a word's class: 2^(DEPTH * CLASS) counts reach the driver, whatever the table.
DEPTH, CLASS = 4, 4
LAST = (1 << 63) - 1
_STEP = np.uint64(0xD6E8FEB86659FD93)


@cache
def _hasher() -> WordHasher:
    return WordHasher(seed=13)


def _span(x: np.ndarray, n: int) -> np.ndarray:
    """The polynomial of each ``n`` consecutive numbers."""
    power, width, out, at, shift = x, 1, None, 0, 1
    step = int(_STEP)
    while True:
        if n & width:
            part = power[at:] * np.uint64(shift)
            out = part if out is None else out[:len(part)] + part
            at, shift = at + width, shift * pow(step, width, 1 << 64) % (1 << 64)
        width *= 2
        if width > n:
            return out
        half = width // 2
        power = power[:-half] + power[half:] * np.uint64(pow(step, half, 1 << 64)) if len(power) > half else power[:0]


def suffixes(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes of at least ``window`` words: path fingerprint, trie cell, place of the document, word position."""
    words, counts = _hasher().of_texts(texts)
    starts = np.cumsum(counts) - counts
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    doc = np.repeat(np.arange(len(texts)), counts)
    at = np.flatnonzero(np.arange(len(words)) + window <= np.repeat(starts + counts, counts))
    path = mix(_span(words, window))[at]
    cell, depth = np.zeros(len(at), np.int64), min(DEPTH, window)
    for k in range(depth):
        cell = (cell << CLASS) | (words[at + k] >> np.uint64(64 - CLASS)).astype(np.int64)
    return path, cell << (CLASS * (DEPTH - depth)), doc[at], at - starts[doc[at]]


def prefix_groups(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell of the trie the first of its groups and their number, groups holding about ``most`` suffixes."""
    first, number = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    used = 0

    def cut(a: int, b: int) -> None:
        nonlocal used
        n = int(counts[a:b].sum())
        if n > most and b - a > 1:
            step = (b - a) >> CLASS
            for k in range(a, b, step):
                cut(k, k + step)
            return
        first[a:b], number[a:b] = used, max(1, math.ceil(n / most))
        used += int(number[a])

    cut(0, len(counts))
    return first, number


def _count(docs: DataFrame, window: int) -> np.ndarray:
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(1 << (DEPTH * CLASS), np.int64)
        for b in batches:
            texts = column(b, "text")
            for _, part in by_bytes(texts, texts, 1 << 20):
                total += np.bincount(suffixes([t.encode() for t in part], window)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield rows(schema, [at.astype(np.int32), total[at]])

    got = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << (DEPTH * CLASS), np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text), spans (word ranges taken out, end exclusive) for every row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id, judged
    on the input. Null and blank texts have no words; texts shorter than a window lose none. Rows that share a doc_id
    don't bear on each other; rows without one come after all others. An empty table gives no rows.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block))
    first, number = prefix_groups(_count(base, window), group)
    dealt = base.withColumn("block", F.pmod(F.xxhash64("ord"), F.lit(blocks)))

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        path, cell, doc, _ = suffixes([t.encode() for t in pdf["text"]], window)
        path, least = np.unique(path, return_index=True)  # the first place of a path is in its least document
        doc, cell = doc[least], cell[least]
        to = first[cell] + (path % number[cell].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((doc, to))
        path, doc, to = path[order], doc[order], to[order]
        ids, out = pdf["ord"].to_numpy(np.int64), []
        cuts = np.flatnonzero(np.diff(to, prepend=-1, append=-1)) if len(to) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            runs = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
            out.append((int(to[a]), int(pdf["block"].iloc[0]), ids[doc[a:b][runs]].tobytes(), np.diff(runs, append=b - a).astype(np.int32).tobytes(), path[a:b].tobytes()))
        return pd.DataFrame(out, columns=["to", "block", "ids", "runs", "paths"])

    def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
        path = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["paths"]])
        ids = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(r, np.int32)) for i, r in zip(pdf["ids"], pdf["runs"])])
        ends = np.cumsum([len(x) // 8 for x in pdf["paths"]])
        order = np.argsort(path, kind="stable")
        node = np.flatnonzero(np.diff(path[order], prepend=~path[order[:1]]))  # deep nodes: runs of one path
        least = np.repeat(np.minimum.reduceat(ids[order], node), np.diff(node, append=len(order)))
        later = np.zeros(len(path), bool)
        later[order] = least < ids[order]
        out = [(b, path[s:e][later[s:e]].tobytes()) for b, s, e in zip(pdf["block"], np.append(0, ends[:-1]), ends) if later[s:e].any()]
        return pd.DataFrame(out, columns=["block", "paths"])

    def apply(key, pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        texts, ids = [t.encode() for t in pdf["text"]], pdf["ord"].to_numpy(np.int64)
        path, _, doc, at = suffixes(texts, window)
        other = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in found["paths"]]]))
        own, which = np.unique(path, return_inverse=True)
        least = np.full(len(own), LAST, np.int64)
        np.minimum.at(least, which, ids[doc]) if len(own) else None
        hit = (least[which] < ids[doc]) | np.isin(path, other)
        doc, at = doc[hit], at[hit]
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = []
        for k, t in enumerate(texts):
            words = t.split()
            starts = at[edge[k]:edge[k + 1]]
            if not len(starts):
                out.append((len(words), 0, b" ".join(words).decode(), []))
                continue
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, starts, 1)
            np.add.at(depth, starts + window, -1)
            gone = np.cumsum(depth)[:-1] > 0
            turn = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
            out.append((len(words), int(gone.sum()), b" ".join(compress(words, (~gone).tolist())).decode(), list(zip(turn[0::2], turn[1::2]))))
        frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "spans"], index=pdf.index)
        frame.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
        return frame.assign(spans=[[{"start": a, "end": b} for a, b in s] for s in frame["spans"]])

    by_block = dealt.select("block", "ord", "doc_id", "text")
    paths = by_block.groupBy("block").applyInPandas(emit, "to long, block long, ids binary, runs binary, paths binary")
    found = paths.groupBy("to").applyInPandas(subtree, "block long, paths binary")
    return by_block.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(
        apply, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
m AS (SELECT g, min(doc_id) AS f FROM p GROUP BY g),
gone AS (SELECT DISTINCT p.doc_id, unnest(range(p.i, p.i + {WINDOW})) AS k FROM p JOIN m USING (g) WHERE m.f < p.doc_id),
one AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM one ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
