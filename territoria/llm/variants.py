"""Spelling variants: words one edit apart, found in tries of letter-group counts.

A word's letters fall into groups; the counts of the groups, one after the other, are its path in a trie. One inserted,
deleted or replaced letter raises one count by one at most and lowers one by one at most, so a depth-first search that may
spend one surplus and one deficit reaches every leaf that can hold a word one edit away; the words there are compared.

On Spark, the counts of a few coarse groups are the upper part of each path and deal the words to subtrees. A word stays
in its own subtree and calls on those that the budget reaches and whose path is greater, so each pair meets once. A
subtree with many words is cut into slices, and callers visit each. Below, a task holds the trie of one slice and walks
it with all its callers at once, level by level.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm.common import column, documents, rows, stored

#: Letter groups: the code point modulo this. The 26 plain letters have a group each.
GROUPS = 29
#: Coarse groups, the group modulo this: the upper part of a path.
COARSE = 5
#: Words of one slice of a subtree.
SLICE = 4096
#: Callers that walk a trie together, and pairs compared at once.
CALLERS = 4096
PAIRS = 1 << 15
#: A node with so few words is searched as a leaf.
LEAF = 4
#: Words longer than this are compared one by one.
WIDTH = 64
#: Characters of a text that are read at once, and different words a task holds before it passes them on.
PIECE = 1 << 20
HELD = 200_000

RUN = re.compile("[a-zÀ-ÿ]+")
END = re.compile("[^a-zÀ-ÿ]")
WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
CALLS = pa.schema([("path", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("own", pa.bool_())])


def runs(text: str) -> Counter:
    """How often each run of letters is in a text; A-Z are lower-cased. Long texts are read in pieces cut between runs."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes, lower() knows A-Z only
    if len(text) <= PIECE:
        return Counter(RUN.findall(text))
    out, at = Counter(), 0
    while at < len(text):
        cut = END.search(text, min(len(text), at + PIECE))
        end = cut.start() if cut else len(text)
        out.update(RUN.findall(text, at, end))
        at = end
    return out


def _words(least: int, one_in: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(column(b, "doc_id"), column(b, "text")):
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in runs(text or "").items():
                    if len(word) < least:
                        continue
                    h = zlib.crc32(word.encode(), seed)
                    if h % one_in == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1:]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield rows(WORDS, [list(total), list(total.values())])
                    total.clear()
        yield rows(WORDS, [list(total), list(total.values())])

    return run


def vocabulary(docs: DataFrame, least: int = 5, times: int = 3, one_in: int = 97) -> DataFrame:
    """word, n: the words of ``docs`` (doc_id, text) with ``least`` code points and ``times`` occurrences at least.

    A run of letters loses one letter where ``one_in`` divides the crc32 of doc_id and run, as misspelling would.
    """
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_words(least, one_in), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def counts(words: list[str]) -> np.ndarray:
    """How many letters of each group each word has."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) % GROUPS
    at = np.repeat(np.arange(len(words)), sizes) * GROUPS + letters
    return np.bincount(at, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def _coarse(fine: np.ndarray) -> np.ndarray:
    return np.stack([fine[:, c::COARSE].sum(axis=1) for c in range(COARSE)], axis=1)


def _path(coarse: np.ndarray) -> np.ndarray:
    """Coarse counts, one after the other, as one number; beyond 255 they are alike."""
    return (np.minimum(coarse, 255).astype(np.int64) << (8 * np.arange(COARSE - 1, -1, -1))).sum(axis=1)


def _calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word once with its own path, and once with each greater path that one surplus and one deficit reach."""
    changes = [np.zeros(COARSE, np.int64)]
    for i in range(COARSE):
        for j in range(-1, COARSE):
            for sign in ((1, -1) if j < 0 else (1,)):
                if i != j:
                    change = np.zeros(COARSE, np.int64)
                    change[i] = sign
                    if j >= 0:
                        change[j] = -1
                    changes.append(change)
    for b in batches:
        words, n = column(b, "word"), b.column("n").to_numpy()
        for at in range(0, len(words), CALLERS):
            part = words[at:at + CALLERS]
            coarse = _coarse(counts(part))
            own = _path(coarse)
            paths, who = [], []
            for change in changes[1:]:
                there = coarse + change
                path = _path(there)
                fits = np.flatnonzero((there >= 0).all(axis=1) & (path > own))
                paths.append(path[fits])
                who.append(fits)
            calls = np.unique(np.stack([np.concatenate(who), np.concatenate(paths)]), axis=1)  # changes beyond 255 lead to one path
            who_, path_ = np.append(np.arange(len(part)), calls[0]), np.append(own, calls[1])
            yield pa.RecordBatch.from_arrays([pa.array(path_), pa.array([part[i] for i in who_.tolist()], pa.string()), pa.array(n[at:at + CALLERS][who_]), pa.array(np.arange(len(who_)) < len(part))], schema=CALLS)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point parts two words."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)
    while low < high:  # the longest common beginning, by halves
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)):] == b[low + 1:]


class Letters:
    """Words as rows of code points, from the left and from the right, for comparing many pairs at once."""

    def __init__(self, words: list[str]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        width = max(1, int(self.size[self.size <= WIDTH].max(initial=1)))
        short = [w if len(w) <= WIDTH else "" for w in words]
        self.left = np.array(short, f"U{width}").view(np.uint32).reshape(len(words), width)
        self.right = np.array([w[::-1] for w in short], f"U{width}").view(np.uint32).reshape(len(words), width)

    def one_edit(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        a, b = self.size[x], self.size[y]
        long = (a > WIDTH) | (b > WIDTH)
        out[long] = [one_edit(self.words[i], self.words[j]) for i, j in zip(x[long], y[long])]
        k = np.flatnonzero(~long & (np.abs(a - b) <= 1))
        x, y, a, b = x[k], y[k], a[k], b[k]
        front, back = self.left[x] != self.left[y], self.right[x] != self.right[y]
        agree = np.minimum(front.argmax(axis=1), np.minimum(a, b)) + np.minimum(back.argmax(axis=1), np.minimum(a, b))
        out[k] = front.any(axis=1) & (agree >= np.minimum(a, b) - (a == b))
        return out


class CountTrie:
    """Trie of words by successive letter-group counts, the most telling group first; a level is an array of nodes."""

    def __init__(self, fine: np.ndarray):
        self.fine = fine
        spread = fine.std(axis=0) if len(fine) else np.zeros(GROUPS)
        self.groups = [g for g in np.argsort(-spread, kind="stable") if spread[g] > 0]
        self.order = np.lexsort([fine[:, g] for g in reversed(self.groups)]) if self.groups else np.arange(len(fine))
        self.span = int(fine.max(initial=0)) + 3
        start = np.zeros(min(1, len(fine)), np.int64)
        self.levels = []  # for each level: where its nodes start among the ordered words, and the keys of their children
        for g in self.groups:
            value = fine[self.order, g]
            node = np.searchsorted(start, np.arange(len(fine)), side="right") - 1
            key = node * self.span + value + 1
            first = np.flatnonzero(np.diff(key, prepend=-1))
            self.levels.append((start, key[first]))
            if len(first) == len(fine) and len(start) == len(fine):
                break
            start = first
        self.levels.append((start, None))

    def reached(self, callers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (caller, word) whose counts differ by one surplus and one deficit at most, in bounded pieces."""
        n = len(self.fine)
        who = np.arange(len(callers)) if n else np.zeros(0, np.int64)
        node, more, less = (np.zeros(len(who), np.int64) for _ in range(3))
        for level, (start, keys) in enumerate(self.levels):
            size = np.diff(np.append(start, n))[node]
            leaf = (size <= LEAF) | (keys is None)
            yield from self._leaves(callers, who[leaf], start[node[leaf]], size[leaf])
            who, node, more, less = (x[~leaf] for x in (who, node, more, less))
            if keys is None or not len(who):
                return
            value = callers[who, self.groups[level]]
            found = []
            for change, able in ((0, slice(None)), (1, more == 0), (-1, less == 0)):
                key = node[able] * self.span + np.clip(value[able] + change, -1, self.span - 2) + 1
                at = np.searchsorted(keys, key)
                hit = keys[np.minimum(at, len(keys) - 1)] == key
                found.append((who[able][hit], at[hit], more[able][hit] + (change > 0), less[able][hit] + (change < 0)))
            who, node, more, less = (np.concatenate(x) for x in zip(*found))

    def _leaves(self, callers: np.ndarray, who: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ends = np.cumsum(size)
        lo = 0
        while lo < len(who):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            s = size[lo:hi]
            x = np.repeat(who[lo:hi], s)
            y = self.order[np.repeat(start[lo:hi], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)]
            diff = self.fine[y] - callers[x]
            near = (np.maximum(diff, 0).sum(axis=1) <= 1) & (np.maximum(-diff, 0).sum(axis=1) <= 1)
            yield x[near], y[near]
            lo = hi


def _near(pdf: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, form_n, form: what one slice adds to each of its words and callers."""
    pdf = pdf.sort_values("word", kind="stable")  # by code point: a smaller row number is a smaller word
    words, n, own = pdf["word"].tolist(), pdf["n"].to_numpy(np.int64), np.flatnonzero(pdf["own"].to_numpy(bool))
    fine, letters = counts(words), Letters(words)
    trie = CountTrie(fine[own])
    held = np.zeros(len(words), bool)
    held[own] = True
    pairs = []
    for at in range(0, len(words), CALLERS):
        for x, y in trie.reached(fine[at:at + CALLERS]):
            x, y = at + x, own[y]
            once = ~held[x] | (x < y)
            x, y = x[once], y[once]
            good = letters.one_edit(x, y)
            pairs.append(np.stack([x[good], y[good]]))
    x, y = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
    x, y = np.concatenate([x, y]), np.concatenate([y, x])
    order = np.lexsort((y, -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    text = lambda at: pd.Series([words[i] for i in at.tolist()], dtype=object)  # noqa: E731  pandas' own strings reach Arrow in chunks, which Spark refuses
    return pd.DataFrame({"word": text(x[first]), "n_near": np.diff(np.append(first, len(x))), "form_n": n[y[first]], "form": text(y[first])})


def neighbours(words: DataFrame, most: int = SLICE) -> DataFrame:
    """word, n_near, form_n, form of every word of ``words`` (word, n; words distinct) that has near words.

    form: the near word of largest n, of equals the smallest in code-point order. A word's pairs never leave its slice:
    they are summed there first. ``most``: words of a slice.
    """
    calls = stored(words.select("word", "n").mapInArrow(_calls, "path long, word string, n long, own boolean"), "calls")
    trees = calls.where("own").groupBy("path").agg(F.count(F.lit(1)).alias("size"))
    trees = trees.withColumn("slices", F.ceil(F.col("size") / most)).drop("size")
    dealt = calls.join(trees, "path").withColumn("at", F.pmod(F.xxhash64("word"), F.col("slices")))
    # A word stays in one slice; callers visit all, words of other slices of the same subtree those that follow theirs.
    slot = F.when(F.col("own"), F.sequence("at", F.col("slices") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    visits = dealt.select("path", "word", "n", "at", F.col("own").alias("lives"), F.explode(slot).alias("slice"))
    visits = visits.select("path", "slice", "word", "n", (F.col("lives") & (F.col("slice") == F.col("at"))).alias("own"))
    parts = visits.groupBy("path", "slice").applyInPandas(_near, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.m")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: ``forms`` (word, form) followed to the end, twice as far each round. n at least doubles on each step, so rounds are few."""
    to = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not step.where("moved").take(1):
            return step.select("word", "root")
        to = step.select("word", "root")


def variant_groups(words: DataFrame, times: int = 2, most: int = SLICE) -> DataFrame:
    """word, n, n_near, form, form_n, root of ``words`` (word, n; words distinct).

    A word's form is its near word of largest n if that is ``times`` its own n at least, its root the end of the chain
    of forms, itself without one. An empty table gives no rows.
    """
    words = stored(words.select("word", "n"), "vocabulary")
    near = stored(neighbours(words, most), "near-words")
    whole = words.join(near, "word", "left")
    has = F.col("form_n") >= times * F.col("n")
    whole = whole.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n"))
    whole = stored(whole, "word-forms")
    ends = roots(whole.where(F.col("form").isNotNull()))
    return whole.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents. A null text has none, a null doc_id is written as nothing, rows that repeat count again; other columns are not read."""
    return variant_groups(vocabulary(documents(spark, sf_dir)))
