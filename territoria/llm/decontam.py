"""Benchmark decontamination by the q-gram lemma in overlapping diagonal bands, verified by banded alignment.

Texts are compared lower-cased with each run of white space made one space. A passage within k edits of an item of m
characters keeps at least m - q + 1 - k * q of its q-grams, all on at most k + 1 neighbouring diagonals (place in
the document minus place in the item). Bands of 2 (k + 1) diagonals that overlap by half hold any such run whole, so a
band with fewer shared q-grams can't hold a passage; the others are aligned within their band. An item takes the longest q
up to ``Q`` for which the lemma still asks for one shared q-gram, so the shortest items are searched as well, exactly those
under ten characters. Where band after band is full, as in repetitive texts, they are aligned together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm.common import by_bytes, column, documents, rows

#: Edits for each character of an item, and the length of a q-gram.
EDITS, Q = 0.1, 8
#: UTF-8 bytes of the items that are sent to the tasks together: larger benchmarks go in several blocks.
ITEMS = 4 << 20
#: Characters of documents that are searched together.
RUN = 1 << 20
FAR = 1 << 20
#: Full bands in a row that are still aligned one by one.
ROW = 8


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 32-bit number of each q-gram, from two overlapping windows of a power of two."""
    x, width = codes * np.uint32(0x9E3779B1), 1
    while 2 * width <= q:
        x = x[:-width] * np.uint32(0x85EBCA6B + 2 * width) + x[width:]
        width *= 2
    if q > width:
        x = x[:-(q - width)] * np.uint32(0xC2B2AE35) + x[q - width:]
    return x ^ (x >> np.uint32(15))


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, anchored: bool = False) -> tuple[int, int]:
    """Least edits of ``item`` against a stretch of ``text`` on diagonals low..high, and where that stretch ends.

    The stretch may start anywhere on those diagonals, or at ``text[0]`` only (anchored).
    """
    width, m = high - low + 1, len(item)
    slide = np.arange(width)
    padded = np.full(max(0, -low) + max(len(text), m + high) + 1, np.uint32(0xFFFFFFFF))
    padded[max(0, -low):max(0, -low) + len(text)] = text
    shift, out = max(0, -low), m + width + 1
    at = low + slide
    inside = (at >= 0) & (at <= len(text))
    row = np.where(inside, np.abs(at) if anchored else 0, out)
    for i in range(m):
        same = padded[i + low + shift:i + low + shift + width] == item[i]
        new = row + ~same
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        at = i + 1 + low + slide
        new[(at < 0) | (at > len(text))] = out
        row = np.minimum.accumulate(new - slide) + slide
        row[(at < 0) | (at > len(text))] = out
    best = int(np.argmin(row))
    return int(row[best]), m + low + best


@dataclass
class Items:
    """A block of items with the q-grams they hold; built once in each worker."""

    ids: list[int]
    texts: list[str]
    edits: float
    q: int

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("ids", "texts", "edits", "q")}

    @cached_property
    def codes(self) -> list[np.ndarray]:
        return [_codes(t) for t in self.texts]

    @cached_property
    def budget(self) -> np.ndarray:
        return np.array([int(len(c) * self.edits) for c in self.codes], np.int64)

    @cached_property
    def least(self) -> np.ndarray:
        """Shared q-grams that a passage has at least: one or more, by the choice of q."""
        return np.array([len(c) for c in self.codes], np.int64) - self.q + 1 - self.budget * self.q

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        found = [(_grams(c, self.q), k) for k, c in enumerate(self.codes) if len(c) >= self.q]
        gram = np.concatenate([np.zeros(0, np.uint32), *[g for g, _ in found]])
        item = np.concatenate([np.zeros(0, np.int64), *[np.full(len(g), k) for g, k in found]])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g, _ in found]])
        order = np.argsort(gram, kind="stable")
        gram, first = np.unique(gram[order], return_index=True)
        sieve = np.zeros(1 << 20, bool)
        sieve[gram >> np.uint32(12)] = True
        return gram, np.append(first, len(order)), item[order], place[order], sieve

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(place of the text, item id, start, end, edits, shared q-grams) of the best passage of each item in each text."""
        gram, first, item, place, sieve = self.index
        codes = _codes("\U0010ffff".join(texts))
        if len(codes) < self.q or not len(gram):
            return
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        h = _grams(codes, self.q)
        at = np.flatnonzero(sieve[h >> np.uint32(12)])
        g = np.searchsorted(gram, h[at])
        g[g == len(gram)] = 0
        real = gram[g] == h[at]
        at, g = at[real], g[real]
        many = first[g + 1] - first[g]
        end = np.cumsum(many)
        which = np.repeat(first[g] - (end - many), many) + np.arange(end[-1] if len(end) else 0)
        who, diagonal = item[which], np.repeat(at, many) - place[which]
        key = (who << 40) | ((diagonal + FAR) // (self.budget[who] + 1))
        order = np.argsort(key)
        cells = np.flatnonzero(np.diff(key[order], prepend=-1))  # strips of k + 1 diagonals; a band is one and the next
        of = key[order][cells]
        size = np.diff(cells, append=len(order))
        size[:-1] += np.where(of[1:] == of[:-1] + 1, size[1:], 0)
        dense = np.flatnonzero(size >= self.least[of >> 40])
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for c, last in self._bands(dense, of):
            k, sel = int(of[c] >> 40), order[cells[c]:cells[last] + size[last]]
            owner = np.searchsorted(begin, diagonal[sel] + place[which[sel]], "right") - 1
            for t in np.unique(owner).tolist():
                old = best.get((t, k))
                if old and old[2] == 0:
                    continue
                mine = sel[owner == t]
                found = self._window(k, diagonal[mine], place[which[mine]]) if last == c else self._stretch(k, diagonal[mine], place[which[mine]])
                if found is None:
                    continue
                a, z, shared = found
                got = self._passage(k, texts[t], codes, int(begin[t]), a, z)
                if got and (not old or got[2] < old[2]):
                    best[t, k] = (*got, shared)
        for (t, k), (start, stop, edits, shared) in sorted(best.items()):
            yield t, self.ids[k], start, stop, edits, shared

    @staticmethod
    def _bands(dense: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int]]:
        """First and last cell of what is aligned at once: a band, or a row of more than ROW full bands that follow each other."""
        if not len(dense):
            return
        new = np.append(True, (np.diff(dense) != 1) | (np.diff(of[dense]) != 1))
        first = np.flatnonzero(new)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(dense)]):
            if b - a > ROW:
                yield int(dense[a]), int(dense[b - 1])
            else:
                for c in dense[a:b].tolist():
                    yield c, c

    def _stretch(self, k: int, diagonal: np.ndarray, place: np.ndarray) -> tuple[int, int, int] | None:
        """First and last diagonal of a row of bands, and how many different q-grams of the item they share."""
        shared = len(np.unique(place))
        return (int(diagonal.min()), int(diagonal.max()), shared) if shared >= self.least[k] else None

    def _window(self, k: int, diagonal: np.ndarray, place: np.ndarray) -> tuple[int, int, int] | None:
        """Where k + 1 neighbouring diagonals share enough different q-grams of the item: first and last diagonal, and how many."""
        least, order = int(self.least[k]), np.argsort(diagonal)
        diagonal, place = diagonal[order], place[order]
        end = np.searchsorted(diagonal, diagonal + self.budget[k], "right")
        full = [(a, b, n) for a, b in zip(range(len(end)), end.tolist()) if b - a >= least and (n := len(set(place[a:b].tolist()))) >= least]
        if not full:
            return None
        return int(diagonal[full[0][0]]), int(diagonal[full[-1][1] - 1]), max(n for _, _, n in full)

    def _passage(self, k: int, whole: str, codes: np.ndarray, begin: int, a: int, z: int) -> tuple[int, int, int] | None:
        """Start, end and edits of the best passage on diagonals near a..z, if within the budget."""
        code, budget = self.codes[k], int(self.budget[k])
        lo = max(begin, a - budget)
        text = codes[lo:min(begin + len(whole), z + len(code) + 2 * budget)]
        at = whole.find(self.texts[k], lo - begin, lo - begin + len(text))
        if at >= 0:
            return at, at + len(code), 0
        if len(text) < len(code) - budget:
            return None
        edits, stop = align(code, text, a - budget - lo, z + budget - lo)
        if edits > budget:
            return None
        back = text[max(0, stop - len(code) - budget):stop][::-1]
        _, length = align(code[::-1], back, -budget, budget, anchored=True)
        return lo + stop - length - begin, lo + stop - begin, edits


def blocks(benchmark: DataFrame, edits: float, q: int, most: int) -> Iterator[list[Items]]:
    """The items in blocks of about ``most`` bytes, read one after another, in parts of one q each. Null and blank items are left out."""
    parts: dict[int, tuple[list[int], list[str]]] = {}
    size = 0

    def block() -> list[Items]:
        return [Items(ids, texts, edits, n) for n, (ids, texts) in sorted(parts.items())]

    for r in benchmark.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        t = normal(r["text"])
        if t:
            ids, texts = parts.setdefault(max(1, min(q, len(t) // (int(len(t) * edits) + 1))), ([], []))
            ids.append(r["item_id"])
            texts.append(t)
            size += len(t.encode("utf-8", "surrogatepass"))
        if size > most:
            yield block()
            parts, size = {}, 0
    if parts:
        yield block()


OUT = "doc_id long, item_id long, start long, end long, edits long, shared long"


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, q: int = Q, most: int = ITEMS) -> DataFrame:
    """doc_id, item_id, start, end, edits, shared: the best passage of each benchmark item in each document that holds one.

    Places are characters of the normalised text, and a short item may stand within a word. Null and blank texts hold none; repeated rows
    and rows without a doc_id are reported like others. An empty table on either side gives no rows.
    """
    schema = pa.schema([(x.split()[0], pa.int64()) for x in OUT.split(", ")])
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], OUT)
    for items in blocks(benchmark, edits, q, most):
        def run(batches, items=items):
            for b in batches:
                for ids, texts in by_bytes(column(b, "doc_id"), column(b, "text"), RUN):
                    plain = [normal(t or "") for t in texts]
                    found = [f for part in items for f in part.search(plain)]
                    if found:
                        yield rows(schema, [[ids[f[0]] for f in found], *zip(*[f[1:] for f in found])])

        out = out.unionByName(slim.mapInArrow(run, OUT))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, q: int = Q, most: int = ITEMS) -> DataFrame:
    """The rows of ``docs`` without a passage of any item, unchanged; decided row by row, without a join."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)])
    at = f"in_{names.index('text')}"
    for items in blocks(benchmark, edits, q, most):
        def run(batches, items=items):
            for b in batches:
                texts, keep = column(b, at), []
                for _, part in by_bytes(texts, texts, RUN):
                    plain = [normal(t or "") for t in part]
                    bad = {f[0] for q_items in items for f in q_items.search(plain)}
                    keep += [i not in bad for i in range(len(part))]
                yield b.filter(pa.array(keep, pa.bool_()))

        inner = inner.mapInArrow(run, inner.schema)
    return inner.toDF(*names)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
