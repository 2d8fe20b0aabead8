"""Hierarchical packing of tokenised documents into windows of several context sizes.

Full windows of the longest size come off a document first; its rest is routed to the smallest tier that holds it. Each
tier packs its own documents, the longest first; the gap of a long window is filled from shorter rests, the longest that
fits, and at last by cutting one to measure, so every window is full. What is left at the end of a task is laid out
in windows of powers of two. Windows of one tier form step groups with equal numbers of tokens.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm.common import by_bytes, column, documents

TIERS = (2048, 1024, 512, 256)
END = 1
#: Tokens that a task gathers before it packs, tokens of a step group, and words whose ids a worker keeps.
POOL, STEP, WORDS = 2 << 20, 1 << 16, 600_000
#: New runs that are encoded as one text.
RUNS = 256


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Every character that a tokenizer may take for white space.
_WHITE = [chr(i) for i in range(0x110000) if chr(i).isspace()]
#: How a byte-level tokenizer parts a text into pieces that it encodes one by one, for texts of Latin letters
#: (no ordinal signs and no micro sign among them), plain digits, spaces, line ends, and what is neither letter, number nor white.
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(f"[{_L}0-9\t\n\r !-/:-@\\[-`{{-~\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u2030-\u203a]*")
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[0-9]+| ?[^\\s0-9{_L}]+|\\s+(?!\\S)|\\s+")


class Encoder:
    """The ids of texts by one tokenizer, as little-endian bytes.

    A byte-level tokenizer parts a text into pieces before it encodes each. Plain texts are parted the same way here; other
    ones at each single space between other characters. Every piece or run is encoded once and kept. New ones that start
    with a space are encoded together, as no other of their tokens does. Texts where white space meets a space, but for
    plain ones, are encoded whole. What is kept has two generations: once the young one holds half of ``most``, it becomes
    the old one, and what is met again moves from there to the new young one.
    """

    def __init__(self, path: str, most: int = WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known, self.old = Tokenizer.from_file(path), most, {}, {}
        self.starts = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.starts[[i for t, i in self.tokenizer.get_vocab().items() if t[0] == "\u0120"]] = True  # a space in the byte alphabet
        form = json.loads(self.tokenizer.to_str())
        parts = form.get("pre_tokenizer") or {}
        self.by_pieces = form.get("normalizer") is None and parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: list[str]) -> None:
        """Runs that start with a space and hold no other one after another character."""
        parts = [runs[i:i + RUNS] for i in range(0, len(runs), RUNS)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            at = (np.flatnonzero(self.starts[ids]) * 4).tolist()
            if len(at) != len(part):
                raise ValueError("the tokenizer does not part texts at spaces")
            data = ids.tobytes()
            self.known.update(zip(part, map(data.__getitem__, map(slice, at, [*at[1:], len(data)]))))

    def _parts(self, text: str) -> list[str] | None:
        if "<|" in text:
            return None
        if self.by_pieces and _PLAIN.fullmatch(text):
            return _PIECES.findall(text)
        if text[:1] == " " or text[-1:] == " " or any(w in text and (f" {w}" in text or f"{w} " in text) for w in _WHITE):
            return None  # white space beside a space, or a space at an end
        first, *rest = text.split(" ")
        return [first, *[f" {r}" for r in rest]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most // 2:
            self.known, self.old = {}, self.known
        parts = [self._parts(t) for t in texts]
        new = set().union(*[p for p in parts if p]).difference(self.known)
        again = new.intersection(self.old)
        self.known.update(zip(again, map(self.old.__getitem__, again)))
        new -= again
        spaced = [r for r in new if r[:1] == " " and r[1:].strip()]
        self._learn(spaced)
        alone = list(new.difference(spaced))
        self.known.update(zip(alone, self._ids(alone)))
        whole = iter(self._ids([t for t, p in zip(texts, parts) if p is None]))
        return [next(whole) if p is None else b"".join(map(self.known.__getitem__, p)) for p in parts]


@cache
def encoder(path: str) -> Encoder:
    """One for a worker process, so that what it has learned serves the tasks that follow."""
    return Encoder(path)


class Packer:
    """Windows out of (key, tokens) rests; a window is a tier and its pieces (key, start, length)."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = sorted(tiers, reverse=True)
        self.size: list[int] = []  # lengths of the open rests, ascending, and what they are
        self.what: list[tuple[int, int]] = []
        self.open = 0

    def _put(self, key: int, start: int, n: int) -> None:
        at = bisect_left(self.size, n)
        self.size.insert(at, n)
        self.what.insert(at, (key, start))
        self.open += n

    def _take(self, at: int) -> tuple[int, int, int]:
        n, (key, start) = self.size.pop(at), self.what.pop(at)
        self.open -= n
        return key, start, n

    def add(self, key: int, tokens: int) -> Iterator[tuple[int, list]]:
        top = self.tiers[0]
        for start in range(0, tokens - top + 1, top):
            yield top, [(key, start, top)]
        if tokens % top:
            self._put(key, tokens - tokens % top, tokens % top)

    def pack(self) -> Iterator[tuple[int, list]]:
        """All windows that the open rests fill; what can't fill its tier's window stays open."""
        for tier, below in zip(self.tiers, [*self.tiers[1:], 0]):
            while self.open >= tier:
                longest = bisect_right(self.size, tier) - 1
                if longest < 0 or self.size[longest] <= below:
                    break
                pieces = [self._take(longest)]
                gap = tier - pieces[0][2]
                while gap:
                    at = bisect_right(self.size, gap) - 1
                    if at >= 0:
                        pieces.append(self._take(at))
                        gap -= pieces[-1][2]
                    else:  # every rest is longer than the gap: the shortest is cut
                        key, start, n = self._take(0)
                        pieces.append((key, start, gap))
                        self._put(key, start + gap, n - gap)
                        gap = 0
                yield tier, pieces

    def close(self) -> Iterator[tuple[int, list]]:
        """The rests that are left, in windows of powers of two."""
        yield from self.pack()
        left = [(*w, n) for n, w in zip(reversed(self.size), reversed(self.what))]
        while self.open:
            tier = min(self.tiers[0], 1 << (self.open.bit_length() - 1))
            pieces, gap = [], tier
            while gap:
                key, start, n = left.pop(0)
                pieces.append((key, start, min(n, gap)))
                if n > gap:
                    left.insert(0, (key, start + gap, n - gap))
                gap -= min(n, gap)
            self.open -= tier
            yield tier, pieces


OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = END, tiers: tuple[int, ...] = TIERS, pool: int = POOL, step: int = STEP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, tier, step_id.

    Every document, a null text counting as empty, becomes its ids and then ``end``. Each id lies in one piece; every
    sequence is full for its tier, or for a power of two below the least tier at the end of a task, so none needs
    padding. step_id numbers groups of sequences of one tier that hold ``step`` tokens together; a task counts its own, so its last group of each
    tier, and the windows of powers of two below the least tier, may hold less. Repeated rows and rows
    without a doc_id are packed like others. An empty table gives no rows. There is no shuffle: each input partition is
    packed by itself, and a task that runs again reads the same rows and gives the same sequences.
    """
    path = tokenizer or tokenizer_path()
    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = {"ids": pa.binary(), "tier": pa.int32()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def run(batches):
        encode, packer, ids = encoder(path), Packer(tiers), {}
        sequence = TaskContext.get().partitionId() << 40
        steps: dict[int, int] = {}
        finish = np.array([end], "<u4").tobytes()
        out: list[tuple] = []

        def emit(windows):
            nonlocal sequence
            for tier, pieces in windows:
                n = steps[tier] = steps.get(tier, -1) + 1
                group = (TaskContext.get().partitionId() << 40) | (tier.bit_length() << 34) | (n * tier // max(step, tier))
                offset = 0
                for key, start, length in pieces:
                    doc, data, left = ids[key]
                    out.append((doc, start, length, data[4 * start:4 * (start + length)], len(data) // 4, sequence, offset, tier, group))
                    offset += length
                    if left == length:
                        del ids[key]
                    else:
                        ids[key] = (doc, data, left - length)
                sequence += 1

        def batch():
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out.clear()
            return done

        key = 0
        for b in batches:
            for docs_, texts in by_bytes(column(b, "doc_id"), column(b, "text"), 1 << 20):
                for doc, data in zip(docs_, encode([t or "" for t in texts])):
                    data += finish
                    ids[key] = (doc, data, len(data) // 4)
                    emit(packer.add(key, len(data) // 4))
                    key += 1
                if packer.open > pool:
                    emit(packer.pack())
                if out:
                    yield batch()
        emit(packer.close())
        if out:
            yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def pieces(docs: DataFrame, **options) -> DataFrame:
    out = pack(docs, **options)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(documents(spark, sf_dir))
