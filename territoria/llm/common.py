"""Helpers that the operators of this package share: stored tables, word and byte arithmetic, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes that part words: space and the control characters 9 to 13. ``bytes.split()`` parts at exactly these.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without it gets a fresh one, a cluster session is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage (a lost executor costs a re-read, not a recomputation) and gives the planner the
    table's true size, so that Spark itself decides whether a join side is small enough to broadcast.
    The table stays until the owner of the folder clears it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def rows(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of unsigned 64-bit numbers that spreads their bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit numbers of the words of a byte string, many words at once.

    A word's number is the polynomial of a random number per byte value in a random odd base modulo 2^64.
    The text is read in pieces of about ``piece`` bytes, cut between words, so a very long text costs eight
    bytes a word and not several arrays of its own length.
    """

    def __init__(self, seed: int = 7, piece: int = 1 << 20):
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(0, 1 << 62)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.is_space = np.zeros(256, bool)
        self.is_space[list(SPACE)] = True
        self.piece = piece
        self._powers(1 << 12)

    def _powers(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            out = np.ones(n, np.uint64)
            done, step = 1, b
            while done < n:
                k = min(done, n - done)
                out[done:done + k] = out[:k] * np.uint64(step)
                done, step = done + k, step * step % (1 << 64)
            return out

        self.up, self.down = powers(self.base), powers(self.inverse)

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) + 1 > len(self.up):
            self._powers(1 << (len(data) + 1).bit_length())
        space = self.is_space[data]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        start, end = edge[0::2], edge[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.up[:len(data)], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start]), start

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of all texts in order, and how many words each text has."""
        numbers, counts, run, size = [np.zeros(0, np.uint64)], [], [], 0

        def flush():
            if run:
                data = np.frombuffer(b" ".join(run), np.uint8)
                got, starts = self._piece(data)
                ends = np.cumsum([len(t) + 1 for t in run])
                counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
                numbers.append(got)
                run.clear()

        for t in texts:
            if len(t) > self.piece:
                flush()
                size = 0
                numbers.append(self.words(t))
                counts.append(np.array([len(numbers[-1])]))
                continue
            run.append(t)
            size += len(t)
            if size > self.piece:
                flush()
                size = 0
        flush()
        return np.concatenate(numbers), np.concatenate([np.zeros(0, np.int64), *counts])

    def words(self, text: bytes) -> np.ndarray:
        data, out, at = np.frombuffer(text, np.uint8), [], 0
        while at < len(data):
            end = min(len(data), at + self.piece)
            while end < len(data) and not self.is_space[data[end]]:
                rest = np.flatnonzero(self.is_space[data[end:end + self.piece]])
                end = end + int(rest[0]) if len(rest) else min(len(data), end + self.piece)
            out.append(self._piece(data[at:end])[0])
            at = end
        return np.concatenate([np.zeros(0, np.uint64), *out])


def few(batches: Iterator[pa.RecordBatch], rows_: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows_`` rows and about ``size`` bytes of texts and binaries; one row alone may hold more."""
    for b in batches:
        wide = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False) for c in b.columns if pa.types.is_binary(c.type) or pa.types.is_string(c.type)]
        ends = np.cumsum(np.sum(wide, axis=0, dtype=np.int64)) if wide else np.zeros(b.num_rows, np.int64)
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            end = min(max(start + 1, int(np.searchsorted(ends, before + size, "right"))), start + rows_, b.num_rows)
            yield b.slice(start, end - start)
            start = end


def by_bytes(keys: list, texts: list, most: int) -> Iterator[tuple[list, list]]:
    """The rows in runs of about ``most`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield keys[start:i + 1], texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield keys[start:], texts[start:]
