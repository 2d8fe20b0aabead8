"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A model holds, for each language, log probabilities of hashed letter trigrams (word edges included) and the scripts in
which it is written. Each word gets the sum of its trigrams' log probabilities for each language that uses its script.
The best path through a text pays a penalty for every change of language, so single odd words don't make spans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm.common import column, documents, few, rows

#: Buckets of trigrams, documents of a language that the model is fitted on (expected), the penalty of a change of
#: language, the share of a language's letters from which it counts as written in a script, and what a word costs a
#: language that isn't.
BUCKETS, SAMPLE, CHANGE, IN_SCRIPT, FOREIGN = 1 << 15, 2000, 12.0, 0.01, 50.0
#: Languages of a model at most; with more labels than that the table's labels are no languages.
LANGUAGES = 1024
#: Least share of the letters in spans of the document's language, for the pipeline.
LEAST = 0.4
UND = "und"
#: Characters whose words are scored together, and words that one Viterbi run takes together.
RUN, PATHS = 1 << 19, 1 << 20

#: First and last code points of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "gurmukhi": [(0xA00, 0xA7F)], "gujarati": [(0xA80, 0xAFF)], "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)], "kannada": [(0xC80, 0xCFF)], "malayalam": [(0xD00, 0xD7F)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)], "ethiopic": [(0x1200, 0x137F)], "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the script of a letter (0: no letter, 1: of none listed), and the lower-case letter."""
    points = 0x110000
    script = np.array([chr(i).isalpha() for i in range(points)], np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a:b + 1] *= np.uint8(k + 2)
    lower = np.arange(points, dtype=np.uint32)
    for i in np.flatnonzero(script).tolist():
        if len(x := chr(i).lower()) == 1:
            lower[i] = ord(x)
    return script, lower


@dataclass
class Words:
    """The words of several texts: owner, first and end place, script, and the trigrams with the word of each."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    grams: np.ndarray
    first: np.ndarray


def words_of(texts: list[str], begin: np.ndarray | None = None) -> Words:
    """Words are runs of letters; a trigram sits on each letter, with its neighbours or the word's edge."""
    script, lower = _tables()
    codes = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = script[codes]
    letter = kind > 0
    edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    x = np.zeros(len(codes) + 2, np.uint32)
    x[1:-1] = np.where(letter, lower[codes], 0)
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA6B) + x[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    grams = (h >> np.uint32(32 - BUCKETS.bit_length() + 1))[letter]
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(at, start, "right") - 1
    size = end - start
    return Words(doc, start - at[doc], end - at[doc], kind[start], grams, np.cumsum(size) - size)


def _cut(texts: list[str], most: int) -> list[tuple[int, int, str]]:
    """(text, offset, piece) with pieces of about ``most`` characters, long texts cut where no letter is."""
    out = []
    for k, t in enumerate(texts):
        a = 0
        while len(t) - a > most:
            b = a + most
            while b < len(t) and t[b].isalpha():
                b += 1
            out.append((k, a, t[a:b]))
            a = b
        out.append((k, a, t[a:]))
    return out


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # bucket x language
    fits: np.ndarray  # script x language: 0 or what a word costs
    change: float

    def scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all words: text, start, end, score for each language."""
        none = np.zeros(0, np.int64)
        out = [(none, none, none, np.zeros((0, len(self.langs)), np.float32))]
        run, size = [], 0
        pieces = _cut(texts, RUN)
        for i, piece in enumerate(pieces):
            run.append(piece)
            size += len(piece[2])
            if size < RUN and i + 1 < len(pieces):
                continue
            w = words_of([p[2] for p in run])
            if len(w.doc):
                own, offset = np.array([p[0] for p in run]), np.array([p[1] for p in run])
                score = np.add.reduceat(self.logs[w.grams], w.first, axis=0) + self.fits[w.script]
                out.append((own[w.doc], w.start + offset[w.doc], w.end + offset[w.doc], score))
            run, size = [], 0
        return tuple(np.concatenate(x) for x in zip(*out))

    def path(self, doc: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The language of each word on the best path of its text; texts advance side by side."""
        n, k = score.shape
        if not n:
            return np.zeros(0, np.int64)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        size = np.diff(first, append=n)
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")  # texts with more than t words
        back = np.empty((n, k), np.uint16)
        total = score[first].astype(np.float64)
        own = np.arange(k, dtype=np.uint16)
        for t in range(1, int(size[0])):
            m = alive[t]
            now, at = total[:m], first[:m] + t
            best = now.argmax(axis=1)
            move = now[np.arange(m), best] - self.change
            stay = now >= move[:, None]
            back[at] = np.where(stay, own, best[:, None])
            total[:m] = np.where(stay, now, move[:, None]) + score[at]
        out = np.empty(n, np.int64)
        state = total.argmax(axis=1)
        for t in range(int(size[0]) - 1, -1, -1):
            m = alive[t]
            at = first[:m] + t
            out[at] = state[:m]
            if t:
                state[:m] = back[at, state[:m]]
        return out

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans of each text. The score is the share of letters in spans of that language."""
        found = [(UND, 0.0, [])] * len(texts)
        if not self.langs:
            return found
        doc, start, end, score = self.scored(texts)
        lang = self.path(doc, score)
        k = len(self.langs)
        letters = np.bincount(doc * k + lang, weights=end - start, minlength=len(texts) * k).reshape(-1, k)
        total, best = letters.sum(axis=1), letters.argmax(axis=1)
        turn = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0))
        last = np.append(turn[1:], len(doc)) - 1
        spans: list[list] = [[] for _ in texts]
        for d, a, b, j in zip(doc[turn].tolist(), start[turn].tolist(), end[last].tolist() if len(turn) else [], lang[turn].tolist()):
            spans[d].append((a, b, self.langs[j]))
        return [(self.langs[best[i]], float(letters[i, best[i]] / total[i]), spans[i]) if total[i] else (UND, 0.0, []) for i in range(len(texts))]


def fit(labelled: DataFrame, sample: int = SAMPLE, change: float = CHANGE) -> Model:
    """Fit on ``labelled`` (text, lang): about ``sample`` whole texts of each language, drawn by a hash of the text.

    Rows without text or label are no examples. What reaches the driver are BUCKETS counts a language.
    """
    rows_ = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    per = {r["lang"]: r["n"] for r in rows_.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()}
    if len(per) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels")
    langs = sorted(per)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 2, 0), np.float32), change)
    share = F.create_map(*[F.lit(x) for g in langs for x in (g, min(1.0, sample / per[g]))])
    drawn = rows_.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    schema = pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])
    width = BUCKETS + len(SCRIPTS) + 2

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(column(b, "text"), column(b, "lang")):
                t = totals.setdefault(lang, np.zeros(width, np.int64))
                for _, _, piece in _cut([text], RUN):
                    w = words_of([piece])
                    t[:BUCKETS] += np.bincount(w.grams, minlength=BUCKETS)
                    t[BUCKETS:] += np.bincount(w.script, weights=w.end - w.start, minlength=width - BUCKETS).astype(np.int64)
        for lang, t in totals.items():
            at = np.flatnonzero(t)
            yield rows(schema, [[lang] * len(at), at.astype(np.int32), t[at]])

    got = drawn.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((width, len(langs)))
    place = {g: i for i, g in enumerate(langs)}
    np.add.at(counts, (got["cell"].to_numpy(), np.array([place[g] for g in got["lang"].to_pylist()], np.int64)), got["n"].to_numpy())
    grams, scripts = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    used = scripts >= np.maximum(1, IN_SCRIPT * scripts.sum(axis=0))
    fits = np.where(used | ~used.any(axis=1, keepdims=True), 0.0, -FOREIGN)  # a script that nobody uses narrows nothing
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), fits.astype(np.float32), change)


OUT = "lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and, if wanted, spans (places in code points, end exclusive).

    ``und`` with score 0 and no spans where the text is null or has no letter. Row by row, from the text alone.
    """
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)])
    at = f"in_{names.index('text')}"
    part = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    out = ", ".join(f"in_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def run(batches):
        for b in few(batches, 1 << 16, 4 * PATHS):
            found = model.label([t or "" for t in column(b, at)])
            out = [*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            if spans:
                out.append(pa.array([[{"start": x, "end": y, "lang": g} for x, y, g in f[2]] for f in found], pa.list_(part)))
            yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names, *added])

    added = ["lang_pred", "score", "spans"][:3 if spans else 2]
    kinds = OUT if spans else OUT.partition(", spans")[0]
    return inner.mapInArrow(run, f"{out}, {kinds}").toDF(*names, *added)


def held_out(doc_id: str = "doc_id"):
    """True for the fold that no model is fitted on."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    slim = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(slim, model).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
