"""Secret scanning: three base patterns, and assignments lexed into names and literals.

The lexer reads what source and configuration files share: a name, an operator (= := => :) and a value of quoted
literals, bare words and names of earlier assignments, joined by + where several. Constants are propagated: a literal
that reaches a sensitive name through other names is scored for it. The score is the weight of the most sensitive word
of the name times how much the literal looks like a secret. Each place of a text is lexed once, values share what follows
a +, and a name points at its value, so time and memory grow with the text, whatever stands in it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm.common import column, documents

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Words of names and how sensitive they are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.9, "authorization": 0.8, "signature": 0.6, "salt": 0.6, "key": 0.6,
}
#: What people write where a secret will stand.
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined", "your-token", "xxxxxx"}
SCORE, LEAST, LONGEST = 0.5, 6, max(map(len, PLACEHOLDERS))

_OPERATOR = re.compile(r":=|=>|=(?![=~>])|:(?![:=])")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_QUOTED = re.compile(r"""[ \t]*(?:"([^"\\\n]*(?:\\.[^"\\\n]*)*)"|'([^'\\\n]*(?:\\.[^'\\\n]*)*)'|`([^`\n]*)`)""", re.DOTALL)
_BARE = re.compile(r"""[^\s"'`,;+()\[\]{}<>]+""")
_SPACES = re.compile(r"[ \t]*")
_PLUS = re.compile(r"[ \t]*\+[ \t]*\n?")
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_REFERENCE = re.compile(r"^\$\{?([A-Za-z_][A-Za-z0-9_.\-]*)\}?$|^([A-Za-z_][A-Za-z0-9_.\-]*)$", re.ASCII)


def sensitivity(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    return max([0.0, *(SENSITIVE.get(w, 0.0) for w in words), *(SENSITIVE.get(a + b, 0.0) for a, b in zip(words, words[1:]))])


def _mixed(letters: str) -> bool:
    return letters != letters.lower()


def likeness(literal: str, quoted: bool) -> float:
    """0 to 1: the information of the characters, less for words of prose."""
    if len(literal) < LEAST or literal.lower() in PLACEHOLDERS or literal[0] in "$<%{":
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    mixed = any(c.isdigit() for c in literal) or (_mixed(literal) and _mixed(literal[1:]))
    return min(1.0, entropy * n / 20) * (1.0 if mixed else 0.6 if quoted and " " not in literal else 0.3)


def tail_likeness(text: str, starts: list[int], end: int) -> dict[int, float]:
    """``likeness`` of the bare literals from each of ``starts`` to one ``end``: counts grow leftwards, a character at a time."""
    out, counts, log_sum, digit, inner, at = {}, Counter(), 0.0, False, False, end
    for a in sorted(starts, reverse=True):
        while at > a:
            inner = inner or (at < end and _mixed(text[at]))
            at -= 1
            c = counts[text[at]]
            log_sum += (c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)
            counts[text[at]] = c + 1
            digit = digit or text[at].isdigit()
        n = end - a
        if n < LEAST or (n <= LONGEST and text[a:end].lower() in PLACEHOLDERS) or text[a] in "$<%{":
            out[a] = 0.0
        else:
            out[a] = min(1.0, (n * math.log2(n) - log_sum) / 20) * (1.0 if digit or inner else 0.3)
    return out


def _name(text: str, at: int) -> str | None:
    """The name that ends before an operator at ``at``, quoted or not."""
    i = at
    while i and text[i - 1] in " \t":
        i -= 1
    if i and text[i - 1] in "\"'`":
        i -= 1
    j = i
    while j and text[j - 1] in _NAME_CHARS:
        j -= 1
    name = text[j:i].lstrip("0123456789.-")
    return name or None


class Values:
    """The values of a text as chains of terms joined by +. A chain is known by the place where it starts.

    ``terms``: place to (start, end, quoted, reference, place of the next term or None). What follows a + is one chain for
    all values that run into it. ``names``: every assignment in order, with the place of its value.
    """

    def __init__(self, text: str):
        self.text = text
        self.terms: dict[int, tuple[int, int, bool, str | None, int | None]] = {}
        self.tails: dict[int, tuple[int, bool]] = {}  # where a chain ends, and whether all its terms are quoted
        self.run = (0, 0, 0)  # the last run of bare characters: start, end, and where its last run of name characters starts
        self.names: list[tuple[str, int]] = []
        self.bound: dict[int, int] = {}  # term that is a reference to the place of its value
        known: dict[str, int] = {}
        after = 0
        for m in _OPERATOR.finditer(text):
            if m.start() < after or (m.start() and text[m.start() - 1] in "=!<>:+-*/|&^%~"):
                continue
            name = _name(text, m.start())
            if name is None:
                continue
            new = self._chain(m.end())
            if m.end() not in self.terms:
                continue
            for place in new:
                of = self.terms[place][3]
                if of is not None and of in known:
                    self.bound[place] = known[of]
            end, all_quoted = self.tails[m.end()]
            after = max(after, end if all_quoted else m.end())
            known[name] = m.end()
            self.names.append((name, m.end()))

    def _term(self, at: int) -> tuple[int, int, int, bool, str | None] | None:
        """End of the term, start and end of its literal, whether it is quoted, and the name that it refers to."""
        text = self.text
        if m := _QUOTED.match(text, at):
            k = m.lastindex
            ref = _REFERENCE.match(m[k]) if m[k][:1] == "$" else None
            return m.end(), m.start(k), m.end(k), True, ref[1] if ref else None
        a = _SPACES.match(text, at).end()
        start, end, name = self.run
        if not start <= a < end:
            m = _BARE.match(text, a)
            if not m:
                return None
            name = end = m.end()
            while name > a and text[name - 1] in _NAME_CHARS:
                name -= 1
            self.run = (a, end, name)
        ref = None
        if a >= name - 1 and (m := _REFERENCE.match(text[a:end])):  # name characters, after a $ at most
            ref = m[1] or m[2]
        return end, a, end, False, ref

    def _chain(self, at: int) -> list[int]:
        """Lexes the chain that starts at a place as far as it isn't known, and returns the new places."""
        new, place, end = [], at, at
        while place not in self.terms:
            term = self._term(place)
            if term is None:
                break
            new.append((place, term))
            end = term[0]
            plus = _PLUS.match(self.text, end)
            if not plus:
                break
            place = end = plus.end()
        following, (end, quoted) = (place, self.tails[place]) if place in self.terms else (None, (end, True))
        for place, (_, a, b, own, ref) in reversed(new):
            self.terms[place] = (a, b, own, ref, following)
            quoted = quoted and own
            self.tails[place] = (end, quoted)
            following = place
        return [place for place, _ in new]


def assignments(text: str) -> Iterator[tuple[str, list[tuple[int, int, bool]]]]:
    """Names and the terms (start, end, quoted) of their values, in order."""
    values = Values(text)
    for name, place in values.names:
        terms = []
        while place is not None:
            a, b, quoted, _, place = values.terms[place]
            terms.append((a, b, quoted))
        yield name, terms


def literals(text: str, score: float = SCORE) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of every literal that reaches a sensitive name: the most sensitive one, of equals the first."""
    if ":" not in text and "=" not in text:
        return []
    values = Values(text)
    weighted = [(w, name, place) for name, place in values.names if (w := sensitivity(name))]
    reached: dict[tuple[int, int], tuple[float, str, bool]] = {}
    seen: set[int] = set()
    for weight, name, place in sorted(weighted, key=lambda x: -x[0]):  # whoever comes first to a term is its most sensitive name
        stack = [place]
        while stack:
            place = stack.pop()
            if place in seen:
                continue
            seen.add(place)
            a, b, quoted, _, following = values.terms[place]
            if following is not None:
                stack.append(following)
            if place in values.bound:
                stack.append(values.bound[place])
            else:
                reached.setdefault((a, b), (weight, name, quoted))
    tails: dict[int, list[int]] = {}
    for (a, b), (_, _, quoted) in reached.items():
        if not quoted:
            tails.setdefault(b, []).append(a)
    bare = {(a, b): like for b, starts in tails.items() if len(starts) > 1 for a, like in tail_likeness(text, starts, b).items()}
    out = []
    for (a, b), (weight, name, quoted) in sorted(reached.items()):
        s = weight * (bare[a, b] if (a, b) in bare and not quoted else likeness(text[a:b], quoted))
        if s >= score:
            out.append((a, b, name, round(s, 6)))
    return out


def spans(text: str) -> list[tuple[str, int, int, str | None, float | None]]:
    """All spans (kind, start, end, name, score) by start, then kind; places in code points, ends exclusive."""
    out: list[tuple] = [("assign", m.start(), m.end(), m[1], None) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), None, None) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), None, None) for m in _HEX.finditer(text)]
    out += [("literal", a, b, n, s) for a, b, n, s in literals(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


OUT = "doc_id long, spans array<struct<kind:string,start:int,end:int,name:string,score:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row of ``docs``; a null or empty text has none, repeated rows are scanned each.

    Row by row: nothing is shuffled. An empty table gives no rows.
    """
    part = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(part))])

    def run(batches):
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "name", "score"), s)) for s in spans(t or "")] for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, schema.types[1])], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def _listed(of):
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), n("literal"))
