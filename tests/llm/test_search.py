"""Top-k search, prefix trie and spelling variants against brute force, with nulls, empty tables, ties, repeats and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from territoria.llm import inner, trie, variants


def got(df):
    return [tuple(r) for r in df.collect()]


def brute_top(rows, asked, k, scale=1024):
    usable = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for a, (q, v) in enumerate(usable):
        if asked(q):
            found = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i) for b, (i, w) in enumerate(usable) if b != a)
            yield from ((q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], 1))


@pytest.mark.parametrize("limits", [{}, {"band_bytes": 4000, "block_bytes": 600, "seeds": 16}, {"seeds": 0}])
def test_top_inner(spark, monkeypatch, limits):
    """Lengths of every size, nulls, not-a-numbers, widths that differ, one vector for a third of all rows, repeated ids."""
    monkeypatch.setattr(inner, "SLICE", 32)
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=9) * 10 ** rng.uniform(-3, 2) * [3, 2, 1, 1, 1, .5, .1, .1, 0]).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(5000, rows[7][1]), (5000, rows[7][1]), (5000, rows[8][1])]
    rows += [(2000, None), (2010, [None, 1.0]), (2020, [float("nan")] * 9), (2030, [float("inf")]), (2040, []), (2050, [1.0]), (2060, [0.0] * 9), (None, [1.0] * 9), (2070, [-2.5] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS ord", "2 AS band", "3 AS norm", "4 AS rank").repartition(5)
    from pyspark.sql import functions as F

    out = got(inner.top_inner(df, F.col("vec_id") % 10 == 0, 6, **limits))
    assert sorted(out) == sorted(brute_top(rows, lambda i: i % 10 == 0, 6))
    assert got(inner.top_inner(df.limit(0), F.col("vec_id") % 10 == 0)) == []
    assert got(inner.top_inner(df.where("vec_id = 10"), F.col("vec_id") % 10 == 0)) == []


def test_scores_beyond_a_double(spark):
    from pyspark.sql import functions as F

    rows = [(0, [3e9, 1.0, -7.0]), (1, [3e9, 2.0, 5.0]), (2, [-3e9, 1e12, 0.5]), (3, [1e300, 0.0, 0.0]), (4, [2e-3, 0.0, 0.0]), (5, [3e9, 2.0, 5.0])]
    out = got(inner.top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), 3))
    assert sorted(out) == sorted(brute_top(rows, lambda i: True, 3))


def test_partial_sums_prune():
    """Where few directions carry the table, pairs fall to the bound before they are scored, but for the first slice, which sets it."""
    rng = np.random.default_rng(1)
    v = np.floor(1024 * rng.normal(size=(4000, 32)) * np.geomspace(1, 1e-3, 32))
    v = v[np.argsort(-inner.length(v))]
    q = v[rng.choice(4000, 50, replace=False)]
    ids = np.arange(4000)
    turn = np.linalg.eigh(v.T @ v)[1][:, ::-1]
    best, scored = inner.search(q, np.full(50, -1), np.full(50, -np.inf), v, ids, ids, turn, 10)
    want = np.sort(q @ v.T, axis=1)[:, ::-1][:, :10].astype(np.int64)
    assert (best.score.reshape(50, 10) == want).all() and scored < 50 * (inner.SLICE + 100)


def brute_trie(rows):
    talk = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talk[c].append((turn is not None, turn or 0, role or "", text or ""))
    talk = {c: [x[2:] for x in sorted(t)] for c, t in talk.items()}
    members = defaultdict(list)
    for c in sorted(talk):
        h = zlib.crc32(str(c).encode()) % 4
        turns = talk.get(c - c % 20, [])[:h] + talk[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, d == len(turns)))
    below = defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in below[p]) if below[p] else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = sum(saved[x] for x in below[p]) + (len(members[p]) - 1) * words
    return [(members[p][0][0], len(p), members[p[:-1]][0][0] if p else None, len(members[p]), len(below[p]), leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c, ends in members[p] if ends).encode()).hexdigest()) for p in members]


@pytest.mark.parametrize("limits", [{}, {"range_bytes": 400}])
def test_prefix_trie(spark, monkeypatch, limits):
    """Deep sharing, copies, null turns and texts, repeated turns, one long conversation, one first turn for a third of all."""
    monkeypatch.setattr(trie, "BATCH", 3)
    monkeypatch.setattr(trie, "PIECE", 7)
    rng = random.Random(4)
    rows = []
    for c in range(160):
        turns = [(k, rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", "", None])) for k in range(rng.choice([0, 1, 1, 2, 5, 9]))]
        if c % 3 == 0:
            turns[:1] = [(0, "user", "same first turn")]
        rows += [(c, *t) for t in turns]
    rows += [(c, k, "user", "copy") for c in range(200, 260) for k in range(6)] + [(300, k, "user", f"t{k % 3}") for k in range(300)] + [(301, k, "user", f"t{k % 3}") for k in range(290)]
    rows += [(400, None, "tool", "first"), (400, 0, "user", "x"), (400, 0, "user", "x"), (400, 0, None, "y"), (None, 1, "user", "x"), (421, 0, "user", "few")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS chain", "2 AS range", "3 AS depth")
    out = got(trie.prefix_trie(trie.rebuilt(df), **limits))
    assert Counter(out) == Counter(brute_trie(rows))
    assert got(trie.prefix_trie(trie.rebuilt(df.limit(0)), **limits)) == []


def test_fat_binary_search():
    """The search ends at the node that a walk from the root ends at, and asks the table about log2(depth) times."""
    rng = random.Random(9)

    def chain(turns):
        out, last = b"", b""
        for t in turns:
            last = hashlib.sha256(last + t).digest()[:trie.D]
            out += last
        return out

    base = [bytes([rng.randrange(2)]) for _ in range(400)]
    texts = {tuple(base[:rng.randint(0, 400)] + [bytes([rng.randrange(3)]) for _ in range(rng.randint(0, 5))]) for _ in range(150)}
    chains = [chain(t) for t in texts]
    t = trie.ZFastTrie()
    t.insert_batch(chains[:100])
    for at in range(100, 150, 10):
        t.insert_batch(chains[at:at + 10])
    for v in range(1, len(t.up)):
        assert t.stop[t.up[v]] == t.start[v] < t.stop[v]
        f = trie.fattest(t.start[v], t.stop[v])
        assert t.handles[t.strings[t.string[v]][trie.D * f - trie.D:trie.D * f]] == v
    assert len(t.handles) == len(t.up) - 1
    for x in [*chains, *(chain(list(c)[:50] + [b"new"]) for c in texts)]:
        v = 0
        while (c := t.down[v].get(x[trie.D * t.stop[v]:trie.D * t.stop[v] + trie.D])) and x.startswith(t.strings[t.string[c]][:trie.D * t.stop[c]]):
            v = c
        asked = []
        handles, t.handles = t.handles, type("Table", (dict,), {"get": lambda self, k: asked.append(k) or dict.get(self, k)})(t.handles)
        assert t.above(x) == v and len(asked) <= 2 * 9
        t.handles = handles


def brute_variants(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and brute_edit(w, x)] for w in n}
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda x: (-n[x], x))] >= 2 * n[w]}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        yield w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root


def brute_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


@pytest.mark.parametrize("most", [4096, 5])
def test_spelling_variants(spark, monkeypatch, most):
    """Anagrams, accents, capitals that aren't plain, words of thousands of letters, one word for a third of all, ties, nulls, repeats."""
    for name, x in (("PIECE", 50), ("HELD", 20), ("CALLERS", 7), ("PAIRS", 9)):
        monkeypatch.setattr(variants, name, x)
    rng = random.Random(2)
    stems = ["".join(rng.choices("aeirÉéàbc", k=rng.randint(4, 7))) for _ in range(60)] + ["abcde", "bacde", "cabde", "x" * 3000, "y" * 64, "y" * 65]
    words = []
    for s in stems:
        words += [s] * rng.choice([3, 6, 12, 40])
        for _ in range(4):
            k = rng.randrange(len(s))
            words += [rng.choice([s[:k] + s[k + 1:], s[:k] + rng.choice("aeß÷×") + s[k + 1:], s[:k] + "é" + s[k:]])] * rng.choice([1, 3, 5])
    words += ["popular"] * 800 + ["popolar"] * 3 + ["POPULAR", "the", "of"] * 20
    rng.shuffle(words)
    docs = [(i, rng.choice([" ", "\n", ", ", "1"]).join(words[i::40])) for i in range(40)]
    docs += [(100, None), (101, ""), (None, "popular abcde abcde"), (7, docs[7][1]), (102, "popular-" * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS path", "4 AS slice")
    out = got(variants.variant_groups(variants.vocabulary(df), most=most))
    want = Counter(brute_variants(docs))
    assert list((Counter(out) - want).items())[:3] == list((want - Counter(out)).items())[:3] == []
    assert sum(r[3] is not None for r in out) > 20
    assert got(variants.variant_groups(variants.vocabulary(df.limit(0)))) == []


def test_one_edit():
    words = ["", "a", "b", "ab", "ba", "aa", "aab", "aaa", "abab", "abba", "aabb", "bbaa", "é" * 70, "é" * 71, "é" * 70 + "x", "é" * 35 + "x" + "é" * 35]
    x, y = np.divmod(np.arange(len(words) ** 2), len(words))
    many = variants.Letters(words).one_edit(x, y)
    for i, j, m in zip(x, y, many):
        assert m == variants.one_edit(words[i], words[j]) == brute_edit(words[i], words[j]), (words[i], words[j])
