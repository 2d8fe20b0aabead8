"""Special functions as Columns: gamma family, normal and Student probabilities, and two maximum-likelihood fits.

Series and continued fractions have a length that follows from their arguments and run inside the JVM; nothing is sent
to Python. A continued fraction is evaluated from its far end, so one number is its whole state.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from territoria.functions.scalars import ColumnLike, col, let

# Coefficients of the Lanczos approximation of the gamma function (g = 7, nine terms).
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Rounds of the Newton searches, and halvings of a step that raises the likelihood's loss by more than rounding does.
SHAPE_ROUNDS, FIT_ROUNDS, HALVINGS = 12, 30, 8


def lgamma(a: ColumnLike) -> Column:
    """Log of the gamma function of a positive number."""
    a = col(a)
    t = a + LANCZOS_G + 0.5
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (a + i)
    return 0.5 * math.log(2 * math.pi) + (a + 0.5) * F.ln(t) - t + F.ln(series) - F.ln(a)


def digamma(a: ColumnLike) -> Column:
    """Eight steps of the recurrence, then the asymptotic series."""
    def far(y: Column) -> Column:
        v = 1 / (y * y)
        return F.ln(y) - 0.5 / y - v * (1 / 12 - v * (1 / 120 - v * (1 / 252 - v * (1 / 240 - v / 132))))

    a = col(a)
    out = let(a + 8, far)
    for k in range(8):
        out = out - 1 / (a + k)
    return out


def trigamma(a: ColumnLike) -> Column:
    def far(y: Column) -> Column:
        v = 1 / (y * y)
        return 1 / y + v / 2 + v / y * (1 / 6 - v * (1 / 30 - v * (1 / 42 - v / 30)))

    a = col(a)
    out = let(a + 8, far)
    for k in range(8):
        out = out + 1 / ((a + k) * (a + k))
    return out


def gamma_shape(log_gap: ColumnLike) -> Column:
    """Shape a solving ln a - digamma(a) = ln(mean x) - mean(ln x): closed-form start, then Newton. Null unless the gap is positive."""
    def search(g: Column) -> Column:
        start = (3 - g + F.sqrt((g - 3) * (g - 3) + 24 * g)) / (12 * g)
        step = lambda a, _: F.greatest(a - (F.ln(a) - digamma(a) - g) / (1 / a - trigamma(a)), F.lit(1e-8))
        return F.aggregate(F.sequence(F.lit(1), F.lit(SHAPE_ROUNDS)), start, step)

    g = col(log_gap)
    return let(F.when(g > 0, g), lambda v: F.when(v.isNotNull(), search(v)))


def lower_gamma(a: ColumnLike, x: ColumnLike) -> Column:
    """Regularised lower incomplete gamma: power series below a + 1, continued fraction above. 0 for x <= 0, null unless a > 0."""
    def front(v: Column) -> Column:
        return F.exp(-v["x"] + v["a"] * F.ln(v["x"]) - lgamma(v["a"]))

    def series(v: Column) -> Column:
        first = 1 / v["a"]
        step = lambda s, i: F.struct((s["t"] * v["x"] / (v["a"] + i)).alias("t"), (s["sum"] + s["t"] * v["x"] / (v["a"] + i)).alias("sum"))
        return front(v) * F.aggregate(F.sequence(F.lit(1), v["n"]), F.struct(first.alias("t"), first.alias("sum")), step, lambda s: s["sum"])

    def fraction(v: Column) -> Column:
        b = lambda i: v["x"] + 1 - v["a"] + 2 * i
        far = F.aggregate(F.sequence(v["n"], F.lit(1), F.lit(-1)), b(v["n"]).cast("double"), lambda f, i: b(i - 1) - i * (i - v["a"]) / f)
        return 1 - front(v) / far

    a, x = col(a).cast("double"), col(x).cast("double")
    terms = (150 + 10 * F.ceil(F.sqrt(a))).cast("int")
    ok = (a > 0) & x.isNotNull()
    pick = lambda v: F.when(v["x"] <= 0, F.lit(0.0)).when(v["x"] < v["a"] + 1, series(v)).otherwise(fraction(v))
    return let(F.when(ok, F.struct(a.alias("a"), x.alias("x"), terms.alias("n"))), lambda v: F.when(v.isNotNull(), pick(v)))


def normal_cdf(z: ColumnLike) -> Column:
    z = col(z)
    return 0.5 * (1 + F.signum(z) * lower_gamma(F.lit(0.5), z * z / 2))


def gamma_cdf_with_zeros(x: ColumnLike, zero_share: ColumnLike, shape: ColumnLike, scale: ColumnLike) -> Column:
    """q0 + (1-q0) F(x); exactly q0 at or below zero."""
    x, q0 = col(x), col(zero_share)
    return F.when(x <= 0, q0).otherwise(q0 + (1 - q0) * lower_gamma(shape, x / col(scale)))


def pearson3_cdf(x: ColumnLike, skew: ColumnLike, loc: ColumnLike, scale: ColumnLike) -> Column:
    """Skewed gamma with mean ``loc`` and standard deviation ``scale``; normal when the skew vanishes."""
    def skewed(v: Column) -> Column:
        g = lower_gamma(4 / (v["k"] * v["k"]), F.greatest(2 / v["k"] * (v["z"] + 2 / v["k"]), F.lit(0.0)))
        return F.when(v["k"] > 0, g).otherwise(1 - g)

    z = (col(x) - col(loc)) / col(scale)
    both = F.struct(z.cast("double").alias("z"), col(skew).cast("double").alias("k"))
    return let(both, lambda v: F.when(v["z"].isNull() | v["k"].isNull(), None).when(F.abs(v["k"]) < 1.6e-5, normal_cdf(v["z"])).otherwise(skewed(v)))


def beta_cdf(x: ColumnLike, a: ColumnLike, b: ColumnLike) -> Column:
    """Regularised incomplete beta by its continued fraction, on the side where that converges."""
    def part(v: Column, x: Column, a: Column, b: Column) -> Column:
        front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.ln(x) + b * F.ln(1 - x)) / a

        def number(i: Column) -> Column:
            m = F.floor(i / 2)
            even = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
            return F.when(i % 2 == 0, even).otherwise(odd) * x

        return front / F.aggregate(F.sequence(v["n"], F.lit(1), F.lit(-1)), F.lit(1.0), lambda f, i: 1 + number(i) / f)

    def pick(v: Column) -> Column:
        near = v["x"] <= (v["a"] + 1) / (v["a"] + v["b"] + 2)
        whole = F.when(v["x"] <= 0, F.lit(0.0)).when(v["x"] >= 1, F.lit(1.0))
        return whole.when(near, part(v, v["x"], v["a"], v["b"])).otherwise(1 - part(v, 1 - v["x"], v["b"], v["a"]))

    a, b, x = (col(c).cast("double") for c in (a, b, x))
    terms = (100 + 10 * F.ceil(F.sqrt(a + b))).cast("int")
    ok = x.isNotNull() & (a > 0) & (b > 0)
    return let(F.when(ok, F.struct(a.alias("a"), b.alias("b"), x.alias("x"), terms.alias("n"))), lambda v: F.when(v.isNotNull(), pick(v)))


def student_two_sided(t: ColumnLike, df: ColumnLike) -> Column:
    """Two-sided p-value of a Student statistic; null unless df > 0."""
    t, df = col(t).cast("double"), col(df).cast("double")
    return F.when((df > 0) & t.isNotNull(), beta_cdf(df / (df + t * t), df / 2, F.lit(0.5)))


def fit_loglogistic(values: ColumnLike) -> Column:
    """Struct (shape, scale) of maximum likelihood over an array of positive numbers: damped Newton on the logistic of their logarithms.

    Null for fewer than two values, or where they don't differ. The state is the location, the log of the spread and the loss.
    """
    def total(of: Column) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda s, v: s + v)

    def loss(y: Column, m: Column, t: Column) -> Column:
        def one(v: Column) -> Column:
            return let((v - m) / F.exp(t), lambda z: z + t + 2 * (F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))))

        return total(F.transform(y, one))

    def state(m: Column, t: Column, best: Column) -> Column:
        return F.struct(m.alias("m"), t.alias("t"), best.alias("best"))

    def newton(y: Column, v: Column) -> Column:
        def moments(c: Column) -> Column:
            zero = F.struct(*[F.lit(0.0).alias(n) for n in ("f", "fz", "h", "hz", "hzz")])

            def add(s: Column, x: Column) -> Column:
                return let((x - c["m"]) / F.exp(c["t"]), lambda z: let(F.struct(z.alias("z"), F.tanh(z / 2).alias("f")), lambda w: let(
                    F.struct(w["z"].alias("z"), w["f"].alias("f"), ((1 - w["f"] * w["f"]) / 2).alias("h")), lambda q: F.struct(
                        (s["f"] + q["f"]).alias("f"), (s["fz"] + q["f"] * q["z"]).alias("fz"), (s["h"] + q["h"]).alias("h"),
                        (s["hz"] + q["h"] * q["z"]).alias("hz"), (s["hzz"] + q["h"] * q["z"] * q["z"]).alias("hzz")))))

            return F.aggregate(y, zero, add)

        def direction(s: Column) -> Column:
            size = F.exp(v["t"])
            gm, gt = -s["f"] / size, F.size(y) - s["fz"]
            return F.struct(gm.alias("gm"), gt.alias("gt"), (s["h"] / (size * size)).alias("mm"), ((s["hz"] + s["f"]) / size).alias("mt"), (s["hzz"] + s["fz"]).alias("tt"))

        def step(g: Column) -> Column:
            det = g["mm"] * g["tt"] - g["mt"] * g["mt"]
            whole = F.struct(((g["tt"] * g["gm"] - g["mt"] * g["gt"]) / det).alias("m"), ((g["mm"] * g["gt"] - g["mt"] * g["gm"]) / det).alias("t"))
            most = F.greatest(F.lit(1.0), F.abs(g["gm"]), F.abs(g["gt"]))
            return F.when((det > 0) & (g["mm"] > 0), whole).otherwise(F.struct((g["gm"] / most).alias("m"), (g["gt"] / most).alias("t")))

        def damped(d: Column) -> Column:
            tries = []
            for k in range(HALVINGS + 1):
                m, t = v["m"] - d["m"] / 2**k, v["t"] - d["t"] / 2**k
                tries.append(let(state(m, t, loss(y, m, t)), lambda s: F.when(s["best"] <= v["best"] + 1e-12 * (1 + F.abs(v["best"])), s)))
            return F.coalesce(*tries, v)

        return let(moments(v), lambda s: let(direction(s), lambda g: let(step(g), damped)))

    def search(y: Column) -> Column:
        def start(mean: Column) -> Column:
            spread = F.sqrt(total(F.transform(y, lambda v: (v - mean) * (v - mean))) / F.size(y))
            return F.when(spread >= 1e-12, F.struct(mean.alias("m"), F.ln(spread * math.sqrt(3) / math.pi).alias("t")))

        def run(s: Column) -> Column:
            end = F.aggregate(F.sequence(F.lit(1), F.lit(FIT_ROUNDS)), state(s["m"], s["t"], loss(y, s["m"], s["t"])), lambda v, _: newton(y, v))
            return let(end, lambda e: F.struct(F.exp(-e["t"]).alias("shape"), F.exp(e["m"]).alias("scale")))

        return let(total(y) / F.size(y), lambda mean: let(start(mean), lambda s: F.when(s.isNotNull(), run(s))))

    logs = F.filter(F.transform(col(values), lambda v: F.when(v > 0, F.ln(v))), lambda v: v.isNotNull())
    return let(logs, lambda y: F.when(F.size(y) >= 2, search(y)))


