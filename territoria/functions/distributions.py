"""Normal quantile and log-logistic distribution as Columns; the gamma family is in ``special``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from territoria.functions.scalars import ColumnLike, clip, col, let

# Coefficients of the AS241 normal quantile (numerator, denominator per region, ascending powers).
AS241_CENTRAL = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867,
     39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
AS241_NEAR = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590,
     0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
AS241_FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
     0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _poly(coefs, x: Column) -> Column:
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + c
    return out


def norm_ppf(p: ColumnLike, clamp: float = 1e-6) -> Column:
    """Standard normal quantile of p clamped to [clamp, 1-clamp]."""

    def centre(q: Column) -> Column:
        return let(0.180625 - q * q, lambda r: q * _poly(AS241_CENTRAL[0], r) / _poly(AS241_CENTRAL[1], r))

    def tails(q: Column) -> Column:
        def size(r: Column) -> Column:
            near = let(r - 1.6, lambda v: _poly(AS241_NEAR[0], v) / _poly(AS241_NEAR[1], v))
            far = let(r - 5.0, lambda v: _poly(AS241_FAR[0], v) / _poly(AS241_FAR[1], v))
            return F.when(r <= 5.0, near).otherwise(far)

        return F.signum(q) * let(F.sqrt(-F.ln(0.5 - F.abs(q))), size)

    q = clip(col(p), clamp, 1 - clamp) - 0.5
    return let(q, lambda v: F.when(F.abs(v) <= 0.425, centre(v)).otherwise(tails(v)))


def loglogistic_cdf(x: ColumnLike, shape: ColumnLike, scale: ColumnLike) -> Column:
    x = col(x)
    return F.when(x > 0, 1 / (1 + F.pow(x / col(scale), -col(shape)))).when(x <= 0, F.lit(0.0))
