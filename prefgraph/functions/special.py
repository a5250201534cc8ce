"""Special functions as column expressions: log gamma, the regularised incomplete beta function, tails of Student's t."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series, B(2k) / (2k (2k - 1)).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
_SHIFT, _TINY = 8, 1e-300


def log_gamma(z: Column) -> Column:
    """Of positive z: Stirling's series at z + 8, less the factors between."""
    up = z + _SHIFT
    series = sum((F.lit(c) / F.pow(up, F.lit(2.0 * k + 1)) for k, c in enumerate(_STIRLING)), F.lit(0.0))
    between = F.lit(1.0)
    for k in range(_SHIFT):
        between = between * (z + k)
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - F.log(between)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's rule, as a fold with as many steps as the root of a and b asks for."""
    guard = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)
    steps = (40 + 6 * F.sqrt(F.greatest(a, b))).cast("int")

    def step(s, m):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / guard(1 + even * s["d"]), guard(1 + even / s["c"])
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # the second half of the step, spelt out with the first half's c and d
        d2, c2 = 1 / guard(1 + odd * d), guard(1 + odd / c)
        return F.struct(d2.alias("d"), c2.alias("c"), (s["h"] * d * c * d2 * c2).alias("h"))

    first = 1 / guard(1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), steps), lambda m: m.cast("double")), start, step, lambda s: s["h"])


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b > 0, 0 at x <= 0 and 1 at x >= 1."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    # both ends of the range by the same fraction, which is quick below the mean
    p, q, y = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(1 - x)
    part = front * _fraction(p, q, y) / p
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(low, part).otherwise(1 - part)


def t_two_sided(t: Column, df: Column) -> Column:
    """Share of Student's t at least as far from 0 as t."""
    df = df.cast("double")
    return beta_share(df / 2, F.lit(0.5), df / (df + t * t))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation r of n rows by t with n - 2 degrees; 0 at -1 and 1, null for fewer than three rows."""
    df = F.greatest(n - 2, F.lit(1)).cast("double")
    # df / (df + t^2) is 1 - r^2
    return F.when(n >= 3, F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(beta_share(df / 2, F.lit(0.5), (1 - r) * (1 + r))))
