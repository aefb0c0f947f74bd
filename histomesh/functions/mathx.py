"""Tail probabilities as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart (1968), algorithm 5666 for the normal tail, from the highest power down.
P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SPLIT, ROOT = 7.0711, 2.506628274631


def horner(x: Column, coefficients) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_sf(z: Column) -> Column:
    """P(Z > z) of a standard normal for z >= 0."""
    e = F.exp(-z * z / 2)
    tail = z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + F.lit(0.65)))))
    return F.when(z < SPLIT, e * horner(z, P) / horner(z, Q)).otherwise(e / (tail * ROOT))


def two_sided(z: Column) -> Column:
    return 2 * normal_sf(F.abs(z))


def two_sided_sql(z: str) -> str:
    """The same for SQL text."""
    a = f"abs({z})"
    poly = lambda cs: reduce(lambda acc, c: f"({acc} * {a} + {c})", map(str, cs[1:]), str(cs[0]))
    e = f"exp(-({z}) * ({z}) / 2)"
    return f"2 * (case when {a} < {SPLIT} then {e} * {poly(P)} / {poly(Q)} else {e} / (({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) * {ROOT}) end)"


def chi2_sf(x: float, df: int) -> float:
    """P(X > x) of chi-square, by the regularised incomplete gamma function (series below the mean, continued fraction above)."""
    import math

    if x <= 0 or df <= 0:
        return 1.0
    a, h = df / 2, x / 2
    scale = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= h / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = h + 1 - a
    c, d = 1 / tiny, 1 / b
    f = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        f *= (step := d * c)
        if abs(step - 1) < 1e-15:
            break
    return min(1.0, scale * f)
