"""Upper tails of two distributions, without further libraries."""

from __future__ import annotations

import math


def normal_tail(x: float) -> float:
    """P(Z > x) of a standard normal."""
    return 0.5 * math.erfc(x / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) of a chi-square with `df` degrees of freedom: the regularised
    upper incomplete gamma function, by its series below a + 1 and by a
    continued fraction (Lentz) above."""
    if df <= 0 or x != x:
        return math.nan
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return 1 - front * total
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h
