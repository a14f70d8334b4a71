"""Tails of the t, F, chi-square and normal distributions, by regularised incomplete beta and gamma functions."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt

TINY = 1e-300


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > TINY else TINY)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > TINY else TINY), (c if abs(c) > TINY else TINY)
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1 / TINY
    d = 1 / b
    f = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = num * d + b
        d = 1 / (d if abs(d) > TINY else TINY)
        c = b + num / c
        c = c if abs(c) > TINY else TINY
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(x: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def inverse(tail, p: float, high: float = 1e6) -> float:
    """The x at which a falling tail function is p."""
    low = 0.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > p else (low, mid)
    return (low + high) / 2


def t_quantile(level: float, df: float) -> float:
    """The half width, in standard errors, of a two-sided interval of this level."""
    return inverse(lambda x: t_two_sided(x, df), 1 - level)


def normal_quantile(level: float) -> float:
    return inverse(normal_two_sided, 1 - level, 100.0)


def holm(p: list[float]) -> list[float]:
    """Step-down adjusted p values."""
    m, out, top = len(p), [0.0] * len(p), 0.0
    for k, i in enumerate(sorted(range(m), key=p.__getitem__)):
        top = max(top, min(1.0, (m - k) * p[i]))
        out[i] = top
    return out
