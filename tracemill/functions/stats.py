"""Exact and interval statistics as column expressions; nothing leaves the JVM.

Every function defines its result for n = 0, as stated. Counts are longs, results doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def _d(c: Column) -> Column:
    return c.cast("double")


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of k of n; (0, 1) for n = 0."""
    k, m = _d(k), F.greatest(_d(n), F.lit(1.0))
    p = k / m
    mid = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    none = _d(n) <= 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(none, 1.0).otherwise(F.least(F.lit(1.0), mid + half))


def zero_upper(n: Column, alpha: float = 0.05) -> Column:
    """Exact upper bound of a rate of which none of n occurred; 1 for n = 0."""
    return F.when(_d(n) <= 0, 1.0).otherwise(1 - F.pow(F.lit(alpha / 2), 1 / F.greatest(_d(n), F.lit(1.0))))


def log_factorial(n: Column) -> Column:
    """ln n!, exact to about 1e-15 of its size: factorials up to 20, Stirling's series beyond. Constant work."""
    x = F.greatest(_d(n), F.lit(1.0)) + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.log(F.factorial(F.least(F.greatest(n, F.lit(0)), F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact McNemar p of the discordant counts; 1 for none.

    The binomial tail is summed from its largest term down; terms beyond some square roots of n add nothing to a
    double, so the work grows with the root of the counts.
    """
    n, k = (b + c).cast("long"), F.least(b, c).cast("long")
    top = F.exp(log_choose(n, k) - _d(n) * math.log(2))
    steps = F.least(k, F.ceil(4.5 * F.sqrt(_d(n))) + 60).cast("int")
    # from C(n, i) to C(n, i - 1); the sum goes with the running term
    total = F.aggregate(
        F.sequence(F.lit(0), steps), F.struct(top.alias("t"), F.lit(0.0).alias("s")),
        lambda a, j: F.struct((a["t"] * (k - j) / (n - k + j + 1)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def newcombe(e11: Column, e10: Column, e01: Column, e00: Column) -> tuple[Column, Column]:
    """Newcombe's interval of a paired difference, clipped to [-1, 1]; (0, 0) for n = 0."""
    n, a, b = e11 + e10 + e01 + e00, e11 + e10, e11 + e01
    m = F.greatest(_d(n), F.lit(1.0))
    p1, p2 = _d(a) / m, _d(b) / m
    (l1, u1), (l2, u2) = wilson(a, n), wilson(b, n)
    spread = _d(a) * _d(n - a) * _d(b) * _d(n - b)
    phi = F.when(spread > 0, (_d(e11) * _d(e00) - _d(e10) * _d(e01)) / F.sqrt(F.greatest(spread, F.lit(1e-300)))).otherwise(0.0)
    root = lambda x, y: F.sqrt(F.greatest(F.lit(0.0), x * x - 2 * phi * x * y + y * y))
    low, high = p1 - p2 - root(p1 - l1, u2 - p2), p1 - p2 + root(u1 - p1, p2 - l2)
    none = n == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(-1.0), low)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), high))


def fisher(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Two-sided Fisher p of two proportions: all tables that are no likelier than the observed one; 1 for an empty table.

    Only tables within some standard deviations of the likeliest and of the observed one are looked at, the others add
    nothing to a double; so the work grows with the root of the counts.
    """
    k1, n1, k2, n2 = (c.cast("long") for c in (k1, n1, k2, n2))
    k, n = k1 + k2, n1 + n2
    low, high = F.greatest(F.lit(0).cast("long"), k - n2), F.least(n1, k)
    safe = F.greatest(_d(n), F.lit(2.0))
    sd = F.sqrt(_d(k) / safe * _d(n1) / safe * _d(n2) * (_d(n) - _d(k)) / (safe - 1))
    mode = F.least(high, F.greatest(low, F.floor((_d(k) + 1) * (_d(n1) + 1) / (_d(n) + 2)).cast("long")))
    wide = (F.ceil(9 * sd) + 30).cast("long")
    near = lambda at: F.sequence(F.greatest(low, at - wide), F.least(high, at + wide))
    log_p = lambda x: log_choose(n1, x) + log_choose(n2, k - x) - log_choose(n, k)
    p = F.transform(F.array_union(near(mode), near(k1)), lambda x: F.exp(log_p(x)))
    seen = F.exp(log_p(k1))
    # equally likely tables differ by rounding, which grows with the counts
    total = F.aggregate(F.filter(p, lambda x: x <= seen * (1 + 1e-9 + 1e-14 * _d(n))), F.lit(0.0), lambda s, x: s + x)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), total))


def kappa(both: Column, first: Column, second: Column, n: Column) -> Column:
    """Cohen's kappa from counts of agreement, of the first's and of the second's yes; 0 for n = 0, 1 if chance is certain."""
    m = F.greatest(_d(n), F.lit(1.0))
    po, pe = _d(both) / m, (_d(first) / m) * (_d(second) / m) + (1 - _d(first) / m) * (1 - _d(second) / m)
    return F.when(n == 0, 0.0).when(pe >= 1, 1.0).otherwise((po - pe) / F.when(pe < 1, 1 - pe).otherwise(1.0))


def gwet_ac1(both: Column, first: Column, second: Column, n: Column) -> Column:
    """Gwet's AC1 from the same counts; 0 for n = 0."""
    m = F.greatest(_d(n), F.lit(1.0))
    q = (_d(first) + _d(second)) / (2 * m)
    pe = 2 * q * (1 - q)
    return F.when(n == 0, 0.0).otherwise((_d(both) / m - pe) / (1 - pe))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(_d(a), _d(b)), F.lit(0.0))


def format_p(p: Column) -> Column:
    """A p-value for a report: three places, or a power below 0.001."""
    return F.when(p < 0.001, F.format_string("%.1e", p)).otherwise(F.format_string("%.3f", p))
