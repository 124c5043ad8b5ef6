"""Resampling statistics as column expressions, with a hash as the source of randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most differences of an exact sign-flip test: each half of them has up to 2^20 sums.
EXACT_LIMIT = 40
ALPHA = 0.05


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5; the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _all_sums(half: Column) -> Column:
    """The sums of an array under all patterns of signs."""
    return F.aggregate(half, F.array(F.lit(0.0)), lambda sums, x: F.concat(F.transform(sums, lambda s: s + x), F.transform(sums, lambda s: s - x)))


def _patterns_reaching(d: Column, goal: Column) -> Column:
    """How many of the 2^n patterns of signs have a sum of at least ``goal``: each sum of one half meets those of the other that suffice, counted along one sorted array of both."""
    middle = F.floor(F.size(d) / 2).cast("int")
    asks = F.transform(_all_sums(F.slice(d, F.lit(1), middle)), lambda s: F.struct((s - goal).alias("x"), F.lit(1).cast("long").alias("asks")))
    gives = F.transform(_all_sums(F.slice(d, middle + 1, F.size(d))), lambda s: F.struct((-s).alias("x"), F.lit(0).cast("long").alias("asks")))
    none = F.lit(0).cast("long")
    start = F.struct(none.alias("met"), none.alias("n"))
    step = lambda a, e: F.struct((a["met"] + 1 - e["asks"]).alias("met"), (a["n"] + e["asks"] * a["met"]).alias("n"))
    return F.aggregate(F.array_sort(F.concat(gives, asks)), start, step, lambda a: a["n"])


def _drawn_sum(d: Column, draw: Column) -> Column:
    """The sum of an array under the signs of one draw: the bits of a hash stand for 128 of them."""
    hashes = F.transform(F.sequence(F.lit(0), F.floor((F.size(d) - 1) / 128).cast("int")), lambda k: F.md5(F.concat_ws(":", F.lit("42"), draw.cast("string"), k.cast("string"))))
    digits = F.array_join(hashes, "")
    bit = lambda i: F.floor(F.conv(F.substring(digits, F.floor(i / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int") / F.pow(F.lit(2), 3 - i % 4)).cast("int") % 2
    return _sum(F.transform(d, lambda x, i: F.when(bit(i) == 1, x).otherwise(-x)))


def sign_flip_p(diffs: str, draws: int = 100_000) -> Column:
    """Two-sided p of the mean of an array column under random signs; zeros are left out, null if none is left.

    Up to EXACT_LIMIT differences all 2^n patterns count, by way of the 2^(n/2) sums of each half; beyond it ``draws`` hashed ones. Sums that
    fall short of the observed one by less than n * 1e-12 reach it.
    """

    def test(d: Column) -> Column:
        n = F.size(d)
        goal = F.abs(_sum(d)) - n * F.lit(1e-12)
        exact = F.least(F.lit(1.0), 2 * let(goal, lambda g: _patterns_reaching(d, g)) / F.pow(F.lit(2.0), n))
        hits = F.aggregate(F.sequence(F.lit(1), F.lit(draws)), F.lit(0).cast("long"), lambda k, m: k + F.when(F.abs(_drawn_sum(d, m)) >= goal, 1).otherwise(0))
        return F.when(n > 0, F.when(n <= EXACT_LIMIT, exact).otherwise(hits / F.lit(float(draws))))

    return let(F.filter(F.transform(diffs, lambda x: x.cast("double")), lambda x: x != 0), test)


def bootstrap_means(values: str, resamples: int = 2000, least: int = 3) -> Column:
    """The means of all n^n resamples of an array column (n up to 5), or of ``resamples`` hashed ones; null under ``least`` values."""
    return F.expr(f"""
    CASE WHEN size({values}) < {least} THEN NULL
    WHEN size({values}) <= 5 THEN transform(sequence(0, cast(pow(size({values}), size({values})) AS int) - 1),
      m -> aggregate(transform({values}, (x, i) -> {values}[cast(floor(m / pow(size({values}), i)) AS int) % size({values})]), 0D, (s, x) -> s + x) / size({values}))
    ELSE transform(sequence(1, {resamples}),
      m -> aggregate(transform({values}, (x, i) -> {values}[cast(floor(conv(substr(md5(concat_ws(':', '42', m, i)), 1, 8), 16, 10) / 4294967296D * size({values})) AS int)]), 0D, (s, x) -> s + x) / size({values}))
    END""")


def percentile_interval(means: Column, level: float = 0.95) -> tuple[Column, Column]:
    """(low, high) by the inverse of the distribution function; three values give their extremes."""
    ordered, n = F.array_sort(means), F.size(means)
    at = lambda q: F.element_at(ordered, F.greatest(F.lit(1), F.ceil(n * F.lit(q) - 1e-9)).cast("int"))
    return at((1 - level) / 2), at((1 + level) / 2)


#: Coefficients of a rational approximation of the normal law's quantiles (relative error 1.2e-9), for the middle and for the tails below TAIL.
MIDDLE = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
MIDDLE_BELOW = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
OUTER = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
OUTER_BELOW = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The number below which a standard normal one lies with probability ``p``; null at 0 and 1."""

    def of(p: Column) -> Column:
        q = p - 0.5
        tail = let(F.sqrt(-2 * F.log(F.least(p, 1 - p))), lambda t: _polynomial(OUTER, t) / _polynomial(OUTER_BELOW, t))
        middle = let(q * q, lambda r: q * _polynomial(MIDDLE, r) / _polynomial(MIDDLE_BELOW, r))
        return F.when((p > 0) & (p < 1), F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(middle))

    return let(p, of)


def normal_share(x: Column) -> Column:
    """The probability that a standard normal number lies below ``x``: the series of odd powers over odd factorials up to the 161st, beyond 7 the limits."""

    def of(x: Column) -> Column:
        series = let(x * x, lambda square: F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, k: 1 + square / (2 * k + 1) * s))
        return F.when(x < -7, 0.0).when(x > 7, 1.0).otherwise(0.5 + F.exp(-x * x / 2) / F.sqrt(2 * F.pi()) * x * series)

    return let(x, of)
