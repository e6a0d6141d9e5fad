"""Contingency statistics and scores as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable
from decimal import Context, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _high_low(x: Decimal) -> tuple[float, float]:
    """x as a multiple of 2 ** -40, of which sums are exact, and the rest."""
    high = math.floor(float(x) * 2.0**40) / 2.0**40
    return high, float(x - Decimal(high))


def _doubles(values: Iterable[float]) -> str:
    return f"array({', '.join(f'{x!r}D' for x in values)})"


_LOGS = [_high_low(Context(prec=40).ln(Decimal(j))) for j in range(127, 257)]
_LOG2 = _high_low(Context(prec=40).ln(Decimal(2)))
_SERIES = (4.18938533204672725052e-01, 8.33333333333329678849e-02, -2.77777777728775536470e-03, 7.93650558643019558500e-04, -5.95187557450339963135e-04, 8.36339918996282139126e-04, -1.63092934096575273989e-03)


def ln_whole(x: Column) -> Column:
    """ln of a whole number, the nearest double but for one in some thousand: x is a number of eight bits times 1 + r."""
    x = x.cast("double")
    highs, lows = (F.expr(_doubles(t[k] for t in _LOGS)) for k in (0, 1))

    def near(e: Column, unit: Column, j: Column) -> Column:
        at = j.cast("int") - 127
        return e * _LOG2[0] + F.get(highs, at) + (F.log1p((x - j * unit) / (j * unit)) + (e * _LOG2[1] + F.get(lows, at)))

    return _let(F.floor(F.log2(x)) - 7, lambda e: _let(F.pow(F.lit(2.0), e), lambda unit: _let(F.floor(x / unit), lambda j: near(e, unit, j))))


def log_gamma_sum(n: Column) -> Column:
    """ln(n!) as the C library's lgamma(n + 1) has it, digit by digit: logarithms of factorials, from 8 on a series.

    Of millions, ln(n!) has some hundreds of millions, so the last place of a sum of these is 1e-7 of a probability, which
    six digits show.  It must be rounded where the SQL's lgamma rounds.
    """
    small = F.get(F.expr(_doubles(math.log(math.factorial(k)) for k in range(7))), F.least(n, F.lit(6)).cast("int"))

    def series(x: Column, z: Column, y: Column) -> Column:
        rest = F.lit(_SERIES[6])
        for w in _SERIES[5:0:-1]:
            rest = w + y * rest
        return (x - 0.5) * (ln_whole(x) - 1) + (_SERIES[0] + z * rest)

    large = _let(F.greatest(n, F.lit(7)).cast("double") + 1, lambda x: _let(1 / x, lambda z: _let(z * z, lambda y: series(x, z, y))))
    return F.when(n <= 6, small).otherwise(large)


def _first(lo: Column, hi: Column, holds) -> Column:
    """The first whole number in lo..hi that holds, hi + 1 if none does; it holds for all that follow."""
    def halve(acc: Column, _: Column) -> Column:
        def cut(mid: Column) -> Column:
            return F.when(acc["lo"] >= acc["hi"], acc).when(holds(mid), F.struct(acc["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))

        return _let(F.floor((acc["lo"] + acc["hi"]) / 2), cut)

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(hi - lo + 2, F.lit(2)).cast("double"))).cast("int") + 1)
    return F.aggregate(steps, F.struct(lo.alias("lo"), (hi + 1).alias("hi")), halve, lambda acc: acc["lo"])


TAIL = 42.0  # terms below exp(-42) of a tail's first one add nothing to a double


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of the table (a, b, c, d): the sum of all probabilities that are not above the observed one.

    The probabilities rise to the mode and fall behind it, so they form two tails, whose ends at the mode are found by
    bisection of the logarithms, with some slack: each term's own probability decides, as in the SQL.  The second
    difference of the logarithms bounds how far a tail reaches above TAIL: some standard deviations, not the margin.
    A zero margin gives 1.
    """
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    lf, zero = log_gamma_sum, F.lit(0).cast("long")
    at = lambda array, k: F.get(array, F.lit(k))
    table = F.struct(a.alias("a"), (a + b).alias("r1"), (c + d).alias("r2"), (a + c).alias("c1"), (b + d).alias("c2"))

    def summed(t: Column, g: Column) -> Column:
        r1, r2, c1, lo, hi, mode = t["r1"], t["r2"], t["c1"], g["lo"], g["hi"], g["mode"]
        # one after the other, as the SQL takes them
        log_p = lambda x: _let(F.transform(F.array(x, r1 - x, c1 - x, r2 - c1 + x), lf), lambda f: g["base"] - at(f, 0) - at(f, 1) - at(f, 2) - at(f, 3))
        over = lambda *sizes: sum(((1.0 / F.greatest(x, F.lit(1))) for x in sizes[1:]), 1.0 / F.greatest(sizes[0], F.lit(1)))

        def tail(most: Column, bend: Column, place, p0: Column) -> Column:
            count = F.least(most, F.ceil(F.sqrt(F.lit(2 * TAIL) / bend)) + 1)
            step = lambda acc, j: acc + _let(F.exp(log_p(place(j))), lambda p: F.when(p <= p0 * (1 + 1e-7), p).otherwise(0.0))
            return F.when(most > 0, F.aggregate(F.sequence(zero, F.greatest(count, F.lit(1)) - 1), F.lit(0.0), step)).otherwise(0.0)

        def both(s: Column) -> Column:
            limit, p0 = s + (1e-6 + (r1 + r2) * 1e-13), F.exp(s)
            before = _let(_first(lo, mode, lambda x: log_p(x) > limit) - 1, lambda x: tail(x - lo + 1, over(x, r2 - c1 + x, r1, c1), lambda j: x - j, p0))
            behind = _let(_first(mode + 1, hi, lambda x: log_p(x) <= limit), lambda x: tail(hi - x + 1, over(r1 - x, c1 - x, hi, r2 - c1 + hi), lambda j: x + j, p0))
            return F.least(F.lit(1.0), before + behind)

        return _let(log_p(t["a"]), both)

    def bounds(t: Column) -> Column:
        n, hi = t["r1"] + t["r2"], F.least(t["r1"], t["c1"])
        lo = F.greatest(zero, t["c1"] - t["r2"])
        mode = F.greatest(lo, F.least(hi, F.floor((t["r1"] + 1) * ((t["c1"] + 1) / (n + 2)))))
        base = _let(F.transform(F.array(t["r1"], t["r2"], t["c1"], t["c2"], n), lf), lambda f: at(f, 0) + at(f, 1) + at(f, 2) + at(f, 3) - at(f, 4))
        return _let(F.struct(lo.alias("lo"), hi.alias("hi"), mode.alias("mode"), base.alias("base")), lambda g: summed(t, g))

    return F.when((a + b == 0) | (c + d == 0) | (a + c == 0) | (b + d == 0), F.lit(1.0)).otherwise(_let(table, bounds))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    top, low = (a * d).cast("double"), (b * c).cast("double")
    empty = (a + b == 0) | (c + d == 0) | (a + c == 0) | (b + d == 0)
    return F.when(empty, 0.0).when(low == 0, float("inf")).otherwise(F.try_divide(top, low))


def lift(a: Column, b: Column, c: Column, d: Column) -> Column:
    """P(bad | factor) / P(bad); null without factor rows or bad rows."""
    return F.try_divide(F.try_divide(a.cast("double"), a + b), F.try_divide((a + c).cast("double"), a + b + c + d))


def rounded(x: Column | str, digits: int) -> Column:
    """Rounded as DuckDB does: the product with the power of ten, as a double, goes to the next whole number.

    Spark's round works on the shortest decimal text, so it lifts 0.72625, whose product is 7262.499…, to 0.7263.
    """
    x, scale = F.col(x) if isinstance(x, str) else x, float(10**digits)
    return F.when(F.abs(x) * scale < 2.0**52, F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale).otherwise(x)


def min_max(value: str, *keys: str) -> Column:
    """Value scaled to 0..1 within its group, 0.5 if all are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi - lo < 1e-9, 0.5).otherwise((F.col(value) - lo) / (hi - lo))


def triangular_cdf(x: Column, a: float = 0.75, m: float = 1.0, b: float = 1.5) -> Column:
    rise = (x - a) * (x - a) / ((b - a) * (m - a))
    fall = 1 - (b - x) * (b - x) / ((b - a) * (b - m))
    return F.when(x <= a, 0.0).when(x >= b, 1.0).when(x < m, rise).otherwise(fall)


def triangular_excess(c: Column, a: float = 0.75, m: float = 1.0, b: float = 1.5) -> Column:
    """E[max(0, T - c)]."""
    mean = (a + m + b) / 3
    left = c - a
    rest = b - c
    return F.when(c <= a, mean - c).when(c >= b, 0.0).when(c < m, mean - c + left * left * left / (3 * (b - a) * (m - a))).otherwise(rest * rest * rest / (3 * (b - a) * (b - m)))


def triangular_quantile(u: Column, a: float = 0.75, m: float = 1.0, b: float = 1.5) -> Column:
    cut = (m - a) / (b - a)
    return F.when(u < cut, a + F.sqrt(u * ((b - a) * (m - a)))).otherwise(b - F.sqrt((1 - u) * ((b - a) * (b - m))))


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Micro precision, recall and F1 of sets held in two array columns."""
    tp = F.sum(F.size(F.array_intersect(expected, predicted)))
    fp = F.sum(F.size(F.array_except(predicted, expected)))
    fn = F.sum(F.size(F.array_except(expected, predicted)))
    exact = F.avg((F.array_sort(F.array_distinct(expected)) == F.array_sort(F.array_distinct(predicted))).cast("double"))
    hit = F.avg(((F.size(expected) == 0) & (F.size(predicted) == 0) | F.arrays_overlap(expected, predicted)).cast("double"))
    return _micro(rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), exact.alias("exact"), hit.alias("hit")))


def counted_confusion(rows: DataFrame, expected: str, predicted: str, both: str) -> DataFrame:
    """confusion() of sets of which only the sizes, and that of what they share, are known."""
    e, g, k = F.col(expected), F.col(predicted), F.col(both)
    exact = F.avg(((k == e) & (k == g)).cast("double"))
    hit = F.avg(((k > 0) | (e == 0) & (g == 0)).cast("double"))
    return _micro(rows.agg(F.sum(k).alias("tp"), F.sum(g - k).alias("fp"), F.sum(e - k).alias("fn"), exact.alias("exact"), hit.alias("hit")))


def _micro(out: DataFrame) -> DataFrame:
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    out = out.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
