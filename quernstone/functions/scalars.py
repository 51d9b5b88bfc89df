"""Row-local expressions: rounding, piecewise utilities, array aggregates, text and date helpers. All stay in the JVM."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, digits: int) -> Column:
    """Scale, round half to even, unscale: NumPy's rule (``round``/``bround`` go through decimal text)."""
    s = 10.0**digits
    return F.rint(c * s) / s


def half_away(c: Column, digits: int) -> Column:
    """Scale, round half away from zero, unscale: SQL's rule for doubles (``round`` to digits goes through decimal text)."""
    s = 10.0**digits
    return F.round(c * s, 0) / s


def finite(c: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def any_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions)


def sum_ignoring_nulls(columns: Sequence[Column]) -> Column:
    """Nulls count as 0; all null gives 0."""
    return functools.reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])


def spectral(values: Column, decay: float = 0.45) -> Column:
    """Mean of the values in descending order with weights exp(-decay * position)."""
    ordered = F.sort_array(values, asc=False)
    weight = lambda i: F.exp(-decay * i)
    add = lambda a, b: a + b
    top = F.aggregate(F.transform(ordered, lambda v, i: v * weight(i)), F.lit(0.0), add)
    below = F.aggregate(F.transform(ordered, lambda v, i: weight(i)), F.lit(0.0), add)
    return F.when(F.size(values) > 0, top / below)


def worst_mean(values: Column, share: float = 0.25) -> Column:
    """Mean of the highest ``ceil(share * n)`` values."""
    k = F.ceil(F.size(values) * share).cast("int")
    worst = F.slice(F.sort_array(values, asc=False), F.lit(1), F.greatest(k, F.lit(1)))
    return F.when(F.size(values) > 0, F.aggregate(worst, F.lit(0.0), lambda a, b: a + b) / k)


def power_mean(values: Column, power: float = 4.0) -> Column:
    """100 * (mean of (v / 100) ** power) ** (1 / power)."""
    total = F.aggregate(F.transform(values, lambda v: F.pow(v / 100.0, F.lit(power))), F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(values) > 0, 100.0 * F.pow(total / F.size(values), F.lit(1.0 / power)))


def median_of_three(a: Column, b: Column, c: Column) -> Column:
    return F.sort_array(F.array(a, b, c))[1]


def knot_utility(v: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through (value, utility), flat outside; null stays null."""
    (x0, y0), (xn, yn) = knots[0], knots[-1]
    out = F.when(v.isNull(), None).when(v <= x0, F.lit(float(y0))).when(v >= xn, F.lit(float(yn)))
    for (xa, ya), (xb, yb) in zip(knots[:-1], knots[1:], strict=True):
        out = out.when(v <= xb, ya + (v - xa) * (yb - ya) / (xb - xa))
    return out


def linear_clamp(v: Column, low: float, high: float) -> Column:
    return F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low))))


def weighted_utility(parts: Sequence[tuple[Column, float]]) -> Column:
    """Sum of weight times utility in the given order; null if any part is."""
    return functools.reduce(lambda a, b: a + b, [c * w for c, w in parts])


def class_bin(v: Column, width: float, low: float, bins: int) -> Column:
    """Equal-width class 0 .. bins - 1, clamped."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((v - low) / width))).cast("int")


def zfill(c: Column, width: int) -> Column:
    """Pad with zeros; longer input stays whole (``lpad`` alone would cut it)."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def month_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def overlaps(begin: Column, end: Column, low: Column, high: Column) -> Column:
    """Closed intervals meet; a null end is open."""
    return (begin <= high) & (end.isNull() | (end >= low))


def stale(month: Column, today: Column, days: int = 62) -> Column:
    """``today`` lies more than ``days`` after the end of the month ``yyyy-MM``."""
    return today > F.date_add(F.last_day(F.to_date(F.concat(month, F.lit("-01")))), days)


def window_cells(radius: float, cell: float) -> int:
    """Odd width, in cells, of the square with the area of a circle."""
    return max(1, math.floor(math.sqrt(math.pi) * radius / cell / 2) * 2 + 1)
