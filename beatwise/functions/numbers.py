"""Number rules: half-up rounding, numeric prefixes, quantile ranks."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half toward plus infinity (also for negatives), as double."""
    scale = 10.0 ** digits
    return F.floor(x * scale + 0.5).cast("double") / scale


def six(x: Column) -> Column:
    """Report rounding of a double."""
    return F.round(x, 6)


def float_prefix(text: Column) -> Column:
    """The number a text starts with (``33.5N`` gives 33.5), null when there is none."""
    head = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return head.try_cast("double")


def int_prefix(text: Column) -> Column:
    """The whole number a text starts with, null when there is none."""
    head = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return head.try_cast("bigint")


def nearest_rank(q: float, n: Column) -> Column:
    """0-based position of the q quantile among n sorted values."""
    return F.least(n - 1, F.greatest(F.lit(0), F.floor((n - 1) * F.lit(q) + 0.5))).cast("bigint")


def stepped(x: Column, steps: list[tuple[float, float]], otherwise: float = 0.0) -> Column:
    """Points by the first limit that x does not exceed."""
    out = None
    for limit, points in steps:
        cond = x <= F.lit(limit)
        out = F.when(cond, F.lit(points)) if out is None else out.when(cond, F.lit(points))
    return out.otherwise(F.lit(otherwise))
