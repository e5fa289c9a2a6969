"""Column expressions on closed integer intervals, closed boxes and exact power sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def overlaps(lo1, hi1, lo2, hi2, reach=0) -> Column:
    """Whether [lo1, hi1] and [lo2, hi2] meet once each end is moved out by ``reach`` in all."""
    return (c(hi1) >= c(lo2) - c(reach)) & (c(lo1) <= c(hi2) + c(reach))


def inside(inner: str, outer: str) -> Column:
    """Whether box ``inner``.(x0, y0, x1, y1) lies in ``outer``, borders included."""
    a, b = (lambda k: F.col(f"{inner}.{k}")), (lambda k: F.col(f"{outer}.{k}"))
    return (a("x0") >= b("x0")) & (a("y0") >= b("y0")) & (a("x1") <= b("x1")) & (a("y1") <= b("y1"))


def meets(a: str, b: str) -> Column:
    """Whether two boxes have a point in common, borders included."""
    return overlaps(f"{a}.x0", f"{a}.x1", f"{b}.x0", f"{b}.x1") & overlaps(f"{a}.y0", f"{a}.y1", f"{b}.y0", f"{b}.y1")


def gap(a: str, b: str) -> Column:
    """Distance of two boxes along the axis on which they are farther apart; 0 if they meet."""
    dx = F.greatest(F.col(f"{a}.x0") - F.col(f"{b}.x1"), F.col(f"{b}.x0") - F.col(f"{a}.x1"))
    dy = F.greatest(F.col(f"{a}.y0") - F.col(f"{b}.y1"), F.col(f"{b}.y0") - F.col(f"{a}.y1"))
    return F.greatest(F.lit(0), dx, dy)


def iou(a: str, b: str) -> Column:
    """Intersection over union of two closed boxes of whole pixels."""
    side = lambda p, q: F.greatest(F.lit(0), F.least(F.col(f"{a}.{q}"), F.col(f"{b}.{q}")) - F.greatest(F.col(f"{a}.{p}"), F.col(f"{b}.{p}")) + 1)
    size = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0") + 1) * (F.col(f"{t}.y1") - F.col(f"{t}.y0") + 1)
    both = side("x0", "x1") * side("y0", "y1")
    return both / (size(a) + size(b) - both)


def sum_range(lo, hi) -> Column:
    """lo + ... + hi."""
    lo, hi = c(lo).cast("long"), c(hi).cast("long")
    return F.shiftright((hi - lo + 1) * (lo + hi), 1)


def squares_range(lo, hi) -> Column:
    """lo**2 + ... + hi**2, in whole numbers, from the sums of powers below the length of the range."""
    lo, hi = c(lo).cast("long"), c(hi).cast("long")
    n = hi - lo + 1
    first = n * lo * lo + lo * n * (n - 1)
    rest = (n - 1) * n * (2 * n - 1)  # six times the sum of squares below n
    return first + F.call_function("div", rest, F.lit(6))
