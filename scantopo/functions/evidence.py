"""Measured facts as text: what was compared with what, in three significant digits; predicates on lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def general(value: Column, digits: int = 3) -> Column:
    """A number in ``digits`` significant digits, without closing zeros; with an exponent under -4 or of ``digits`` and more.

    Rounded from the exact binary value, a tie to the even digit, as C does: Java's formatter rounds the shortest decimal
    digits, which may stand on the other side of a half."""

    def write(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else format(v, f".{digits}g") for v in values.to_pylist()], pa.string())

    return F.arrow_udf(write, "string")(value.cast("double"))


def fact(name: str, value: Column, test: str, threshold: Column, whole: bool = False) -> Column:
    """``name value test threshold``; null where the value wasn't measured. Whole numbers are written as they are."""
    write = (lambda c: c.cast("string")) if whole else general
    return F.concat_ws(" ", F.lit(name), write(value), F.lit(test), write(threshold), F.when(value.isNull(), F.lit(None)))


def because(*facts: tuple[Column, Column]) -> Column:
    """The facts (condition under which one counts, fact) that count, in order."""
    return F.array_compact(F.array(*[F.when(on, f) for on, f in facts]))


def is_horizontal(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """At least as wide as tall: a point and a diagonal are."""
    return F.abs(x1 - x0) >= F.abs(y1 - y0)


def at_border(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: float = 0.025) -> Column:
    """Whether a line comes within ``margin`` of the page's side to an edge of it."""
    mx, my = width * margin, height * margin
    return (F.least(x0, x1) <= mx) | (F.greatest(x0, x1) >= width - mx) | (F.least(y0, y1) <= my) | (F.greatest(y0, y1) >= height - my)
