"""Date and time expressions whose meaning differs between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units counted by their length in microseconds.
_LENGTH = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def datediff_boundary(unit: str, start: Column, end: Column) -> Column:
    """How many boundaries of `unit` lie between two instants (UTC session); null if either is null.

    10:59 to 11:01 crosses one hour boundary, though two minutes pass.
    """
    unit = unit.lower()
    if unit == "month":
        return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)).cast("long")
    if unit == "year":
        return (F.year(end) - F.year(start)).cast("long")
    n = F.lit(_LENGTH[unit])
    floor = lambda c: (_micros(c) - F.pmod(_micros(c), n)) / n
    return (floor(end) - floor(start)).cast("long")


def date_key(c: Column) -> Column:
    """yyyyMMdd as an integer."""
    return (F.year(c) * 10_000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def ratio(a: Column, b: Column, scale: float = 1.0, digits: int | None = None) -> Column:
    """scale * a / b as a double, null where b is 0 or null; rounded half up to digits."""
    out = F.lit(float(scale)) * a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    return out if digits is None else F.round(out, digits)
