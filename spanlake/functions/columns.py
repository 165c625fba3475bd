"""Column functions over interval bounds (inclusive ends)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.operators.overlap import overlaps

__all__ = ["overlaps", "overlap_length", "overlap_span", "interval_distance", "contains", "contains_point", "date_position", "time_position"]


def overlap_span(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """min(ends) - max(starts) of overlapping intervals, else null."""
    return F.when(overlaps(ls, le, rs, re), F.least(le, re) - F.greatest(ls, rs))


def overlap_length(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """Number of positions two intervals share; 0 if none."""
    return F.greatest(F.least(le, re) - F.greatest(ls, rs) + 1, F.lit(0))


def interval_distance(ls: Column, le: Column, rs: Column, re: Column) -> Column:
    """0 where intervals overlap, else how far the closer ends are apart."""
    return F.greatest(rs - le, ls - re, F.lit(0))


def contains(os: Column, oe: Column, s: Column, e: Column) -> Column:
    return (s >= os) & (e <= oe)


def contains_point(s: Column, e: Column, point: Column) -> Column:
    return (point >= s) & (point <= e)


def date_position(day: Column, origin: str = "1970-01-01") -> Column:
    """Days since origin, for intervals between dates."""
    return F.datediff(day, F.lit(origin).cast("date")).cast("long")


def time_position(ts: Column) -> Column:
    """Microseconds since 1970, for intervals between times."""
    return F.unix_micros(ts.cast("timestamp"))
