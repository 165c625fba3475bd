"""What the interval operators are given: keys, bounds and strictness."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = str


@dataclass(frozen=True)
class Bounds:
    """Start and end of an interval: column names. Ends are inclusive."""

    start: ColumnLike = "start"
    end: ColumnLike = "end"

    @classmethod
    def of(cls, bounds: Bounds | Sequence[ColumnLike]) -> Bounds:
        return bounds if isinstance(bounds, Bounds) else cls(*bounds)


def key_pairs(on: Sequence[str | tuple[ColumnLike, ColumnLike]] | None) -> list[tuple[ColumnLike, ColumnLike]]:
    return [(k, k) if isinstance(k, str) else tuple(k) for k in on or []]


def is_integral(df: DataFrame, *columns: Column) -> bool:
    kinds = [f.dataType for f in df.select(*columns).schema.fields]
    return all(isinstance(k, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) for k in kinds)


def floor_div(x: Column, size: int | float, integral: bool) -> Column:
    """Number of the bin of a position; exact for 64-bit integers, negative ones included."""
    if integral:
        z = F.lit(int(size)).cast("long")
        x = x.cast("long")
        # x - pmod(x, z) could leave the range at its low end, so divide first
        low = F.call_function("div", x, z)
        return low - F.when((x < 0) & (low * z != x), F.lit(1)).otherwise(F.lit(0))
    return F.floor(x / F.lit(float(size))).cast("long")
