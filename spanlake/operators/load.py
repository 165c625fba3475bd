"""How rows are dealt over keys, found before a plan is chosen: whether keys alone are enough to deal a table out.

Where no key is crowded, rows are dealt by their keys once, and running values, lists and comparisons stay within a key.
Else keys are cut into bins of positions, at the price of more shuffles. Both give the same results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.operators import bins

#: Cells to which keys are hashed; comparisons a row may have on average, and a cell at most, where rows are compared within keys.
CELLS, EACH, CELL_PAIRS = 1 << 16, 64, 1e8


@dataclass(frozen=True)
class Load:
    """Rows of both sides, rows of the largest cell, pairs of equal keys (estimated), those of the largest cell, largest position."""

    left: int
    right: int
    most: int
    pairs: float
    cell_pairs: float
    far: float = float("inf")

    @property
    def even(self) -> bool:
        """No key is crowded: the rows of any fit one task."""
        return self.most <= max(10 * bins.FEW, 8 * (self.left + self.right) // CELLS)

    @property
    def few_pairs(self) -> bool:
        """Rows can be compared with all of their key."""
        return self.even and self.pairs <= EACH * (self.left + self.right) and self.cell_pairs <= CELL_PAIRS


def cell_of(left: DataFrame, right: DataFrame, lkeys: Sequence[Column], rkeys: Sequence[Column]) -> tuple[Column, Column]:
    """The cell of a row of either side; equal keys have one cell, also where their types differ."""
    l0, r0 = left.select(*lkeys).schema.fields, right.select(*rkeys).schema.fields
    kinds = [None if a.dataType == b.dataType else "double" if isinstance(a.dataType, T.NumericType) and isinstance(b.dataType, T.NumericType) else "string" for a, b in zip(l0, r0)]
    return tuple(F.pmod(F.xxhash64(*[k if t is None else k.cast(t) for k, t in zip(keys, kinds)]), F.lit(CELLS)).cast("int") for keys in (lkeys, rkeys))


def cells(left: DataFrame, right: DataFrame, lkeys: Sequence[Column], rkeys: Sequence[Column], lfar: Column | None = None, rfar: Column | None = None) -> DataFrame:
    """__cell with the rows of both sides (__l, __r) whose keys hash to it, and the largest of lfar and rfar (__far)."""
    at = cell_of(left, right, lkeys, rkeys)
    one = [df.select(c.alias("__cell"), F.lit(n).alias("l"), F.lit(m).alias("r"), (F.lit(0) if x is None else x).cast("double").alias("__far")) for df, c, n, m, x in ((left, at[0], 1, 0, lfar), (right, at[1], 0, 1, rfar))]
    return one[0].union(one[1]).groupBy("__cell").agg(F.sum("l").alias("__l"), F.sum("r").alias("__r"), F.max("__far").alias("__far"))


def load(left: DataFrame, right: DataFrame, lkeys: Sequence[Column], rkeys: Sequence[Column], lfar: Column | None = None, rfar: Column | None = None) -> Load:
    """One pass over the keys (and bounds, if given) of both sides.

    Pairs are estimated from the cells: the sum of the products of their rows, less what keys that only share a cell add on average."""
    found = cells(left, right, lkeys, rkeys, lfar, rfar)
    product = F.col("__l").cast("double") * F.col("__r")
    got = found.agg(F.sum("__l").alias("l"), F.sum("__r").alias("r"), F.max(F.col("__l") + F.col("__r")).alias("most"), F.sum(product).alias("pairs"), F.max(product).alias("cell"), F.max("__far").alias("far")).first()
    n, m = got.l or 0, got.r or 0
    return Load(n, m, got.most or 0, max(0.0, (got.pairs or 0) - n * m / CELLS) / (1 - 1 / CELLS), got.cell or 0, got.far or 0.0)
