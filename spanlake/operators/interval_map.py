"""The interval-map interface over a DataFrame: built from arrays or rows, asked for one interval or for a table of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators.counting import count_overlaps, coverage_sum, has_overlap
from spanlake.operators.search import search_arrays, with_index


class IntervalMap:
    """Intervals (start, end, value) with inclusive ends, in the order of start, then end descending.

    Single questions are filters on two columns, which Parquet statistics help with; the batch forms are joins of
    whole tables. Nothing is collected but the answers to single questions."""

    def __init__(self, df: DataFrame, start: str = "start", end: str = "end", value: str | None = "value"):
        self.df = df.select(F.col(f"`{start}`").alias("start"), F.col(f"`{end}`").alias("end"), (F.col(f"`{value}`") if value in df.columns else F.lit(None).cast("long")).alias("value"))
        self.spark = df.sparkSession

    @classmethod
    def from_arrays(cls, spark: SparkSession, starts: Sequence[int], ends: Sequence[int], values: Sequence | None = None) -> IntervalMap:
        if len(starts) != len(ends) or values is not None and len(values) != len(starts):
            raise ValueError("arrays differ in length")
        kind = "string" if values is not None and any(isinstance(v, str) for v in values) else "double" if values is not None and any(isinstance(v, float) for v in values) else "long"
        return cls(spark.createDataFrame(list(zip(starts, ends, values if values is not None else [None] * len(starts))), f"start long, end long, value {kind}"))

    def add(self, start: int, end: int, value=None) -> IntervalMap:
        """A map with one interval more."""
        row = self.spark.createDataFrame([(start, end, value)], self.df.schema)
        return IntervalMap(self.df.union(row))

    def clear(self) -> IntervalMap:
        return IntervalMap(self.df.limit(0))

    def size(self) -> int:
        return self.df.count()

    def sorted(self) -> DataFrame:
        return self.df.orderBy(F.asc("start"), F.desc("end"))

    def indexed(self) -> DataFrame:
        return with_index(self.df)

    def at(self, index: int) -> tuple:
        return tuple(self.indexed().filter(F.col("idx") == index).select("start", "end", "value").first())

    def _met(self, start: int, end: int) -> DataFrame:
        return self.df.filter((F.col("start") <= end) & (F.col("end") >= start))

    def has_overlaps(self, start: int, end: int) -> bool:
        return bool(self._met(start, end).limit(1).count())

    def count(self, start: int, end: int) -> int:
        return self._met(start, end).count()

    def search_items(self, start: int, end: int) -> list[tuple]:
        return [tuple(r) for r in self._met(start, end).orderBy(F.asc("start"), F.desc("end"), "value").collect()]

    def search_keys(self, start: int, end: int) -> list[tuple]:
        return [r[:2] for r in self.search_items(start, end)]

    def search_values(self, start: int, end: int) -> list:
        return [r[2] for r in self.search_items(start, end)]

    def search_idxs(self, start: int, end: int) -> list[int]:
        return [r.idx for r in self.indexed().filter((F.col("start") <= end) & (F.col("end") >= start)).orderBy("idx").collect()]

    def search_iter(self, start: int, end: int) -> Iterator[tuple]:
        """Items one after another, without holding them all."""
        for r in self._met(start, end).orderBy(F.asc("start"), F.desc("end")).toLocalIterator():
            yield tuple(r)

    def search_point(self, point: int) -> list:
        return self.search_values(point, point)

    def idxs_iter(self, start: int, end: int) -> Iterator[int]:
        for r in self.indexed().filter((F.col("start") <= end) & (F.col("end") >= start)).orderBy("idx").toLocalIterator():
            yield r.idx

    def keys_iter(self, start: int, end: int) -> Iterator[tuple]:
        return (r[:2] for r in self.search_iter(start, end))

    def values_iter(self, start: int, end: int) -> Iterator:
        return (r[2] for r in self.search_iter(start, end))

    def coverage(self, start: int, end: int) -> tuple[int, int]:
        """Number of overlaps and the sum of min(ends) - max(starts)."""
        r = self._met(start, end).agg(F.count("*").alias("n"), F.sum(F.least("end", F.lit(end)) - F.greatest("start", F.lit(start))).alias("s")).first()
        return r.n, r.s or 0

    def count_batch(self, queries: DataFrame) -> DataFrame:
        return count_overlaps(queries, self.df, name="count")

    def has_overlaps_batch(self, queries: DataFrame) -> DataFrame:
        return has_overlap(queries, self.df)

    def coverage_batch(self, queries: DataFrame) -> DataFrame:
        return coverage_sum(queries, self.df)

    def search_batch(self, queries: DataFrame, what: str = "values") -> DataFrame:
        """what: values, idxs, keys or items."""
        return search_arrays(queries, self.df, value="value", what=what)

    # names of older interfaces
    findOverlaps = search_values
    anyOverlaps = has_overlaps
    countOverlaps = count
    findIndexes = search_idxs
    findKeys = search_keys
    findItems = search_items
    findStabbed = search_point
