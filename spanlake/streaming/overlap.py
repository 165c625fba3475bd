"""Overlap joins of a stream with a table: the same bins, in append mode, without state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators.overlap import Binning, overlap_join
from spanlake.operators.spec import Bounds, ColumnLike


def stream_overlap(stream: DataFrame, table: DataFrame, on: Sequence[str | tuple[ColumnLike, ColumnLike]] | None = None, stream_bounds: Bounds | Sequence[ColumnLike] = ("start", "end"), table_bounds: Bounds | Sequence[ColumnLike] = ("start", "end"), size: int = 1000, levels: int = 4, **options) -> DataFrame:
    """Pairs of new stream rows and the table's rows; every micro-batch is one binned join.

    Lengths of a stream can't be looked at beforehand, so the lowest bin width and the number of levels are given;
    longer intervals than size * 16 ** (levels - 1) are right too, only listed in more bins."""
    return overlap_join(stream, table, on, stream_bounds, table_bounds, "inner", binning=Binning(size, levels), **options)


def windowed_overlaps(stream: DataFrame, table: DataFrame, on: Sequence[str | tuple[ColumnLike, ColumnLike]] | None = None, stream_bounds: Bounds | Sequence[ColumnLike] = ("start", "end"), table_bounds: Bounds | Sequence[ColumnLike] = ("start", "end"), time: str = "ts", window: str = "1 hour", slide: str | None = None, late: str = "1 hour", by: Sequence[str] = (), **options) -> DataFrame:
    """Number of overlapping pairs (n) for each window of the stream's time and each value of by (columns l_..., r_...).

    Rows that are later than the watermark are dropped by it; what is held is a number a window and value."""
    met = stream_overlap(stream.withWatermark(time, late), table, on, stream_bounds, table_bounds, **options)
    kept = met.groupBy(F.window(f"l_{time}", window, slide).alias("window"), *by).agg(F.count("*").alias("n"))
    return kept.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c.replace("`", "") for c in by], "n")
