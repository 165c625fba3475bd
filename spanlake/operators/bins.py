"""Bins of positions by quantiles: about equally many positions in each, wherever they lie."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins at most, and positions a bin has at least, about. Bounds are a list of this length, whatever the rows.
MOST, FEW = 1024, 20_000


def quantile_bins(positions: Sequence[tuple[DataFrame, Column]], most: int | None = None, few: int | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """A function that adds __b, the bin of a position, to a table: in the order of positions, equal ones in one bin.

    Bounds are approximate quantiles of all positions given, found in one pass over these columns. Positions
    beyond any range, infinite or NaN ones have bins too. Bins are told on doubles, which keeps the order of
    64-bit integers: two that are one double are in one bin."""
    most, few = most or MOST, few or FEW
    every = reduce(DataFrame.unionByName, [df.select(p.cast("double").alias("p")) for df, p in positions])
    cuts = ", ".join(f"{i / most}D" for i in range(1, most))
    got = every.agg(F.count("p").alias("n"), F.expr(f"percentile_approx(p, array({cuts}), {5 * most})").alias("q")).first()
    step = max(1, -(-most * few // max(got.n, 1)))  # fewer bounds for few positions
    cuts = sorted({q for q in (got.q or [])[step - 1 :: step] if isfinite(q)})
    if not cuts:
        return lambda df, pos: df.withColumn("__b", F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]

    def add(df: DataFrame, pos: str) -> DataFrame:
        made = Bucketizer(splits=splits, inputCol="__bp", outputCol="__b", handleInvalid="keep")
        return made.transform(df.withColumn("__bp", F.col(pos).cast("double"))).drop("__bp")

    return add
