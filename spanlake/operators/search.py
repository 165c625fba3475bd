"""Searches of the interval-map kind over whole tables of queries: points, containment, array-valued results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators.bins import quantile_bins
from spanlake.operators.load import load
from spanlake.operators.overlap import LOWEST, Binning, choose_binning, levels_for, overlap_join, overlaps, prefixed
from spanlake.operators.spec import Bounds, floor_div, is_integral, key_pairs


def stab(points: DataFrame, intervals: DataFrame, on=None, point: str = "point", bounds=("start", "end"), **options) -> DataFrame:
    """Pairs of points and the intervals that contain them, ends included; prefixes l_ and r_."""
    return overlap_join(points, intervals, on, (point, point), bounds, **options)


def contained_in(inner: DataFrame, outer: DataFrame, on=None, inner_bounds=("start", "end"), outer_bounds=("start", "end"), size: int | None = None, left_prefix: str = "l_", right_prefix: str = "r_") -> DataFrame:
    """Pairs where the inner row lies within the outer one.

    An outer row is listed in the few bins it touches on the level of its length, an inner row in the bin of its start
    on every level, so one very long outer row doesn't make the bins of all others wide."""
    pairs, ib, ob = key_pairs(on), Bounds.of(inner_bounds), Bounds.of(outer_bounds)
    a, b = prefixed(inner, left_prefix), prefixed(outer, right_prefix)
    s, e = (F.col(f"`{left_prefix}{c}`") for c in (ib.start, ib.end))
    os, oe = (F.col(f"`{right_prefix}{c}`") for c in (ob.start, ob.end))
    if size is None:
        binning = choose_binning([(b, os, oe)])
    else:
        most = b.agg(F.max(oe.cast("double") - os.cast("double"))).first()[0] or 0
        binning = Binning(size, levels_for(size, min(most, 2.0**62)))
    whole = is_integral(a, s) and is_integral(b, os, oe)

    def place(level: int, low: Column, high: Column) -> Column:
        z = binning.width(level)
        return F.transform(F.sequence(floor_div(low, z, whole), floor_div(high, z, whole)), lambda x: F.struct(F.lit(level).alias("lv"), x.alias("bin")))

    home = place(0, os, oe)
    for level in range(1, binning.levels):
        home = F.when(oe.cast("double") - os.cast("double") >= float(binning.width(level - 1) * LOWEST), place(level, os, oe)).otherwise(home)
    a = a.filter(s.isNotNull() & e.isNotNull()).withColumn("__bin", F.explode(F.concat(*[place(k, s, s) for k in range(binning.levels)])))
    b = b.filter(os <= oe).withColumn("__bin2", F.explode(home))
    same = (F.col("__bin.lv") == F.col("__bin2.lv")) & (F.col("__bin.bin") == F.col("__bin2.bin")) & (s >= os) & (e <= oe)
    # a reversed inner row can start beyond the outer one's end; its start must still be within
    same &= s <= oe
    for x, y in pairs:
        same &= F.col(f"`{left_prefix}{x}`") == F.col(f"`{right_prefix}{y}`")
    return a.join(b, same).drop("__bin", "__bin2")


def contains(outer: DataFrame, inner: DataFrame, on=None, outer_bounds=("start", "end"), inner_bounds=("start", "end"), **options) -> DataFrame:
    """Pairs where the left row contains the right one; prefixes l_ and r_."""
    swapped = [(b, a) for a, b in key_pairs(on)]
    got = contained_in(inner, outer, swapped, inner_bounds, outer_bounds, left_prefix="r_", right_prefix="l_", **options)
    return got.select(*[f"l_{c}" for c in outer.columns], *[f"r_{c}" for c in inner.columns])


def with_index(df: DataFrame, on=None, bounds=("start", "end"), name: str = "idx") -> DataFrame:
    """df with each row's place in its key in the order of start, then end descending; from 0.

    Places are ranks within bins of the starts plus the rows of the bins before, so one key isn't one task's. Where
    no key is crowded, they are ranks within keys."""
    b, keys = Bounds.of(bounds), [f"`{k}`" for k, _ in key_pairs(on)]
    if keys and load(df, df.limit(0), *[[F.col(k) for k in keys]] * 2).even:
        return _ranked(df, keys, b, name)
    s = F.col(f"`{b.start}`")
    binned = quantile_bins([(df, s)])(df, f"`{b.start}`")
    counts = binned.groupBy(*[F.col(k) for k in keys], "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__n", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__b2"), "__n")
    same = F.col("__b").eqNullSafe(F.col("__b2"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rest = [F.col(f"`{c}`") for c in df.columns]
    rank = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(s.asc(), F.col(f"`{b.end}`").desc(), *rest))
    return binned.withColumn("__r", rank).join(counts, same).select(*rest, (F.col("__n") + F.col("__r") - 1).cast("long").alias(name))


def _ranked(df: DataFrame, keys: list[str], b: Bounds, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(f"`{b.start}`").asc(), F.col(f"`{b.end}`").desc(), *[F.col(f"`{c}`") for c in df.columns])
    return df.withColumn(name, (F.row_number().over(order) - 1).cast("long"))


def search_arrays(queries: DataFrame, intervals: DataFrame, on=None, query_bounds=("start", "end"), bounds=("start", "end"), value: str | None = None, what: str = "keys", name: str = "found", strict: bool = False) -> DataFrame:
    """queries with an array of what they overlap, in the order of the intervals (start, then end descending).

    what: "keys" (start, end), "idxs" (places as in with_index), "values" (the value column) or "items" (start, end, value).
    Queries without an overlap have an empty array; equal queries have equal arrays, found once. Where no key is crowded and
    keys have few pairs, each query takes its part of the list of its key."""
    qb, b, pairs = Bounds.of(query_bounds), Bounds.of(bounds), key_pairs(on)
    parts = {"keys": ["start", "end"], "items": ["start", "end", "value"], "values": ["value"], "idxs": []}[what]
    if pairs and load(queries, intervals, [F.col(f"`{x}`") for x, _ in pairs], [F.col(f"`{y}`") for _, y in pairs]).few_pairs:
        known = {"start": b.start, "end": b.end, "value": value}
        item = F.struct(F.col("__idx").alias("__i"), F.col(f"`{b.start}`").alias("__s"), F.col(f"`{b.end}`").alias("__e"), *[(F.col(f"`{known[p]}`") if known[p] else F.lit(None)).alias(p) for p in parts])
        lists = _ranked(intervals, [f"`{y}`" for _, y in pairs], b, "__idx").groupBy(*[F.col(f"`{y}`").alias(f"__q{i}") for i, (_, y) in enumerate(pairs)]).agg(F.sort_array(F.collect_list(item)).alias("__f"))
        same = F.lit(True)
        for i, (x, _) in enumerate(pairs):
            same &= queries[x] == F.col(f"__q{i}")
        met = F.filter("__f", lambda x: overlaps(queries[qb.start], queries[qb.end], x["__s"], x["__e"], strict))
        found = F.transform(met, lambda x: x["__i"] if what == "idxs" else x["value"] if what == "values" else F.struct(*[x[p].alias(p) for p in parts]))
        got = queries.join(lists, same, "left").select(*[queries[c] for c in queries.columns], found.alias(name))
        return got.withColumn(name, F.coalesce(name, F.array().cast(got.schema[name].dataType)))
    placed = with_index(intervals, [y for _, y in pairs], b, "__idx")
    used = [a for a, _ in pairs] + [qb.start, qb.end]
    asked = queries.select(*[F.col(f"`{c}`") for c in dict.fromkeys(used)]).distinct()
    met = overlap_join(asked, placed, on, qb, b, strict=strict)
    col = {"start": F.col(f"`r_{b.start}`"), "end": F.col(f"`r_{b.end}`"), "value": F.col(f"`r_{value}`") if value else F.lit(None)}
    item = F.struct(F.col("r___idx").alias("__i"), *[col[p].alias(p) for p in parts])
    ids = [F.col(f"`l_{c}`").alias(f"__q{i}") for i, c in enumerate(asked.columns)]
    lists = met.groupBy(*ids).agg(F.sort_array(F.collect_list(item)).alias("__f"))
    taken = F.transform("__f", lambda x: x["__i"] if what == "idxs" else x["value"] if what == "values" else F.struct(*[x[p].alias(p) for p in parts]))
    same = F.lit(True)
    for i, c in enumerate(asked.columns):
        same &= queries[c].eqNullSafe(F.col(f"__q{i}"))
    lists = lists.withColumn(name, taken).drop("__f")
    kind = lists.schema[name].dataType
    return queries.join(lists, same, "left").select(*[queries[c] for c in queries.columns], F.coalesce(name, F.array().cast(kind)).alias(name))
