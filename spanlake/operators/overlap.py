"""Overlap joins by bins: an equi-join on (keys, bin) that Spark shuffles, broadcasts, spills and splits as any other.

Every interval is listed in the bins it touches, and a pair is kept in the one bin in which the later of
the two starts lies, so no distinct is needed. Bins have levels (each LEVEL times as wide): an interval is at home on
the level where it touches two bins at most, so one very long interval doesn't become millions of rows. A pair
meets on the level of its longer interval; the shorter one is a guest there. If all lengths fit one level,
which is the usual case, there are no guests and the plan is the plain binned join.

Bins pay where a key has many rows. Where no key is crowded and keys have few pairs (load.py), the join is on the keys
with the overlap as its condition, of any type, and each side is shuffled once. Where a bin has many pairs, it is cut
into blocks: tasks follow from the pairs to compare, not from the bytes to read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.operators.load import CELLS, cell_of, cells, load
from spanlake.operators.spec import Bounds, ColumnLike, floor_div, is_integral, key_pairs

#: Width of a level's bins over that of the level below, and bins an interval may have on the lowest level.
LEVEL, LOWEST = 16, 8
#: Comparisons of a task, about, and partitions at most that are asked for.
TASK_PAIRS, MOST_TASKS = 20_000_000, 20_000
JOIN_TYPES = {"inner": "inner", "left": "left", "leftouter": "left", "left_outer": "left", "right": "right", "rightouter": "right", "right_outer": "right", "full": "full", "outer": "full", "fullouter": "full", "full_outer": "full", "semi": "semi", "left_semi": "semi", "leftsemi": "semi", "anti": "anti", "left_anti": "anti", "leftanti": "anti"}


@dataclass(frozen=True)
class Binning:
    """Width of the lowest bins and number of levels."""

    size: int
    levels: int

    def width(self, level: int) -> int:
        return min(self.size * LEVEL**level, 1 << 62)


def choose_binning(sides: Sequence[tuple[DataFrame, Column, Column]]) -> Binning:
    """From the lengths of both sides: bins about as wide as long intervals usually are. One pass over the bounds."""
    middle, most = [], 0
    for df, start, end in sides:
        length = F.abs(end.cast("double") - start.cast("double"))
        got = df.agg(F.percentile_approx(length, 0.9, 1000).alias("p"), F.max(F.when(~F.isnan(length), length)).alias("m")).first()
        if got.p is not None:
            middle.append(got.p)
            most = max(most, min(got.m, 2.0**62))
    size = min(max(1, int(max(middle, default=1)) + 1), 1 << 62)
    return Binning(size, levels_for(size, most))


def levels_for(size: int, longest: float) -> int:
    """Levels with which the longest interval has few bins."""
    levels = 1
    while size * LEVEL ** (levels - 1) * LOWEST < longest and size * LEVEL ** (levels - 1) < 1 << 62:
        levels += 1
    return levels


def _places(low: Column, high: Column, level: int, tag: str) -> Column:
    return F.transform(F.sequence(low, high), lambda b: F.struct(F.lit(level).alias("lv"), b.alias("bin"), F.lit(tag).alias("tag")))


def _listed(df: DataFrame, start: Column, end: Column, keys: list[Column], binning: Binning, integral: bool, home_tag: str, guest_tag: str) -> DataFrame:
    """df with __k0.. (keys), __lv, __bin and __tag: where its rows are listed."""
    length = F.abs(end.cast("double") - start.cast("double"))
    home = F.lit(0)
    for level in range(binning.levels - 1):
        home = F.when(length >= F.lit(float(binning.width(level) * LOWEST)), F.lit(level + 1)).otherwise(home)
    places = []
    none = F.array().cast("array<struct<lv:int,bin:bigint,tag:string>>")
    for level in range(binning.levels):
        z = binning.width(level)
        low, high = floor_div(F.least(start, end), z, integral), floor_div(F.greatest(start, end), z, integral)
        at_home = ["="] if binning.levels == 1 else ["=", home_tag]
        for tag in at_home:
            places.append(F.when(home == level, _places(low, high, level, tag)).otherwise(none))
        if level:
            places.append(F.when(home < level, _places(low, high, level, guest_tag)).otherwise(none))
    every = F.concat(*places) if len(places) > 1 else places[0]
    known = start.isNotNull() & end.isNotNull()
    for k in keys:
        known &= k.isNotNull()
    out = df.filter(known).withColumn("__p", F.explode(every))
    return out.withColumns({f"__k{i}": k for i, k in enumerate(keys)} | {"__lv": F.col("__p.lv"), "__bin": F.col("__p.bin"), "__tag": F.col("__p.tag")}).drop("__p")


def overlaps(ls: Column, le: Column, rs: Column, re: Column, strict: bool | tuple[bool, bool] = False) -> Column:
    """ls <= re and le >= rs; strict ones with < and >."""
    first, second = strict if isinstance(strict, tuple) else (strict, strict)
    return (ls < re if first else ls <= re) & (le > rs if second else le >= rs)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[df[c].alias(prefix + c) for c in df.columns])


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str | tuple[ColumnLike, ColumnLike]] | None = None,
    left_bounds: Bounds | Sequence[ColumnLike] = ("start", "end"),
    right_bounds: Bounds | Sequence[ColumnLike] = ("start", "end"),
    how: str = "inner",
    strict: bool | tuple[bool, bool] = False,
    condition=None,
    binning: Binning | int | None = None,
    algorithm: str = "auto",
    left_prefix: str = "l_",
    right_prefix: str = "r_",
) -> DataFrame:
    """Pairs of rows with equal keys and overlapping intervals; columns of both sides with their prefixes.

    how: inner, left, right, full, or left semi / anti (these give the left columns without prefix). Null keys and null
    bounds never match. condition: a function of the prefixed pair (its DataFrame) that gives a further Column.
    binning: a Binning, a bin width, or None to choose from the lengths. algorithm "native" leaves the whole join to Spark;
    "auto" and the names of in-memory structures that reference users know all mean bins and differ in nothing."""
    how = JOIN_TYPES.get(how.lower().replace(" ", "_"))
    if how is None:
        raise ValueError("unknown join type")
    lb, rb, pairs = Bounds.of(left_bounds), Bounds.of(right_bounds), key_pairs(on)
    by_keys = bool(pairs) and binning is None and algorithm != "native" and load(left, right, [F.col(f"`{a}`") for a, _ in pairs], [F.col(f"`{b}`") for _, b in pairs]).few_pairs
    if how in ("semi", "anti") and condition is None and algorithm != "native" and not by_keys:
        return by_reach(left, right, pairs, lb, rb, strict, how)
    l0 = prefixed(left, left_prefix).withColumns({"__ls": _moved(left, lb.start, left_prefix), "__le": _moved(left, lb.end, left_prefix)} | {f"__lk{i}": _moved(left, a, left_prefix) for i, (a, _) in enumerate(pairs)})
    r0 = prefixed(right, right_prefix).withColumns({"__rs": _moved(right, rb.start, right_prefix), "__re": _moved(right, rb.end, right_prefix)} | {f"__rk{i}": _moved(right, b, right_prefix) for i, (_, b) in enumerate(pairs)})
    predicate = overlaps(F.col("__ls"), F.col("__le"), F.col("__rs"), F.col("__re"), strict)
    lcols, rcols = [left_prefix + c for c in left.columns], [right_prefix + c for c in right.columns]
    if algorithm == "native" or by_keys:
        for i in range(len(pairs)):
            predicate &= F.col(f"__lk{i}") == F.col(f"__rk{i}")
    if by_keys:
        if condition is not None:
            predicate &= condition(l0.join(r0, predicate))
        met = l0.join(r0, predicate, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
        return met.select(*[F.col(f"`{left_prefix}{c}`").alias(c) for c in left.columns]) if how in ("semi", "anti") else met.select(*lcols, *rcols)
    if algorithm == "native":
        inner = l0.join(r0, predicate)
    else:
        inner = binned_pairs(l0, r0, ("__ls", "__le"), ("__rs", "__re"), [(f"__lk{i}", f"__rk{i}") for i in range(len(pairs))], predicate, binning)
    if condition is not None:
        inner = inner.filter(condition(inner))
    if how == "inner":
        return inner.select(*lcols, *rcols)
    out = inner.select(*lcols, *rcols)
    if how in ("semi", "anti"):
        return unmatched(left, out, left_prefix, how)
    met = out
    if how in ("left", "full"):
        alone = by_reach(left, right, pairs, lb, rb, strict, "anti") if condition is None else unmatched(left, met, left_prefix, "anti")
        out = out.unionByName(prefixed(alone, left_prefix), allowMissingColumns=True)
    if how in ("right", "full"):
        turned = (strict, strict) if not isinstance(strict, tuple) else strict
        swapped = [(b, a) for a, b in pairs]
        alone = by_reach(right, left, swapped, rb, lb, (turned[1], turned[0]), "anti") if condition is None else unmatched(right, met, right_prefix, "anti")
        out = out.unionByName(prefixed(alone, right_prefix), allowMissingColumns=True)
    return out.select(*lcols, *rcols)


def by_reach(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], lb: Bounds, rb: Bounds, strict: bool | tuple[bool, bool], how: str) -> DataFrame:
    """The left rows that have (semi) or lack (anti) a partner, without listing pairs; only keys and bounds are looked at."""
    from spanlake.operators.counting import reaching

    keys = [f"__k{i}" for i in range(len(pairs))] or ["__k0"]
    own = [(F.col(f"`{a}`"), F.col(f"`{b}`")) for a, b in pairs] or [(F.lit(0), F.lit(0))]
    q = left.withColumns({k: a for k, (a, _) in zip(keys, own)} | {"__s": F.col(f"`{lb.start}`"), "__e": F.col(f"`{lb.end}`")})
    r = right.select(*[b.alias(k) for k, (_, b) in zip(keys, own)], F.col(f"`{rb.start}`").alias("__s"), F.col(f"`{rb.end}`").alias("__e"))
    got = reaching(q, r, keys, strict if isinstance(strict, tuple) else (strict, strict), "__hit")
    return got.filter(F.col("__hit") if how == "semi" else ~F.col("__hit")).select(*[F.col(f"`{c}`") for c in left.columns])


def _moved(df: DataFrame, c: ColumnLike, prefix: str) -> Column:
    """A named column of df as seen after its columns got the prefix."""
    if not isinstance(c, str) or c not in df.columns:
        raise ValueError("keys and bounds are names of columns; add a column for an expression first")
    return F.col(f"`{prefix}{c}`")


def unmatched(side: DataFrame, pairs: DataFrame, prefix: str, how: str) -> DataFrame:
    """Rows of a side by whether they are in pairs. Equal rows match alike, so values identify them; no row ids are made.

    Maps, which Spark doesn't compare, are compared as sorted entries."""
    def plain(c: str, col: Column) -> Column:
        return F.array_sort(F.map_entries(col)) if isinstance(side.schema[c].dataType, T.MapType) else col

    seen = pairs.select(*[plain(c, F.col(f"`{prefix}{c}`")).alias(f"__m_{c}") for c in side.columns]).distinct()
    same = F.lit(True)
    for c in side.columns:
        same &= plain(c, side[c]).eqNullSafe(seen[f"__m_{c}"])
    return side.join(seen, same, "left_semi" if how == "semi" else "left_anti")


def binned_pairs(left: DataFrame, right: DataFrame, lb: tuple[str, str], rb: tuple[str, str], keys: list[tuple[str, str]], predicate: Column, binning: Binning | int | None = None) -> DataFrame:
    """All pairs that satisfy predicate (which implies overlap of the bounds), each once."""
    ls, le, rs, re = F.col(lb[0]), F.col(lb[1]), F.col(rb[0]), F.col(rb[1])
    integral = is_integral(left, ls, le) and is_integral(right, rs, re)
    if binning is None:
        binning = choose_binning([(left, ls, le), (right, rs, re)])
    elif not isinstance(binning, Binning):
        most = [df.agg(F.max(F.abs(e.cast("double") - s.cast("double")))).first()[0] or 0 for df, s, e in ((left, ls, le), (right, rs, re))]
        binning = Binning(int(binning), levels_for(int(binning), max(most)))
    a = _listed(left, ls, le, [F.col(k) for k, _ in keys], binning, integral, ">", "<")
    b = _listed(right, rs, re, [F.col(k) for _, k in keys], binning, integral, "<", ">")
    b = b.withColumnsRenamed({f"__k{i}": f"__j{i}" for i in range(len(keys))} | {"__lv": "__lv2", "__bin": "__bin2", "__tag": "__tag2"})
    where = [("__bin", "__bin2"), *([("__lv", "__lv2"), ("__tag", "__tag2")] if binning.levels > 1 else []), *[(f"__k{i}", f"__j{i}") for i in range(len(keys))]]
    if not (left.isStreaming or right.isStreaming):
        a, b, where = _in_blocks(a, b, where)
    same = predicate
    for x, y in where:
        same &= F.col(x) == F.col(y)
    later = F.greatest(ls, rs)
    bin_of = floor_div(later, binning.size, integral)
    for level in range(1, binning.levels):
        bin_of = F.when(F.col("__lv") == level, floor_div(later, binning.width(level), integral)).otherwise(bin_of)
    drop = [f"__{x}{i}" for i in range(len(keys)) for x in "kj"] + ["__lv", "__bin", "__tag", "__lv2", "__bin2", "__tag2", "__block", "__block2"]
    return a.join(b, same & (F.col("__bin") == bin_of)).drop(*drop)


def _in_blocks(a: DataFrame, b: DataFrame, where: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """The listed rows of both sides dealt to as many tasks as their comparisons need, and the columns in which pairs agree.

    In bins with more comparisons than a task should have, the rows of the larger side are cut into blocks by hash and
    those of the smaller one are in every block. Counting the rows of bins is one pass; few comparisons leave the sides as they are."""
    at = cell_of(a, b, [F.col(x) for x, _ in where], [F.col(y) for _, y in where])
    found = cells(a, b, [F.col(x) for x, _ in where], [F.col(y) for _, y in where])
    total = found.agg(F.sum("__l").alias("l"), F.sum("__r").alias("r")).first()
    n, m = total.l or 0, total.r or 0
    if float(n) * m <= TASK_PAIRS:
        return a, b, where
    product = F.greatest(F.col("__l").cast("double") * F.col("__r") - float(n) * m / CELLS**2, F.lit(0.0))  # less what bins that only share a cell add
    crowded = F.when(product > TASK_PAIRS, F.struct("__cell", F.ceil(product / TASK_PAIRS).cast("int").alias("__blocks")))
    got = found.agg(F.sum(product).alias("pairs"), F.collect_list(crowded).alias("crowded")).first()
    tasks = min(MOST_TASKS, int(got.pairs / TASK_PAIRS) + 1)
    if tasks == 1:
        return a, b, where
    spark = a.sparkSession
    if got.crowded:
        blocks = F.broadcast(spark.createDataFrame([tuple(x) for x in got.crowded], "__cell int, __blocks int"))
        a, b = (df.withColumn("__cell", c).join(blocks, "__cell", "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1))).drop("__cell") for df, c in zip((a, b), at))
        sides = [(a, "__block"), (b, "__block2")]
        for i, (df, name) in enumerate(sides):
            if (n >= m) == (i == 0):
                told = [F.col(f"`{c}`") for c, f in zip(df.columns, df.schema.fields) if not isinstance(f.dataType, (T.MapType, T.VariantType))]
                df = df.withColumn(name, F.pmod(F.xxhash64(*told), F.col("__blocks")).cast("int"))
            else:
                df = df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
            sides[i] = df.drop("__blocks"), name
        (a, _), (b, _) = sides
        where = [*where, ("__block", "__block2")]
    tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return a.repartition(tasks, *[x for x, _ in where]), b.repartition(tasks, *[y for _, y in where]), where
