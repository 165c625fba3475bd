"""Counts, existence, coverage and nearest intervals without listing pairs.

How many intervals overlap [s, e]: those that start at or before e, less those that end before s. Both are ranks
of a position among positions, and so are sums of covered length. Whether any does: the largest end among those that start
at or before e is at least s. Ranks and largest ends are found on distinct positions only - equal ones are
combined before any shuffle - in two steps: running values within the bins of a key, and over whole bins. Bins are
quantiles of the positions of both sides, so each has about as many, however they crowd, spread or lie apart.
The result joins back by equality on (keys, position).

That is for crowded keys and for tables without keys. Where no key is crowded (load.py), both sides are dealt by their
keys once and sorted within them, and each row takes the running values at its start and end where it stands among the events.

Rows whose start is after their end are no intervals here: they overlap nothing and nothing overlaps them. Null
keys and bounds match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators.bins import quantile_bins
from spanlake.operators.load import Load, load
from spanlake.operators.overlap import Binning, binned_pairs, overlaps, prefixed
from spanlake.operators.spec import Bounds, ColumnLike, is_integral, key_pairs


def ranks(events: DataFrame, asked: DataFrame, keys: list[str], pos: str, sums: dict[str, Column]) -> DataFrame:
    """keys, pos and for each name of sums: name_le and name_lt, its sum over the events of the key at or before, and before, pos.

    One row for each distinct (keys, pos) of asked. Events are (keys, pos, ...); sums are aggregates of them."""
    held = events.groupBy(*keys, pos).agg(*[x.alias(n) for n, x in sums.items()])
    points = asked.select(*keys, pos).distinct()
    both = held.unionByName(points.select(*keys, pos, *[F.lit(0).cast(held.schema[n].dataType).alias(n) for n in sums]).withColumn("__asked", F.lit(1)), allowMissingColumns=True)
    both = both.groupBy(*keys, pos).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums], F.max("__asked").alias("__asked"))
    both = quantile_bins([(events, F.col(pos)), (asked, F.col(pos))])(both, pos)
    inside = Window.partitionBy(*keys, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    bins = both.groupBy(*keys, "__b").agg(*[F.sum(n).alias(f"__{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "__b", *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    run = both.withColumns({f"{n}_le": F.sum(n).over(inside) for n in sums}).filter("__asked = 1")
    out = run.join(bins, [*keys, "__b"])
    return out.select(*keys, pos, *[(F.col(f"{n}_le") + F.col(f"__{n}")).alias(f"{n}_le") for n in sums], *[(F.col(f"{n}_le") + F.col(f"__{n}") - F.col(n)).alias(f"{n}_lt") for n in sums])


def _sides(left: DataFrame, right: DataFrame, on, lb, rb) -> tuple[DataFrame, DataFrame, list[str]]:
    """left with __k.., __s, __e added (null where it is no interval); right as __k.., __s, __e, intervals only."""
    pairs, lb, rb = key_pairs(on), Bounds.of(lb), Bounds.of(rb)
    keys = [f"__k{i}" for i in range(len(pairs))]
    q = left.withColumns({k: F.col(f"`{a}`") for k, (a, _) in zip(keys, pairs)} | {"__s": F.col(f"`{lb.start}`"), "__e": F.col(f"`{lb.end}`")})
    real = F.col("__s") <= F.col("__e")
    q = q.withColumns({"__s": F.when(real, F.col("__s")), "__e": F.when(real, F.col("__e"))})
    b = right.select(*[F.col(f"`{c}`").alias(k) for k, (_, c) in zip(keys, pairs)], F.col(f"`{rb.start}`").alias("__s"), F.col(f"`{rb.end}`").alias("__e"))
    b = b.filter(F.col("__s") <= F.col("__e")).dropna(subset=keys) if keys else b.filter(F.col("__s") <= F.col("__e"))
    if not keys:  # range only: one key for all; bins spread it
        q, b, keys = q.withColumn("__k0", F.lit(0)), b.withColumn("__k0", F.lit(0)), ["__k0"]
    return q, b, keys


def _ask(q: DataFrame, b: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """q with e_<name>_le, e_<name>_lt at its ends and s_<name>_le, s_<name>_lt at its starts: ranks among b's bounds.

    Sums are over events (__p, __on: 1 for a start, 0 for an end). Starts and ends of both sides are ranked in one pass."""
    events = b.select(*keys, F.explode(F.array(F.struct(F.col("__s").alias("p"), F.lit(1).alias("o")), F.struct(F.col("__e").alias("p"), F.lit(0).alias("o")))).alias("x"))
    events = events.select(*keys, F.col("x.p").alias("__p"), F.col("x.o").alias("__on"))
    asked = q.select(*keys, F.explode(F.array("__s", "__e")).alias("__p")).dropna()
    found = ranks(events, asked, keys, "__p", sums)
    for at in ("__e", "__s"):
        names = [F.col(f"{n}_{o}").alias(f"{at[2]}_{n}_{o}") for n in sums for o in ("le", "lt")]
        q = q.join(found.select(*keys, F.col("__p").alias(at), *names), [*keys, at], "left")
    return q


def _load(q: DataFrame, b: DataFrame, keys: list[str], on) -> Load | None:
    """How the rows of both sides are dealt over the keys; None without keys."""
    far = F.greatest(F.abs(F.col("__s").cast("double")), F.abs(F.col("__e").cast("double")))
    return load(q, b, *[[F.col(k) for k in keys]] * 2, far, far) if key_pairs(on) else None


def _span_events(b: DataFrame, keys: list[str], **amounts: Column) -> DataFrame:
    """One event for each row of b: at its start among ends (__p1), at its end among starts (__p2)."""
    return b.select(*keys, F.col("__s").alias("__p1"), F.col("__e").alias("__p2"), *[x.alias(n) for n, x in amounts.items()])


def _edge_events(b: DataFrame, keys: list[str], number: Column, **names: str) -> DataFrame:
    """Two events for each row of b, at its start and its end: began, ended, depth (starts less ends) and moment (their positions)."""
    def edge(at: str, sign: int) -> Column:
        p = F.col(at)
        return F.struct(p.alias("p"), F.lit(1 if sign > 0 else 0).cast("long").alias("began"), F.lit(1 if sign < 0 else 0).cast("long").alias("ended"), F.lit(sign).cast("long").alias("depth"), (p.cast(number) * sign).cast(number).alias("moment"))

    x = b.select(*keys, F.explode(F.array(edge("__s", 1), edge("__e", -1))).alias("x"))
    return x.select(*keys, F.col("x.p").alias("__p1"), F.col("x.p").alias("__p2"), *[F.col(f"x.{c}").alias(n) for c, n in names.items()])


def _sweep(q: DataFrame, events: Sequence[DataFrame], keys: list[str], at_end: dict[str, str], at_start: dict[str, str], strict: bool = False) -> DataFrame:
    """q with running sums of the events of its key: at_end has those up to its end, at_start those before its start (strict: before its end, up to its start).

    One shuffle by the keys and two sorts within them; rows of q stand among the events."""
    both = q.withColumn("__ev", F.lit(False))
    for x in events:
        both = both.unionByName(x.withColumn("__ev", F.lit(True)), allowMissingColumns=True)
    event_first, event_last = F.col("__ev").desc(), F.col("__ev").asc()
    place = [F.when(F.col("__ev"), F.col(p)).otherwise(F.col(at)) for p, at in (("__p1", "__e"), ("__p2", "__s"))]
    for sums, where, tie in ((at_end, place[0], event_last if strict else event_first), (at_start, place[1], event_first if strict else event_last)):
        upto = Window.partitionBy(*keys).orderBy(where, tie).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumns({n: F.coalesce(F.sum(x).over(upto), F.lit(0)) for n, x in sums.items()})
    return both.filter(~F.col("__ev"))


def count_overlaps(left: DataFrame, right: DataFrame, on: Sequence[str | tuple[ColumnLike, ColumnLike]] | None = None, left_bounds=("start", "end"), right_bounds=("start", "end"), strict: bool = False, name: str = "n_overlaps") -> DataFrame:
    """left with the number of right intervals that overlap each row; every row stays, duplicates too."""
    q, b, keys = _sides(left, right, on, left_bounds, right_bounds)
    dealt = _load(q, b, keys, on)
    if dealt and dealt.even:
        point = F.when(F.col("__s") == F.col("__e"), 1).otherwise(0).cast("long")
        q = _sweep(q, [_span_events(b, keys, __one=F.lit(1).cast("long"), __pt=point)], keys, {"__begun": "__one"} | ({"__pt1": "__pt"} if strict else {}), {"__ended": "__one"} | ({"__pt2": "__pt"} if strict else {}), strict)
        count = F.col("__begun") - F.col("__ended")
        if strict:  # points at a row that is a point itself were taken off without having been counted
            count += F.when(F.col("__s") == F.col("__e"), F.col("__pt2") - F.col("__pt1")).otherwise(0)
        count = F.when(F.col("__s").isNotNull(), count).otherwise(0).cast("long")
        return q.select(*[F.col(f"`{c}`") for c in left.columns], count.alias(name))
    q = _ask(q, b, keys, {"bg": F.sum("__on"), "ed": F.sum(1 - F.col("__on"))})
    begun, ended = ("e_bg_lt", "s_ed_le") if strict else ("e_bg_le", "s_ed_lt")
    count = F.coalesce(begun, F.lit(0)) - F.coalesce(ended, F.lit(0))
    if strict:  # points at a row that is a point itself were taken off without having been counted
        points = b.filter("__s = __e").groupBy(*keys, "__s").agg(F.count("*").alias("__pt"))
        q = q.join(points, [*keys, "__s"], "left")
        count += F.when(F.col("__s") == F.col("__e"), F.coalesce("__pt", F.lit(0))).otherwise(0)
    return q.withColumn(name, F.coalesce(count, F.lit(0)).cast("long")).select(*[F.col(f"`{c}`") for c in left.columns], name)


def reaching(left: DataFrame, right: DataFrame, keys: list[str], strict: tuple[bool, bool], name: str) -> DataFrame:
    """left with whether a right row of equal keys satisfies left.__s <= right.__e and left.__e >= right.__s (strict: < and >).

    Reversed rows count as the predicate says; null keys and bounds satisfy nothing."""
    some = right.select(*keys, "__s", "__e").dropna()
    ends = some.groupBy(*keys, F.col("__s").alias("__p")).agg(F.max("__e").alias("__to"))
    asked = left.select(*keys, F.col("__e").alias("__p")).dropna().distinct()
    both = ends.unionByName(asked.withColumn("__asked", F.lit(1)), allowMissingColumns=True)
    both = both.groupBy(*keys, "__p").agg(F.max("__to").alias("__to"), F.max("__asked").alias("__asked"))
    both = quantile_bins([(some, F.col("__s")), (left, F.col("__e"))])(both, "__p")
    inside = Window.partitionBy(*keys, "__b").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1 if strict[1] else 0)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bins = both.groupBy(*keys, "__b").agg(F.max("__to").alias("__bt")).withColumn("__bt", F.max("__bt").over(before))
    run = both.withColumn("__to", F.max("__to").over(inside)).filter("__asked = 1").join(bins, [*keys, "__b"])
    found = run.select(*keys, F.col("__p").alias("__e"), F.greatest("__to", "__bt").alias("__to"))  # skips nulls
    hit = F.col("__s") < F.col("__to") if strict[0] else F.col("__s") <= F.col("__to")
    return left.join(found, [*keys, "__e"], "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop("__to")


def has_overlap(left: DataFrame, right: DataFrame, on=None, left_bounds=("start", "end"), right_bounds=("start", "end"), strict: bool = False, name: str = "has_overlap") -> DataFrame:
    """left with whether any right interval overlaps each row."""
    q, b, keys = _sides(left, right, on, left_bounds, right_bounds)
    return reaching(q, b, keys, (strict, strict), "__hit").select(*[F.col(f"`{c}`") for c in left.columns], F.col("__hit").alias(name))


def merge_intervals(df: DataFrame, on: Sequence[str] | None = None, bounds=("start", "end"), gap: int = 0) -> DataFrame:
    """keys, start, end, n: unions of intervals that overlap or are at most gap apart (inclusive ends: gap 1 joins neighbours)."""
    b, keys = Bounds.of(bounds), list(on or [])
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{b.start}`").alias("__s"), F.col(f"`{b.end}`").alias("__e")).filter("__s <= __e")
    rows = rows.dropna(subset=keys) if keys else rows
    if keys and load(rows, rows.limit(0), *[[F.col(f"`{k}`") for k in keys]] * 2).even:
        return _merged(rows, keys, gap).select(*[F.col(f"`{k}`") for k in keys], F.col("__s").alias(b.start), F.col("__e").alias(b.end), "n")
    by = keys or ["__all"]
    rows = rows if keys else rows.withColumn("__all", F.lit(0))
    held = rows.groupBy(*by, "__s").agg(F.max("__e").alias("__e"), F.count("*").alias("__n"))
    held = quantile_bins([(rows, F.col("__s"))])(held, "__s")
    inside = Window.partitionBy(*by, "__b").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bins = held.groupBy(*by, "__b").agg(F.max("__e").alias("__be")).withColumn("__be", F.max("__be").over(before))
    marked = held.withColumn("__m", F.max("__e").over(inside)).join(bins, [*by, "__b"])
    reach = F.greatest("__m", "__be")  # skips nulls
    marked = marked.withColumn("__new", F.when(reach.isNull() | (F.col("__s") > reach + gap), 1).otherwise(0))
    # number of the group: new ones so far, within bins and over them
    upto = Window.partitionBy(*by, "__b").orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)
    news = marked.groupBy(*by, "__b").agg(F.sum("__new").alias("__bn")).withColumn("__bn", F.coalesce(F.sum("__bn").over(before), F.lit(0)))
    group = marked.withColumn("__g", F.sum("__new").over(upto)).join(news, [*by, "__b"]).withColumn("__g", F.col("__g") + F.col("__bn"))
    return group.groupBy(*by, "__g").agg(F.min("__s").alias(b.start), F.max("__e").alias(b.end), F.sum("__n").alias("n")).select(*[F.col(f"`{k}`") for k in keys], b.start, b.end, "n")


def _merged(rows: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """keys, __s, __e, n: unions of the intervals of a key, in one shuffle and one sort within the keys."""
    order = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy("__s", "__e")
    reach = F.max("__e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__m", reach)
    marked = marked.withColumn("__new", F.when(F.col("__m").isNull() | (F.col("__s") > F.col("__m") + gap), 1).otherwise(0))
    marked = marked.withColumn("__g", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*[F.col(f"`{k}`") for k in keys], "__g").agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"), F.count("*").alias("n")).drop("__g")


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _number(q: DataFrame, b: DataFrame, dealt: Load) -> str:
    """The type in which positions of a key can be summed."""
    small = is_integral(q, F.col("__s"), F.col("__e")) and is_integral(b, F.col("__s"), F.col("__e")) and dealt.far * 4 * (dealt.most + 1) < 2.0**62
    return "long" if small else "decimal(38,0)"


def _covered(q: DataFrame) -> Column:
    """Length covered between __s and __e, from depths and moments up to both: x * depth - moment up to x."""
    number = q.schema["__te"].dataType.simpleString()
    upto = [F.col(x).cast(number if number.startswith("decimal") else "long") * F.col(d) - F.col(t) for x, d, t in (("__e", "__de", "__te"), ("__s", "__ds", "__ts"))]
    return F.when(F.col("__s").isNotNull(), upto[0] - upto[1]).otherwise(0).cast("long")


def coverage_sum(left: DataFrame, right: DataFrame, on=None, left_bounds=("start", "end"), right_bounds=("start", "end"), count_name: str = "n_overlaps", name: str = "coverage") -> DataFrame:
    """left with the number of overlaps and the sum over them of min(ends) - max(starts): overlaps count repeatedly, lengths have no +1.

    Length covered up to x, with multiplicity, is the sum of x - start over starts before x less the sum of x - end over ends before x."""
    q, b, keys = _sides(left, right, on, left_bounds, right_bounds)
    dealt = _load(q, b, keys, on)
    if dealt and dealt.even:
        q = _sweep(q, [_edge_events(b, keys, _number(q, b, dealt), began="__n1", ended="__n2", depth="__d", moment="__t")], keys, {"__begun": "__n1", "__de": "__d", "__te": "__t"}, {"__ended": "__n2", "__ds": "__d", "__ts": "__t"})
        return q.select(*[F.col(f"`{c}`") for c in left.columns], F.when(F.col("__s").isNotNull(), F.col("__begun") - F.col("__ended")).otherwise(0).cast("long").alias(count_name), _covered(q).alias(name))
    on, p = F.col("__on"), _wide(F.col("__p"))
    q = _ask(q, b, keys, {"bg": F.sum(on), "ed": F.sum(1 - on), "tb": F.sum(F.when(on == 1, p)), "tz": F.sum(F.when(on == 0, p))})

    def rank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    def upto(x: str, tag: str) -> Column:
        return (_wide(F.col(x)) * rank(f"{tag}_bg_le") - rank(f"{tag}_tb_le")) - (_wide(F.col(x)) * rank(f"{tag}_ed_le") - rank(f"{tag}_tz_le"))

    covered = F.coalesce(upto("__e", "e") - upto("__s", "s"), F.lit(0)).cast("long")
    count = F.when(F.col("__s").isNotNull(), rank("e_bg_le") - rank("s_ed_lt")).otherwise(0).cast("long")
    return q.withColumn("__c", count).withColumn("__v", covered).select(*[F.col(f"`{c}`") for c in left.columns], F.col("__c").alias(count_name), F.col("__v").alias(name))


def coverage_union(left: DataFrame, right: DataFrame, on=None, left_bounds=("start", "end"), right_bounds=("start", "end"), count_name: str = "n_overlaps", name: str = "covered") -> DataFrame:
    """left with the number of overlaps and how many of its positions, ends included, at least one right interval covers."""
    pairs, rb = key_pairs(on), Bounds.of(right_bounds)
    q, b, keys = _sides(left, right, on, left_bounds, right_bounds)
    dealt = _load(q, b, keys, on)
    if dealt and dealt.even:
        edges = _edge_events(_merged(b, keys), keys, _number(q, b, dealt), began="__m1", ended="__m2", depth="__d", moment="__t")
        q = _sweep(q, [_span_events(b, keys, __one=F.lit(1).cast("long")), edges], keys, {"__begun": "__one", "__mb": "__m1", "__de": "__d", "__te": "__t"}, {"__ended": "__one", "__me": "__m2", "__ds": "__d", "__ts": "__t"})
        real = F.col("__s").isNotNull()
        count, touched = (F.when(real, F.col(x) - F.col(y)).otherwise(0).cast("long") for x, y in (("__begun", "__ended"), ("__mb", "__me")))
        return q.select(*[F.col(f"`{c}`") for c in left.columns], count.alias(count_name), (_covered(q) + touched).alias(name))
    merged = merge_intervals(right, [b for _, b in pairs], rb, gap=0)
    got = coverage_sum(left, merged, on, left_bounds, rb, "__m", "__v")
    got = got.withColumn("__v", F.col("__v") + F.col("__m")).drop("__m")
    lb = Bounds.of(left_bounds)
    return count_overlaps(got, right, on, lb, rb, name=count_name).select(*[F.col(f"`{c}`") for c in left.columns], count_name, F.col("__v").alias(name))


def nearest(left: DataFrame, right: DataFrame, on=None, left_bounds=("start", "end"), right_bounds=("start", "end"), strict: bool = False, right_prefix: str = "r_", distance: str = "distance", binning: Binning | int | None = None) -> DataFrame:
    """left with one right row each: an overlapping one if there is (distance 0), else the nearest of its key, else nulls.

    Ties go to the smaller start, then end, then the other columns in order. Distance is how far apart the closer ends are.
    With strict, intervals that only touch don't overlap; they are nearest at distance 0. For rows without an overlap only two
    candidates are looked at: the last that ends before and the first that starts after. For others the smallest of
    their overlapping rows is combined before the shuffle. Where no key is crowded and keys have few pairs, each
    row is compared with the list of its key instead: both sides are shuffled once."""
    pairs, lb, rb = key_pairs(on), Bounds.of(left_bounds), Bounds.of(right_bounds)
    rest = [c for c in right.columns if c not in (rb.start, rb.end)]
    row = F.struct(F.col(f"`{rb.start}`").alias("__s"), F.col(f"`{rb.end}`").alias("__e"), *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(rest)])
    q, _, keys = _sides(left, right, on, lb, rb)
    b = right.withColumn("__row", row).select(*[F.col(f"`{c}`").alias(k) for k, (_, c) in zip(keys, pairs)], *([] if pairs else [F.lit(0).alias("__k0")]), F.col("__row.__s").alias("__s"), F.col("__row.__e").alias("__e"), "__row").filter("__s <= __e").dropna(subset=keys)
    if pairs and binning is None and is_integral(q, F.col("__s"), F.col("__e")) and is_integral(b, F.col("__s"), F.col("__e")) and load(q, b, *[[F.col(k) for k in keys]] * 2).few_pairs:
        lists = b.groupBy(*keys).agg(F.collect_list("__row").alias("__rows"))
        s, e, furthest = F.col("__s"), F.col("__e"), F.lit((1 << 63) - 1)

        def place(x: Column) -> Column:
            """Overlapping rows first, then by distance, then by the row."""
            away = F.when(x["__s"] > e, F.try_subtract(x["__s"].cast("long"), e.cast("long"))).when(s > x["__e"], F.try_subtract(s.cast("long"), x["__e"].cast("long"))).otherwise(0)
            return F.struct((~overlaps(s, e, x["__s"], x["__e"], strict)).alias("o"), F.coalesce(away, furthest).alias("d"), x.alias("x"))

        got = q.join(lists, keys, "left").withColumn("__best", F.when(s.isNotNull(), F.array_min(F.transform("__rows", place))))
        got = got.withColumns({"__row": F.col("__best.x"), "__beside": F.col("__best.o")})
        x = F.col("__row")
        away = F.when(x["__s"] > e, x["__s"] - e).when(s > x["__e"], s - x["__e"]).otherwise(0)
        got = got.withColumn("__d", F.when(F.col("__beside"), away).when(x.isNotNull(), 0))
        return _with_row(got, left, right, rb, rest, right_prefix, distance)
    asked = q.select(*keys, "__s", "__e").dropna().distinct()
    # overlapping
    l0, r0 = prefixed(asked, "q"), prefixed(b, "b")
    met = binned_pairs(l0, r0, ("q__s", "q__e"), ("b__s", "b__e"), [(f"q{k}", f"b{k}") for k in keys], overlaps(F.col("q__s"), F.col("q__e"), F.col("b__s"), F.col("b__e"), strict), binning)
    hit = met.groupBy(*[F.col(f"q{k}").alias(k) for k in keys], F.col("q__s").alias("__s"), F.col("q__e").alias("__e")).agg(F.min("b__row").alias("__hit"))
    # before and after
    ends = b.groupBy(*keys, F.col("__e").alias("__p")).agg(F.min("__row").alias("__row"))
    starts = b.groupBy(*keys, F.col("__s").alias("__p")).agg(F.min("__row").alias("__row"))
    before = _neighbour(ends, asked.select(*keys, F.col("__s").alias("__p")).distinct(), keys, strict, last=True)
    after = _neighbour(starts, asked.select(*keys, F.col("__e").alias("__p")).distinct(), keys, strict, last=False)
    got = q.join(hit, [*keys, "__s", "__e"], "left").join(before.withColumnsRenamed({"__p": "__s", "__row": "__before"}), [*keys, "__s"], "left").join(after.withColumnsRenamed({"__p": "__e", "__row": "__after"}), [*keys, "__e"], "left")
    db, da = F.col("__s") - F.col("__before.__e"), F.col("__after.__s") - F.col("__e")
    chosen = F.when(F.col("__hit").isNotNull(), F.col("__hit")).when(db.isNull(), F.col("__after")).when(da.isNull() | (db <= da), F.col("__before")).otherwise(F.col("__after"))
    away = F.when(F.col("__hit").isNotNull(), F.lit(0)).otherwise(F.least(db, da))
    return _with_row(got.withColumns({"__row": chosen, "__d": away}), left, right, rb, rest, right_prefix, distance)


def _with_row(got: DataFrame, left: DataFrame, right: DataFrame, rb: Bounds, rest: list[str], right_prefix: str, distance: str) -> DataFrame:
    """The columns of left, those of right from __row, and __d."""
    names = {rb.start: "__row.__s", rb.end: "__row.__e"} | {c: f"__row.__c{i}" for i, c in enumerate(rest)}
    return got.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(names[c]).alias(right_prefix + c) for c in right.columns], F.col("__d").alias(distance))


def _neighbour(points: DataFrame, asked: DataFrame, keys: list[str], touching: bool, last: bool) -> DataFrame:
    """keys, __p and __row of the last point before (or first after) each asked position; touching: or at it. Bins as in ranks()."""
    both = points.unionByName(asked.withColumn("__asked", F.lit(1)), allowMissingColumns=True)
    both = both.groupBy(*keys, "__p").agg(F.min("__row").alias("__row"), F.max("__asked").alias("__asked"))
    both = quantile_bins([(points, F.col("__p")), (asked, F.col("__p"))])(both, "__p")
    order, bins_order = (F.col("__p").asc(), F.col("__b").asc()) if last else (F.col("__p").desc(), F.col("__b").desc())
    inside = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if touching else -1)
    over = Window.partitionBy(*keys).orderBy(bins_order).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.max_by if last else F.min_by
    bins = both.groupBy(*keys, "__b").agg(edge("__row", F.when(F.col("__row").isNotNull(), F.col("__p"))).alias("__br")).withColumn("__br", F.last("__br", ignorenulls=True).over(over))
    run = both.withColumn("__in", F.last("__row", ignorenulls=True).over(inside)).filter("__asked = 1")
    return run.join(bins, [*keys, "__b"]).select(*keys, "__p", F.coalesce("__in", "__br").alias("__row"))
