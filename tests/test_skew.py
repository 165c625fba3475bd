"""Positions that crowd, lie far apart or have no end; results, and how many rows a bin gets."""

from pyspark.sql import functions as F

from spanlake.operators import bins, counting, overlap, search


def table(spark, some):
    return spark.createDataFrame(some, "k string, start long, end long")


def plain(a, b):
    return [sum(x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1] for y in b) for x in a]


def test_an_outlier_does_not_gather_the_rest(spark):
    many = spark.range(50_000).select((F.col("id") * 3).alias("p")).union(spark.createDataFrame([(10**15,), (-(10**15),)], "p long"))
    got = bins.quantile_bins([(many, F.col("p"))], most=100, few=1)(many, "p")
    sizes = [r.n for r in got.groupBy("__b").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 90 and max(sizes) < 4 * 50_000 / 100
    edges = got.groupBy("__b").agg(F.min("p").alias("a"), F.max("p").alias("z")).orderBy("__b").collect()
    assert all(x.z < y.a for x, y in zip(edges, edges[1:]))


def test_narrow_events_and_wide_questions(spark):
    events = spark.range(2000).select((F.col("id") * 2).alias("p"))
    asked = spark.range(20_000).select((F.col("id") * 10**9).alias("p"))
    add = bins.quantile_bins([(events, F.col("p")), (asked, F.col("p"))], most=100, few=1)
    sizes = [r.n for r in add(events.union(asked), "p").groupBy("__b").agg(F.count("*").alias("n")).collect()]
    assert 50 < len(sizes) <= 101 and max(sizes) < 4 * 22_000 / 100


def test_operators_with_outliers(spark, monkeypatch):
    monkeypatch.setattr(bins, "FEW", 2)
    a = [("x", i, i + i % 7) for i in range(60)] + [("x", -(10**15), 10**15), ("y", 10**15, 10**15), ("x", 5, 4), (None, 1, 2), ("x", None, 3)]
    b = [("x", 3 * i, 3 * i + 10) for i in range(20)] + [("y", 0, 10**15), ("x", 10**15 - 1, 10**15 + 1), ("x", 9, 2)]
    l, r = table(spark, a), table(spark, b)
    real = [x for x in a if None not in x and x[1] <= x[2]]
    want = sorted(zip(real, plain(real, [y for y in b if y[1] <= y[2]])))
    got = counting.count_overlaps(l.dropna().filter("start <= end"), r, ["k"]).collect()
    assert sorted(((x.k, x.start, x.end), x.n_overlaps) for x in got) == want
    got = counting.has_overlap(l.dropna().filter("start <= end"), r, ["k"]).collect()
    assert sorted(((x.k, x.start, x.end), x.has_overlap) for x in got) == [(x, n > 0) for x, n in want]
    l, r = l.coalesce(1).cache(), r.coalesce(1).cache()
    for strict, kinds in ((False, ("left_anti", "full")), ((True, False), ("left_semi", "left")), ((False, True), ("right",))):
        predicate = overlap.overlaps(F.col("l.start"), F.col("l.end"), F.col("r.start"), F.col("r.end"), strict) & (F.col("l.k") == F.col("r.k"))
        for how in kinds:
            plainly = l.alias("l").join(r.alias("r"), predicate, how).collect()
            got = overlap.overlap_join(l, r, ["k"], how=how, strict=strict, binning=overlap.Binning(64, 14)).collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, plainly))), (how, strict)


def test_bounds_without_end(spark):
    inf, nan = float("inf"), float("nan")
    a = spark.createDataFrame([(-inf, 1.0), (0.0, inf), (5.0, 6.0), (nan, nan)], "start double, end double")
    b = spark.createDataFrame([(2.0, 3.0), (-inf, inf), (7.0, 7.5)], "start double, end double")
    got = {(str(r.start), str(r.end)): r.n_overlaps for r in counting.count_overlaps(a, b).collect()}
    assert {k: v for k, v in got.items() if "nan" not in k} == {("-inf", "1.0"): 1, ("0.0", "inf"): 3, ("5.0", "6.0"): 1}


def test_one_long_outer_row(spark):
    """Its length must not make the bins of all others wide."""
    inner = spark.range(20_000).select((F.col("id") * 50).alias("start"), (F.col("id") * 50 + 20).alias("end"))
    outer = spark.range(20_000).select((F.col("id") * 50 - 10).alias("start"), (F.col("id") * 50 + 40).alias("end")).union(spark.createDataFrame([(0, 10**6)], "start long, end long"))
    got = search.contained_in(inner, outer)
    assert got.count() == 20_000 + 20_000 - 0 and got.filter("r_end = 1000000").count() == 20_000


def test_maps_in_outer_joins(spark):
    a = spark.createDataFrame([("x", 1, 5, {"p": 1}), ("x", 50, 51, {"p": 2, "q": None})], "k string, start long, end long, m map<string, int>")
    b = table(spark, [("x", 4, 9)])
    assert sorted(r.l_start for r in overlap.overlap_join(a, b, ["k"], how="left").filter("r_start is null").collect()) == [50]
    far = overlap.overlap_join(a, b, ["k"], how="full", condition=lambda p: p.l_start > 3)
    assert sorted((r.l_start, r.r_start) for r in far.filter("l_start is not null").collect()) == [(1, None), (50, None)]
