"""Plans where no key is crowded: one shuffle by the keys, and the results of the plans with bins."""

import random

import pytest
from pyspark.sql import functions as F

from spanlake import queries
from spanlake.operators import bins, counting, load, overlap, search
from spanlake.plans.session import IntervalSession

SF, KEYED = "/root/testdata/sf0.001", "k string, start long, end long, id long"


def rows(seed, n, far=60):
    r = random.Random(seed)
    out = [(r.choice("abcdefgh"), s := r.randint(-far, far), s + r.choice([0, 0, 1, 3, 10, -2]), i) for i in range(n)]
    return out + [out[0][:3] + (n,), out[1], out[1], (None, 1, 5, n + 1), ("a", None, 5, n + 2), ("b", 3, None, n + 3)]


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(rows(1, 150), KEYED), spark.createDataFrame(rows(2, 90), KEYED)


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Plans as for large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def bag(df):
    return sorted(map(str, map(tuple, df.collect())))


def both_ways(monkeypatch, make):
    """What make() returns with keys dealt out whole, and with the keys cut into bins."""
    even = make()
    wanted = bag(even)
    with monkeypatch.context() as m:
        m.setattr(bins, "FEW", 1)
        crowded = make()
        assert bag(crowded) == wanted
    return even, crowded


def meets(a, b, strict=False):
    if None in a or None in b or a[0] != b[0] or a[1] > a[2] or b[1] > b[2]:
        return False
    return a[1] < b[2] and a[2] > b[1] if strict else a[1] <= b[2] and a[2] >= b[1]


def test_load(spark, sides):
    left, right = sides
    got = load.load(left, right, [F.col("k")], [F.col("k")], F.abs(F.col("start")), F.col("end"))
    known = [[x[0] for x in rows(seed, n)] for seed, n in ((1, 150), (2, 90))]
    pairs = sum(known[0].count(k) * known[1].count(k) for k in set(known[0]))
    assert (got.left, got.right, got.most) == (len(known[0]), len(known[1]), max(known[0].count(k) + known[1].count(k) for k in known[0]))
    assert abs(got.pairs - pairs) < 2 and got.even and got.few_pairs and got.far >= 60
    crowd = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("k"))
    assert not load.load(crowd, crowd, [F.col("k")], [F.col("k")]).even
    many = spark.range(300_000).select((F.col("id") % 300).alias("k"))
    got = load.load(many, many.select(F.col("k").cast("int")), [F.col("k")], [F.col("k")])
    assert got.even and not got.few_pairs and 2.8e8 < got.pairs < 3.2e8


def test_coverage_union_in_one_shuffle(spark, sides, monkeypatch):
    """the probe side was shuffled for each of four joins, and ranks had a row for each key and bin."""
    left, right = sides
    even, crowded = both_ways(monkeypatch, lambda: counting.coverage_union(left, right, ["k"]))
    assert shuffles(even) <= 2 < shuffles(crowded)
    held = {}
    for k, s, e, _ in rows(2, 90):
        if None not in (k, s, e):
            held.setdefault(k, set()).update(range(s, e + 1))
    for r in even.collect():
        x = (r.k, r.start, r.end, r.id)
        assert r.n_overlaps == sum(meets(x, y) for y in rows(2, 90))
        assert r.covered == (sum(p in held.get(r.k, ()) for p in range(r.start, r.end + 1)) if None not in x else 0)


def test_coverage_sum_in_one_shuffle(spark, sides, monkeypatch):
    """F7."""
    left, right = sides
    even, crowded = both_ways(monkeypatch, lambda: counting.coverage_sum(left, right, ["k"]))
    assert shuffles(even) <= 1 < shuffles(crowded)
    for r in even.collect():
        x = (r.k, r.start, r.end, r.id)
        assert r.coverage == sum(min(x[2], y[2]) - max(x[1], y[1]) for y in rows(2, 90) if meets(x, y))


def test_coverage_sum_of_far_positions(spark):
    """Sums of positions that 64 bits don't hold."""
    far = 1 << 61
    b = spark.createDataFrame([("x", far - i, far + i, i) for i in range(1, 40)], KEYED)
    got = counting.coverage_sum(spark.createDataFrame([("x", far - 5, far + 2, 0)], KEYED), b, ["k"]).first()
    assert (got.n_overlaps, got.coverage) == (39, sum(min(2, i) + min(5, i) for i in range(1, 40)))


def test_count_overlaps_strict_in_one_shuffle(spark, sides, monkeypatch):
    """F8."""
    left, right = sides
    even, crowded = both_ways(monkeypatch, lambda: counting.count_overlaps(left, right, ["k"], strict=True))
    assert shuffles(even) <= 1 < shuffles(crowded)
    assert all(r.n_overlaps == sum(meets((r.k, r.start, r.end), y, True) for y in rows(2, 90)) for r in even.collect())


def test_count_overlaps_in_one_shuffle(spark, sides, monkeypatch):
    """F10."""
    left, right = sides
    even, crowded = both_ways(monkeypatch, lambda: counting.count_overlaps(left, right, ["k"]))
    assert shuffles(even) <= 1 < shuffles(crowded)
    assert all(r.n_overlaps == sum(meets((r.k, r.start, r.end), y) for y in rows(2, 90)) for r in even.collect())


def test_crowded_bins_are_cut_into_blocks(spark, monkeypatch):
    """tables of few bytes whose bins have many pairs were joined by one task a bin, or one for all."""
    left = spark.range(600).select(F.col("id").alias("a"), (F.col("id") % 40).alias("s"), (F.col("id") % 40 + 20).alias("e"))
    right = spark.range(900).select(F.col("id").alias("b"), (F.col("id") % 45).alias("s"), (F.col("id") % 45 + 10).alias("e"))
    plainly = left.alias("l").join(right.alias("r"), F.expr("l.s <= r.e AND l.e >= r.s")).select("a", "b")
    monkeypatch.setattr(overlap, "TASK_PAIRS", 20_000, raising=False)
    for x, y in ((("l_a", "l_s", "l_e"), ("r_b", "r_s", "r_e")), (("r_a", "r_s", "r_e"), ("l_b", "l_s", "l_e"))):
        turned = x[0] == "r_a"
        got = overlap.overlap_join(right if turned else left, left if turned else right, None, ("s", "e"), ("s", "e"))
        tasks = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(tasks) > 10 * 20_000 and max(tasks) < sum(tasks) / 4
        assert bag(got.select(x[0], y[0])) == bag(plainly)
    long = right.union(spark.createDataFrame([(-1, -5000, 5000)], "b long, s long, e long"))  # several levels, and keys
    for on in (None, ["k"]):
        a, b = left.withColumn("k", F.lit("x")), long.withColumn("k", F.lit("x"))
        got = overlap.overlap_join(a, b, on, ("s", "e"), ("s", "e"), binning=overlap.Binning(8, 3))
        assert bag(got.select("l_a", "r_b")) == bag(left.alias("l").join(long.alias("r"), F.expr("l.s <= r.e AND l.e >= r.s")).select("a", "b"))


def test_sql_nearest_in_one_shuffle_a_side(spark):
    """F5."""
    got = queries.queries()["sql_nearest_algorithm"](spark, SF)
    assert shuffles(got) <= 2


def test_nearest_row_in_one_shuffle_a_side(spark, sides, monkeypatch):
    """F6."""
    left, right = sides
    for strict in (False, True):
        even, crowded = both_ways(monkeypatch, lambda: counting.nearest(left, right, ["k"], strict=strict))
        assert even.dtypes == crowded.dtypes
        assert shuffles(even) <= 2 < shuffles(crowded)
    real = [y for y in rows(2, 90) if None not in y and y[1] <= y[2]]
    for r in counting.nearest(left, right, ["k"]).collect():
        x = (r.k, r.start, r.end)
        near = [(max(y[1] - x[2], x[1] - y[2], 0), y[1], y[2], y[3]) for y in real if None not in x and x[1] <= x[2] and y[0] == x[0]]
        assert (r.distance, r.r_start, r.r_end, r.r_id) == min(near, default=(None,) * 4)


def test_nearest_of_far_and_short_numbers(spark):
    far = 1 << 62
    b = spark.createDataFrame([("x", -far - 9, -far, 1), ("x", far, far + 9, 2)], KEYED)
    got = counting.nearest(spark.createDataFrame([("x", far + 20, far + 20, 0)], KEYED), b, ["k"]).first()
    assert (got.r_id, got.distance) == (2, 11)
    short = [x.select("k", F.col("start").cast("int"), F.col("end").cast("int")) for x in (spark.createDataFrame([("x", 1, 2, 0)], KEYED), spark.createDataFrame([("x", 7, 9, 0)], KEYED))]
    got = counting.nearest(*short, ["k"])
    assert dict(got.dtypes)["distance"] == "int" and got.first().distance == 5


def test_nearest_distance_in_one_shuffle_a_side(spark):
    """F9."""
    assert shuffles(queries.queries()["nearest_distance"](spark, SF)) <= 2


def test_sql_full_join_in_one_shuffle_a_side(spark):
    """F11."""
    got = queries.queries()["sql_full_join"](spark, SF)
    assert shuffles(got) <= 2
    session = IntervalSession(spark)
    left, right = (spark.createDataFrame(rows(seed, n), KEYED) for seed, n in ((1, 150), (2, 90)))
    left.createOrReplaceTempView("load_a")
    right.createOrReplaceTempView("load_b")
    for how in ("JOIN", "LEFT JOIN", "RIGHT JOIN", "FULL JOIN", "LEFT SEMI JOIN", "LEFT ANTI JOIN"):
        text = f"SELECT * FROM load_a a {how} load_b b ON a.k = b.k AND a.start <= b.end AND a.end > b.start AND (a.id + 1) % 5 > 0"
        assert bag(session.sql(text)) == bag(spark.sql(text)), how


@pytest.mark.parametrize("how", ["inner", "full", "left_semi", "left_anti"])
def test_joins_in_one_shuffle_a_side(spark, sides, monkeypatch, how):
    """F12 (full)."""
    compared(*sides, monkeypatch, how)


def compared(left, right, monkeypatch, how):
    for strict in (False, (True, False)):
        even, crowded = both_ways(monkeypatch, lambda: overlap.overlap_join(left, right, ["k"], how=how, strict=strict))
        assert even.columns == crowded.columns
        assert shuffles(even) <= 2 and (how == "inner" or shuffles(crowded) > 2)
    both_ways(monkeypatch, lambda: overlap.overlap_join(left, right, ["k"], how=how, condition=lambda p: p.l_id < p.r_id))
    both_ways(monkeypatch, lambda: overlap.overlap_join(left, left, ["k"], how=how, condition=lambda p: p.l_id < p.r_id))


@pytest.mark.parametrize("what", ["idxs", "values", "items", "keys"])  # F13, F14, F17, F19
def test_searches_in_one_shuffle_a_side(spark, sides, monkeypatch, what):
    searched(*sides, monkeypatch, what)


def searched(left, right, monkeypatch, what):
    for strict in (False, True):
        even, crowded = both_ways(monkeypatch, lambda: search.search_arrays(left, right, ["k"], value="id", what=what, strict=strict))
        assert even.dtypes == crowded.dtypes
        assert shuffles(even) <= 2 < shuffles(crowded)


def test_sql_three_tables_in_one_shuffle_a_table(spark):
    """F15."""
    got = queries.queries()["sql_three_tables"](spark, SF)
    assert shuffles(got) <= 3


@pytest.mark.parametrize("how", ["right"])
def test_right_join_in_one_shuffle_a_side(spark, sides, monkeypatch, how):
    """F16."""
    compared(*sides, monkeypatch, how)


@pytest.mark.parametrize("how", ["left"])
def test_left_join_in_one_shuffle_a_side(spark, sides, monkeypatch, how):
    """F18."""
    compared(*sides, monkeypatch, how)
