"""Golden tables, boundaries, interval maps, random intervals against plain joins, SQL, sources and streams."""

import io
import random
import sys

import pytest
from pyspark.sql import functions as F

from spanlake import __main__ as cli
from spanlake.functions import columns as fn
from spanlake.operators import counting, overlap, search
from spanlake.operators.interval_map import IntervalMap
from spanlake.plans.recogniser import recognise_text
from spanlake.plans.session import ALGORITHMS, IntervalSession, columns_ddl, statements
from spanlake.sources import readers
from spanlake.streaming.overlap import stream_overlap

#: The golden tables.
READS = [(c, s, e) for c in ("chr1", "chr2") for s, e in ((150, 250), (190, 300), (300, 501 if c == "chr1" else 500), (500, 700), (22000, 22300), (15000, 15000))]
TARGETS = [(c, s, e) for c in ("chr1", "chr2") for s, e in ((100, 190), (200, 290), (400, 600), (10000, 20000), (22100, 22100))]
EDGES = [(11, 15), (10, 15), (10, 10), (9, 15), (5, 15), (4, 15), (4, 10), (6, 8), (4, 8), (4, 5), (5, 5), (4, 4)]
P = ("pos_start", "pos_end")


@pytest.fixture(scope="module")
def golden(spark):
    kind = "contig string, pos_start int, pos_end long"
    return spark.createDataFrame(READS, kind), spark.createDataFrame(TARGETS, kind)


@pytest.fixture(scope="module")
def edges(spark):
    kind = "contig string, start int, end int"
    return spark.createDataFrame([("a", 5, 10)], kind), spark.createDataFrame([("a", *e) for e in EDGES], kind)


@pytest.mark.parametrize("algorithm, size", [("auto", None), ("coitrees", 50), ("lapper", 5000), ("native", None)])
def test_golden_pairs(golden, algorithm, size):
    a, b = golden
    assert overlap.overlap_join(a, b, ["contig"], P, P, binning=size, algorithm=algorithm).count() == 16
    assert overlap.overlap_join(a, b, None, P, P, binning=size, algorithm=algorithm).count() == 32


@pytest.mark.parametrize("strict, want", [(False, [e for e in EDGES if e not in ((11, 15), (4, 4))]), (True, [(9, 15), (5, 15), (4, 15), (4, 10), (6, 8), (4, 8)])])
def test_boundaries(spark, edges, strict, want):
    a, b = edges
    got = overlap.overlap_join(a, b, ["contig"], strict=strict)
    assert sorted((r.r_start, r.r_end) for r in got.collect()) == sorted(want)
    a.createOrReplaceTempView("ea")
    b.createOrReplaceTempView("eb")
    s, (lt, gt) = IntervalSession(spark), ("<", ">") if strict else ("<=", ">=")
    on = f"a.contig = b.contig AND a.start {lt} b.end AND a.end {gt} b.start"
    swapped = f"b.contig = a.contig AND b.end {gt} a.start AND b.start {lt} a.end"
    for text in (f"SELECT b.start, b.end FROM ea a JOIN eb b ON {on}", f"SELECT b.start, b.end FROM eb b JOIN ea a ON {on}", f"SELECT b.start, b.end FROM ea a, eb b WHERE {on}", f"SELECT b.start, b.end FROM eb b, ea a WHERE {swapped}"):
        assert s.explain(text).startswith("IntervalJoin: algorithm=auto")
        assert sorted(map(tuple, s.sql(text).collect())) == sorted(want)


def test_nearest_golden(spark):
    kind = "contig string, strand string, start int, end int"
    spark.createDataFrame([("a", "s", 5, 10)], kind).createOrReplaceTempView("na")
    spark.createDataFrame([("a", "s", 11, 13), ("a", "s", 20, 21), ("a", "x", 0, 1), ("b", "s", 1, 2)], kind).createOrReplaceTempView("nb")
    s = IntervalSession(spark)
    s.sql("SET spanlake.interval_join_algorithm TO CoitreesNearest")
    got = s.sql("SELECT * FROM na JOIN nb ON na.contig = nb.contig AND na.strand = nb.strand AND na.start < nb.end AND na.end > nb.start")
    s.sql("SET spanlake.interval_join_algorithm TO auto")
    assert got.columns == ["contig", "strand", "start", "end"] * 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "s", 5, 10, "a", "s", 11, 13), ("a", "s", 5, 10, "a", "s", 20, 21), (None,) * 4 + ("a", "x", 0, 1), (None,) * 4 + ("b", "s", 1, 2)], key=str)


def test_wide_coordinates(spark):
    a = spark.createDataFrame([("a", 1, 2), ("b", 1, 4)], "contig string, start long, end long")
    b = spark.createDataFrame([("a", 1, 2), ("b", 3, 2147483648), ("c", -(2**62), 2**62)], "contig string, start long, end long")
    assert overlap.overlap_join(a, b, ["contig"]).count() == 2
    assert overlap.overlap_join(a, b).count() == 5


def test_projections(spark):
    spark.createDataFrame([("a", 1, 2)], "contig string, start int, end int").createOrReplaceTempView("pa")
    s = IntervalSession(spark)
    for what in ("*", "a.*", "b.*", "b.start, a.end, b.end"):
        assert s.sql(f"SELECT {what} FROM pa a JOIN pa b ON a.contig = b.contig AND a.start <= b.end AND a.end >= b.start").count() == 1


def test_recogniser(spark):
    a, b = {"a"}, {"b"}
    want = ["a.l_start", "a.l_end", "b.r_start", "b.r_end"]
    for lo in ("a.l_start <= b.r_end", "b.r_end >= a.l_start"):
        for hi in ("a.l_end >= b.r_start", "b.r_start <= a.l_end"):
            for text in (f"{lo} AND {hi}", f"{hi} AND {lo}", f"a.contig = b.contig AND {lo} AND {hi} AND a.x <> b.y"):
                for t in (text, text.replace("<=", "<").replace(">=", ">")):
                    assert recognise_text(spark, t, a, b).bounds() == want
    assert recognise_text(spark, "a.l_start <= b.r_end OR a.l_end >= b.r_start", a, b) is None
    assert recognise_text(spark, "a.l_start <= b.r_end", a, b) is None
    assert recognise_text(spark, "(b.r_end - a.l_start) >= a.l_start AND a.l_end >= b.r_start", a, b) is None
    assert recognise_text(spark, "a.l_start <= b.r_end AND a.l_start <= b.r_start AND a.l_end >= b.r_start", a, b) is None
    assert recognise_text(spark, "a.l_start + 1 <= b.r_end AND a.l_end >= b.r_start", a, b).left_start.sql() == "(a.l_start + 1)"


def random_rows(rng, n):
    out = []
    for i in range(n):
        s = rng.choice([rng.randrange(-60, 60), 3, rng.randrange(-60, 60) * 10])
        e = s + rng.choice([0, 0, 1, 4, 40, 700, -3 if rng.random() < 0.3 else 2])
        out.append((rng.choice(["a", "a", "b", "c", None]), None if rng.random() < 0.05 else s, None if rng.random() < 0.05 else e, i % 9))
    return out + out[:10] + [("a", -(10**6), 10**9, 1)]


@pytest.mark.parametrize("seed", range(1))
def test_random_against_plain_joins(spark, seed):
    """Nested, repeated, empty, reversed, negative, null and very long intervals."""
    rng, kind = random.Random(seed), "k string, start long, end long, v int"
    ra, rb = random_rows(rng, 120), random_rows(rng, 130)
    a, b = spark.createDataFrame(ra, kind), spark.createDataFrame(rb, kind)
    a.createOrReplaceTempView("ra")
    b.createOrReplaceTempView("rb")
    both = ", ".join(f"{t}.{c} {p}_{c}" for t, p in (("a", "l"), ("b", "r")) for c in a.columns)
    show = lambda df: sorted(str(tuple(r)) for r in df.collect())
    for strict in (False, True):
        lt, gt = ("<", ">") if strict else ("<=", ">=")
        on = f"a.k = b.k AND a.start {lt} b.end AND a.end {gt} b.start"
        for how in ("inner", "left", "right", "full"):
            assert show(overlap.overlap_join(a, b, ["k"], how=how, strict=strict, binning=rng.choice([None, 1, 7, 100]))) == show(spark.sql(f"SELECT {both} FROM ra a {how} JOIN rb b ON {on}")), how
        for how in ("semi", "anti"):
            assert show(overlap.overlap_join(a, b, ["k"], how=how, strict=strict)) == show(spark.sql(f"SELECT * FROM ra a LEFT {how} JOIN rb b ON {on}")), how
    real = [r for r in rb if None not in r[:3] and r[1] <= r[2]]
    met = lambda q, r, s: q[0] == r[0] and None not in q[:3] and q[1] <= q[2] and (q[1] < r[2] and q[2] > r[1] if s else q[1] <= r[2] and q[2] >= r[1])
    for strict in (False, True):
        want = sorted(str((*q, sum(met(q, r, strict) for r in real))) for q in ra)
        assert show(counting.count_overlaps(a, b, ["k"], strict=strict)) == want
    assert show(counting.coverage_sum(a, b, ["k"])) == sorted(str((*q, sum(met(q, r, False) for r in real), sum(min(q[2], r[2]) - max(q[1], r[1]) for r in real if met(q, r, False)))) for q in ra)
    covered = lambda q: len({p for r in real if met(q, r, False) for p in range(max(q[1], r[1], -2000), min(q[2], r[2], 9000) + 1)})
    small = a.filter("v > 1 or v is null").filter("end < 9000 or end is null")
    got = {str(tuple(r)[:4]): r.covered for r in counting.coverage_union(small, b.filter("end < 9000"), ["k"]).collect()}
    real = [r for r in real if r[2] < 9000]
    assert got == {str(q): covered(q) for q in ra if str(q) in got}
    for r in counting.nearest(a, b.filter("end < 9000"), ["k"]).collect():
        some = [x for x in real if x[0] == r.k] if None not in (r.k, r.start, r.end) and r.start <= r.end else []
        best = min(((max(0, x[1] - r.end, r.start - x[2]), x[1], x[2], x[0], x[3]) for x in some), default=None)
        assert best == (None if r.r_start is None else (r.distance, r.r_start, r.r_end, r.r_k, r.r_v))
    assert show(search.contained_in(a, b, ["k"])) == show(spark.sql(f"SELECT {both} FROM ra a JOIN rb b ON a.k = b.k AND a.start >= b.start AND a.end <= b.end AND a.start <= b.end"))
    assert counting.merge_intervals(a, ["k"]).agg(F.sum("n")).first()[0] == sum(None not in r[:3] and r[1] <= r[2] for r in ra)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, start long, end long")
    one = spark.createDataFrame([("a", 1, 2)], none.schema)
    for a, b in ((none, one), (one, none), (none, none)):
        assert [overlap.overlap_join(a, b, ["k"], how=h).count() for h in ("inner", "left", "full", "anti")] == [0, a.count(), a.count() + b.count(), a.count()]
        assert counting.count_overlaps(a, b, ["k"]).filter("n_overlaps > 0").count() == 0
        assert counting.nearest(a, b, ["k"]).filter("r_start is not null").count() == 0
        assert counting.coverage_union(a, b, ["k"]).count() == a.count() and search.search_arrays(a, b, ["k"]).count() == a.count()
    assert counting.merge_intervals(none, ["k"]).count() == 0 and search.with_index(none, ["k"]).count() == 0


#: Intervals of the map cases with a question and how many it meets.
CASES = [
    ([(10, 20), (11, 12), (13, 14), (15, 16), (25, 29)], (17, 30), 2),
    ([(0, 250000), *((k * 500, k * 500 + 1000) for k in range(17))], (1377, 2377), 5),
    ([(1, 6100000), (3, 4), (5, 6), (7, 8), (20, 30)], (2, 25), 5),
    ([(1, 100), (10, 12)], (50, 60), 1),
    ([], (1, 5), 0),
]


@pytest.mark.parametrize("some, asked, n", CASES)
def test_interval_map(spark, some, asked, n):
    m = IntervalMap.from_arrays(spark, [s for s, _ in some], [e for _, e in some], list(range(len(some))))
    hits = sorted(((s, e, i) for i, (s, e) in enumerate(some) if s <= asked[1] and e >= asked[0]), key=lambda x: (x[0], -x[1], x[2]))
    assert m.count(*asked) == n == len(hits) and m.has_overlaps(*asked) == bool(n)
    assert m.search_items(*asked) == hits and m.search_keys(*asked) == [h[:2] for h in hits] and m.search_values(*asked) == [h[2] for h in hits]
    assert m.coverage(*asked) == (n, sum(min(e, asked[1]) - max(s, asked[0]) for s, e, _ in hits))
    assert [m.at(i) for i in m.search_idxs(*asked)] == hits and list(m.search_iter(*asked)) == hits
    q = spark.createDataFrame([asked], "start long, end long")
    assert m.count_batch(q).first()["count"] == n and m.search_batch(q).first().found == [h[2] for h in hits]
    assert list(m.idxs_iter(*asked)) == m.search_idxs(*asked) and list(m.keys_iter(*asked)) == m.findKeys(*asked) and list(m.values_iter(*asked)) == m.findOverlaps(*asked)
    assert m.add(*asked, 99).size() == len(some) + 1 and m.clear().size() == 0


def test_interval_map_arrays_differ(spark):
    with pytest.raises(ValueError):
        IntervalMap.from_arrays(spark, [1], [2, 3])


def test_settings(spark):
    s = IntervalSession(spark)
    for name in ALGORITHMS:
        s.sql(f"SET spanlake.interval_join_algorithm = {name.upper()}")
        assert s.get("interval_join_algorithm") == name
    with pytest.raises(ValueError):
        s.sql("SET spanlake.interval_join_algorithm TO nestedloops")
    s.sql("SET spanlake.interval_join_algorithm TO auto")
    s.sql("SET spanlake.interval_join_low_memory TO true")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    s.sql("SET spanlake.interval_join_low_memory TO false")
    s.sql("SET spanlake.prefer_interval_join TO false")
    assert "IntervalJoin" not in s.explain("SELECT 1 FROM range(3) a JOIN range(3) b ON a.id <= b.id AND a.id + 1 >= b.id")
    s.sql("SET spanlake.prefer_interval_join TO true")
    assert s.sql("SHOW spanlake.prefer_interval_join").first().value == "true"


def test_script_and_sources(spark, golden, tmp_path, capsys, monkeypatch):
    a, b = golden
    a.toPandas().to_csv(tmp_path / "a.csv", index=False)
    b.toPandas().to_csv(tmp_path / "b.tsv", index=False, header=False, sep="\t")
    (tmp_path / "t.bed").write_text("track name=x\n#c\nchr1\t10\t20\nchr1\t5\t5\nchr1\t-1\t4\nchr2\t0\t1\nchr2\t9\t3\n")
    b.write.parquet(str(tmp_path / "b.parquet"))
    text = f"""-- overlaps; of two tables
    CREATE EXTERNAL TABLE fa STORED AS CSV LOCATION '{tmp_path}/a.csv' OPTIONS ('format.has_header' 'true');
    CREATE EXTERNAL TABLE fb (contig VARCHAR NOT NULL, pos_start BIGINT NOT NULL, pos_end BIGINT NOT NULL) STORED AS CSV LOCATION '{tmp_path}/b.tsv' OPTIONS ('delimiter' '\\t', 'format.has_header' 'false');
    CREATE EXTERNAL TABLE fp STORED AS PARQUET LOCATION '{tmp_path}/b.parquet';
    CREATE TABLE empty_one (contig TEXT, start INT);
    SELECT count(1) AS n FROM fa a JOIN fb b ON a.contig = b.contig AND a.pos_start <= b.pos_end AND a.pos_end >= b.pos_start;
    SELECT count(1) AS n FROM fa a, fp b WHERE a.pos_start <= b.pos_end AND a.pos_end >= b.pos_start"""
    assert len(list(statements(text))) == 6
    results = list(IntervalSession(spark).script(text))
    assert [r.first().n for r in results[-2:]] == [16, 32] and spark.table("empty_one").count() == 0
    assert sorted(map(tuple, readers.read_bed(spark, str(tmp_path / "t.bed")).collect())) == [("chr1", 10, 19), ("chr2", 0, 0)]
    assert readers.read_bed(spark, str(tmp_path / "t.bed"), half_open=False, contigs=["chr1"]).count() == 2
    readers.write_sorted(b, str(tmp_path / "s.parquet"), ["contig"], "pos_start")
    assert readers.read_parquet(spark, str(tmp_path / "s.parquet")).count() == 10
    (tmp_path / "q.sql").write_text(text)
    assert cli.main(["--file", str(tmp_path / "q.sql")]) == 0 and "|16" in capsys.readouterr().out.replace(" ", "")
    monkeypatch.setattr(sys, "stdin", io.StringIO("SELECT 41 + 1 AS x;"))
    assert cli.main([]) == 0 and "42" in capsys.readouterr().out
    assert columns_ddl("a VARCHAR NOT NULL, b INT64") == "a string NOT NULL, b bigint"


def test_stream(spark, golden, tmp_path):
    a, b = golden
    a.write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    q = stream_overlap(rows, b, ["contig"], P, P, size=100).writeStream.format("memory").queryName("stream_pairs").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stream_pairs").count() == 16


def test_column_functions(spark):
    a = [F.lit(x) for x in (5, 10, 8, 20)]
    got = spark.range(1).select(fn.overlaps(*a), fn.overlap_length(*a), fn.overlap_span(*a), fn.interval_distance(*a), fn.contains(*a), fn.contains_point(F.lit(5), F.lit(10), F.lit(10)), fn.date_position(F.lit("1970-01-11").cast("date")), fn.time_position(F.lit("1970-01-01 00:00:01").cast("timestamp"))).first()
    assert tuple(got) == (True, 3, 2, 0, False, True, 10, 1000000)
    assert spark.range(1).select(fn.interval_distance(*[F.lit(x) for x in (1, 2, 7, 8)])).first()[0] == 5


def test_package_does_not_need_llm():
    import pathlib

    import spanlake

    root = pathlib.Path(spanlake.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "spanlake.llm" in p.read_text()]


def test_counting_algorithm_is_refused(spark):
    """Not accepted and then answered with overlap pairs."""
    with pytest.raises(ValueError, match="count_overlaps"):
        IntervalSession(spark).set("interval_join_algorithm", "CoitreesCountOverlaps")
    session = IntervalSession(spark)
    before = session.get("interval_join_algorithm")
    spark.conf.set("spanlake.interval_join_algorithm", "coitreescountoverlaps")
    try:
        with pytest.raises(ValueError, match="count_overlaps"):
            session.sql("SELECT 1 AS x")
    finally:
        spark.conf.set("spanlake.interval_join_algorithm", before)


def test_prompt(spark, monkeypatch, capsys):
    lines = iter(["", "SELECT", "40 + 2 AS x;", "SELECT nothing_like_it;", "SELECT 7 AS y; SELECT 8 AS z;", "quit"])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    monkeypatch.setattr(sys.stdin, "isatty", lambda: True, raising=False)
    assert cli.main([]) == 0
    out = capsys.readouterr().out
    assert all(f"|{x} " in out for x in (42, 7, 8)) and "nothing_like_it" in out


def test_functions_in_sql(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf, udtf

    @pandas_udf("long")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    @udtf(returnType="p: long")
    class Positions:
        def eval(self, s: int, e: int):
            for p in range(s, e + 1):
                yield (p,)

    s = IntervalSession(spark)
    s.register("twice", twice)
    s.register("positions", Positions)
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION thrice(x BIGINT) RETURNS BIGINT RETURN 3 * x")
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION pieces(n BIGINT) RETURNS TABLE (k BIGINT) RETURN SELECT explode(sequence(1L, n))")
    got = s.sql("SELECT twice(4), thrice(4), overlap_length(1, 5, 4, 9), interval_distance(1, 2, 6, 7), contains_point(1, 5, 6)").first()
    assert tuple(got) == (8, 12, 2, 4, False)
    assert [r.p for r in s.sql("SELECT p FROM positions(3, 5) ORDER BY p").collect()] == [3, 4, 5]
    assert s.sql("SELECT sum(k) AS n FROM pieces(4)").first().n == 10


def test_windowed_stream(spark, tmp_path):
    from spanlake.streaming.overlap import windowed_overlaps

    rows = [(f"2024-01-01 00:{m:02d}:00", "c", m * 10, m * 10 + 15) for m in range(0, 60, 7)]
    a = spark.createDataFrame(rows, "t string, contig string, start long, end long").selectExpr("cast(t as timestamp) as ts", "contig", "start", "end")
    b = spark.createDataFrame([("c", s, s + 40) for s in range(0, 600, 50)], "contig string, start long, end long")
    a.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))
    options = dict(on=["contig"], window="20 minutes", late="5 minutes", by=["l_contig"], size=100)
    q = windowed_overlaps(stream, b, **options).writeStream.format("memory").queryName("windowed_pairs").option("checkpointLocation", str(tmp_path / "c")).outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, windowed_overlaps(a, b, **options).collect()))
    assert sorted(map(tuple, spark.table("windowed_pairs").collect())) == want and len(want) == 3
    assert sum(r[-1] for r in want) == sum(s <= y + 40 and e >= y for _, _, s, e in rows for y in range(0, 600, 50))
