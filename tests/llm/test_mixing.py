import struct
from collections import defaultdict

import pytest
import xxhash
from conftest_llm import SF
from pyspark.sql import functions as F

from spanlake.llm import common, mixing, queries


def plain(cells, targets, rounds=3000):
    """Raking by loops: cells (source, lang, topic) to tokens; targets as shares by category."""
    w = {c: b for c, b in cells.items() if b > 0}
    total = sum(w.values())
    for _ in range(rounds):
        for axis in range(3):
            have = defaultdict(float)
            for c, v in w.items():
                have[c[axis]] += v
            w = {c: v * targets[axis].get(c[axis], 0.0) * total / have[c[axis]] for c, v in w.items() if have[c[axis]]}
    return {c: w.get(c, 0.0) / b if b else 0.0 for c, b in cells.items()}


def power(cells, axis, p):
    base = defaultdict(float)
    for c, b in cells.items():
        base[c[axis]] += b
    total = sum(b**p for b in base.values() if b)
    return {k: b**p / total for k, b in base.items() if b}


def cells_of(rows):
    cells = defaultdict(float)
    for r in rows:
        cells[r.source or "", r.lang or "", r.topic] += r.tokens
    return cells


def test_whole_table(spark):
    got = queries.op8_mixing_weights(spark, SF).collect()
    texts = {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()}
    assert len(got) == len(texts) and all(r.tokens == (texts[r.doc_id].replace("\n", " ").count(" ") + 1) for r in got)
    cells = cells_of(got)
    want = plain(cells, [power(cells, 0, 0.7), power(cells, 1, 0.85), power(cells, 2, 0.85)])
    top = max(want.values())
    for r in got:
        w = want[r.source, r.lang, r.topic]
        assert r.weight == pytest.approx(w, rel=1e-4) and r.probability == pytest.approx(w / top, rel=1e-4)
    assert all(r.sampled for r in got if r.probability >= 1) and 0.2 < sum(r.sampled for r in got) / sum(r.probability for r in got) < 5


def test_margins_and_given_shares(spark):
    rows = [(f"s{a}", f"l{b}", f"t{c}", float(10 + a * 7 + b * 3 + c * a)) for a in range(6) for b in range(3) for c in range(4)] + [("s9", "l0", "t0", 0.0), ("s8", "l9", "t0", 5.0)]
    targets = {"source": {"s0": 5.0, "s1": 1.0, "s2": 1.0, "s7": 3.0}, "lang": {"l0": 0.5, "l1": 0.25, "l2": 0.25}, "topic": 0.5}
    factors, fl, ft, top = mixing.rake(spark.createDataFrame(rows, "source string, lang string, topic string, base double"), targets)
    fs = {r.source: r.factor for r in factors.collect()}
    weigh = {r[:3]: r[3] * fs.get(r[0], 0) * fl.get(r[1], 0) * ft.get(r[2], 0) for r in rows}
    total = sum(weigh.values())

    def share(axis):
        out = defaultdict(float)
        for c, v in weigh.items():
            out[c[axis]] += v / total
        return out

    assert share(0)["s0"] == pytest.approx(5 / 7) and share(0)["s3"] == 0
    assert share(1)["l0"] == pytest.approx(0.5, rel=1e-6) and share(1)["l9"] == 0
    base = {k: sum(r[3] for r in rows if r[2] == k) for k in ("t0", "t3")}
    assert share(2)["t3"] / share(2)["t0"] == pytest.approx((base["t3"] / base["t0"]) ** 0.5, rel=1e-6)
    assert top == pytest.approx(max(v / r[3] for r, v in zip(rows, weigh.values()) if r[3]))


@pytest.mark.parametrize("limit", [0, 100])
def test_odd_rows(spark, odd, limit, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    docs = odd.union(spark.createDataFrame([(None, "no id", None, None, 5, "", 1)], odd.schema))
    got = mixing.weights(docs)
    assert got.count() == docs.count()
    assert got.filter("probability is null or probability < 0 or probability > 1 or sampled is null").count() == 0
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and kept.count() == got.filter("sampled").count()


def test_no_rows(spark, none):
    assert mixing.weights(none).count() == 0 and mixing.sample(none).count() == 0


def test_uniform_numbers(spark):
    got = spark.range(3000).select("id", mixing.uniform(F.col("id")).alias("u")).collect()
    assert all(r.u == (xxhash.xxh64_intdigest(struct.pack("<q", r.id), 42) >> 11) * 2.0**-53 for r in got)
    assert abs(sum(r.u for r in got) / 3000 - 0.5) < 0.03


def test_no_python_on_the_main_path(spark):
    for df in (mixing.weights(common.table(spark, SF, "documents")), mixing.sample(common.table(spark, SF, "documents"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_token_counts_are_words(spark):
    some = [None, "", " ", "\n \t\r\n", "a", "a  b", " a b ", "a\n\nb\tc", "x" + " " * 5000 + "y", " ".join("ab" * 3)]
    got = spark.createDataFrame(list(enumerate(some)), "i int, t string").select("i", mixing.token_count(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: len((t or "").split()) for i, t in enumerate(some)}


def test_margins_that_conflict_are_told(spark):
    cells = spark.createDataFrame([("a", "x", "p", 1.0), ("b", "y", "p", 1.0)], "source string, lang string, topic string, base double")
    with pytest.warns(UserWarning, match="margins"):
        mixing.rake(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}, "topic": 1.0}, rounds=3)
