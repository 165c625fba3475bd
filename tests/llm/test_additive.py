import numpy as np
import pytest
from conftest_llm import SF
from pyspark.sql import functions as F

from spanlake.llm import additive, common, queries


def brute(rows, asked, k, metric="ip"):
    rows = [(i, np.array(v, "f8")) for i, v in rows]
    out = {}
    for i, q in rows:
        if asked(i):
            scores = sorted((-float((v * q).sum() if metric == "ip" else -((v - q) ** 2).sum()), j) for j, v in rows if j != i)
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def taken(df, name="id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r[name], r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in w}) for i, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in common.table(spark, sf, "embeddings").collect()]
    want = brute(rows, lambda i: i % 20 == 0, 20)
    got = taken(queries.op1_additive_quantisation(spark, sf), "vec_id")
    assert set(got) == set(want) and all(len(g) == len(want[i]) for i, g in got.items())
    assert recall(got, want) >= 0.95
    exact = {(i, j): s for i, w in brute(rows, lambda i: i % 20 == 0, len(rows)).items() for j, s in w}
    assert all(abs(exact[i, j] - s) < 1e-12 for i, g in got.items() for j, s in g)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_recall_beyond_one_strip(spark, metric):
    rng = np.random.default_rng(1)
    rows = [(i, (v * rng.uniform(0.5, 2)).tolist()) for i, v in enumerate(rng.normal(size=(3000, 24)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    s = additive.Settings(strip=700, queries=40, rerank=120)
    assert recall(taken(additive.search(df, F.col("vec_id") % 20 == 0, 20, metric, s)), brute(rows, lambda i: i % 20 == 0, 20, metric)) >= 0.9


def test_recall_at_the_production_ratio(spark):
    """400 of the 8,192 rows of a strip are reranked; more strips only add candidates."""
    rng = np.random.default_rng(4)
    n = additive.Settings().strip
    v = rng.normal(size=(n, 32)) * rng.uniform(0.5, 2, size=(n, 1))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = taken(additive.search(df, F.col("vec_id") % 200 == 0))
    want = {}
    for i in range(0, n, 200):
        score = v @ v[i]
        score[i] = -np.inf
        want[i] = [(int(j), score[j]) for j in np.argsort(-score)[:20]]
    assert recall(got, want) >= 0.9


def test_odd_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100, 180)] + [(0, [1.0, 0.0, 0.0]), (20, [0.0, 0.5, 0.5]), (20, [0.0, 0.5, 0.5]), (7, [1.0, 2.0, 3.0])]
    bad = [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 2.0]), (40, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (60, [1.0, 2.0]), (None, [9.0, 9.0, 9.0]), (8, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + bad], "vec_id long, embedding array<double>, id int, score string")
    got = taken(additive.search(df, F.col("vec_id") % 20 == 0, 5, settings=additive.Settings(strip=30, rerank=6)))
    want = brute(rows, lambda i: i % 20 == 0, 5)
    assert got == want and got[100][0] == (7, 14.0) and got[0] == [(7, 1.0), *((i, 1.0) for i in range(100, 104))]


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert taken(additive.search(df, F.col("vec_id") == 0, 20)) == {0: [(3, 4.0)]}
    assert additive.search(df.filter("vec_id = 3"), F.col("vec_id") == 3, 20).count() == 0
    assert additive.search(df.limit(0), F.col("vec_id") == 0, 20).count() == 0


def test_beam_search_is_no_worse_than_greedy():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    q = additive.Quantiser.train(x, additive.Settings(books=4, words=16, rounds=5))
    error = [((x - q.decode(q.encode(x, b))) ** 2).sum() for b in (1, 8)]
    assert error[1] < error[0] < (x**2).sum()
