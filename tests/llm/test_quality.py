import math

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import SF
from pyspark.sql import functions as F

from spanlake.llm import common, quality, queries


def test_held_out_accuracy(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    fitted = labels.filter("doc_id % 3 > 0")
    got = quality.classify(docs, fitted).join(labels.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    bad = (got.quality == 0) | (got.toxic == 1)
    assert len(got) > 1000 and (got.keep[~bad]).mean() > 0.995 and (~got.keep[bad]).mean() > 0.9


def test_whole_table(spark):
    got = queries.op4_quality_classifier(spark, SF)
    assert got.count() == 200 and got.columns == ["doc_id", "p_low_quality", "p_toxic", "keep"]
    assert got.filter("p_toxic between 0 and 1 and p_low_quality between 0 and 1").count() == 200


def plain(rows, priors):
    """The same by loops: rows of host, path, e0, e1."""
    out = [[0.0, 0.0] for _ in rows]
    for k in (0, 1):
        r = [1 / (1 + math.exp(-(x[2 + k] + priors[k]))) for x in rows]
        share = (sum(r) + 0.5) / (len(r) + 1)
        host, path = {}, {}
        for x, v in zip(rows, r):
            for site, key in ((host, x[0]), (path, (x[0], x[1]))):
                n, s = site.get(key, (0, 0.0))
                site[key] = (n + 1, s + v)

        def strength(sites):
            total = sum(n for n, _, _ in sites)
            mean = sum(n * t for n, _, t in sites) / total
            spread = sum(n * (s / n - t) ** 2 for n, s, t in sites) / total
            within = sum(n * t * (1 - t) for n, _, t in sites) / total
            extra = spread - within * len(sites) / total
            return min(max(mean * (1 - mean) / max(extra, 1e-9) - 1, 1.0), 1e6)

        kh = strength([(n, s, share) for n, s in host.values()])
        kp = strength([(n, s, (host[h][1] + kh * share) / (host[h][0] + kh)) for (h, _), (n, s) in path.items()])
        for j, (x, v) in enumerate(zip(rows, r)):
            (hn, hs), (n, s) = host[x[0]], path[x[0], x[1]]
            top = (hs - v + kh * share) / (hn - 1 + kh)
            prior = min(max((s - v + kp * top) / (n - 1 + kp), 1e-4), 1 - 1e-4)
            out[j][k] = 1 / (1 + math.exp(-(x[2 + k] + math.log(prior / (1 - prior)))))
    return out


@pytest.mark.parametrize("limit", [0, 100])
def test_posteriors_against_loops(spark, limit):
    rng = np.random.default_rng(4)
    rows = [(f"h{h}", f"p{rng.integers(3)}", float(rng.normal(-2 + h, 2)), float(rng.normal(0, 1))) for h in (0, 0, 0, 0, 1, 2, 3, 4) for _ in range(rng.integers(1, 30))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, host string, path string, e0 double, e1 double")
    got = quality.posteriors(df, [-1.5, -0.5], limit).orderBy("i").collect()
    assert np.allclose([[g.p0, g.p1] for g in got], plain(rows, [-1.5, -0.5]), rtol=1e-6)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (7, 1, 0), (1, 0, 1), (None, 0, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels)
    assert got.count() == odd.count() and got.filter("p_toxic is null or p_low_quality is null").count() == 0
    kept = quality.quality_filter(odd, labels)
    assert kept.columns == odd.columns and kept.count() == got.filter("keep").count()
    assert quality.classify(odd, labels.limit(0)).filter("keep").count() == odd.count()
    assert quality.classify(odd.drop("source").withColumn("source", F.lit(None).cast("string")), labels).count() == odd.count()


def test_no_rows(spark, none):
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(none, labels).count() == 0 and quality.quality_filter(none, labels).count() == 0


def test_long_texts_are_read_whole(monkeypatch):
    text = " ".join(f"word{k % 97} x" for k in range(3000)) + " last"
    want = quality.features([text, None, "a b"])
    monkeypatch.setattr(quality, "PIECE", 50)
    got = quality.features([text, None, "a b"])
    assert sorted(zip(got[0], got[1])) == sorted(zip(want[0], want[1])) and np.allclose(got[2], want[2])


def test_labels_that_differ_are_settled(spark, monkeypatch):
    """The worse label of an id counts, and repeated documents of an id are fitted on once."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda row, slot, shape, bad: seen.append(bad.tolist()))
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (2, "d e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    quality.train(docs, labels)
    assert [sorted(x) for x in seen] == [[False, True], [False, True]]


def test_a_batch_is_read_in_small_parts(monkeypatch):
    """What a worker makes at once follows a bounded run of texts, not the batch; every row is there, in order, with the same values."""
    texts = [None, "", *(f"word{k} Other{k % 7} 12 | " * (1 + k % 90) for k in range(2_000)), "long " * 200_000, None]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(list(range(n)), pa.int32()), pa.array(texts)], names=["__q", "__t", "__x"])
    whole, sizes = quality.features(texts), []
    plain = quality.features
    monkeypatch.setattr(quality, "features", lambda some: sizes.append((len(some), sum(len(t or "") for t in some))) or plain(some))
    got = [r for b in quality._lean(iter([batch])) for r in b.to_pylist()]
    assert max(size for k, size in sizes if k > 1) <= 1 << 19 and sum(k for k, _ in sizes) == n
    assert [r["t"] for r in got] == list(range(n))
    assert b"".join(r["shape"] for r in got) == whole[2].astype("<f8").tobytes()
    pairs = np.unique(whole[0] * quality.SLOTS + whole[1])
    assert b"".join(r["slots"] for r in got) == (pairs % quality.SLOTS).astype("<i4").tobytes()
