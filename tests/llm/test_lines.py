import random
import time

import numpy as np
from conftest_llm import SF, rows

from spanlake.llm import common, lines, queries


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    k = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
    return a[k + 1 :] == (b[k:] if len(a) > len(b) else b[k + 1 :])


def brute(docs, least=12):
    """docs in order, ids all different."""
    seen, out = {}, []
    for i, t in docs:
        if t is None:
            out.append((i, None))
            continue
        keep = []
        for x in t.split("\n"):
            if not x.strip(" "):
                keep.append(x)
                continue
            near = x in seen or len(x) >= least and any(within_one(x, y) for n in (-1, 0, 1) for y in seen.get(len(x) + n, ()) if len(y) >= least)
            seen.setdefault(len(x), set()).add(x)
            seen[x] = True
            if not near:
                keep.append(x)
        out.append((i, "\n".join(keep)))
    return out


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").orderBy("doc_id").collect()]
    got = queries.op3_line_dedup(spark, SF)
    assert rows(got, "doc_id", "text") == brute(docs)
    assert got.filter("n_chars != length(text)").count() == 0


def test_odd_rows(spark, odd):
    got = lines.line_dedup(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    texts = {r.doc_id: r.text for r in got.collect()}
    want = dict(brute(sorted({(r.doc_id, r.text) for r in odd.collect()}, key=lambda r: r[0])))
    assert texts == want
    ids = spark.createDataFrame([(None, "same line of a text\nx"), (None, "same line of a text\ny"), (3, "same line of a text")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in lines.line_dedup(ids).collect()) == [("3", "same line of a text"), ("None", "x"), ("None", "y")]


def test_no_rows(spark, none):
    assert lines.line_dedup(none).count() == 0


def test_random_lines_of_few_letters(spark):
    """Dense neighbourhoods: many lines share variants, at equal and other places, with runs of one letter."""
    rng, docs = random.Random(5), []
    for i in range(150):
        docs.append((i, "\n".join("".join(rng.choice("aab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(5)))))
    long = ["".join(rng.choice("abcdefgh é漢\U0001f600") for _ in range(40)) for _ in range(30)]
    for i in range(150, 400):
        x = list(rng.choice(long))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(x))
            x[k : k + rng.randrange(2)] = rng.choice(["", "z", "q"])
        docs.append((i, "".join(x)))
    for least in (1, 6, 12):
        got = lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), min_chars=least)
        assert rows(got, "doc_id", "text") == brute(docs, least)


def test_many_lines_in_one_document(spark):
    text = "\n".join(f"line {k % 300} of it" for k in range(1000)) + "\n"
    got = lines.line_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string"), min_chars=100).first().text
    assert got == "\n".join(f"line {k} of it" for k in range(300)) + "\n"


def test_disk_is_freed_on_the_way(spark):
    """The steps leave no shuffle files, and of their tables only the masks that the result reads."""
    env, path = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(common.shared_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def shuffled():
        files = env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in files if "/shuffle_" in f}

    def tables():
        return {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()

    docs = common.table(spark, SF, "documents")
    files, written = shuffled(), tables()
    got = lines.line_dedup(docs)
    end = time.time() + 20
    while shuffled() - files and time.time() < end:  # they go in the background
        time.sleep(0.2)
    assert not shuffled() - files
    assert [t.split("-")[0] for t in tables() - written] == ["stay"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert got.count() == docs.count()


def test_variants():
    some = ["abcd", "x", "aa", "é漢c"]
    line, place, key = lines.variants(some)
    want = [(n, p, x if p < 0 else x[:p] + x[p + 1 :]) for n, x in enumerate(some) for p in range(-1, len(x))]
    got = {(int(a), int(b)): int(c) for a, b, c in zip(line, place, key)}
    assert len(got) == len(want) == len(line)
    by_text = {}
    for n, p, x in want:
        by_text.setdefault(x, set()).add(got[n, p])
    assert all(len(v) == 1 for v in by_text.values()) and len({v for s in by_text.values() for v in s}) == len(by_text)
    assert key.dtype == np.uint64
