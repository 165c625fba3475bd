import hashlib
import random
import re

import pytest
from conftest_llm import SF, rows

from spanlake.llm import common, queries, substrings


def brute(docs, size=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - size + 1):
                g = tuple(w[k : k + size])
                least[g] = min(least.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - size + 1):
                if least[tuple(w[k : k + size])] < i:
                    gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def taken(df):
    return sorted(rows(df, "doc_id", "n_words", "n_removed", "kept"), key=str)


def hashed(df):
    return sorted([(i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in rows(df, "doc_id", "n_words", "n_removed", "kept")], key=str)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    got = sorted(rows(queries.op6_substring_dedup(spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256"), key=str)
    want = brute(docs)
    assert got == want and sum(w[2] for w in want) > 1000


def test_odd_rows(spark, odd):
    docs = odd.union(spark.createDataFrame([(None, "word " * 20, "en", "a", 5, "", 1), (14, None, "", "", 0, "", 1)], odd.schema))
    assert hashed(substrings.substring_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_no_rows(spark, none):
    assert substrings.substring_dedup(none).count() == 0


@pytest.mark.parametrize("size", [6, 13])
def test_random_texts_in_small_blocks(spark, size, monkeypatch):
    """Few words, so phrases recur within and across documents and blocks, and hash pieces cut words."""
    rng = random.Random(size)
    docs = [(rng.randrange(200), "".join(rng.choice(["a", "bb", "cé", "漢"]) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randrange(60)))) for _ in range(120)]
    base = [f"w{k}" for k in range(300)]
    for k in range(60):
        a, b = sorted(rng.choices(range(300), k=2))
        docs.append((1000 + rng.randrange(90), " ".join([*base[a:b], str(k), *base[b - 7 : b + 9]])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert hashed(substrings.substring_dedup(df, size)) == brute(docs, size)


def test_words_and_hashes_do_not_depend_on_pieces(monkeypatch):
    data = ("ab cé  d\tlongword\r\n" * 50).encode() + b"x" * 100 + b" end"
    starts, hashes = substrings.word_hashes(data)
    assert [data[s:].split()[0] for s in starts] == data.split()
    assert len(set(hashes.tolist())) == len(set(data.split()))
    monkeypatch.setattr(substrings, "SEGMENT", 7)
    again = substrings.word_hashes(data)
    assert again[0].tolist() == starts.tolist() and again[1].tolist() == hashes.tolist()
