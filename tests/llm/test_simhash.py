import random
import re

import pytest
import xxhash
from conftest_llm import SF, rows

from spanlake.llm import common, queries, simhash
from spanlake.llm.components import components


def plain(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs, radius=2, size=3):
    f = [(i, plain(t, size)) for i, t in docs]
    root = list(range(len(f)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(f)):
        for b in range(a):
            if (f[a][1] ^ f[b][1]).bit_count() <= radius:
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(f):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, f"{x:016x}", least.get(top(k))) for k, (i, x) in enumerate(f)), key=str)


def taken(df):
    return sorted(rows(df, "doc_id", "fingerprint", "component_id"), key=str)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    assert taken(queries.op10_simhash_components(spark, SF)) == brute(docs)


def test_odd_rows(spark, odd):
    docs = odd.union(spark.createDataFrame([(None, "no id", "en", "a", 5, "", 1)], odd.schema))
    assert taken(simhash.simhash_components(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_no_rows(spark, none):
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_near_pair_meets_in_a_table(radius):
    rng, keep = random.Random(radius), simhash.masks(radius)
    assert len(keep) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), radius):
            y ^= 1 << b
        assert any(x & m == y & m for m in keep)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_give_the_components_of_all_near_pairs(spark, radius):
    """Chains, and groups with more members than are compared with each other."""
    rng, fps = random.Random(radius), set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            y = x
            for b in rng.sample(range(64) if rng.random() < 0.5 else range(8), rng.randint(1, radius + 1)):
                y ^= 1 << b
            x = rng.choice([x, y])
            fps.add(y)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.links(nodes, radius)
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(bin((e.u ^ e.v) & (2**64 - 1)).count("1") <= radius for e in edges.collect())
    root = {f: f for f in fps}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in fps:
        for b in fps:
            if b < a and bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert {f: got.get(f, f) for f in fps} == {f: top(f) for f in fps}
