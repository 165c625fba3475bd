import random

import numpy as np
import pytest
import xxhash
from conftest_llm import SF, rows

from spanlake.llm import common, simhash


def groups(docs, size=5, similarity=0.8):
    sets = [(i, set(simhash.shingles(t or "", size))) for i, t in docs]
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if not x and not y or (x or y) and len(x & y) / len(x | y) >= similarity:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return [docs[top(k)][0] for k in range(len(docs))]


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").orderBy("doc_id").collect()]
    kept = [r.doc_id for r in simhash.near_dedup(common.table(spark, SF, "documents")).orderBy("doc_id").collect()]
    assert kept == sorted(set(groups(docs)))


def test_near_copies_of_many_sizes(spark):
    """Recall on pairs at and above the threshold, none below it."""
    rng, docs, i = random.Random(2), [], 0
    for n in (12, 40, 100, 300, 1000, 3000):
        for _ in range(12):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            edits = list(words)
            for k in rng.sample(range(n), max(1, int(n * rng.choice([0.002, 0.01, 0.018, 0.06])))):
                edits[k] = f"x{rng.randrange(10**6)}"
            docs += [(i, " ".join(words)), (i + 1, " ".join(edits))]
            i += 2
    want = groups(docs)
    got = {r.d: r.first_d for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    pairs = {d for (d, _), w in zip(docs, want) if w != d}
    found = {d for d, f in got.items() if f != d}
    assert found <= pairs and len(found) >= 0.97 * len(pairs) > 20


def test_large_group_of_near_copies(spark):
    """More members of a key than are compared with each other, and texts that share only a passage."""
    rng = random.Random(3)
    base, shared = [f"w{k}" for k in range(200)], [f"s{k}" for k in range(25)]
    docs = [(k, " ".join(["a", *base[:150], f"x{k}", *base[151:]])) for k in range(60)]
    docs += [(1000 + k, " ".join([*shared, *(f"y{rng.randrange(10**7)}" for _ in range(30))])) for k in range(60)]
    kept = [r.doc_id for r in simhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).orderBy("doc_id").collect()]
    assert kept == [0, *range(1000, 1060)]


@pytest.mark.parametrize("block", [simhash.BLOCK if hasattr(simhash, "BLOCK") else 0, 9000])
def test_copies_similar_to_the_original_only(spark, block, monkeypatch):
    """Every copy that has a key in common with the original is in its group, however many have that key."""
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    docs = [(0, " ".join(base))]
    for i in range(1, 601):
        words = list(base)
        for k in range(3):
            words[50 * k + rng.randrange(5, 45)] = f"x{i}_{k}"
        docs.append((i, " ".join(words)))

    def keys(t):
        return set(simhash.class_keys(np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in simhash.shingles(t, 5)], "<u8"))))

    assert simhash.jaccard(docs[0][1], docs[1][1], 5) >= 0.8 > simhash.jaccard(docs[1][1], docs[2][1], 5)
    own = keys(docs[0][1])
    met = {i for i, t in docs if keys(t) & own}
    assert len(met) > 560
    got = {r.d: r.first_d for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert {i for i, f in got.items() if f == 0} >= met


def test_odd_rows(spark, odd):
    docs = odd.union(spark.createDataFrame([(None, "no id", "en", "a", 5, "", 1), (None, None, "en", "a", 5, "", 1)], odd.schema))
    got = simhash.near_dedup(docs)
    assert got.columns == docs.columns
    assert rows(got, "doc_id") == [(i,) for i in (1, 2, 4, 5, 8, 11, 12)] + [(None,)]


def test_no_rows(spark, none):
    assert simhash.near_dedup(none).count() == 0


def test_groups_beside_a_hub(spark):
    """Thousands of near copies of one text, and among them groups that are like each other but not like the first."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(160)]

    def changed(words, places, tag):
        out = list(words)
        for k in places:
            out[k] = f"{tag}_{k}"
        return out

    texts = [base] + [changed(base, rng.sample(range(160), rng.choice([1, 2, 3, 4])), f"x{i}") for i in range(2500)]
    for g in range(40):  # each far from the base, its members near each other
        far = changed(base, rng.sample(range(160), 7), f"g{g}")
        texts += [changed(far, rng.sample(range(160), rng.choice([1, 2])), f"g{g}m{m}") for m in range(6)]
    docs = list(enumerate(" ".join(t) for t in texts))
    # all pairs at once: how many shingles each pair shares
    sets = [sorted({hash(x) for x in simhash.shingles(t, 5)}) for _, t in docs]
    every = {h: k for k, h in enumerate(sorted({h for s in sets for h in s}))}
    count: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for h in s:
            count.setdefault(every[h], []).append(i)
    shared = np.zeros((len(docs), len(docs)), np.int16)
    for held in count.values():
        if len(held) > 1:
            shared[np.ix_(held, held)] += 1
    n = np.array([len(s) for s in sets])
    like = np.triu(shared / (n[:, None] + n[None, :] - shared) >= 0.8, 1)
    a, b = np.nonzero(like)
    root = np.arange(len(docs))
    while True:  # smallest reachable
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        if (new == root).all():
            break
        root = new
    got = {r.d: r.first_d for r in simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    found = np.array([got[i] for i in range(len(docs))])
    assert (root[found] == root).all()  # none joined that all pairs don't join
    assert (found[a] == found[b]).mean() >= 0.97


def test_repeated_ids_are_settled_by_the_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "z"), (1, "a b", "y"), (1, "a b", None)], "doc_id long, text string, source string").repartition(3)
    assert rows(simhash.near_dedup(docs), "doc_id", "source") == [(1, None)]
