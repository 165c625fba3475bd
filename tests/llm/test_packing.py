import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanlake.llm import common, packing, queries, records


def check(docs, got, path, length=2048):
    t = Tokenizer.from_file(path)
    want = []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % length + 1
        edges = [0, *range(first, len(ids) + 1, length)]
        want += [(i, k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=key) == sorted(want, key=key)
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for slots in at.values():
        end = 0
        for offset, n in sorted(slots):
            assert offset == end
            end += n
        assert end <= length
    return len(at), -(-sum(r.length for r in got) // length)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    used, bound = check(docs, queries.op5_best_fit_packing(spark, SF).collect(), queries.tokenizer_path("byte_bpe_50k.json"))
    assert used <= bound * 1.02 + 1


def test_odd_rows(spark, odd):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    got = packing.pack(odd, records.tokenizer_encode(path), 64).collect()
    check([(r.doc_id, r.text) for r in odd.collect()], got, path, 64)


def test_no_rows(spark, none):
    assert packing.pack(none, records.tokenizer_encode(queries.tokenizer_path("byte_bpe_50k.json"))).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_plan_holds_every_piece_once(counts):
    plan = packing.plan(counts, 50, rounds=5, passes=2)
    held = defaultdict(int)
    for pattern, copies in plan:
        assert copies > 0 and sum(n * u for n, u in pattern.items()) <= 50
        for n, u in pattern.items():
            held[n] += u * copies
    assert dict(held) == counts
    found = packing.Lookup.of(plan)
    places = set()
    for n, k in counts.items():
        sequence, offset = found.find(n, np.arange(k))
        places |= {(s, o + j) for s, o in zip(sequence.tolist(), offset.tolist()) for j in range(n)}
    assert len(places) == sum(n * k for n, k in counts.items())


@pytest.mark.parametrize("capacity", [1, 7, 12])
def test_knapsack_against_all_fillings(capacity):
    rng = np.random.default_rng(capacity)
    prices = np.full(capacity + 1, -np.inf)
    prices[1:] = rng.random(capacity)

    def best(c):
        return max([0.0, *(prices[n] + best(c - n) for n in range(1, c + 1))])

    got = packing.knapsack(prices, capacity)
    assert sum(n * u for n, u in got.items()) <= capacity
    assert abs(sum(prices[n] * u for n, u in got.items()) - best(capacity)) < 1e-9


@pytest.mark.parametrize("pieces", [300, 6000])
def test_the_program_places_most_pieces(pieces):
    """The result is the rounded program's, not that of best fit, and about as short."""
    rng = np.random.default_rng(pieces)
    lengths, n = np.unique(np.minimum(rng.lognormal(6, 1, pieces).astype(int) + 1, 2048), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist()))
    made, tail, bound = packing.solve(counts, 2048)
    left = np.zeros(2049, np.int64)
    left[lengths] = n
    plain = sum(c for _, c in packing.best_fit(left, 2048))
    placed = sum(c * sum(p.values()) for p, c in made)
    used = sum(c for _, c in made + tail)
    assert placed > 0.5 * pieces and bound <= used <= plain * 1.005 + 1
    assert placed + sum(c * sum(p.values()) for p, c in tail) == pieces


def test_bounded_knapsack_against_all_fillings():
    rng = np.random.default_rng(4)
    for _ in range(20):
        bounds = np.concatenate([[0], rng.integers(0, 4, 9)])
        prices = np.where(bounds > 0, rng.random(10), -np.inf)

        def best(n, c):
            return 0.0 if n == 0 else max(best(n - 1, c - n * u) + (u * prices[n] if u else 0) for u in range(min(bounds[n], c // n) + 1))

        got = packing.knapsack(prices, 12, bounds)
        assert all(u <= bounds[n] for n, u in got.items()) and sum(n * u for n, u in got.items()) <= 12
        assert abs(sum(prices[n] * u for n, u in got.items()) - best(9, 12)) < 1e-9
