import hashlib
import random

import pytest
import xxhash
from conftest_llm import SF

from spanlake.llm import common, fingerprints, queries
from spanlake.llm.fingerprints import Chunker, likeness

GEAR = [xxhash.xxh64_intdigest(bytes([b]), 1) % 2**32 for b in range(256)]


def plain_chunks(data):
    """Byte after byte, as the rule says: at least 16 bytes, at most 256; 6 zero bits to 48 bytes, 4 beyond."""
    chunks, begin, h = [], 0, 0
    for k, byte in enumerate(data):
        h = (2 * h + GEAR[byte]) % 2**32  # goes on over boundaries
        size = k + 1 - begin
        zeros = 32 - h.bit_length()
        if size == 256 or size >= 16 and zeros >= (6 if size <= 48 else 4) and k + 1 < len(data):
            chunks.append(data[begin : k + 1])
            begin = k + 1
    return chunks + [data[begin:]] if begin < len(data) else chunks


def plain_set(text):
    return {(xxhash.xxh64_hexdigest(c)[:12], len(c)) for c in plain_chunks(text.encode())}


def plain_likeness(x, y):
    least = min(sum(n for _, n in x), sum(n for _, n in y))
    return sum(n for _, n in x & y) / least if least else float(x == y)


def brute(docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    shown = lambda x: "".join(sorted(f"{d}{n:03x}" for d, n in x))
    sets = [plain_set(t) for _, t in docs]
    out = []
    for k, (i, t) in enumerate(docs):
        following = (k + 1) % len(docs)
        half = len(t) // 2
        e = t[: len(t) - half] + docs[following][1][:half]
        changed = plain_set(e)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), shown(sets[k]), shown(changed), plain_likeness(sets[k], changed), plain_likeness(sets[k], sets[following])))
    return sorted(map(str, out))


def taken(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    got = queries.op2_document_fingerprints(spark, SF)
    assert taken(got) == brute(docs)
    same = {r.doc_id: (r.near_edited, r.near_next) for r in got.collect() if r.n_chars > 400}
    assert sum(a > 0.25 for a, _ in same.values()) > 0.95 * len(same)
    assert sum(b < 0.05 for _, b in same.values()) > 0.95 * len(same)


def test_odd_rows(spark, odd):
    docs = odd.union(spark.createDataFrame([(None, "no id at all", "en", "a", 5, "", 1)], odd.schema))
    assert taken(fingerprints.fingerprints(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, odd, n):
    docs = odd.orderBy("doc_id").limit(n)
    assert taken(fingerprints.fingerprints(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_boundaries_resist_shifts():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(4000)).encode()
    c = Chunker()
    ends = c.cuts(text)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(text) and all(c.low <= s <= c.high for s in sizes[:-1])
    assert 0.5 * c.usual < sum(sizes) / len(sizes) < 2 * c.usual
    assert likeness(c.fingerprint(text), c.fingerprint(b"moved by some bytes " + text[:9000] + b"!" + text[9000:])) > 0.97
