"""Operator 2: document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes: h(i) = sum over k < 32 of G[byte(i - k)] << k, mod 2**32, so each
position depends on the last 32 bytes alone and edits elsewhere don't move boundaries. Chunking is
normalised: before the wanted size a boundary needs more zero bits of the hash than after it, which keeps
chunk lengths close together; no chunk is shorter than `low` (but the last) or longer than `high`. The
fingerprint of a text is the set of its chunks' digests with their lengths; the likeness of two
fingerprints is the length-weighted containment: bytes of the digests they share over the bytes of the
smaller set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm import common

#: A fingerprint holds 15 hex digits for each distinct chunk: 12 of its digest, 3 of its length; in order.
DIGITS, SIZE_DIGITS = 12, 3
ENTRY = DIGITS + SIZE_DIGITS


def gear_table(seed: int = 1) -> np.ndarray:
    """256 numbers of 32 bits from a rule: the XXH64 of each byte."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), seed) & 0xFFFFFFFF for b in range(256)], np.uint32)


def gear_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, by doubling the window five times."""
    h = table[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            moved = h[:-k] << np.uint32(k)
            h = h.copy()
            h[k:] += moved
    return h


@dataclass(frozen=True)
class Chunker:
    low: int = 16
    usual: int = 48
    high: int = 256
    seed: int = 1

    def cuts(self, data: bytes) -> list[int]:
        """Ends of the chunks of data."""
        n = len(data)
        if n <= self.low:
            return [n] if n else []
        bits = max(1, self.usual.bit_length() - 1)
        h = gear_hash(np.frombuffer(data, np.uint8), _table(self.seed))
        # zero bits are asked of the high end, which all 32 bytes reach
        loose = np.flatnonzero(h >> np.uint32(32 - bits + 1) == 0) + 1
        strict = loose[h[loose - 1] >> np.uint32(32 - bits - 1) == 0]
        loose, strict = loose.tolist(), strict.tolist()
        out, at, i, j, last_i, last_j = [], 0, 0, 0, len(loose), len(strict)
        while n - at > self.low:
            least, turn, most = at + self.low, at + self.usual, min(at + self.high, n)
            while j < last_j and strict[j] < least:
                j += 1
            if j < last_j and strict[j] <= turn:
                cut = strict[j]
            else:
                while i < last_i and loose[i] <= turn:
                    i += 1
                cut = loose[i] if i < last_i else most
            at = min(cut, most)
            out.append(at)
        if at < n:
            out.append(n)
        return out

    def fingerprint(self, data: bytes) -> str:
        ends = self.cuts(data)
        h = xxhash.xxh64_hexdigest
        return "".join(sorted({h(data[a:b])[:DIGITS] + f"{b - a:03x}" for a, b in zip([0, *ends], ends)}))


_tables: dict[int, np.ndarray] = {}


def _table(seed: int) -> np.ndarray:
    if seed not in _tables:
        _tables[seed] = gear_table(seed)
    return _tables[seed]


def _entries(fingerprint: str) -> set[str]:
    return {fingerprint[i : i + ENTRY] for i in range(0, len(fingerprint), ENTRY)}


def _weight(entries: set[str]) -> int:
    return sum([int(e[DIGITS:], 16) for e in entries])


def likeness(a: str, b: str) -> float:
    """Bytes of the chunks both have over those of the smaller; 1 for two empty ones, 0 for one."""
    if a == b:
        return 1.0
    x, y = _entries(a), _entries(b)
    least = min(_weight(x), _weight(y))
    return _weight(x & y) / least if least else 0.0


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, chunker: Chunker = Chunker(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty. The next document is that with the next smaller id, after the last the first; null
    ids come last, equal ids are ordered by text; the only document of a table is its own next. Ranges of
    ids are one task's each; the first document of a range is also dealt to the range before it, so the
    texts are shuffled once and nothing runs over one partition."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    bounds = common.id_bounds(rows, "i", common.shuffle_partitions(spark))
    rows = rows.withColumn("r", common.range_id(F.col("i"), bounds))
    # largest id of each range: as many rows as ranges
    tops = {r.r: r.top for r in rows.groupBy("r").agg(F.max("i").alias("top")).collect()}
    filled = sorted(tops, reverse=True)
    before = {r: filled[k - 1] for k, r in enumerate(filled)}  # the range that precedes r in descending order, cyclic
    if filled:
        pairs = [F.struct(F.lit(before[r]).cast("int").alias("to"), F.lit(tops[r]).cast("long").alias("top")) for r in range(len(bounds) + 1) if r in before] or []
        place = {r: k for k, r in enumerate(sorted(before))}
        slot = F.element_at(F.array(*[F.lit(place.get(r, 0)) for r in range(len(bounds) + 1)]), F.col("r") + 1)
        halo = F.element_at(F.array(*pairs), slot + 1)
        own = F.struct(F.col("r").alias("to"), F.lit(False).alias("extra"))
        also = F.struct(halo["to"].alias("to"), F.lit(True).alias("extra"))
        copies = F.when(F.col("i").eqNullSafe(halo["top"]), F.array(own, also)).otherwise(F.array(own))
        rows = rows.select("i", "t", F.explode(copies).alias("c")).select("i", "t", "c.to", "c.extra")
    else:
        rows = rows.select("i", "t", F.col("r").alias("to"), F.lit(False).alias("extra"))
    dealt = rows.repartitionById(len(bounds) + 1, F.col("to")).sortWithinPartitions("to", "extra", F.col("i").desc_nulls_last(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, to, held = [], 0, None, None

        def row(doc: tuple, following: tuple) -> tuple:
            i, text, print_ = doc
            new = edited(text, following[1])
            data = new.encode("utf-8", "surrogatepass")
            changed = chunker.fingerprint(data)
            return i, len(text), hashlib.sha256(data).hexdigest(), print_, changed, likeness(print_, changed), likeness(print_, following[2])

        for batch in batches:
            for i, text, t, extra in zip(*(batch.column(c).to_pylist() for c in ("i", "t", "to", "extra"))):
                if t != to:
                    to, held = t, None
                if extra and held is None:
                    continue  # the range's last document has had its next
                doc = (i, text, chunker.fingerprint(text.encode("utf-8", "surrogatepass")))
                if held is not None:
                    out.append(row(held, doc))
                    size += len(doc[2])
                held = None if extra else doc
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))
