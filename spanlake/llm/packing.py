"""Operator 5: best-fit packing by a configuration linear program.

Documents become pieces of at most `length` tokens; only the histogram of piece lengths (at most `length`
numbers) reaches the driver. There the configuration linear program - how often to use each way of filling a
sequence so that all pieces are covered - is solved by multiplicative weights: a length is worth its tokens times a weight
that falls exponentially as its coverage runs ahead of the others. A bounded knapsack dynamic program (no more of a
length than there is) prices the fillings; one table gives the best filling around each length, so a round
moves all lengths that lag, and no filling that would carry a length far ahead. The fractional answer is rounded to whole
copies that never exceed what is there, the fuller fillings only, and the program is solved again for
what is left, until little is. That little, and what sits in fillings that aren't full, is packed by best fit on counts.
A plan has at most some ten thousand fillings whatever the number of rows.

Executors rank the pieces of each length (dealt over buckets, so a length that a third of all pieces share
isn't one task's) and look their sequence and offset up in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm import common


class Fillings:
    """The bounded knapsack table: the best worth of every room, and what makes it."""

    def __init__(self, lengths: np.ndarray, prices: np.ndarray, bounds: np.ndarray, capacity: int):
        # a length that may be used b times is b // 2 ** k lots of 2 ** k and so on, each used or not
        lots = []
        for k, (n, b) in enumerate(zip(lengths.tolist(), np.minimum(bounds, capacity // np.maximum(lengths, 1)).tolist())):
            lot = 1
            while b > 0:
                lots.append((k, min(lot, b)))
                b -= lot
                lot *= 2
        self.item, self.uses = np.array(lots, np.int64).reshape(-1, 2).T
        self.size = lengths[self.item] * self.uses
        self.best = np.zeros(capacity + 1)
        self.last = np.full((len(lots) + 1, capacity + 1), -1, np.int32)  # after each lot: the last one used for a room
        for i, (size, worth) in enumerate(zip(self.size.tolist(), (prices[self.item] * self.uses).tolist())):
            more = self.best[:-size] + worth
            better = more > self.best[size:]
            self.last[i + 1] = self.last[i]
            np.copyto(self.last[i + 1, size:], i, where=better)
            np.copyto(self.best[size:], more, where=better)

    def fill(self, rooms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the room, item, uses) of the best fillings, in order of the rooms."""
        room, at, row, out = rooms.copy(), np.full(len(rooms), len(self.item)), np.arange(len(rooms)), []
        while len(row):
            lot = self.last[at, room]
            some = lot >= 0
            row, room, lot = row[some], room[some], lot[some]
            out.append((row, lot))
            room, at = room - self.size[lot], lot
        row, lot = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        order = np.argsort(row, kind="stable")
        return row[order], self.item[lot[order]], self.uses[lot[order]]


def knapsack(prices: np.ndarray, capacity: int, bounds: np.ndarray | None = None) -> dict[int, int]:
    """The multiset of lengths of the highest total price within capacity; prices[l] is -inf where l is absent."""
    lengths = np.flatnonzero(prices > 0)
    made = Fillings(lengths, prices[lengths], np.full(len(lengths), capacity) if bounds is None else bounds[lengths], capacity)
    out: dict[int, int] = {}
    for k, u in zip(*(x.tolist() for x in made.fill(np.array([capacity]))[1:])):
        out[int(lengths[k])] = out.get(int(lengths[k]), 0) + u
    return out


def fractional(left: np.ndarray, capacity: int, rounds: int, rate: float, tries: int = 6) -> tuple[dict[tuple, float], float]:
    """Multiplicative weights on the covering program: fillings and how often each, and a lower bound of its value.

    After round t every length is covered to t / rounds, but for those no filling could carry on without taking
    another length over a round ahead; the last round covers all. The bound is the prices' worth of all pieces over that
    of the best filling (weak duality)."""
    lengths = np.flatnonzero(left)
    demand, names = left[lengths].astype(float).tolist(), lengths.tolist()
    cover, found, bound = [0.0] * len(lengths), {}, 0.0
    for t in range(1, rounds + 1):
        goal, times = t / rounds, tries * (3 if t == rounds else 1)
        for one in range(times):
            lag = [k for k in reversed(range(len(names))) if cover[k] < goal - 1e-9]  # long ones first
            if not lag:
                break
            have = np.array(cover)
            prices = lengths * np.exp(-rate * (have - have.min()))
            made = Fillings(lengths, prices, left[lengths], capacity)
            bound = max(bound, float((prices * left[lengths]).sum() / made.best[capacity]))
            row, item, uses = made.fill(capacity - lengths[lag])
            edges = np.searchsorted(row, np.arange(len(lag) + 1)).tolist()
            item, uses = item.tolist(), uses.tolist()
            ahead = float("inf") if t == rounds and one == times - 1 else goal + 1 / rounds
            for j, k in enumerate(lag):
                if cover[k] >= goal - 1e-9:
                    continue
                pattern = {k: 1}
                for x, u in zip(item[edges[j] : edges[j + 1]], uses[edges[j] : edges[j + 1]]):
                    pattern[x] = pattern.get(x, 0) + u
                pattern[k] = min(pattern[k], int(demand[k]))
                if j and max(map(cover.__getitem__, pattern)) > ahead:
                    continue
                step = min((goal - cover[k]) * demand[k] / pattern[k], *[max(ahead + 1 / rounds - cover[x], 1e-12) * demand[x] / u for x, u in pattern.items()])
                for x, u in pattern.items():
                    cover[x] += step * u / demand[x]
                key = tuple(sorted((names[x], u) for x, u in pattern.items()))
                found[key] = found.get(key, 0.0) + step
    return found, bound


def _take(left: np.ndarray, pattern: dict[int, int], times: float, down: bool = False) -> tuple[dict[int, int], int]:
    copies = min(int(left[n]) // u for n, u in pattern.items())
    if times < copies:
        copies = int(times) if down else max(1, round(times))
    for n, u in pattern.items():
        left[n] -= u * copies
    return pattern, copies


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Largest first, each sequence filled up with the largest piece that still fits; on counts."""
    out = []
    left = left.copy()
    while left.any():
        here, pattern, free = left.copy(), {}, capacity
        while free > 0 and (fit := np.flatnonzero(here[1 : free + 1])).size:
            n = int(fit[-1]) + 1
            uses = min(free // n, int(here[n]))
            pattern[n] = pattern.get(n, 0) + uses
            here[n] -= uses
            free -= uses * n
        out.append(_take(left, pattern, float("inf")))
    return out


def solve(counts: dict[int, int], capacity: int, rounds: int = 8, passes: int = 16, rate: float = 10.0, rest: float = 0.0005) -> tuple[list[tuple[dict[int, int], int]], list[tuple[dict[int, int], int]], float]:
    """Patterns (length to number) and copies of the program's rounded answer, those of best fit for what it leaves, and
    the lower bound of sequences. Together they hold exactly counts pieces.

    First only full fillings are taken, if they are a good part of the answer, and copies are rounded down, so that what is
    left stays like the whole; once a pass places little of what is left, the fuller half, rounded."""
    left = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        left[n] = k
    size, total = np.arange(capacity + 1), int(left.sum())
    bound, made, careful = float(left @ size) / capacity, [], True
    for one in range(passes):
        before = int(left.sum())
        if before <= max(rest * total, 1):
            break
        found, least = fractional(left, capacity, rounds, rate)
        bound = max(bound, least) if not one else bound
        waste = {k: capacity - sum(n * u for n, u in k) for k in found}
        full = sum(t for k, t in found.items() if not waste[k])
        most = 0.0 if careful and full > 0.3 * sum(found.values()) else float(np.median(list(waste.values())))
        for key, times in sorted(found.items(), key=lambda p: -p[1]):
            if waste[key] <= most:
                pattern, copies = _take(left, dict(key), times, careful)
                if copies:
                    made.append((pattern, copies))
        careful = careful and int(left.sum()) < 0.7 * before
    full = [(p, c) for p, c in made if sum(n * u for n, u in p.items()) == capacity]
    loose = left.copy()
    for pattern, copies in made:
        if sum(n * u for n, u in pattern.items()) < capacity:
            for n, u in pattern.items():
                loose[n] += u * copies
    again, tail = best_fit(loose, capacity), best_fit(left, capacity)
    if sum(c for _, c in full + again) < sum(c for _, c in made + tail):
        made, tail = full, again
    return made, tail, bound


def plan(counts: dict[int, int], capacity: int, rounds: int = 8, passes: int = 16, rate: float = 10.0) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to number) and copies that hold exactly counts pieces."""
    made, tail, _ = solve(counts, capacity, rounds, passes, rate)
    return made + tail


@dataclass
class Lookup:
    """A plan as arrays: slots of one length in order, for finding the sequence and offset of the k-th piece of it."""

    first: dict[int, np.ndarray]  # rank at which each pattern begins
    uses: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]

    @classmethod
    def of(cls, patterns: list[tuple[dict[int, int], int]]) -> Lookup:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        done: dict[int, int] = {}
        sequence = 0
        for pattern, copies in patterns:
            at = 0
            for n, uses in sorted(pattern.items(), reverse=True):
                rows.setdefault(n, []).append((done.get(n, 0), uses, sequence, at))
                done[n] = done.get(n, 0) + uses * copies
                at += n * uses
            sequence += copies
        return cls(*({n: np.array([r[k] for r in rs], np.int64) for n, rs in rows.items()} for k in range(4)))

    def find(self, n: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.first[n], rank, "right") - 1
        past, uses = rank - self.first[n][k], self.uses[n][k]
        return self.sequence[n][k] + past // uses, self.offset[n][k] + past % uses * n


def cut(docs: DataFrame, encode: Callable[[], Callable[[list[str]], list[bytes]]], length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of every row; null texts are empty texts (the end id alone).

    Of a longer document all pieces have `length` tokens but the first, which has the rest."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encode(), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for i, ids in zip(batch.column("i").to_pylist(), enc(batch.column("t").to_pylist())):
                ids = memoryview(ids + end)
                total = len(ids) // 4
                starts = [0, *range((total - 1) % length + 1, total, length)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], total])):
                    out.append((i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, encode: Callable[[], Callable[[list[str]], list[bytes]]], length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document into sequences of at most `length` tokens; a row per piece, with sequence_id and offset.

    Rows with equal or null ids are documents of their own. An empty table gives no rows. Other columns of docs
    are not looked at."""
    spark = docs.sparkSession
    pieces = common.materialise(cut(docs, encode, length, end_id, id_col, text_col), "pieces")
    salts = common.shuffle_partitions(spark)
    keyed = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = common.materialise(keyed.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    # one row a length: at most `length` of them
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lookup = spark.sparkContext.broadcast(Lookup.of(plan(histogram, length)))
    # at most `length` times the buckets
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    # the join is by what the ranks are made by, so it needs no broadcast and no shuffle of its own
    ranked = keyed.join(before.hint("merge"), ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lookup.value
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for one in np.unique(n):
                at = np.flatnonzero(n == one)
                sequence[at], offset[at] = found.find(int(one), rank[at])
            keep = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(sequence), pa.array(offset)], names=[*keep.schema.names, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
