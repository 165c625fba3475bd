"""Operator 6: substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The corpus is cut into reference blocks of some MB, written compressed to the shared folder. Documents are
parsed greedily against the phrases of all blocks: a factor grows word by word as long as its last `size`
words are a phrase that starts in a document with a smaller id, and ends where that fails. Where the source of
a phrase changes within a factor, the phrases across that boundary have been looked up like all others,
so a factor is exactly a maximal run of known phrases; factors of at least `size` words are the
duplicate spans. Scanning every block for every document would be quadratic; instead the index of all
blocks' phrases is dealt by hash, and a block asks every index shard about its phrases at once:

1. anchors: of every `size` consecutive words, the run of ANCHOR words with the smallest hash. Equal phrases
   have equal anchors. Blocks send each anchor once to its index shard, which answers which of them
   another block has too. Phrases whose anchor no other document has can't be duplicates.
2. phrases: blocks send the hash of every phrase with a shared anchor, once, with the smallest id of
   their documents that have it; shards answer which of them a smaller id has elsewhere.
3. parsing: with these answers each block parses its documents.

Answers are bitmaps in the order the block sent its hashes. What a block sends is pre-aggregated, so a
phrase that a third of all documents hold is one entry a block. Hashes have 64 bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm import common

ANCHOR = 5
#: Bytes of text in a block (one longer document is a block of its own), and bytes hashed at a time.
BLOCK, SEGMENT = 2 << 20, 2 << 20
#: Hashes an index shard gets at most, about.
SHARD = 4_000_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse mod 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_BYTES = np.random.default_rng(6).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) mod 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1), np.uint64)
        if n > 1:
            have[1:] = np.uint64(base)
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of data, in pieces cut at white space."""
    starts, hashes, at, n = [], [], 0, len(data)
    raw = np.frombuffer(data, np.uint8)
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n and not _SPACE[raw[end]]:  # to the end of a word
            step = np.flatnonzero(_SPACE[raw[end : end + SEGMENT]])
            end = end + int(step[0]) if step.size else min(n, end + SEGMENT)
        part = raw[at:end]
        edge = np.flatnonzero(np.diff(_SPACE[part].astype(np.int8), prepend=1, append=1))
        first, last = edge[::2], edge[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * _power(_BASE, len(part)), out=sums[1:])
        hashes.append(mix((sums[last] - sums[first]) * _power(_INVERSE, len(part))[first]))
        starts.append(first + at)
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + words[k : k + n]
    return mix(out)


class Block:
    """A block's documents, its phrases, and for each phrase its anchor."""

    def __init__(self, payload: bytes, size: int):
        head = np.frombuffer(payload, "<i8", 1)[0]
        table = np.frombuffer(payload, "<i8", 3 * head, 8).reshape(3, head)
        self.ids, self.known, lengths = table[0], table[1].astype(bool), table[2]
        self.data, self.size = payload[8 + 24 * head :], size
        self.ends = np.cumsum(lengths + 1)  # a space follows each document
        self.begins = self.ends - lengths - 1
        starts, words = word_hashes(self.data)
        doc = np.searchsorted(self.ends, starts, "right")
        self.first_word = np.searchsorted(doc, np.arange(head + 1))
        n = max(0, len(words) - size + 1)
        # phrases lie in one document, whose id isn't null
        whole = (doc[:n] == doc[size - 1 :]) & self.known[doc[:n]] if n else np.zeros(0, bool)
        self.at = np.flatnonzero(whole)
        self.doc = doc[self.at]
        self.words = words
        width = size - ANCHOR + 1
        runs = run_hashes(words, ANCHOR)
        self.anchor = np.lib.stride_tricks.sliding_window_view(runs, width).min(axis=1)[self.at] if n else np.zeros(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors in order, and which of them several documents of the block have."""
        order = np.lexsort((self.doc, self.anchor)) if len(self.anchor) else np.zeros(0, np.int64)
        a, d = self.anchor[order], self.doc[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = a[1:] != a[:-1]
        begins = np.flatnonzero(fresh)
        last = np.append(begins[1:], len(a)) - 1
        return a[begins], (d[last] != d[begins]) if len(a) else np.zeros(0, bool)

    def phrases(self, shared: np.ndarray) -> None:
        """Keep the phrases whose anchor is marked in shared (in the order of anchors())."""
        distinct, several = self.anchors()
        keep = (shared | several)[np.searchsorted(distinct, self.anchor)] if len(distinct) else np.zeros(0, bool)
        self.at, self.doc = self.at[keep], self.doc[keep]
        hashes = run_hashes(self.words, self.size)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.distinct, self.number = np.unique(hashes, return_inverse=True)
        self.least = np.full(len(self.distinct), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.number, self.ids[self.doc])

    def parse(self, elsewhere: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """(document, words, spans of words) of each document; elsewhere: phrases that a smaller id has in another block."""
        known = elsewhere[self.number] | (self.ids[self.doc] > self.least[self.number]) if len(self.at) else np.zeros(0, bool)
        at, doc = self.at[known], self.doc[known]
        # a factor goes on while the next phrase begins at most `size` words later in the same document: its words touch or overlap
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] - at[:-1] > self.size) | (doc[1:] != doc[:-1])
        begin = at[new]
        end = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + self.size if len(at) else at
        edges = np.searchsorted(doc[new], np.arange(len(self.ids) + 1))
        for k in range(len(self.ids)):
            base, a, b = int(self.first_word[k]), edges[k], edges[k + 1]
            yield k, int(self.first_word[k + 1]) - base, [(int(s) - base, int(e) - base) for s, e in zip(begin[a:b], end[a:b])]


def _blocks(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """Write the blocks; (block, file, start, bytes, words) of each. Null ids stay apart: they are neither sources nor parsed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        name, out, at, made, held, size = f"{uuid.uuid4().hex}.blocks", None, 0, [], [], 0
        squeeze = zstandard.ZstdCompressor(level=3)

        def put() -> None:
            nonlocal out, at, held, size
            out = out or store.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
            table = np.array([[i or 0 for i, _ in held], [i is not None for i, _ in held], [len(t) for _, t in held]], "<i8")
            raw = b"".join((np.int64(len(held)).tobytes(), table.tobytes(), *(t + b" " for _, t in held)))
            data = squeeze.compress(raw)
            out.write(data)
            made.append({"block": f"{name}:{len(made)}", "file": name, "start": at, "bytes": len(data), "words": size // 6})
            at, held, size = at + len(data), [], 0

        for b in batches:
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist()):
                t = t.encode("utf-8", "surrogatepass")
                if held and size + len(t) > BLOCK:
                    put()
                held.append((i, t))
                size += len(t)
        if held:
            put()
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("block", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("bytes", pa.int64()), ("words", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    common.make_dir(docs.sparkSession, path)
    return common.materialise(rows.mapInArrow(run, "block string, file string, start long, bytes long, words long"), "blocks")


def _load(path: str, row: dict, size: int) -> Block:
    store, root = pafs.FileSystem.from_uri(path)
    with store.open_input_file(f"{root}/{row['file']}") as f:
        return Block(zstandard.ZstdDecompressor().decompress(f.read_at(row["bytes"], row["start"])), size)


def _deal(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's slice of ascending hashes begins, and the end."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


def _gather(answers: list[dict], edges: np.ndarray) -> np.ndarray:
    """Bits of a block's hashes from its shards' answers."""
    out = np.zeros(int(edges[-1]), bool)
    for a in answers:
        s = a["shard"]
        n = int(edges[s + 1] - edges[s])
        out[edges[s] : edges[s + 1]] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=n).astype(bool)
    return out


_SENT = "block string, shard int, hashes binary, ids binary"


def _send(block: str, hashes: np.ndarray, ids: np.ndarray | None, shards: int) -> pa.RecordBatch:
    edges = _deal(hashes, shards)
    full = [s for s in range(shards) if edges[s + 1] > edges[s]]
    cut = lambda x: [x[edges[s] : edges[s + 1]].tobytes() for s in full]
    return pa.RecordBatch.from_arrays([pa.array([block] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(cut(hashes), pa.binary()), pa.array(cut(ids) if ids is not None else [b""] * len(full), pa.binary())], names=["block", "shard", "hashes", "ids"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An index shard: for every hash sent, whether another block has it (with a smaller id, if ids were sent)."""
    held: dict[int, list[tuple[str, np.ndarray, np.ndarray]]] = {}
    for b in batches:
        for r in b.to_pylist():
            held.setdefault(r["shard"], []).append((r["block"], np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["ids"], np.int64)))
    for shard, parts in held.items():
        h = np.concatenate([p[1] for p in parts])
        ids = np.concatenate([p[2] for p in parts])
        order = np.argsort(h, kind="stable")
        ordered = h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        begins = np.flatnonzero(fresh)
        sizes = np.diff(np.append(begins, len(h)))
        bits = np.zeros(len(h), bool)
        if len(ids):
            least = np.minimum.reduceat(ids[order], begins)
            bits[order] = ids[order] > np.repeat(least, sizes)
        else:
            bits[order] = np.repeat(sizes > 1, sizes)
        ends = np.cumsum([len(p[1]) for p in parts])
        for (block, hashes, _), end in zip(parts, ends):
            yield pa.RecordBatch.from_pylist([{"block": block, "shard": shard, "bits": np.packbits(bits[end - len(hashes) : end]).tobytes()}], schema=pa.schema([("block", pa.string()), ("shard", pa.int32()), ("bits", pa.binary())]))
        parts.clear()


def substring_dedup(docs: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, spans (array of start, end in words), n_removed, kept (the words left, joined by spaces).

    A word goes if a run of `size` words over it also starts in a document of smaller id. Null texts have no words.
    Rows of equal ids don't make each other's words go; rows of null id lose nothing and make nothing go. An empty
    table gives no rows. Other columns are not looked at."""
    if size <= ANCHOR:
        raise ValueError(f"size must be over {ANCHOR}")
    spark = docs.sparkSession
    common.bound_batches(spark)
    path = common.new_path(spark, "text")
    blocks = _blocks(docs, path, id_col, text_col)
    total = blocks.agg(F.sum("words"), F.count("*")).first()
    shards = max(common.shuffle_partitions(spark), -(-(total[0] or 0) // SHARD))
    tasks = max(1, min(total[1], 4 * common.shuffle_partitions(spark)))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield _send(row["block"], _load(path, row, size).anchors()[0], None, shards)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                block = _load(path, row, size)
                block.phrases(_gather(row["shared"] or [], _deal(block.anchors()[0], shards)))
                yield _send(row["block"], block.distinct, block.least, shards)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_removed", pa.int64()), ("kept", pa.string())])
        for b in batches:
            for row in b.to_pylist():
                block = _load(path, row, size)
                block.phrases(_gather(row["shared"] or [], _deal(block.anchors()[0], shards)))
                out = []
                for k, n, spans in block.parse(_gather(row["smaller"] or [], _deal(block.distinct, shards))):
                    words = block.data[block.begins[k] : block.ends[k]].split()
                    if spans:
                        keep = np.ones(n, bool)
                        for s, e in spans:
                            keep[s:e] = False
                        words = list(compress(words, keep))
                    out.append({"doc_id": int(block.ids[k]) if block.known[k] else None, "n_words": n, "spans": [{"start": s, "end": e} for s, e in spans], "n_removed": n - len(words), "kept": b" ".join(words).decode("utf-8", "surrogatepass")})
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    def asked(sent: DataFrame, label: str) -> DataFrame:
        """The shards' answers, gathered by block: at most one a shard."""
        answers = sent.repartitionById(shards, F.col("shard")).mapInArrow(_answer, "block string, shard int, bits binary")
        return common.materialise(answers.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias(label)), label)

    # blocks are small rows here (their text is in files), so these joins move little
    dealt = blocks.drop("words")
    shared = asked(dealt.repartition(tasks, "block").mapInArrow(anchors, _SENT), "shared")
    dealt = dealt.join(shared, "block", "left")
    smaller = asked(dealt.repartition(tasks, "block").mapInArrow(phrases, _SENT), "smaller")
    return dealt.join(smaller, "block", "left").repartition(tasks, "block").mapInArrow(parse, "doc_id long, n_words long, spans array<struct<start: long, end: long>>, n_removed long, kept string")
