"""Operator 7: token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard `shard-00012.bin` holds records one after another:

    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

all little-endian. The checksum is CRC-32 (zlib's polynomial), masked by a rotation and a constant, so that
checksums stored inside a payload don't confuse readers. A payload is: i64 document id, u8 flags (1: the id is
null, 2: ids are u16), then the ids. `shard-00012.idx` holds u64 offset, u64 payload length and u64 ids
of each record, 24 bytes each, so a reader can seek to any record. Shards follow document ids: every id in a
shard is smaller than those of the next (null ids come first, equal ids in order of text).

A task writes under a name of its own attempt and renames at the end; a lost executor's task is run again
and replaces nothing that was finished.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import common

#: Fixed value of the mask.
MASK_DELTA = 0xA282EAD8
_FRAME = struct.Struct("<QI")
_HEAD = struct.Struct("<qB")
#: Bytes of one read.
READ = 8 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def _payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return _HEAD.pack(doc_id or 0, (doc_id is None) | narrow << 1) + ids.astype("<u2" if narrow else "<u4").tobytes()


def parse_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = _HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=_HEAD.size)
    return None if flags & 1 else doc_id, ids.astype("<u4")


def write_records(docs: DataFrame, path: str, encode: Callable[[], Callable[[list[str]], list[bytes]]], id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1) -> DataFrame:
    """Write every row's ids to shards under path, in ascending id order, and return the manifest.

    encode: makes, on an executor, a function from texts to little-endian u32 ids. Null texts are empty texts;
    end_id is appended to each. Null ids come first; equal ids are ordered by text. An empty table makes no
    shards. Manifest: shard, docs, ids, bytes, first_id (number of ids before the shard); one row a shard, so
    it is bounded by spark.sql.shuffle.partitions."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    bounds = common.id_bounds(rows, "i", common.shuffle_partitions(spark))
    dealt = rows.withColumn("r", common.range_id(F.col("i"), bounds)).repartitionById(len(bounds) + 1, F.col("r")).sortWithinPartitions("r", F.col("i").asc_nulls_first(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, store, root = encode(), *pafs.FileSystem.from_uri(path)
        tail = np.asarray([] if end_id is None else [end_id], "<u4").tobytes()
        shard, out, index, name, at, total = None, None, [], "", 0, 0

        def end() -> pa.RecordBatch:
            out.close()
            with store.open_output_stream(f"{name}.idx") as f:
                f.write(np.asarray(index, "<u8").tobytes())
            for kind in ("bin", "idx"):
                store.move(f"{name}.{kind}", f"{root}/shard-{shard:05d}.{kind}")
            return pa.RecordBatch.from_pylist([{"shard": shard, "docs": len(index), "ids": total, "bytes": at}], schema=pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            encoded = enc(batch.column("t").to_pylist())
            for r, i, ids in zip(batch.column("r").to_pylist(), batch.column("i").to_pylist(), encoded):
                if r != shard:
                    if out:
                        yield end()
                    shard, index, at, total = r, [], 0, 0
                    name = f"{root}/.attempt-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{name}.bin", buffer_size=1 << 20)
                got = np.frombuffer(ids + tail, "<u4")
                data = frame(payload := _payload(i, got))
                out.write(data)
                index.append((at, len(payload), len(got)))
                at, total = at + len(data), total + len(got)
        if out:
            yield end()

    common.make_dir(spark, path)
    made = sorted(dealt.mapInArrow(run, "shard int, docs long, ids long, bytes long").collect())
    before, out = 0, []
    for m in made:
        out.append((*m, before))
        before += m.ids
    return spark.createDataFrame(out, "shard int, docs long, ids long, bytes long, first_id long")


def scan_shard(store: pafs.FileSystem, name: str) -> Iterator[bytes]:
    """Payloads of a shard in order, each checked against its checksums."""
    with store.open_input_stream(name) as f:
        buf, pos = b"", 0
        while True:
            need = 12 if len(buf) - pos < 12 else 16 + _FRAME.unpack_from(buf, pos)[0]
            if len(buf) - pos < need:
                more = f.read(max(READ, need))
                if not more:
                    if len(buf) > pos:
                        raise ValueError(f"{name} ends within a record")
                    return
                buf, pos = buf[pos:] + more, 0
                continue
            if need == 12:  # nothing but a frame fits; read on
                need = 16 + _FRAME.unpack_from(buf, pos)[0]
                if len(buf) - pos < need:
                    continue
            size, crc = _FRAME.unpack_from(buf, pos)
            if crc != masked(buf[pos : pos + 8]):
                raise ValueError(f"{name}: bad length checksum")
            payload = buf[pos + 12 : pos + 12 + size]
            if struct.unpack_from("<I", buf, pos + 12 + size)[0] != masked(payload):
                raise ValueError(f"{name}: bad payload checksum")
            yield payload
            pos += need


def read_index(path: str, shard: int) -> np.ndarray:
    """Rows of offset, payload length and ids of a shard's records."""
    store, root = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/shard-{shard:05d}.idx") as f:
        return np.frombuffer(f.read(), "<u8").reshape(-1, 3)


def read_record(path: str, shard: int, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number, with one seek: what a shuffled reader does."""
    store, root = pafs.FileSystem.from_uri(path)
    with store.open_input_file(f"{root}/shard-{shard:05d}.idx") as f:
        offset, size, _ = struct.unpack("<QQQ", f.read_at(24, 24 * number))
    with store.open_input_file(f"{root}/shard-{shard:05d}.bin") as f:
        data = f.read_at(size + 16, offset)
    if frame(payload := data[12 : 12 + size]) != data:
        raise ValueError("bad checksum")
    return parse_payload(payload)


def read_records(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, ids binary u32) of all shards, one task for some shards; start counts ids over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                start, rows, size = row["first_id"], [], 0
                for payload in scan_shard(store, f"{root}/shard-{row['shard']:05d}.bin"):
                    doc_id, ids = parse_payload(payload)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
                    start, size = start + len(ids), size + 4 * len(ids)
                    if size > READ:
                        yield _read_batch(rows)
                        rows, size = [], 0
                if start != row["first_id"] + row["ids"]:
                    raise ValueError(f"shard {row['shard']} has {start - row['first_id']} ids, not {row['ids']}")
                if rows:
                    yield _read_batch(rows)

    shards = manifest.repartition(max(1, min(manifest.count(), common.shuffle_partitions(spark))), "shard")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def tokenizer_encode(tokenizer: str) -> Callable[[], Callable[[list[str]], list[bytes]]]:
    """For write_records: whole texts through the tokenizers file at this path (the same on every executor)."""

    def make() -> Callable[[list[str]], list[bytes]]:
        from spanlake.llm.tokens import encoder

        return encoder(tokenizer).encode_batch

    return make
