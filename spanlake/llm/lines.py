"""Operator 3: line dedup by a deletion-neighbourhood join.

Two lines within one edit (of a character) share a variant: the longer without one character is the shorter, or
both without the character at the same place are equal. Every line emits all its variants as hashed keys,
equal keys meet, and the earliest line of a key is the witness that makes the others go, after the edit
distance is verified on the texts. Keys are met by minima, not by listing pairs: lines that share (variant,
place) all are within one edit of each other, and so are a line and those of which it is a variant, so the
earliest of each is enough whatever the group's size.

Equal lines are made one first. Of the distinct lines only those emit variants that share a half with
another line of a length that differs by one at most: one edit leaves one half of the shorter line's length
untouched, so no match is lost, and the variants that have to be shuffled follow the lines that are alike.

Each step is written, its shuffle files go as it ends and its table when no later step reads it, so the disk
holds the largest step and not their sum. What is returned reads the documents and the masks of kept lines only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm import common

_BASE = 0xD6E8FEB86659FD93  # odd
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters of lines put into one block of variants.
BLOCK = 400_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def variants(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line number, place, hash): each line itself (place -1) and each line without the character at a place."""
    data = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    n = np.array([len(x) for x in lines])
    first = np.concatenate([[0], np.cumsum(n)])
    line = np.repeat(np.arange(len(lines)), n)
    place = np.arange(len(data)) - first[line]
    most = int(n.max(initial=0)) + 1
    power = np.ones(most, np.uint64)
    power[1:] = np.uint64(_BASE)
    np.multiply.accumulate(power, out=power)
    value = _mix(data.astype(np.uint64) + np.uint64(1)) * power[place]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    whole = sums[first[1:]] - sums[first[:-1]]
    before = sums[:-1] - sums[first[line]]
    # what follows the place moves down by one power
    without = before + (whole[line] - before - value) * np.uint64(_INVERSE)
    return np.concatenate([np.arange(len(lines)), line]), np.concatenate([np.full(len(lines), -1), place]), _mix(np.concatenate([whole, without]) ^ _mix(np.concatenate([n, n[line] - 1]).astype(np.uint64)))


#: A line's place: document id, hash of the document's text (tells rows of equal or null ids apart), number of the line.
PLACE = ["doc", "th", "no"]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = b.column("line").to_pylist()
        places = [b.column(c).to_numpy() for c in PLACE]
        at = 0
        while at < len(text):
            end, size = at, 0
            while end < len(text) and (end == at or size + len(text[end]) <= BLOCK):
                size += len(text[end])
                end += 1
            line, place, key = variants(text[at:end])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), *(pa.array(p[at:end][line]) for p in places)], names=["key", "place", *PLACE])
            at = end


def _halves() -> Column:
    """Keys of which two lines within one edit share one: for the shorter length m, its first or last half and m."""
    n = F.length("line")

    def of(m: Column) -> Column:
        half = F.floor(m / 2).cast("int")
        return F.array(
            F.xxhash64(m, F.lit(0), F.expr("line").substr(F.lit(1), half)),
            F.xxhash64(m, F.lit(1), F.expr("line").substr(n - (m - half) + 1, m - half)),
        )

    return F.array_distinct(F.concat(of(n), of(n - 1)))


#: Stands for a null id, which is after all others.
NULL_ID = (1 << 63) - 1


def _document(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(F.col(text_col)).alias("th")]


def distinct_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """line and place (doc, th, no) of every distinct line that isn't blank: where it is first."""
    lines = docs.select(*_document(id_col, text_col), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("no", "line")).filter(F.trim("line") != "")
    firsts = lines.groupBy("line").agg(F.min(F.struct(*PLACE)).alias("f"))
    return firsts.select("line", *[F.col(f"f.{c}").alias(c) for c in PLACE])


def line_witnesses(docs: DataFrame, min_chars: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """line, place and keep of the distinct lines; keep is false where an earlier line is within one edit.

    Lines of fewer than min_chars characters are like equal lines only. An earlier line counts whether it is
    kept itself or not."""
    with common.freed_shuffles(docs.sparkSession):
        return _witnesses(docs, min_chars, id_col, text_col)[0]


def _witnesses(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """line_witnesses, and the folders it reads."""
    spark = docs.sparkSession
    path = {k: common.new_path(spark, k) for k in ("lines", "alike", "live", "gone")}
    lines = common.materialise(distinct_lines(docs, id_col, text_col), "lines", path["lines"])
    long = lines.filter(F.length("line") >= min_chars)
    halves = long.select(*PLACE, F.explode(_halves()).alias("half"))
    # lines that share a half with another: by counts, then the places of these lines
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    alike = halves.join(shared, "half", "left_semi").select(*PLACE).distinct()
    some = common.materialise(long.join(alike, PLACE, "left_semi"), "alike", path["alike"])
    common.bound_batches(spark)
    keys = some.mapInArrow(_emit, "key long, place int, doc long, th long, no int")
    here = F.struct(*PLACE)
    # the earliest of each variant at each place, combined before the shuffle; then per variant
    met = keys.groupBy("key", "place").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    own, cut = F.when(F.col("place") < 0, F.col("first")), F.when(F.col("place") >= 0, F.col("first"))
    by_key = Window.partitionBy("key")  # at most one row for each place in a line
    met = met.withColumn("own", F.min(own).over(by_key)).withColumn("cut", F.min(cut).over(by_key))
    # for lines cut at one place: the first of these, or the line that is the variant; for that line: the first cut anywhere
    met = met.withColumn("witness", F.when(F.col("place") < 0, F.col("cut")).otherwise(F.least("first", "own"))).filter(F.col("witness") < F.col("last"))
    live = common.materialise(met.select("key", "place", "witness"), "live", path["live"])
    hit = keys.join(live, ["key", "place"]).filter(F.col("witness") < here)
    asked = hit.select(*PLACE, *[F.col(f"witness.{c}").alias(f"w_{c}") for c in PLACE]).distinct()
    text = some.select(F.col("line").alias("w_line"), *[F.col(c).alias(f"w_{c}") for c in PLACE])
    near = asked.join(text, [f"w_{c}" for c in PLACE]).join(some, PLACE).filter(F.levenshtein("line", "w_line", 1).between(0, 1))
    gone = common.materialise(near.select(*PLACE).distinct().withColumn("gone", F.lit(True)), "gone", path["gone"])
    for k in ("alike", "live"):
        common.drop_path(spark, path.pop(k))
    return lines.join(gone, PLACE, "left").select("line", *PLACE, F.col("gone").isNull().alias("keep")), list(path.values())


def line_dedup(docs: DataFrame, min_chars: int = 12, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every line gone that equals, or is within one edit of, a line that comes earlier; same columns and rows.

    Earlier: in a document of smaller id (null last; rows of equal ids in the order of a hash of their text) or before
    it in the same. Lines end at newlines; blank lines always stay. Lines under min_chars characters go only for
    equal ones. Rows of equal id and text are one document and keep the same lines. Null texts stay null; a text that
    loses all lines is empty. chars_col, if the table has it, gets the new length. An empty table gives no rows."""
    spark = docs.sparkSession
    with common.freed_shuffles(spark):
        witnesses, read = _witnesses(docs, min_chars, id_col, text_col)
        # numbers of the kept lines as 64-bit masks, by document
        masks = witnesses.filter("keep").groupBy("doc", "th", F.expr("no div 64").cast("int").alias("b")).agg(F.expr("bit_or(shiftleft(1L, no % 64))").alias("m"))
        stay = masks.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("b", "m"))).alias("__m")).withColumnsRenamed({"doc": "__doc", "th": "__th"})
        stay = common.materialise(stay, "stay")
    for p in read:
        common.drop_path(spark, p)
    doc, th = _document(id_col, text_col)
    joined = docs.withColumns({"__doc": doc, "__th": th}).join(stay, ["__doc", "__th"], "left")
    dense = F.expr("aggregate(coalesce(__m, array()), cast(array() as array<bigint>), (a, x) -> concat(a, array_repeat(0L, x.b - size(a)), array(x.m)))")
    joined = joined.withColumn("__dense", dense).withColumn("__parts", F.split(F.col(text_col), "\n", -1))
    left = F.expr("filter(__parts, (x, i) -> trim(x) = '' or (shiftright(coalesce(try_element_at(__dense, cast(i div 64 as int) + 1), 0L), i % 64) & 1) = 1)")
    out = joined.withColumn("__text", F.when(F.col(text_col).isNotNull(), F.array_join(left, "\n")))
    new = {text_col: F.col("__text")}
    if chars_col in docs.columns:
        new[chars_col] = F.length("__text").cast(docs.schema[chars_col].dataType)
    return out.withColumns(new).select(*docs.columns)
