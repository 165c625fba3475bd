"""Operator 10: SimHash near-duplicates found by covering locality-sensitive hashing.

A document's fingerprint has a bit set where over half the XXH64 values of its word shingles have it.
For radius r, bit i gets a non-zero vector a(i) of r + 1 bits; table v (a non-zero vector too: 2**(r+1) - 1
tables) keeps the bits i with <a(i), v> odd. At most r differing bits span at most r dimensions, so some v is
orthogonal to all their vectors, and in that table the two fingerprints have the same key: every pair within
the radius collides, by construction and not by chance.

Fingerprints are made distinct first, so copies cost nothing. In a table, keys of few members have their
members compared. Keys of more members are not compared pair by pair: each member is listed under the
points within half the radius (over the bits the table drops), and those listed under one point are linked
to the smallest - the same components, with links in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm import common
from spanlake.llm.components import components

BITS = 64
#: Members of a key that are compared with each other; larger keys go by way of points.
FEW = 8


def shingles(text: str, size: int) -> list[bytes]:
    """Runs of size words of the text with A-Z in lower case; all words if there are fewer, none if none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    joined, starts, at = b" ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[size:]] + [len(joined)]
    return [joined[a:b] for a, b in zip(starts, ends)]


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """The 64 bits, as a signed number; 0 without words."""
    some = shingles(text, size)
    if not some:
        return 0
    h, x = np.array([xxhash.xxh64_intdigest(s, seed) for s in some], "<u8"), 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    x = int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])
    return x


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (long) of every row; null texts have no words."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t, size) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """The bits each covering table keeps, as signed numbers."""
    top = (1 << (radius + 1)) - 1
    keep = []
    for v in range(1, top + 1):
        m = sum(1 << i for i in range(BITS) if ((i % top + 1) & v).bit_count() % 2)
        keep.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    return keep


def _flips(mask: int, most: int) -> list[int]:
    free = [1 << i for i in range(BITS) if not (mask >> i) & 1]
    out = [sum(some) for k in range(most + 1) for some in combinations(free, k)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in out]


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v), u > v, between distinct fingerprints fp within radius bits whose components are those of all such pairs."""
    keep = masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(keep)])
    keyed = nodes.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    met = common.materialise(keyed.join(sizes, ["t", "k"]).select("t", "k", "fp", "n"), "met")

    def near(a: Column, b: Column) -> Column:
        return F.bit_count(a.bitwiseXOR(b)) <= radius

    few = met.filter(F.col("n") <= FEW).groupBy("t", "k").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: (b < a) & near(a, b)), lambda b: F.struct(a.alias("u"), b.alias("v")))))
    small = few.select(F.explode(pairs).alias("e")).select("e.u", "e.v")

    # x and y within the radius have a point within `inner` of the one and `outer` of the other
    inner, outer = radius // 2, radius - radius // 2
    many = met.filter(F.col("n") > FEW)
    flips = F.array(*[F.array(*[F.lit(x).cast("long") for x in _flips(m, outer)]) for m in keep])
    points = many.select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("f")).select("fp", F.col("fp").bitwiseXOR(F.col("f")).alias("z"), (F.bit_count("f") <= inner).alias("close")).distinct()
    # at most as many members as the ball around a point has
    stars = points.groupBy("z").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("hub"), F.collect_list("fp").alias("m")).filter((F.size("m") > 1) & F.col("hub").isNotNull())
    large = stars.select("hub", F.explode("m").alias("x")).filter("x != hub").select(F.greatest("x", "hub").alias("u"), F.least("x", "hub").alias("v"))
    return small.union(large).distinct()


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Null and blank texts have fingerprint zero and are linked like any other. Rows with equal ids each get a row. A
    null id is no smallest id; a component of null ids alone has none. An empty table gives no rows."""
    rows = common.materialise(fingerprints(docs, size, id_col, text_col), "fps")
    nodes = common.materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("doc")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Groups by similarity, for filtering


#: Classes a document's shingles are dealt to at least this many a class, tables, and the fewest classes (a power of two).
CLASS, TABLES, LEAST = 5, 40, 3
#: Shingles that a block of members of a large key has, about.
BLOCK = 1 << 17


def class_keys(hashes: np.ndarray) -> list[int]:
    """Keys of the SimHash fingerprints of parts of a document, for tables 0 .. TABLES - 1, at one or two levels.

    A level has 2**level classes of CLASS to 2 * CLASS shingles; a document whose size is just over a level's lower bound
    also counts at the level below, so documents of similar sizes meet. Where a level has fewer classes than
    there are tables, the shingles are dealt again with another salt. Empty classes have no key."""
    n = len(hashes)
    if not n:
        return []
    level = max(LEAST, int(np.log2(max(1, n // CLASS))))
    levels = [level] + ([level - 1] if level > LEAST and n * 0.8 < CLASS << level else [])
    out = []
    for at in levels:
        salt = 0
        for first in range(0, TABLES, 1 << at):
            with np.errstate(over="ignore"):
                h = (hashes ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            part = (h & np.uint64((1 << at) - 1)).astype(np.int64)
            used = np.flatnonzero(part < min(1 << at, TABLES - first))
            if len(used):
                used = used[np.argsort(part[used], kind="stable")]
                part = part[used]
                begins = np.flatnonzero(np.diff(part, prepend=-1))
                bits = np.unpackbits(hashes[used].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
                prints = np.packbits(ones * 2 > np.diff(begins, append=len(part))[:, None], axis=1, bitorder="little")
                out += [xxhash.xxh64_intdigest(x.tobytes() + bytes((at, first + t))) - (1 << 63) for x, t in zip(prints, part[begins].tolist())]
            salt += 1
    return out


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps, sets, keys = [], [], []
        for t in b.column("t").to_pylist():
            h = np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(t, size)], "<u8"))
            ones = np.zeros(BITS, np.int64)
            for i in range(0, len(h), 1 << 16):
                ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            fps.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0]) if len(h) else 0)
            sets.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63))
            keys.append(class_keys(h))
        yield pa.RecordBatch.from_arrays([b.column("d"), b.column("th"), pa.array(fps, pa.int64()), pa.array(sets, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["d", "th", "fp", "s", "keys"])


def jaccard(a: str, b: str, size: int) -> float:
    x, y = set(shingles(a, size)), set(shingles(b, size))
    return len(x & y) / len(x | y) if x or y else 1.0


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, th, first_d, first_th) of every row: its id, the hash of its text, and the row of its group that comes first.

    Groups are the components of verified links: documents whose sets of `size`-word shingles have a Jaccard similarity
    of `similarity` or more. Equal sets (texts without words, too) are one. Candidates come from the covering tables
    of the whole fingerprints, which miss no pair within radius bits, and, as lower similarities differ in more bits
    than masks can cover, from SimHash fingerprints of classes of the shingles (see class_keys). Every pair that has
    a key in common is compared, or is in one group already: a key's members are compared with its first; keys whose
    members aren't one group by all such links are dealt to blocks, and a block's members outside its largest group are
    compared with all of it, then with the other blocks. Rows grow with the members, whatever a key's size. Null ids
    come last."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("th", F.xxhash64("t"))
    rows = common.materialise(texts.select("d", "th", "t").mapInArrow(lambda it: _sets(it, size), "d long, th long, fp long, s long, keys array<long>"), "sets")
    first = rows.groupBy("s").agg(F.min(F.struct("d", "th", "fp", "keys")).alias("f"))
    nodes = common.materialise(first.select("s", "f.d", "f.th", "f.fp", "f.keys"), "nodes")

    # whole fingerprints: nodes of one fingerprint are linked through the smallest of them
    prints = nodes.groupBy("fp").agg(F.min("s").alias("hub"))
    same = nodes.join(prints, "fp").filter("s != hub").select(F.greatest("s", "hub").alias("a"), F.least("s", "hub").alias("b"))
    near = links(prints.select("fp"), radius)
    of_u, of_v = prints.select(F.col("fp").alias("u"), F.col("hub").alias("x")), prints.select(F.col("fp").alias("v"), F.col("hub").alias("y"))
    whole = near.join(of_u, "u").join(of_v, "v").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))

    # classes: all members of a key with the first of them, in proportion to the members
    keyed = common.materialise(nodes.select("s", F.explode("keys").alias("k")).distinct(), "keyed")
    firsts = keyed.groupBy("k").agg(F.min("s").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    met = common.materialise(keyed.join(firsts.select("k", "hub"), "k"), "met")
    stars = met.filter("s != hub").select(F.col("s").alias("a"), F.col("hub").alias("b"))
    found = _verified(same.union(whole).union(stars).distinct(), nodes, texts, size, similarity)

    # keys that these links leave in several groups, in blocks
    named = common.materialise(met.join(_roots(found).withColumnRenamed("node", "s"), "s", "left").select("k", "s", F.coalesce("root", "s").alias("root")), "named")
    several = named.groupBy("k").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("k")
    several = common.materialise(named.join(several, "k", "left_semi"), "several")
    asked = nodes.join(several.select("s").distinct(), "s", "left_semi").select("s", "d", "th")
    sets = common.materialise(texts.join(asked, ["d", "th"]).dropDuplicates(["s"]).select("s", "t").mapInArrow(lambda it: _hashes(it, size), "s long, n long, h array<long>"), "hashes")
    sizes = several.join(sets.select("s", "n"), "s").groupBy("k").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = common.materialise(several.join(sizes, "k").withColumn("i", _block("blocks")), "dealt")
    inside = _joined(dealt.select("s", "root", F.xxhash64("k", "i", "i").alias("place")), sets, similarity)
    found = found.union(_verified(inside.distinct(), nodes, texts, size, similarity))
    if not dealt.filter("blocks > 1").isEmpty():
        found = found.union(_verified(_across(dealt.filter("blocks > 1"), sets, found, similarity).distinct(), nodes, texts, size, similarity))
    roots = _roots(found)
    labelled = nodes.select("s", "d", "th").join(roots.withColumnRenamed("node", "s"), "s", "left").select("s", "d", "th", F.coalesce("root", "s").alias("root"))
    least = labelled.groupBy("root").agg(F.min(F.struct("d", "th")).alias("f"))
    named = labelled.join(least, "root").select("s", F.col("f.d").alias("first_d"), F.col("f.th").alias("first_th"))
    return rows.select("d", "th", "s").join(named, "s").select("d", "th", "first_d", "first_th")


def _roots(links: DataFrame) -> DataFrame:
    return components(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("s"), F.col(blocks)).cast("int")


def _hashes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in shingles(t, size)], "<u8")).view("<i8") for t in b.column("t").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("s"), pa.array([len(h) for h in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["s", "n", "h"])


def spanning(hashes: np.ndarray, lengths: np.ndarray, label: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that join those of different labels to the components of all similar pairs.

    Sets lie one after the other in hashes. Each set outside the largest component is compared with all: of a pair in
    different components one at least is outside."""
    ids = np.unique(hashes, return_inverse=True)[1]
    starts = np.cumsum(lengths) - lengths
    label = np.unique(label, return_inverse=True)[1]
    done, mark, out = np.zeros(len(lengths), bool), np.zeros(len(hashes), bool), []
    while True:
        left = np.flatnonzero((label != np.bincount(label).argmax()) & ~done)
        if not len(left):
            return out
        q = left[0]
        done[q] = True
        own = ids[starts[q] : starts[q] + lengths[q]]
        mark[own] = True
        both = np.add.reduceat(mark[ids], starts, dtype=np.int64)
        mark[own] = False
        hit = np.flatnonzero((both / (lengths + lengths[q] - both) >= similarity) & (label != label[q]))
        groups, firsts = np.unique(label[hit], return_index=True)
        out += [(int(q), int(x)) for x in hit[firsts]]
        label[np.isin(label, groups)] = label[q]


def _joined(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the members (s, root) of each place to the components of all similar pairs in it.

    Places are hashes of what they stand for; two of one hash are compared as one, which finds no false link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None  # rows of the place that goes on

        def end() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            s, h = rows.column("s").to_numpy(), rows.column("h").combine_chunks()
            found = spanning(h.flatten().to_numpy(), rows.column("n").to_numpy(), rows.column("root").to_numpy(), similarity)
            a, b = np.array([s[x] for x, _ in found], np.int64), np.array([s[y] for _, y in found], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            place = batch.column("place").to_numpy()
            edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            for x, y in zip(edges, edges[1:]):
                if x < y:
                    if held and place[x] != at:
                        yield end()
                        held = []
                    held.append(batch.slice(x, y - x))
                    at = place[x]
        if held:
            yield end()

    rows = members.join(sets, "s").select("place", "s", "root", "n", "h")
    return rows.repartition("place").sortWithinPartitions("place").mapInArrow(run, "a long, b long")


def _across(dealt: DataFrame, sets: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Links between members (k, s, blocks, i) in different blocks of a key: those outside its largest group with all."""
    named = common.materialise(dealt.drop("root").join(_roots(found).withColumnRenamed("node", "s"), "s", "left").select("k", "s", "blocks", "i", F.coalesce("root", "s").alias("root")), "named")
    held = named.groupBy("k", "root").agg(F.count("*").alias("n"))
    main = held.groupBy("k").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"))
    main = main.select("k", F.col("m.root").alias("main"), (F.col("all") - F.col("m.n")).alias("out"), "all").filter("out > 0")
    # blocks of those outside, in proportion to the blocks of all
    some = named.join(main, "k").withColumn("outs", F.greatest(F.lit(1), F.ceil(F.col("blocks") * F.col("out") / F.col("all")).cast("int")))
    outside = some.filter("root != main").withColumn("o", _block("outs")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = some.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("outs") - 1))).withColumn("j", F.col("i"))
    cols = ["s", "root", F.xxhash64("k", "o", "j").alias("place")]
    return _joined(outside.select(*cols).union(every.select(*cols)).distinct(), sets, similarity)


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are as similar as asked; written."""
    pairs = common.materialise(pairs, "pairs")
    asked = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct()
    places = nodes.join(asked, "s", "left_semi").select("s", "d", "th")
    # equal rows have equal ids and texts
    some = common.materialise(texts.join(places, ["d", "th"]).dropDuplicates(["s"]).select("s", "t"), "texts")
    left, right = some.select(F.col("s").alias("a"), F.col("t").alias("x")), some.select(F.col("s").alias("b"), F.col("t").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [jaccard(x, y, size) >= similarity for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return common.materialise(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def near_dedup(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar_groups(), the first by id, columns unchanged.

    Rows without words (null and blank texts) are one group. Null ids come last, equal ids in the order of a hash of
    the text. Of rows of equal id and text that whose columns are smallest in order stays (any, if a column can't be
    ordered). An empty table gives no rows."""
    groups = similar_groups(docs, size, similarity, radius, id_col, text_col)
    stay = groups.filter("d = first_d and th = first_th").select(F.col("d").alias("__d"), F.col("th").alias("__th")).distinct()
    key, th = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    marked = docs.withColumns({"__d": key, "__th": th}).join(stay, ["__d", "__th"], "left_semi")
    if any(x in f.dataType.simpleString() for f in docs.schema for x in ("map<", "variant", "interval")):
        return marked.dropDuplicates(["__d", "__th"]).select(*docs.columns)
    return marked.groupBy("__d", "__th").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__r")).select("__r.*")
