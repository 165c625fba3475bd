"""Operator 1: approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of `books` codewords, one from each of as many full-dimensional codebooks.
The codebooks are trained on a bounded sample: k-means on the residuals, level by level, then least squares
over all codewords at once for the codes that beam search finds. Every row is encoded by beam search, which
follows the `beam` best partial sums through the levels. With the codes two numbers are stored: the squared
norm of the approximation (for Euclidean distance) and the factor that makes its inner product with the row
itself that of the row (for inner products).

A search reads stated queries in blocks against strips of the index: a lookup table of the queries' inner products
with all codewords, sums of table entries for all rows of a strip, then exact scores in double precision of
the best `rerank` rows of the strip and of all rows that tie with the last of them. The best k of each
strip are merged per query.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm import common


@dataclass(frozen=True)
class Settings:
    books: int = 8
    words: int = 256
    beam: int = 8
    #: Rows of the training sample at most, those with the smallest hash of their id.
    sample: int = 20_000
    rounds: int = 8
    #: Rows of a strip and queries of a block, about.
    strip: int = 8_192
    queries: int = 512
    #: Rows of a strip that are scored exactly for each query.
    rerank: int = 400


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Quantiser:
    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)  # levels, words, dimensions
        m, k, d = books.shape
        flat = self.books.reshape(m * k, d)
        self.gram = (flat @ flat.T).reshape(m, k, m, k)
        self.square = (self.books**2).sum(2)

    @classmethod
    def train(cls, x: np.ndarray, settings: Settings) -> Quantiser:
        rng, x = np.random.default_rng(0), x.astype(np.float32)
        k, d = settings.words, x.shape[1]
        books, rest = [], x.copy()
        for _ in range(settings.books):
            words = rest[rng.choice(len(rest), k, replace=len(rest) < k)].copy()
            for _ in range(settings.rounds):
                near = ((words**2).sum(1)[None] - 2 * rest @ words.T).argmin(1)
                count = np.bincount(near, minlength=k)
                total = np.zeros((k, d))
                np.add.at(total, near, rest)
                words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words).astype(np.float32)
            near = ((words**2).sum(1)[None] - 2 * rest @ words.T).argmin(1)
            rest = rest - words[near]
            books.append(words)
        made = cls(np.stack(books))
        for _ in range(2):  # all codewords at once, given the codes
            codes, m = made.encode(x, settings.beam), settings.books
            normal, right = np.eye(m * k) * 0.1, np.zeros((m * k, d))
            at = codes + np.arange(m) * k
            for a in range(m):
                np.add.at(right, at[:, a], x)
                for b in range(m):
                    np.add.at(normal, (at[:, a], at[:, b]), 1.0)
            made = cls(np.linalg.solve(normal, right + 0.1 * made.books.reshape(m * k, d)).reshape(m, k, d))
        return made

    def encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        """Codes of the rows of x, by beam search."""
        return np.concatenate([self._beam(x[i : i + 1024].astype(np.float32), beam) for i in range(0, len(x), 1024)]) if len(x) else np.zeros((0, len(self.books)), np.int64)

    def _beam(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, (m, k, _) = len(x), self.books.shape
        dots = [x @ self.books[level].T for level in range(m)]
        cost, codes = np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.int64)
        row = np.arange(n)[:, None]
        for level in range(m):
            # |x - s - c|^2 = |x - s|^2 - 2 <x, c> + 2 <s, c> + |c|^2
            grown = cost[:, :, None] + (self.square[level] - 2 * dots[level])[:, None, :]
            for before in range(level):
                grown += 2 * self.gram[before, codes[:, :, before], level]
            flat = grown.reshape(n, -1)
            keep = min(beam, flat.shape[1]) if level < m - 1 else 1
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            cost = flat[row, best]
            codes = np.concatenate([codes[row, best // k], (best % k)[:, :, None]], axis=2)
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[level][codes[:, level]] for level in range(len(self.books)))


def _save(store: pafs.FileSystem, name: str, **arrays: np.ndarray) -> None:
    buf = io.BytesIO()
    np.savez(buf, **arrays)
    with store.open_output_stream(name) as f:
        f.write(buf.getvalue())


def _open(path: str, name: str) -> dict[str, np.ndarray]:
    store, root = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/{name}") as f:
        return dict(np.load(io.BytesIO(f.read())))


def _parts(rows: DataFrame, path: str, size: int, count: int, prepare) -> DataFrame:
    """Deal rows (id, v) by hash into parts of about size and write a file each; (part, file)."""
    parts = max(1, -(-count // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        held: dict[int, list] = {}
        for b in batches:
            part, ids, v = b.column("part").to_numpy(), b.column("id").to_numpy(), b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            for p in np.unique(part):
                held.setdefault(int(p), []).append((ids[part == p], v[part == p]))
        for p, some in held.items():
            ids, v = np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some])
            order = np.argsort(ids, kind="stable")
            _save(store, f"{root}/{(name := uuid.uuid4().hex)}", ids=ids[order], v=v[order], **prepare(v[order]))
            yield pa.RecordBatch.from_pylist([{"part": p, "file": name}], schema=pa.schema([("part", pa.int32()), ("file", pa.string())]))

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))
    return common.materialise(dealt.mapInArrow(run, "part int, file string"), "parts")


def _score(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact scores of rows v for one query; larger is nearer. Equal rows get equal scores wherever they stand."""
    if metric == "l2":
        return -((v - q) ** 2).sum(1)
    return (v * q).sum(1)


def search(rows: DataFrame, queries: Column, k: int = 20, metric: str = "ip", settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of each query's k nearest of all other rows (all of them, if fewer), nearest first.

    queries: a condition on the id column that states which rows are queries. metric: "ip" (inner product) or "l2" (score
    is minus the squared distance), both in double precision on the original vectors; ties go to smaller ids. Rows
    whose vector is null, zero, or has null or non-finite components, or whose id is null, take no part, nor do
    those of another than the most frequent dimension. Of rows with the query's id none is a candidate; repeated rows of
    a query are one query. An empty table gives no rows."""
    spark = rows.sparkSession
    common.bound_batches(spark)
    good = rows.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), queries.alias("asked"))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("int")).alias("q")).orderBy(F.desc("n"), "d").first()
    out = "query_id long, rank int, id long, score double"
    if sizes is None or not sizes.q:
        return spark.createDataFrame([], out)
    good = good.filter(F.size("v") == sizes.d)
    sample = good.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(settings.sample).toPandas()
    model = spark.sparkContext.broadcast(Quantiser.train(np.array(sample["v"].tolist()), settings))
    path = common.new_path(spark, "index")
    common.make_dir(spark, path)

    def encoded(v: np.ndarray) -> dict[str, np.ndarray]:
        codes = model.value.encode(v, settings.beam)
        near = model.value.decode(codes)
        dot = (near * v).sum(1)
        return {"codes": codes.astype(np.uint8 if settings.words <= 256 else np.uint16), "norm": (near**2).sum(1), "factor": ((v**2).sum(1) / np.where(dot > 0, dot, np.inf)).astype(np.float32)}

    strips = _parts(good.select("id", "v"), path, settings.strip, sizes.n, encoded)
    blocks = _parts(good.filter("asked").select("id", "v").dropDuplicates(["id"]), path, settings.queries, sizes.q, lambda v: {})
    # a row for each strip and block: file names, not vectors
    names = [r.file for r in blocks.select("file").collect()]
    every = strips.select(F.col("file").alias("strip"), F.explode(F.array(*[F.lit(n) for n in names])).alias("block"))
    tasks = max(1, min(len(names) * (-(-sizes.n // settings.strip)), 4 * common.shuffle_partitions(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = model.value.books
        for b in batches:
            for pair in b.to_pylist():
                s, q = _open(path, pair["strip"]), _open(path, pair["block"])
                approx = np.zeros((len(s["ids"]), len(q["ids"])), np.float32)
                for level in range(len(books)):
                    table = books[level] @ q["v"].T.astype(np.float32)  # words, queries
                    approx += table[s["codes"][:, level]]
                approx = approx * s["factor"][:, None] if metric == "ip" else 2 * approx - s["norm"][:, None]
                found = []
                n, few = len(s["ids"]), min(len(s["ids"]), settings.rerank + 1)
                floors = -np.partition(-approx, few - 1, axis=0)[few - 1] if few < n else np.full(len(q["ids"]), -np.inf)
                for j, (i, v) in enumerate(zip(q["ids"], q["v"])):
                    at = np.flatnonzero((approx[:, j] >= floors[j]) & (s["ids"] != i))
                    exact = _score(metric, v, s["v"][at])
                    best = np.lexsort((s["ids"][at], -exact))[:k]
                    found.append((np.full(len(best), i), s["ids"][at][best], exact[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query_id", "id", "score"])

    best = every.repartition(tasks, "strip", "block").mapInArrow(run, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
