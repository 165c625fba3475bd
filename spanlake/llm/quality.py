"""Operator 4: a quality classifier with hierarchical empirical Bayes over hosts and paths.

Two logistic models (low quality, toxic) over words, word beginnings and the shape of the whole text give each
document its evidence: the log-odds without the training prior. Sites are judged by all their documents:
expected shares of bad documents are summed per path and per host by grouped aggregation, and shrunk -
path towards host, host towards the global share - by Beta priors whose strengths come from the spread
between sites (method of moments), so a site with few documents has its parent's share. A document's
posterior joins its evidence with the prior of its path, made without the document itself.

The models are fitted on the driver on at most `sample` labelled rows (those with the smallest hash of their
id); everything else - evidence, shares, strengths - covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm import common
from spanlake.llm.substrings import _BASE, _BYTES, _INVERSE, _power, mix

SLOTS = 1 << 18
#: Bytes at a word's start that are a feature of their own.
START = 5
SHAPES = 8
#: Bytes hashed at a time; longer texts are hashed in pieces cut between words.
PIECE = 2 << 20
_LETTER = np.ones(256, bool)
_LETTER[:128] = [chr(b).isalnum() for b in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'\"-;:()"]] = True


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash of the word and hash of its first bytes, of each run of letters, digits and non-ASCII bytes."""
    edge = np.flatnonzero(np.diff(_LETTER[raw].astype(np.int8), prepend=0, append=0))
    first, last = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[raw]] * _power(_BASE, len(raw)), out=sums[1:])
    back = _power(_INVERSE, len(raw) + 1)[first]
    return first, mix((sums[last] - sums[first]) * back), mix((sums[np.minimum(last, first + START)] - sums[first]) * back ^ np.uint64(0x5555))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, slot) of the words and beginnings in each text, repeats included, and the shape of each text."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    shape, rows, slots = np.zeros((len(data), SHAPES)), [], []
    pending: list[tuple[int, bytes]] = []

    def flush() -> None:
        if not pending:
            return
        raw = np.frombuffer(b" ".join(d for _, d in pending), np.uint8)
        ends = np.cumsum([len(d) + 1 for _, d in pending])
        first, word, start = _words(raw)
        at = np.array([k for k, _ in pending])[np.searchsorted(ends, first, "right")] if len(first) else first
        rows.extend((at, at))
        slots.extend(((word % np.uint64(SLOTS)).astype(np.int64), (start % np.uint64(SLOTS)).astype(np.int64)))
        pending.clear()

    size = 0
    for k, d in enumerate(data):
        while len(d) > PIECE:
            cut = max(d.rfind(b" ", 0, PIECE), d.rfind(b"\n", 0, PIECE)) + 1 or PIECE
            pending.append((k, d[:cut]))
            flush()
            d = d[cut:]
        pending.append((k, d))
        size += len(d)
        if size > PIECE:
            flush()
            size = 0
    flush()
    row, slot = (np.concatenate(rows), np.concatenate(slots)) if rows else (np.zeros(0, np.int64),) * 2
    words = np.bincount(row, minlength=len(data)) / 2
    pairs = np.unique(row * SLOTS + slot) // SLOTS
    distinct = np.bincount(pairs, minlength=len(data)) / 2
    for k, d in enumerate(data):
        raw = np.frombuffer(d, np.uint8)
        n, w = max(1, len(raw)), max(1.0, words[k])
        upper = np.count_nonzero((raw >= 65) & (raw <= 90))
        marks = np.count_nonzero(_MARK[raw])
        shape[k] = (
            np.log1p(n),
            n / w,
            min(1.0, 20 * marks / n),
            min(1.0, 5 * upper / n),
            distinct[k] / w,
            min(1.0, np.log1p(w / max(1.0, distinct[k])) / 3),
            min(1.0, 20 * d.count(b"|") / n),
            min(1.0, 10 * np.count_nonzero((raw >= 48) & (raw <= 57)) / n),
        )
    return row, slot, shape


@dataclass
class Model:
    """A logistic model: a weight for each chosen slot (0 elsewhere), weights of the shapes, and the log-odds of its training rows."""

    slots: np.ndarray
    shapes: np.ndarray
    middle: np.ndarray
    scale: np.ndarray
    bias: float
    prior: float

    def evidence(self, row: np.ndarray, slot: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Log-odds of each text beyond the training prior; a slot counts once a text."""
        hit = self.slots[slot] != 0
        pairs = np.unique(row[hit] * SLOTS + slot[hit])
        words = np.bincount(pairs // SLOTS, self.slots[pairs % SLOTS], len(shape))
        return self.bias - self.prior + words + _bend((shape - self.middle) / self.scale) @ self.shapes


def _bend(z: np.ndarray) -> np.ndarray:
    """Each shape itself and how far it lies to either side."""
    z = np.clip(z, -6, 6)
    return np.hstack([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)])


def fit(row: np.ndarray, slot: np.ndarray, shape: np.ndarray, bad: np.ndarray, chosen: int = 800, ridge: float = 1.0, rounds: int = 12) -> Model:
    """Choose the slots that differ most between the classes and fit by iterated least squares with a ridge.

    (text number, slot) pairs are distinct."""
    n, ones = len(bad), max(1, int(bad.sum()))
    middle, scale = shape.mean(0) if n else np.zeros(SHAPES), (shape.std(0) if n else np.ones(SHAPES)) + 1e-6
    prior = float(np.log((bad.sum() + 0.5) / (n - bad.sum() + 9.5)))  # without labels, one in twenty
    if not 0 < bad.sum() < n:  # one class, or no rows: nothing to learn
        return Model(np.zeros(SLOTS), np.zeros(3 * SHAPES), middle, scale, prior, prior)
    r, s = row, slot
    has1, has0 = np.bincount(s[bad[r]], minlength=SLOTS), np.bincount(s[~bad[r]], minlength=SLOTS)
    p, share = (has1 + has0) / n, has1 / ones - has0 / (n - ones)
    z = np.abs(share) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / ones + 1 / (n - ones)))
    z[has1 + has0 < 4] = 0
    best = np.argsort(-z, kind="stable")[:chosen]
    best = best[z[best] > 4]
    place = np.full(SLOTS, -1)
    place[best] = np.arange(len(best))
    x = np.zeros((n, len(best) + 3 * SHAPES + 1), np.float32)
    keep = place[s] >= 0
    x[r[keep], place[s[keep]]] = 1
    x[:, len(best) : -1] = _bend((shape - middle) / scale)
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    w[-1] = prior
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        weight = np.maximum(prob * (1 - prob), 1e-5)
        curve = np.diag(penalty)
        for i in range(0, n, 1000):  # some rows at a time, so no second copy of x is held
            part = x[i : i + 1000]
            curve += (part * weight[i : i + 1000, None].astype(np.float32)).T @ part
        step = np.linalg.solve(curve, x.T @ (bad - prob) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    slots = np.zeros(SLOTS)
    slots[best] = w[: len(best)]
    return Model(slots, w[len(best) : -1], middle, scale, float(w[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 8_000) -> list[Model]:
    """Models of low quality (quality = 0) and of toxic documents, from at most `sample` labelled rows.

    Where labels of an id differ the worse count: low quality, toxic. Of documents of one id that with the smallest text is
    fitted on, so what comes to the driver is at most `sample` rows."""
    some = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("__q"), F.max("toxic").alias("__t"))
    some = some.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    common.bound_batches(docs.sparkSession)
    # at most `sample` ids: a bounded broadcast
    rows = docs.join(F.broadcast(some), docs[id_col] == some["__id"]).groupBy("__id", "__q", "__t").agg(F.min(text_col).alias("__x"))
    got = rows.mapInArrow(_lean, "q int, t int, slots binary, shape binary").collect()
    row = np.repeat(np.arange(len(got), dtype=np.int32), [len(g.slots) // 4 for g in got])
    slot = np.frombuffer(b"".join([bytes(g.slots) for g in got]), "<i4")
    shape = np.frombuffer(b"".join([bytes(g.shape) for g in got]), "<f8").reshape(-1, SHAPES)
    classes = [np.array([g.q == 0 for g in got], bool), np.array([g.t == 1 for g in got], bool)]
    del got
    return [fit(row, slot, shape, bad) for bad in classes]


def _lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts as their distinct slots and shapes."""
    for b in (x for batch in batches for x in common.slices(batch, "__x")):
        row, slot, shape = features(b.column("__x").to_pylist())
        pairs = np.unique(row * SLOTS + slot)
        cuts = np.searchsorted(pairs // SLOTS, np.arange(1, len(shape)))
        found = np.split((pairs % SLOTS).astype("<i4"), cuts) if len(shape) else []
        yield pa.RecordBatch.from_arrays([pa.array(b.column("__q").to_pylist(), pa.int32()), pa.array(b.column("__t").to_pylist(), pa.int32()), pa.array([f.tobytes() for f in found], pa.binary()), pa.array([x.astype("<f8").tobytes() for x in shape], pa.binary())], names=["q", "t", "slots", "shape"])


def evidence(docs: DataFrame, models: list[Model], host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), host, path, e0 and e1 (evidence of low quality and of being toxic) of every row; null texts are empty."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    sent = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in common.slices(batch, "t")):
            got = features(b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), b.column("host"), b.column("path"), *(pa.array(np.clip(m.evidence(*got), -30, 30)) for m in sent.value)], names=["doc_id", "th", "host", "path", "e0", "e1"])

    none = F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.coalesce(host.cast("string"), none).alias("host"), F.coalesce(path.cast("string"), none).alias("path"), F.coalesce(F.col(text_col), none).alias("t"))
    return rows.mapInArrow(run, "doc_id long, th long, host string, path string, e0 double, e1 double")


def _strength(sites: DataFrame, n: str, s: str, parent: Column) -> Column:
    """Strength of the Beta prior by moments: how much site shares differ beyond what their numbers explain."""
    weight, mean = F.sum(n), F.sum(F.col(n) * parent) / F.sum(n)
    within = F.sum(F.col(n) * parent * (1 - parent)) / F.sum(n)
    spread = F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - parent, 2)) / weight
    extra = spread - within * F.count("*") / weight
    # share (1 - share) = variance (strength + 1); between 1 (sites differ freely) and a million (not at all)
    return F.coalesce(F.least(F.greatest(mean * (1 - mean) / F.greatest(extra, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e6)), F.lit(1.0))


def posteriors(found: DataFrame, priors: list[float], broadcast_rows: int = 20_000) -> DataFrame:
    """found with p0 and p1: the posterior probabilities of low quality and of being toxic."""
    expect = [1 / (1 + F.exp(-(F.col(f"e{k}") + F.lit(priors[k])))) for k in (0, 1)]
    soft = found.withColumns({"r0": expect[0], "r1": expect[1]})
    paths = common.materialise(soft.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("r0").alias("s0"), F.sum("r1").alias("s1")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s0").alias("h0"), F.sum("s1").alias("h1"))
    hosts = common.materialise(hosts, "hosts")
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("h0").alias("s0"), F.sum("h1").alias("s1"), F.count("*").alias("k")).first()
    if not total.n:
        return found.withColumns({"p0": F.lit(0.0), "p1": F.lit(0.0)})
    share = [(total.s0 + 0.5) / (total.n + 1), (total.s1 + 0.5) / (total.n + 1)]
    kh = hosts.agg(*[_strength(hosts, "hn", f"h{k}", F.lit(share[k])).alias(f"k{k}") for k in (0, 1)]).first()
    hosts = hosts.select("host", "hn", "h0", "h1", *[((F.col(f"h{k}") + kh[k] * share[k]) / (F.col("hn") + kh[k])).alias(f"t{k}") for k in (0, 1)])
    sites = common.materialise(paths.join(hosts, "host"), "sites")
    kp = sites.agg(*[_strength(sites, "n", f"s{k}", F.col(f"t{k}")).alias(f"k{k}") for k in (0, 1)]).first()
    small = sites.count() <= broadcast_rows  # else an equi-join that adaptive execution splits where a path is hot
    joined = soft.join(F.broadcast(sites) if small else sites, ["host", "path"])
    out = {}
    for k in (0, 1):
        # without the document itself, on both levels
        top = (F.col(f"h{k}") - F.col(f"r{k}") + kh[k] * share[k]) / (F.col("hn") - 1 + kh[k])
        prior = (F.col(f"s{k}") - F.col(f"r{k}") + kp[k] * top) / (F.col("n") - 1 + kp[k])
        prior = F.least(F.greatest(prior, F.lit(1e-4)), F.lit(1 - 1e-4))
        out[f"p{k}"] = 1 / (1 + F.exp(-(F.col(f"e{k}") + F.log(prior / (1 - prior)))))
    return joined.withColumns(out).select(*found.columns, *out)


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, thresholds: tuple[float, float] = (0.5, 0.3), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, p_low_quality, p_toxic, keep of every row: keep is false where a posterior is over its threshold (a toxic document kept costs more than a clean one lost).

    host and path default to the source, and the source with the language. Null hosts and paths are sites of their
    own; null texts are empty. Without labels of both classes there is no evidence, and without
    any label every document is kept. Repeated rows are judged each. An empty table gives no rows."""
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if path is None else path
    models = train(docs, labels, id_col, text_col)
    found = common.materialise(evidence(docs, models, host, path, id_col, text_col), "evidence")
    got = posteriors(found, [m.prior for m in models])
    keep = (F.col("p0") <= thresholds[0]) & (F.col("p1") <= thresholds[1])
    return got.select("doc_id", "th", F.col("p0").alias("p_low_quality"), F.col("p1").alias("p_toxic"), keep.alias("keep"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that classify() keeps, columns unchanged."""
    bad = classify(docs, labels, id_col=id_col, text_col=text_col, **options).filter(~F.col("keep")).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__th")), "left_anti")
