"""Operator 8: mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Tokens are summed per cell (source, language, topic) - one grouped aggregation over the documents. Raking gives
every source, language and topic a factor, so that the cells' tokens times their factors have the target
shares on all three margins. The language and topic factors are few and are literals; the source factors
follow from them row by row, however many sources there are. A round sums the cells with the source factors of
the moment over (language, topic) - a job over cells, not documents - and fits the other two margins to it.

A document's weight is the product of its factors, its probability that weight times one common rate, the
largest at which no probability exceeds 1, so expected tokens keep the target shares exactly. A document is
sampled where a uniform number made from its id by hashing is below its probability: the same on every run.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm import common

#: Languages and topics that the margins may have; more are refused, for they are literals in the plan.
FEW = 400
#: Sources up to which their factors (about 40 bytes each) are broadcast; beyond, the join is salted.
BROADCAST_SOURCES = 20_000
SALTS = 32


def token_count(text: Column) -> Column:
    """Words of a text between white space, without splitting it; 0 for null and blank texts.

    Runs of white space become one space by halving them, again and again; the words are the spaces then, and one."""
    flat = F.translate(text, "\n\t\r\f\u000b", "     ")
    for _ in range(5):
        flat = F.replace(flat, F.lit("  "), F.lit(" "))
    flat = F.trim(F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " +", " ")).otherwise(flat))
    return F.when(F.length(F.coalesce(flat, F.lit(""))) == 0, F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "))) + 1).cast("long")


def topic_of(text: Column) -> Column:
    """What kind of text it is, by marks in the whole of it."""
    licence = text.rlike(r"(?i)licen[cs]ed? (under|by)|copyright|all rights reserved")
    contact = text.rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[A-Za-z]|\+\d+ \(\d{3}\) ")
    words = token_count(text)
    return F.when(F.coalesce(licence, F.lit(False)), "licence").when(F.coalesce(contact, F.lit(False)), "contact").when(words < 150, "short").when(words < 800, "prose").otherwise("long")


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(key), 11).cast("double") * F.lit(2.0**-53)


def _shares(base: dict[str, float], target: dict[str, float] | float) -> dict[str, float]:
    """Target shares over the categories that have tokens: given ones, or those of base to a power."""
    raw = {k: (v**target if isinstance(target, float) else float(target.get(k, 0.0))) for k, v in base.items() if v > 0}
    total = sum(raw.values())
    if total <= 0 and raw:
        raise ValueError("no category of the target has tokens")
    return {k: v / total for k, v in raw.items()}


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | float], rounds: int = 200, tolerance: float = 1e-9) -> tuple[DataFrame, dict[str, float], dict[str, float], float]:
    """Factors from cells (source, lang, topic, base): (source, factor) rows, factors by language and by topic, largest weight.

    Weights are relative: base times weight sums to base's total. A margin's target is a share for each category
    (others get none), or a power to which the categories' own shares are raised. Cells without tokens, and
    categories without a target, have weight 0."""
    cells = cells.filter("base > 0")
    bl = {r.lang: r.b for r in _few(cells.groupBy("lang").agg(F.sum("base").alias("b")))}
    bt = {r.topic: r.b for r in _few(cells.groupBy("topic").agg(F.sum("base").alias("b")))}
    total = sum(bl.values())
    if not total:
        return cells.select("source", F.lit(0.0).alias("factor")).limit(0), {}, {}, 0.0
    tl, tt = _shares(bl, targets["lang"]), _shares(bt, targets["topic"])
    langs, topics = sorted(tl), sorted(tt)
    grid = [(a, b) for a in langs for b in topics]
    place = {g: i for i, g in enumerate(grid)}
    number = F.create_map(*[x for (a, b), i in place.items() for x in (F.concat_ws("\u0001", F.lit(a), F.lit(b)), F.lit(i))])
    sources = cells.withColumn("g", F.try_element_at(number, F.concat_ws("\u0001", "lang", "topic"))).filter("g is not null").groupBy("source").agg(F.sum("base").alias("base"), F.collect_list(F.struct("g", F.col("base").alias("b"))).alias("cells"))
    # a source has one cell a language and topic at most
    ts = targets["source"]
    want = F.pow(F.col("base"), F.lit(ts)) if isinstance(ts, float) else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ts.items() for x in kv]), F.col("source")), F.lit(0.0)).cast("double")
    sources = common.materialise(sources.select("source", "cells", want.alias("want")).filter("want > 0"), "sources")
    goal = sources.agg(F.sum("want")).first()[0]
    if not goal:
        raise ValueError("no source of the target has tokens")
    fl, ft = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def source_factor() -> Column:
        factor = F.array(*[F.lit(fl[a] * ft[b]) for a, b in grid])
        made = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["b"] * F.element_at(factor, c["g"] + 1))
        return F.when(made > 0, F.col("want") / F.lit(goal) * F.lit(total) / made).otherwise(0.0)

    for _ in range(rounds):
        rows = sources.select(F.explode("cells").alias("c"), source_factor().alias("f")).groupBy("c.g").agg(F.sum(F.col("c.b") * F.col("f")).alias("m"))
        m = {grid[r.g]: r.m for r in rows.collect()}  # a row a language and topic at most
        error = 0.0
        for inner in range(200):
            worst = 0.0
            for factors, share, axis in ((fl, tl, 0), (ft, tt, 1)):
                have = dict.fromkeys(factors, 0.0)
                for g, v in m.items():
                    have[g[axis]] += v * fl[g[0]] * ft[g[1]]
                for k in factors:
                    if have[k] > 0:
                        change = share[k] * total / have[k]
                        worst = max(worst, abs(change - 1))
                        factors[k] *= change
            if not inner:
                error = worst
            if worst < tolerance:
                break
        if error < max(tolerance, 1e-7):
            break
    else:
        warnings.warn(f"the margins can't be met together, or not within {rounds} rounds; the largest relative error left is {error:.3g}", stacklevel=2)
    factor = F.array(*[F.lit(fl[a] * ft[b]) for a, b in grid])
    out = common.materialise(sources.select("source", source_factor().alias("factor"), F.array_max(F.transform("cells", lambda c: F.element_at(factor, c["g"] + 1))).alias("most")), "factors")
    top = out.agg(F.max(F.col("factor") * F.col("most"))).first()[0] or 0.0
    return out.drop("most"), fl, ft, top


def _few(rows: DataFrame) -> list:
    got = rows.limit(FEW + 1).collect()
    if len(got) > FEW:
        raise ValueError(f"more than {FEW} languages or topics")
    return got


#: Production targets: the shares of sources flattened much, those of languages and topics a little.
TARGETS: dict[str, dict[str, float] | float] = {"source": 0.7, "lang": 0.85, "topic": 0.85}


#: What identifies a document: its id (null: the largest number) and the hash of its text.
KEY = ["__id", "__th"]


def _key(id_col: str, text_col: str) -> dict[str, Column]:
    return {"__id": F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), "__th": F.xxhash64(F.col(text_col))}


def weights(docs: DataFrame, targets: dict[str, dict[str, float] | float] = TARGETS, source: Column | None = None, lang: Column | None = None, topic: Column | None = None, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: its id, source, lang, topic, tokens, weight, probability, sampled, and the key columns.

    The texts are read once: what is marked in them is written, and cells, weights and samples are made of that. Null
    sources, languages and topics are categories named "". Empty and null texts weigh no tokens but have their cell's
    weight (0 if the cell has no tokens at all). Rows of equal id and text are sampled together. An empty table
    gives no rows."""
    none = F.lit("")
    source = F.coalesce((F.col("source") if source is None else source).cast("string"), none)
    lang = F.coalesce((F.col("lang") if lang is None else lang).cast("string"), none)
    topic = F.coalesce((topic_of(F.col(text_col)) if topic is None else topic).cast("string"), none)
    tokens = F.coalesce((token_count(F.col(text_col)) if tokens is None else tokens).cast("long"), F.lit(0))
    key = [c.alias(k) for k, c in _key(id_col, text_col).items()]
    marked = common.materialise(docs.select(F.col(id_col).alias("doc"), *key, source.alias("source"), lang.alias("lang"), topic.alias("topic"), tokens.alias("tokens")), "marks")
    cells = marked.groupBy("source", "lang", "topic").agg(F.sum("tokens").cast("double").alias("base"))
    factors, fl, ft, top = rake(common.materialise(cells, "cells"), targets)
    if factors.count() <= BROADCAST_SOURCES:
        joined = marked.join(F.broadcast(factors), "source", "left")
    else:  # a hot source's rows go to SALTS places
        salted = factors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = marked.withColumn("salt", F.pmod(F.xxhash64("__id", "__th"), F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"], "left")

    def of(factor: dict[str, float], column: str) -> Column:
        if not factor:
            return F.lit(0.0)
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in factor.items() for x in kv]), F.col(column)), F.lit(0.0))

    out = joined.withColumn("weight", F.coalesce("factor", F.lit(0.0)) * of(fl, "lang") * of(ft, "topic"))
    out = out.withColumn("probability", F.least(F.col("weight") / F.lit(top or 1.0), F.lit(1.0)))
    out = out.withColumn("sampled", uniform(F.struct(*KEY)) < F.col("probability"))
    return out.select(F.col("doc").alias(id_col), "source", "lang", "topic", "tokens", "weight", "probability", "sampled", *KEY)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The sampled rows of docs, columns unchanged."""
    some = weights(docs, id_col=id_col, text_col=text_col, **options).filter("sampled").select(*KEY).distinct()
    marked = docs.withColumns(_key(id_col, text_col))
    return marked.join(some, KEY, "left_semi").select(*docs.columns)
