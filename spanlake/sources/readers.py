"""Tables of intervals from CSV, TSV, BED, Parquet and values, and the sinks that keep them ready for joins."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCATION = re.compile(r"location\s+'([^']*)'", re.I)
_OPTIONS = re.compile(r"options\s*\((.*?)\)", re.I | re.S)
_OPTION = re.compile(r"'?([\w.]+)'?\s+'([^']*)'")
BED_COLUMNS = ("contig", "start", "end", "name", "score", "strand")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, sep: str = ",") -> DataFrame:
    """CSV with given columns, or with inferred ones (which reads the files twice)."""
    reader = spark.read.option("header", header).option("sep", sep)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return read_csv(spark, path, schema, header, "\t")


def read_bed(spark: SparkSession, path: str, columns: int = 3, half_open: bool = True, contigs: Sequence[str] | None = None) -> DataFrame:
    """BED as inclusive intervals. Track, browser and comment lines, and rows with a negative start or an end before it, are left out.

    half_open: ends are one past the last position, as the format has them; they become end - 1."""
    if not 3 <= columns <= len(BED_COLUMNS):
        raise ValueError("3 to 6 columns")
    kinds = ("string", "bigint", "bigint", "string", "double", "string")
    rows = spark.read.option("sep", "\t").option("comment", "#").option("mode", "DROPMALFORMED").schema(", ".join(f"`{c}` {k}" for c, k in zip(BED_COLUMNS[:columns], kinds))).csv(path)
    rows = rows.filter(~F.col("contig").rlike("^(track|browser)\\b") & F.col("start").isNotNull() & F.col("end").isNotNull())
    if half_open:
        rows = rows.withColumn("end", F.col("end") - 1)
    rows = rows.filter((F.col("start") >= 0) & (F.col("end") >= F.col("start")))
    return rows.filter(F.col("contig").isin(*contigs)) if contigs else rows


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files, folders or globs."""
    return spark.read.parquet(*paths)


def read_values(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def read_external(spark: SparkSession, kind: str, rest: str, schema: str | None) -> DataFrame:
    """What follows STORED AS in CREATE EXTERNAL TABLE: options and a location."""
    place = _LOCATION.search(rest)
    if not place:
        raise ValueError("LOCATION is missing")
    options = {}
    if m := _OPTIONS.search(rest):
        options = {k.lower().removeprefix("format."): v for k, v in _OPTION.findall(m[1])}
    if re.search(r"with\s+header\s+row", rest, re.I):
        options["header"] = "true"
    if m := re.search(r"delimiter\s+'([^']*)'", rest, re.I):
        options.setdefault("delimiter", m[1])
    kind = kind.lower()
    if kind == "parquet":
        return spark.read.parquet(place[1])
    if kind in ("csv", "tsv"):
        sep = options.get("delimiter", "\t" if kind == "tsv" else ",").replace("\\t", "\t")
        return read_csv(spark, place[1], schema, options.get("header", options.get("has_header", "true" if schema is None else "false")).lower() == "true", sep)
    if kind == "bed":
        return read_bed(spark, place[1])
    if kind in ("json", "ndjson"):
        return spark.read.schema(schema).json(place[1]) if schema else spark.read.json(place[1])
    if kind == "orc":
        return spark.read.orc(place[1])
    raise ValueError(f"unknown format {kind}")


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], start: str = "start", mode: str = "error") -> None:
    """Parquet ranged and sorted by keys and start, so readers skip row groups by position; one shuffle."""
    df.repartitionByRange(*[F.col(k) for k in keys], F.col(start)).sortWithinPartitions(*keys, start).write.mode(mode).parquet(path)


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, start: str = "start") -> None:
    """A table bucketed by its keys: joins and counts on them need no shuffle of it again."""
    df.write.bucketBy(buckets, *keys).sortBy(*keys, start).mode("overwrite").saveAsTable(table)
