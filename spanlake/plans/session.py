"""A session that plans overlap joins in SQL by bins, with its settings and a few statements of its own."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from spanlake.plans.recogniser import Rewriter
from spanlake.sources.readers import read_external

#: Names of join strategies. In-memory structures all mean bins and give the same rows; coitreesnearest turns overlap joins
#: into one row per right row with its nearest left row, and native leaves joins to Spark.
ALGORITHMS = ("auto", "binned", "coitrees", "intervaltree", "arrayintervaltree", "lapper", "superintervals", "coitreesnearest", "native")
DEFAULTS = {"prefer_interval_join": "true", "interval_join_algorithm": "auto", "interval_join_low_memory": "false", "interval_join_bin_size": "0"}
PREFIX = "spanlake."
_SET = re.compile(r"^\s*set\s+([\w.]+)\s*(?:to|=)\s*(.+?)\s*$", re.I | re.S)
_SHOW = re.compile(r"^\s*show\s+(spanlake\.\w+)\s*$", re.I)
_EXTERNAL = re.compile(r"^\s*create\s+external\s+table\s+(?:if\s+not\s+exists\s+)?(\w+)\s*(?:\((.*?)\))?\s*stored\s+as\s+(\w+)\s*(.*)$", re.I | re.S)
_VALUES = re.compile(r"^\s*create\s+table\s+(\w+)\s*(?:\((.*?)\))?\s*(?:as\s+(values\s.*|select\s.*))?$", re.I | re.S)
_EXPLAIN = re.compile(r"^\s*explain\s+(?:verbose\s+|analyze\s+)?((?:select|with)\s.*)$", re.I | re.S)
_TYPES = {"varchar": "string", "text": "string", "utf8": "string", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "integer": "int"}

#: Functions of SQL that every session has; Catalyst puts their expressions in the place of calls.
FUNCTIONS = {
    "overlap_length(ls BIGINT, le BIGINT, rs BIGINT, re BIGINT)": "greatest(least(le, re) - greatest(ls, rs) + 1, 0)",
    "interval_distance(ls BIGINT, le BIGINT, rs BIGINT, re BIGINT)": "greatest(rs - le, ls - re, 0)",
    "contains_point(s BIGINT, e BIGINT, point BIGINT)": "point >= s AND point <= e",
}


def statements(text: str) -> Iterator[str]:
    """Statements of a script: parts between semicolons outside quotes, without comments."""
    part, quote, i = "", "", 0
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif text.startswith("--", i):
            i = text.find("\n", i)
            if i < 0:
                break
            continue
        elif c == ";":
            if part.strip():
                yield part.strip()
            part, i = "", i + 1
            continue
        part += c
        i += 1
    if part.strip():
        yield part.strip()


def columns_ddl(text: str) -> str:
    """Column definitions in Spark's types; NOT NULL is kept."""
    out = []
    for c in text.split(","):
        name, kind, *rest = c.split()
        out.append(" ".join([name, _TYPES.get(kind.lower(), kind), *rest]))
    return ", ".join(out)


def _refuse_counting(algorithm: str) -> None:
    if algorithm.lower() == "coitreescountoverlaps":
        raise ValueError("joins aren't turned into counts; use operators.counting.count_overlaps")


class IntervalSession:
    """Wraps a SparkSession. Settings are spanlake.* keys of its configuration, read anew for every query."""

    def __init__(self, spark: SparkSession, settings: dict[str, str] | None = None):
        self.spark = spark
        for k, v in DEFAULTS.items():
            if spark.conf.get(PREFIX + k, None) is None:
                spark.conf.set(PREFIX + k, v)
        for k, v in (settings or {}).items():
            self.set(k, v)
        for head, body in FUNCTIONS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    def register(self, name: str, function) -> None:
        """A function of one's own for SQL: a Pandas UDF (by rows or aggregating), a Python UDF or a UDTF.

        SQL functions are made by CREATE TEMPORARY FUNCTION, and need no Python."""
        table = type(function).__name__ == "UserDefinedTableFunction"
        (self.spark.udtf if table else self.spark.udf).register(name, function)

    def get(self, key: str) -> str:
        return self.spark.conf.get(PREFIX + key.removeprefix(PREFIX))

    def set(self, key: str, value: object) -> None:
        name, value = key.removeprefix(PREFIX), str(value).strip("'\"")
        if name not in DEFAULTS:
            self.spark.conf.set(key, value)
            return
        if name == "interval_join_algorithm":
            _refuse_counting(value)
        if name == "interval_join_algorithm" and value.lower() not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {value}; there are {', '.join(ALGORITHMS)}")
        if name in ("prefer_interval_join", "interval_join_low_memory") and value.lower() not in ("true", "false"):
            raise ValueError(f"{name} is true or false")
        self.spark.conf.set(PREFIX + name, value.lower())
        if name == "interval_join_low_memory":  # smaller batches on the way to Python, the only place that has any
            self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000" if value.lower() == "true" else "10000")

    def _rewriter(self) -> Rewriter:
        _refuse_counting(self.get("interval_join_algorithm"))
        size = int(self.get("interval_join_bin_size"))
        return Rewriter(self.spark, size or None, self.get("interval_join_algorithm") == "coitreesnearest")

    def plan(self, frame: DataFrame) -> DataFrame:
        """A query with its overlap joins binned, as far as the settings allow."""
        if self.get("prefer_interval_join") != "true" or self.get("interval_join_algorithm") == "native":
            return frame
        return self._rewriter().run(frame)

    def sql(self, text: str) -> DataFrame:
        """One statement: Spark SQL, SET key TO value, CREATE EXTERNAL TABLE, CREATE TABLE ... AS VALUES, EXPLAIN."""
        text = text.strip().rstrip(";")
        if m := _SET.match(text):
            self.set(m[1], m[2])
            return self.spark.createDataFrame([(m[1], m[2].strip("'\""))], "key string, value string")
        if m := _SHOW.match(text):
            return self.spark.createDataFrame([(m[1], self.get(m[1]))], "key string, value string")
        if m := _EXTERNAL.match(text):
            read_external(self.spark, m[3], m[4], columns_ddl(m[2]) if m[2] else None).createOrReplaceTempView(m[1])
            return self.spark.createDataFrame([(m[1],)], "table string")
        if m := _VALUES.match(text):
            self._table(*m.groups())
            return self.spark.createDataFrame([(m[1],)], "table string")
        if m := _EXPLAIN.match(text):
            return self.spark.createDataFrame([(self.explain(m[1]),)], "plan string")
        return self.plan(self.spark.sql(text))

    def _table(self, name: str, columns: str | None, query: str | None) -> None:
        schema = columns_ddl(columns) if columns else None
        if query is None:
            self.spark.createDataFrame([], schema).createOrReplaceTempView(name)
            return
        frame = self.spark.sql(query)
        if schema:
            kinds = self.spark.createDataFrame([], schema).schema
            frame = frame.toDF(*kinds.names).selectExpr(*[f"cast(`{f.name}` as {f.dataType.simpleString()}) as `{f.name}`" for f in kinds])
        frame.createOrReplaceTempView(name)

    def explain(self, text: str) -> str:
        """What joins were recognised, and the physical plan."""
        frame, rewriter = self.spark.sql(text), self._rewriter()
        on = self.get("prefer_interval_join") == "true" and self.get("interval_join_algorithm") != "native"
        planned = rewriter.run(frame) if on else frame
        head = [f"IntervalJoin: algorithm={self.get('interval_join_algorithm')}, bounds={', '.join(b)}" for b in rewriter.done]
        return "\n".join([*head, planned._jdf.queryExecution().executedPlan().toString()])

    def script(self, text: str) -> Iterator[DataFrame]:
        for s in statements(text):
            yield self.sql(s)
