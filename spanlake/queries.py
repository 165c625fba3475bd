"""Queries over the driver's tables, one for each operator, and the same in SQL for a row-by-row comparison.

Orders and line items are intervals of days: an order lasts o_orderkey % 30 days from its date on, a line item as
many days as its quantity from its shipping on; customers and parts stand for contigs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators import counting, overlap, search
from spanlake.operators.interval_map import IntervalMap
from spanlake.plans.session import IntervalSession

Q = dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]
_all: Q = {}

_A = "(SELECT o_orderkey AS aid, o_custkey AS contig, o_orderstatus AS strand, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS st, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 30 AS en FROM orders)"
_B = "(SELECT l_orderkey AS bid, l_linenumber AS bno, l_partkey AS contig, l_linestatus AS strand, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS st, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(floor(l_quantity) AS BIGINT) AS en FROM lineitem)"
_ON = "a.contig = b.contig AND a.st <= b.en AND a.en >= b.st"
_WITH = f"WITH a AS {_A}, b AS {_B} "
ST = ("st", "en")


def iva(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("aid"), F.col("o_custkey").alias("contig"), F.col("o_orderstatus").alias("strand"), day.alias("st"), (day + F.col("o_orderkey") % 30).alias("en"))


def ivb(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("long")
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("bid"), F.col("l_linenumber").alias("bno"), F.col("l_partkey").alias("contig"), F.col("l_linestatus").alias("strand"), day.alias("st"), (day + F.floor("l_quantity")).alias("en"))


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _all[f.__name__] = f, sql
        return f

    return add


def _join(s, d, how="inner", **options):
    return overlap.overlap_join(iva(s, d), ivb(s, d), ["contig"], ST, ST, how, **options)


_PAIR = "a.aid AS l_aid, a.contig AS l_contig, a.st AS l_st, a.en AS l_en, b.bid AS r_bid, b.bno AS r_bno, b.st AS r_st, b.en AS r_en"
_PAIR_COLUMNS = ["l_aid", "l_contig", "l_st", "l_en", "r_bid", "r_bno", "r_st", "r_en"]


@query(_WITH + f"SELECT a.contig AS contig, count(*) AS n FROM a JOIN b ON {_ON} GROUP BY a.contig")
def overlap_count_by_contig(s, d):
    return _join(s, d).groupBy(F.col("l_contig").alias("contig")).agg(F.count("*").alias("n"))


@query(_WITH + f"SELECT {_PAIR} FROM a JOIN b ON {_ON}")
def overlap_pairs(s, d):
    return _join(s, d).select(*_PAIR_COLUMNS)


@query(_WITH + f"SELECT {_PAIR} FROM a JOIN b ON a.contig = b.contig AND a.st < b.en AND a.en > b.st")
def overlap_strict(s, d):
    return _join(s, d, strict=True).select(*_PAIR_COLUMNS)


@query(_WITH + f"SELECT {_PAIR} FROM a JOIN b ON a.contig = b.contig AND a.st <= b.en AND a.en > b.st")
def overlap_half_open(s, d):
    return _join(s, d, strict=(False, True)).select(*_PAIR_COLUMNS)


@query(_WITH + f"SELECT {_PAIR} FROM a JOIN b ON {_ON} AND (a.aid + b.bid) % 3 = 0")
def overlap_residual(s, d):
    return _join(s, d, condition=lambda p: (p.l_aid + p.r_bid) % 3 == 0).select(*_PAIR_COLUMNS)


@query(_WITH + f"SELECT {_PAIR} FROM a JOIN b ON {_ON} AND a.strand = b.strand")
def overlap_multikey(s, d):
    return overlap.overlap_join(iva(s, d), ivb(s, d), ["contig", "strand"], ST, ST).select(*_PAIR_COLUMNS)


for _how in ("left", "right", "full"):

    @query(_WITH + f"SELECT {_PAIR} FROM a {_how.upper()} JOIN b ON {_ON}")
    def _outer(s, d, how=_how):
        return _join(s, d, how).select(*_PAIR_COLUMNS)

    _all[f"overlap_{_how}"] = _all.pop("_outer")


@query(_WITH + f"SELECT {_PAIR} FROM a LEFT JOIN b ON {_ON} AND b.bno = 1")
def overlap_left_residual(s, d):
    return _join(s, d, "left", condition=lambda p: p.r_bno == 1).select(*_PAIR_COLUMNS)


@query(_WITH + f"SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_ON})")
def overlap_semi(s, d):
    return _join(s, d, "left_semi")


@query(_WITH + f"SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_ON})")
def overlap_anti(s, d):
    return _join(s, d, "left_anti")


_RANGE = "WITH a AS (SELECT s_suppkey AS aid, CAST(floor(s_acctbal) AS BIGINT) AS st, CAST(floor(s_acctbal) AS BIGINT) + 100 AS en FROM supplier), b AS (SELECT c_custkey AS bid, CAST(floor(c_acctbal) AS BIGINT) AS st, CAST(floor(c_acctbal) AS BIGINT) + 50 AS en FROM customer) "


def _range_sides(s, d):
    a = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("aid"), F.floor("s_acctbal").cast("long").alias("st"), (F.floor("s_acctbal") + 100).cast("long").alias("en"))
    b = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("bid"), F.floor("c_acctbal").cast("long").alias("st"), (F.floor("c_acctbal") + 50).cast("long").alias("en"))
    return a, b


@query(_RANGE + "SELECT a.aid AS l_aid, b.bid AS r_bid FROM a JOIN b ON a.st <= b.en AND a.en >= b.st")
def overlap_range_only(s, d):
    return overlap.overlap_join(*_range_sides(s, d), None, ST, ST).select("l_aid", "r_bid")


@query(_RANGE + "SELECT a.*, (SELECT count(*) FROM b WHERE a.st <= b.en AND a.en >= b.st) AS n_overlaps FROM a")
def count_overlaps_range_only(s, d):
    return counting.count_overlaps(*_range_sides(s, d), None, ST, ST)


_DOUBLES = "WITH a AS (SELECT s_suppkey AS aid, s_acctbal AS st, s_acctbal + 10.5 AS en FROM supplier), b AS (SELECT c_custkey AS bid, c_acctbal AS st, c_acctbal + 0.25 AS en FROM customer) "


@query(_DOUBLES + "SELECT a.aid AS l_aid, b.bid AS r_bid FROM a JOIN b ON a.st <= b.en AND a.en >= b.st")
def overlap_doubles(s, d):
    a = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("aid"), F.col("s_acctbal").alias("st"), (F.col("s_acctbal") + 10.5).alias("en"))
    b = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("bid"), F.col("c_acctbal").alias("st"), (F.col("c_acctbal") + 0.25).alias("en"))
    return overlap.overlap_join(a, b, None, ST, ST).select("l_aid", "r_bid")


@query(_WITH + f"SELECT b.*, (SELECT count(*) FROM a WHERE {_ON}) AS n_overlaps FROM b")
def count_overlaps(s, d):
    return counting.count_overlaps(ivb(s, d), iva(s, d), ["contig"], ST, ST)


@query(_WITH + "SELECT b.*, (SELECT count(*) FROM a WHERE a.contig = b.contig AND a.st < b.en AND a.en > b.st) AS n_overlaps FROM b")
def count_overlaps_strict(s, d):
    return counting.count_overlaps(ivb(s, d), iva(s, d), ["contig"], ST, ST, strict=True)


@query(_WITH + f"SELECT b.*, EXISTS (SELECT 1 FROM a WHERE {_ON}) AS has_overlap FROM b")
def has_overlap(s, d):
    return counting.has_overlap(ivb(s, d), iva(s, d), ["contig"], ST, ST)


_NEAR = _WITH + """, p AS (SELECT b.bid, b.bno, b.contig, b.strand, b.st, b.en, a.aid AS r_aid, a.contig AS r_contig, a.strand AS r_strand, a.st AS r_st, a.en AS r_en,
 CASE WHEN a.aid IS NULL THEN NULL ELSE greatest(a.st - b.en, b.st - a.en, 0) END AS distance FROM b LEFT JOIN a ON a.contig = b.contig)"""


@query(_NEAR + ", k AS (SELECT DISTINCT bid, bno, contig, strand, st, en, min(distance) OVER (PARTITION BY bid, bno, contig, strand, st, en) AS distance FROM p) SELECT b.bid, b.bno, k.distance FROM b JOIN k ON b.bid = k.bid AND b.bno = k.bno AND b.contig = k.contig AND b.strand = k.strand AND b.st = k.st AND b.en = k.en")
def nearest_distance(s, d):
    return counting.nearest(ivb(s, d), iva(s, d), ["contig"], ST, ST).select("bid", "bno", "distance")


@query(_NEAR + ", k AS (SELECT *, row_number() OVER (PARTITION BY bid, bno, contig, strand, st, en ORDER BY distance, r_st, r_en, r_aid) AS rn FROM p) SELECT b.*, k.r_aid, k.r_st, k.r_en, k.distance FROM b JOIN k ON k.rn = 1 AND b.bid = k.bid AND b.bno = k.bno AND b.contig = k.contig AND b.strand = k.strand AND b.st = k.st AND b.en = k.en")
def nearest_row(s, d):
    return counting.nearest(ivb(s, d), iva(s, d), ["contig"], ST, ST).drop("r_contig", "r_strand")


@query(_WITH + "SELECT a.aid AS l_aid, a.st AS l_st, b.bid AS r_bid, b.bno AS r_bno FROM a JOIN b ON a.contig = b.contig AND a.st BETWEEN b.st AND b.en")
def stab_points(s, d):
    return search.stab(iva(s, d), ivb(s, d), ["contig"], "st", ST).select("l_aid", "l_st", "r_bid", "r_bno")


@query(_WITH + "SELECT a.aid AS l_aid, b.bid AS r_bid, b.bno AS r_bno FROM a JOIN b ON a.contig = b.contig AND a.st >= b.st AND a.en <= b.en")
def contained_in(s, d):
    return search.contained_in(iva(s, d), ivb(s, d), ["contig"], ST, ST).select("l_aid", "r_bid", "r_bno")


@query(_WITH + "SELECT a.aid AS l_aid, b.bid AS r_bid, b.bno AS r_bno FROM a JOIN b ON a.contig = b.contig AND b.st >= a.st AND b.en <= a.en")
def contains(s, d):
    return search.contains(iva(s, d), ivb(s, d), ["contig"], ST, ST).select("l_aid", "r_bid", "r_bno")


@query(_WITH + f"SELECT b.*, (SELECT count(*) FROM a WHERE {_ON}) AS n_overlaps, CAST(coalesce((SELECT sum(least(a.en, b.en) - greatest(a.st, b.st)) FROM a WHERE {_ON}), 0) AS BIGINT) AS coverage FROM b")
def coverage_sum(s, d):
    return counting.coverage_sum(ivb(s, d), iva(s, d), ["contig"], ST, ST)


@query(_WITH + f", e AS (SELECT DISTINCT contig, unnest(generate_series(st, en)) AS p FROM a), q AS (SELECT DISTINCT contig, st, en FROM b), c AS (SELECT q.contig, q.st, q.en, count(*) AS covered FROM q JOIN e ON e.contig = q.contig AND e.p BETWEEN q.st AND q.en GROUP BY ALL) SELECT b.*, (SELECT count(*) FROM a WHERE {_ON}) AS n_overlaps, coalesce(c.covered, 0) AS covered FROM b LEFT JOIN c ON c.contig = b.contig AND c.st = b.st AND c.en = b.en")
def coverage_union(s, d):
    return counting.coverage_union(ivb(s, d), iva(s, d), ["contig"], ST, ST)


def _merge_sql(gap: int) -> str:
    return _WITH + f", m AS (SELECT *, max(en) OVER (PARTITION BY contig ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR st > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS grp FROM m) SELECT contig, min(st) AS st, max(en) AS en, count(*) AS n FROM g GROUP BY contig, grp"


@query(_merge_sql(0))
def merge_intervals(s, d):
    return counting.merge_intervals(ivb(s, d), ["contig"], ST)


@query(_merge_sql(1))
def merge_adjacent(s, d):
    return counting.merge_intervals(ivb(s, d), ["contig"], ST, gap=1)


@query(_WITH + f"SELECT a.aid, coalesce(string_agg(b.st || '-' || b.en, ',' ORDER BY b.st, b.en DESC), '') AS found FROM a LEFT JOIN b ON {_ON} GROUP BY a.aid")
def search_keys_array(s, d):
    got = search.search_arrays(iva(s, d), ivb(s, d), ["contig"], ST, ST, what="keys")
    return got.select("aid", F.array_join(F.transform("found", lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("found"))


_IDX = ", i AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY st, en DESC, bid, bno, strand) - 1 AS idx FROM b) "


@query(_WITH + _IDX + f"SELECT a.aid, coalesce(string_agg(b.idx, ',' ORDER BY b.idx), '') AS found FROM a LEFT JOIN i b ON {_ON} GROUP BY a.aid")
def search_idxs_array(s, d):
    got = search.search_arrays(iva(s, d), ivb(s, d), ["contig"], ST, ST, what="idxs")
    return got.select("aid", F.array_join(F.col("found").cast("array<string>"), ",").alias("found"))


@query(_WITH + _IDX + f"SELECT a.aid, coalesce(string_agg(b.bid, ',' ORDER BY b.idx), '') AS found FROM a LEFT JOIN i b ON {_ON} GROUP BY a.aid")
def search_values_array(s, d):
    got = search.search_arrays(iva(s, d), ivb(s, d), ["contig"], ST, ST, value="bid", what="values")
    return got.select("aid", F.array_join(F.col("found").cast("array<string>"), ",").alias("found"))


@query(_WITH + _IDX + f"SELECT a.aid, coalesce(string_agg(b.st || '-' || b.en || ':' || b.bid, ',' ORDER BY b.idx), '') AS found FROM a LEFT JOIN i b ON {_ON} GROUP BY a.aid")
def search_items_array(s, d):
    got = search.search_arrays(iva(s, d), ivb(s, d), ["contig"], ST, ST, value="bid", what="items")
    return got.select("aid", F.array_join(F.transform("found", lambda x: F.concat(x["start"], F.lit("-"), x["end"], F.lit(":"), x["value"])), ",").alias("found"))


@query(_WITH + "SELECT st AS start, en AS \"end\", aid AS value, row_number() OVER (ORDER BY st, en DESC, aid) - 1 AS idx FROM a")
def interval_map_indexed(s, d):
    return IntervalMap(iva(s, d), "st", "en", "aid").indexed()


@query(_WITH + _IDX + "SELECT bid, bno, contig, strand, st, en, idx FROM i")
def sorted_index(s, d):
    return search.with_index(ivb(s, d), ["contig"], ST)


_NEG = "WITH a AS (SELECT aid, contig, st - 2000 AS st, en - 2000 AS en FROM " + _A + "), b AS (SELECT bid, bno, contig, st - 2000 AS st, en - 2000 AS en FROM " + _B + ") "


@query(_NEG + f"SELECT a.aid AS l_aid, a.st AS l_st, b.bid AS r_bid, b.bno AS r_bno FROM a JOIN b ON {_ON}")
def negative_coordinates(s, d):
    a, b = (f(s, d).withColumns({"st": F.col("st") - 2000, "en": F.col("en") - 2000}) for f in (iva, ivb))
    return overlap.overlap_join(a, b, ["contig"], ST, ST).select("l_aid", "l_st", "r_bid", "r_bno")


_BIG = "WITH a AS (SELECT aid, contig, st * 5000000000000 AS st, en * 5000000000000 AS en FROM " + _A + "), b AS (SELECT bid, bno, contig, st * 5000000000000 AS st, en * 5000000000000 AS en FROM " + _B + ") "


@query(_BIG + f"SELECT a.aid AS l_aid, a.st AS l_st, b.bid AS r_bid, b.bno AS r_bno FROM a JOIN b ON {_ON}")
def big_coordinates(s, d):
    a, b = (f(s, d).withColumns({"st": F.col("st") * 5000000000000, "en": F.col("en") * 5000000000000}) for f in (iva, ivb))
    return overlap.overlap_join(a, b, ["contig"], ST, ST).select("l_aid", "l_st", "r_bid", "r_bno")


_EVENTS = "WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS st, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value) AS BIGINT) AS en FROM events) "


@query(_EVENTS + "SELECT a.event_id AS l_event_id, b.event_id AS r_event_id FROM e a JOIN e b ON a.user_id = b.user_id AND a.st <= b.en AND a.en >= b.st AND a.event_id < b.event_id")
def events_self_overlap(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("st"), F.floor("value").alias("len"))
    e = e.select("event_id", "user_id", "st", (F.col("st") + F.col("len")).alias("en"))
    return overlap.overlap_join(e, e, ["user_id"], ST, ST, condition=lambda p: p.l_event_id < p.r_event_id).select("l_event_id", "r_event_id")


@query("WITH q AS (SELECT c_custkey AS qid, c_custkey * 3 % 2500 AS st, c_custkey * 3 % 2500 + c_nationkey AS en FROM customer), a AS " + _A + " SELECT q.qid, q.st AS start, q.en AS \"end\", (SELECT count(*) FROM a WHERE a.st <= q.en AND a.en >= q.st) AS count FROM q")
def interval_map_count_batch(s, d):
    q = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") * 3 % 2500).alias("start"))
    q = q.join(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("qid"), "c_nationkey"), "qid").select("qid", "start", (F.col("start") + F.col("c_nationkey")).alias("end"))
    return IntervalMap(iva(s, d), "st", "en", "aid").count_batch(q)


# SQL with recognised joins


def _sql(s, d, text, **settings):
    session = IntervalSession(s, {"prefer_interval_join": "true", "interval_join_algorithm": "auto"} | settings)
    iva(s, d).createOrReplaceTempView("spanlake_a")
    ivb(s, d).createOrReplaceTempView("spanlake_b")
    try:
        return session.sql(text)
    finally:
        for k, v in (("prefer_interval_join", "true"), ("interval_join_algorithm", "auto")):
            session.set(k, v)


@query(_WITH + f"SELECT {_PAIR} FROM a JOIN b ON {_ON}")
def sql_recogniser_overlap(s, d):
    return _sql(s, d, f"SELECT {_PAIR} FROM spanlake_a a JOIN spanlake_b b ON {_ON}")


@query(_WITH + f"SELECT {_PAIR} FROM a JOIN b ON {_ON}")
def sql_comma_join(s, d):
    return _sql(s, d, f"SELECT {_PAIR} FROM spanlake_b b, spanlake_a a WHERE b.st <= a.en AND b.en >= a.st AND a.contig = b.contig")


@query(_WITH + f"SELECT {_PAIR} FROM a JOIN b ON {_ON}")
def sql_native_algorithm(s, d):
    return _sql(s, d, f"SELECT {_PAIR} FROM spanlake_a a JOIN spanlake_b b ON {_ON}", interval_join_algorithm="native")


@query(_WITH + "SELECT a.contig % 7 AS grp, count(*) AS n, sum(CASE WHEN b.bno = 1 THEN 1 ELSE 0 END)::BIGINT AS firsts FROM a JOIN b ON a.contig = b.contig AND a.st + 1 <= b.en AND a.en - 1 >= b.st WHERE a.strand <> 'P' GROUP BY 1")
def sql_expression_bounds(s, d):
    return _sql(s, d, "SELECT a.contig % 7 AS grp, count(*) AS n, sum(CASE WHEN b.bno = 1 THEN 1 ELSE 0 END) AS firsts FROM spanlake_a a JOIN spanlake_b b ON a.contig = b.contig AND a.st + 1 <= b.en AND a.en - 1 >= b.st WHERE a.strand <> 'P' GROUP BY 1")


@query(_NEAR + ", k AS (SELECT *, row_number() OVER (PARTITION BY bid, bno, contig, strand, st, en ORDER BY distance, r_st, r_en, r_aid) AS rn FROM p) SELECT b.bid, b.bno, k.r_aid AS aid, k.r_st AS st FROM b JOIN k ON k.rn = 1 AND b.bid = k.bid AND b.bno = k.bno AND b.contig = k.contig AND b.strand = k.strand AND b.st = k.st AND b.en = k.en")
def sql_nearest_algorithm(s, d):
    return _sql(s, d, f"SELECT b.bid, b.bno, a.aid, a.st FROM spanlake_a a JOIN spanlake_b b ON {_ON}", interval_join_algorithm="CoitreesNearest")


@query(_WITH + f"SELECT * FROM (SELECT a.contig AS contig, a.strand AS strand, count(*) AS n FROM a JOIN b ON {_ON} GROUP BY GROUPING SETS ((a.contig, a.strand), (a.strand), ())) t")
def sql_grouping_sets(s, d):
    return _sql(s, d, f"SELECT a.contig AS contig, a.strand AS strand, count(*) AS n FROM spanlake_a a JOIN spanlake_b b ON {_ON} GROUP BY GROUPING SETS ((a.contig, a.strand), (a.strand), ())")


@query(_WITH + "SELECT contig, aid, st, row_number() OVER (PARTITION BY contig ORDER BY st, aid) AS rn, CAST(sum(en - st) OVER (PARTITION BY contig ORDER BY st, aid ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM a")
def sql_window(s, d):
    return _sql(s, d, "SELECT contig, aid, st, row_number() OVER (PARTITION BY contig ORDER BY st, aid) AS rn, sum(en - st) OVER (PARTITION BY contig ORDER BY st, aid ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM spanlake_a")


@query(_WITH + "SELECT contig FROM a UNION SELECT contig FROM b EXCEPT SELECT contig FROM a WHERE strand = 'F'")
def sql_set_operations(s, d):
    return _sql(s, d, "SELECT contig FROM spanlake_a UNION SELECT contig FROM spanlake_b EXCEPT SELECT contig FROM spanlake_a WHERE strand = 'F'")


@query("WITH RECURSIVE r(n, st) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT n + 1, st + 30 FROM r WHERE n < 100), a AS " + _A + " SELECT r.n, count(*) AS c FROM r JOIN a ON a.st <= r.st + 29 AND a.en >= r.st GROUP BY r.n")
def sql_recursive_windows(s, d):
    return _sql(s, d, "WITH RECURSIVE r(n, st) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT n + 1, st + 30 FROM r WHERE n < 100) SELECT r.n, count(*) AS c FROM r JOIN spanlake_a a ON a.st <= r.st + 29 AND a.en >= r.st GROUP BY r.n")


@query(_WITH + f"SELECT {_PAIR} FROM a JOIN b ON {_ON} WHERE a.strand = 'F'")
def sql_with_clause(s, d):
    return _sql(s, d, f"WITH a AS (SELECT * FROM spanlake_a WHERE strand = 'F'), b AS (SELECT * FROM spanlake_b) SELECT {_PAIR} FROM a JOIN b ON {_ON}")


@query(_WITH + f"SELECT a.contig AS contig, count(*) AS n FROM a JOIN b ON {_ON} GROUP BY a.contig ORDER BY n DESC, contig LIMIT 10")
def sql_top_contigs(s, d):
    return _sql(s, d, f"SELECT a.contig AS contig, count(*) AS n FROM spanlake_a a JOIN spanlake_b b ON {_ON} GROUP BY a.contig ORDER BY n DESC, contig LIMIT 10")


@query(_WITH + f"SELECT {_PAIR} FROM a JOIN b ON {_ON}")
def sql_key_on_range_where(s, d):
    return _sql(s, d, f"SELECT {_PAIR} FROM spanlake_a a JOIN spanlake_b b ON a.contig = b.contig WHERE a.st <= b.en AND a.en >= b.st")


@query(_WITH + f"SELECT {_PAIR} FROM a LEFT JOIN b ON {_ON}")
def sql_left_join(s, d):
    return _sql(s, d, f"SELECT {_PAIR} FROM spanlake_a a LEFT JOIN spanlake_b b ON {_ON}")


@query(_WITH + f"SELECT {_PAIR} FROM a RIGHT JOIN b ON {_ON} AND b.bno > 1")
def sql_right_join_residual(s, d):
    return _sql(s, d, f"SELECT {_PAIR} FROM spanlake_a a RIGHT JOIN spanlake_b b ON {_ON} AND b.bno > 1")


@query(_WITH + f"SELECT {_PAIR} FROM a FULL JOIN b ON {_ON}")
def sql_full_join(s, d):
    return _sql(s, d, f"SELECT {_PAIR} FROM spanlake_a a FULL JOIN spanlake_b b ON {_ON}")


@query(_WITH + f"SELECT a.aid, a.st FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_ON})")
def sql_exists(s, d):
    return _sql(s, d, f"SELECT a.aid, a.st FROM spanlake_a a WHERE EXISTS (SELECT 1 FROM spanlake_b b WHERE {_ON})")


@query(_WITH + f"SELECT a.aid, a.st FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_ON})")
def sql_anti_join(s, d):
    return _sql(s, d, f"SELECT a.aid, a.st FROM spanlake_a a LEFT ANTI JOIN spanlake_b b ON {_ON}")


@query(_WITH + f"SELECT count(*) AS n, sum(a.st + b.en + c.st)::BIGINT AS total FROM a, b, b AS c WHERE {_ON} AND b.contig = c.contig AND b.st <= c.en AND b.en >= c.st AND b.bno < c.bno")
def sql_three_tables(s, d):
    return _sql(s, d, f"SELECT count(*) AS n, sum(a.st + b.en + c.st) AS total FROM spanlake_a a, spanlake_b b, spanlake_b c WHERE {_ON} AND b.contig = c.contig AND b.st <= c.en AND b.en >= c.st AND b.bno < c.bno")


@query(_WITH + f"SELECT {_PAIR} FROM a JOIN b ON {_ON} AND a.st <= b.st")
def sql_more_comparisons(s, d):
    return _sql(s, d, f"SELECT {_PAIR} FROM spanlake_a a JOIN spanlake_b b ON {_ON} AND a.st <= b.st")


@query(_WITH + f"SELECT a.contig AS contig, sum(least(a.en, b.en) - greatest(a.st, b.st) + 1)::BIGINT AS shared, max(greatest(b.st - a.st, a.st - b.st))::BIGINT AS apart FROM a JOIN b ON {_ON} GROUP BY a.contig")
def sql_functions(s, d):
    return _sql(s, d, f"SELECT a.contig AS contig, sum(overlap_length(a.st, a.en, b.st, b.en)) AS shared, max(interval_distance(a.st, a.st, b.st, b.st)) AS apart FROM spanlake_a a JOIN spanlake_b b ON {_ON} GROUP BY a.contig")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all.items()}
