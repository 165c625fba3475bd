"""The thin queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import common


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm import substrings

    got = substrings.substring_dedup(common.table(spark, sf_dir, "documents"), size=13)
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm import records

    path = common.new_path(spark, "records")
    manifest = records.write_records(common.table(spark, sf_dir, "documents"), path, records.tokenizer_encode(tokenizer_path("word_bpe_49k.json")))
    return records.read_records(spark, path, manifest).drop("ids")


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm import additive

    got = additive.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, metric="ip")
    return got.withColumnRenamed("id", "vec_id")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm import fingerprints

    return fingerprints.fingerprints(common.table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm import lines

    return lines.line_dedup(common.table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm import quality

    return quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("th")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm import packing, records

    return packing.pack(common.table(spark, sf_dir, "documents"), records.tokenizer_encode(tokenizer_path("byte_bpe_50k.json")), length=2048, end_id=0)


def op8_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm import mixing

    return mixing.weights(common.table(spark, sf_dir, "documents")).drop(*mixing.KEY)


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm import warc

    path = common.new_path(spark, "warc")
    files = warc.write_warc(common.table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    return warc.read_warc(spark, path, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm import simhash

    return simhash.simhash_components(common.table(spark, sf_dir, "documents"), size=3, radius=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Lines: the earliest place of each distinct one; deletion neighbourhoods in full, met on whole variants' 128-bit hashes.
_LINES = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
firsts AS (SELECT line, min((doc_id, no)) AS place FROM l WHERE trim(line, ' ') <> '' GROUP BY line),
v AS (SELECT place, p, md5_number(line[1:p - 1] || line[p + 1:length(line)]) AS h, length(line) - 1 AS n
      FROM (SELECT line, place, unnest(range(1, length(line) + 1)) AS p FROM firsts WHERE length(line) >= 12)),
own AS (SELECT place, md5_number(line) AS h, length(line) AS n FROM firsts WHERE length(line) >= 12),
gone AS (
  SELECT v.place FROM v JOIN (SELECT h, n, p, min(place) AS f FROM v GROUP BY h, n, p) AS m USING (h, n, p) WHERE f < v.place
  UNION SELECT v.place FROM v JOIN own USING (h, n) WHERE own.place < v.place
  UNION SELECT own.place FROM v JOIN own USING (h, n) WHERE v.place < own.place),
kept AS (SELECT place FROM firsts EXCEPT SELECT place FROM gone),
texts AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) AS text
          FROM l LEFT JOIN kept ON kept.place = (l.doc_id, l.no) WHERE trim(l.line, ' ') = '' OR kept.place IS NOT NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text, d.lang, d.source,
       CASE WHEN d.text IS NOT NULL THEN length(coalesce(t.text, '')) END AS n_chars
FROM documents AS d LEFT JOIN texts AS t USING (doc_id)"""

#: Every window of 13 words, as text; words of windows that a smaller id has go.
_SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
least AS (SELECT g, min(doc_id) AS f FROM windows GROUP BY g HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM windows JOIN least USING (g) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

#: SHA-1 in base 32: eight groups of five hexadecimal digits, each four letters.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT t, min(page_id) AS first FROM p GROUP BY t),
n AS (SELECT page_id, g, CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT) AS v FROM p, range(8) AS r(g)),
b AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1), '' ORDER BY g, s DESC) AS digest
      FROM n, (VALUES (15), (10), (5), (0)) AS shifts(s) GROUP BY page_id)
SELECT p.page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, b.digest AS payload_digest,
       CASE WHEN f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p JOIN f USING (t) JOIN b USING (page_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": _LINES, "op6_substring_dedup": _SUBSTRINGS, "op9_warc_round_trip": _WARC}
