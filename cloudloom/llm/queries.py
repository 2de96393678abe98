"""The queries of the ten operators, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.llm import htmlextract, media, packing, pii, quality, simhash, spm, tokencount, urlfilter, warc
from cloudloom.llm.shared import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *[f"stats.{name}" for name in quality.REPORTED], "base_failed", "kept")


_OP5_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM rep) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_echoes
  FROM d LEFT JOIN cov USING (doc_id)
), r AS (
  SELECT doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_repeat_words, n_echoes,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM s
)
SELECT * EXCLUDE (n_echoes), NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 5 * n_echoes > n_words
                                   OR (n_dup_lines >= 3 AND 10 * n_dup_lines > n_words)) AS kept
FROM r
"""

def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.summary(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def _sql_list(terms: Iterable[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


#: Stems of the soft terms with their weights: a term and its plural count once.
_SOFT = {t.removesuffix("s"): w for t, w in urlfilter.SOFT.items()}
_OP3_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS r
  FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN contains(r, '/') THEN substr(r, strpos(r, '/')) ELSE '' END AS path
  FROM u
), rules(v, rh, rp) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urlfilter.RULES)}
), fit AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY page_id
), words AS (
  SELECT page_id, list_distinct(regexp_split_to_array(host || ' ' || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+')) AS w FROM h
), soft(stem, weight) AS (VALUES {", ".join(f"('{t}', {w})" for t, w in _SOFT.items())}
), strict_hits AS (SELECT page_id, true AS strict FROM words WHERE list_has_any(w, {_sql_list(urlfilter.STRICT)})
), soft_hits AS (
  SELECT page_id, count(*) AS n, sum(weight) AS weight
  FROM (SELECT DISTINCT page_id, regexp_replace(t, 's$', '') AS stem FROM (SELECT page_id, unnest(list_intersect(w, {_sql_list(urlfilter.SOFT)})) AS t FROM words)) JOIN soft USING (stem)
  GROUP BY page_id
)
SELECT h.page_id, host, path, rule,
       coalesce(v, CASE WHEN strict OR (n >= {urlfilter.SOFT_TERMS} AND weight >= {urlfilter.SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN fit USING (page_id) LEFT JOIN strict_hits USING (page_id) LEFT JOIN soft_hits USING (page_id)
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP9_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + ((('0x' || substr(hex, (1 + i // 4 * 5)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (hex)
"""


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(table(spark, sf_dir, "documents"))
    digest = F.lower(F.hex("digest")).alias("media_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", digest, "feature")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_url_filters": op3_url_filters,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_rules": op5_quality_rules,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_media_columns": op10_media_columns,
}

ORACLE_SQL: dict[str, str] = {"op3_url_filters": _OP3_SQL, "op5_quality_rules": _OP5_SQL, "op9_warc": _OP9_SQL}
