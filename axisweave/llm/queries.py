"""The queries of this subpackage: opN_<name> applies operator N, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from axisweave.llm.common import table
from axisweave.llm.decontamination import contamination_report
from axisweave.llm.fingerprints import compare_versions
from axisweave.llm.language import predict_languages
from axisweave.llm.linededup import classed_lines
from axisweave.llm.neardup import classes
from axisweave.llm.passages import passages
from axisweave.llm.sentencepieces import encode_texts
from axisweave.llm.sharding import shard_documents
from axisweave.llm.toxicity import score_documents
from axisweave.llm.warc import archive_round_trip


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_convert_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op9_identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op7_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_fingerprint_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed_lines(table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_documents": op1_shard_documents,
    "op4_decontaminate": op4_decontaminate,
    "op8_convert_archives": op8_convert_archives,
    "op9_identify_languages": op9_identify_languages,
    "op7_score_toxicity": op7_score_toxicity,
    "op3_encode_pieces": op3_encode_pieces,
    "op2_fingerprint_versions": op2_fingerprint_versions,
    "op5_near_duplicates": op5_near_duplicates,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op6_repeated_passages": op6_repeated_passages,
}
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents), b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark),
  win AS (SELECT item, k, o, array_to_string(w[o + 1 : o + k], ' ') AS g FROM (SELECT item, w, least(len(w), 8) AS k, unnest(range(0, len(w) - least(len(w), 8) + 1)) AS o FROM b WHERE len(w) > 0)),
  dw AS (SELECT rid, k, p, array_to_string(w[p + 1 : p + k], ' ') AS g FROM (SELECT rid, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
  h AS (SELECT rid, item, p, o, k FROM dw JOIN win USING (k, g)), pos AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM h) GROUP BY ALL),
  it AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY ALL), rn AS (SELECT *, p - row_number() OVER (PARTITION BY rid, item, p - o, k ORDER BY p) AS run FROM h),
  ru AS (SELECT rid, item, min(p) AS p, min(o) AS o, count(*) - 1 + any_value(k) AS length FROM rn GROUP BY rid, item, rn.p - rn.o, k, run), be AS (SELECT * FROM ru QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length DESC, item, p, o) = 1)
  SELECT doc_id, len(w) AS n_words, coalesce(pos.n, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated,
    CAST(coalesce(be.length, 0) AS INT) AS longest_words, be.item AS longest_item, CAST(be.p AS INT) AS longest_doc_word, CAST(be.o AS INT) AS longest_item_word
  FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid) LEFT JOIN be USING (rid)"""
ARCHIVES = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT html, max(page_id) AS refers FROM p GROUP BY html)
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((CAST(concat('0x', substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5)) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1), 1)), '') AS payload_digest,
    CASE WHEN page_id < refers OR (page_id IS NULL AND refers IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < refers OR (page_id IS NULL AND refers IS NOT NULL) THEN refers END AS refers_to, true AS digest_ok
  FROM p JOIN f USING (html)"""
#: What SQL can express; the others are held against brute force in tests/llm.
ORACLE: dict[str, str] = {"op4_decontaminate": DECONTAMINATION, "op8_convert_archives": ARCHIVES}
