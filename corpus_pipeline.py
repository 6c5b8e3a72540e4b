"""A corpus pipeline over ``documents``: language ID, line dedup, near-dedup, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents; the last adds ids, n_tokens and lossless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisweave.llm.common import store, table
from axisweave.llm.decontamination import decontaminate
from axisweave.llm.language import fit, identify
from axisweave.llm.linededup import drop_repeated_lines
from axisweave.llm.neardup import keep_one
from axisweave.llm.sentencepieces import encode_texts

#: A document is rejected when no language has this share of it, or when it has no letter at all.
MIN_SHARE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose main language is clear, with that language in ``lang``. The models are learned from the labelled documents.

    A document without letters (null texts among them) is rejected, as is one in which no language has MIN_SHARE.
    """
    found = identify(docs, fit(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another line, before it in order of doc_id, repeats exactly or nearly."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least doc_id."""
    return keep_one(docs).select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no run of eight words (or whole shorter item) with an item of ``benchmark``."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids under merge-dropout; ``lossless`` tells that they decode to the text."""
    return encode_texts(docs)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding", encode_stage),
]

#: SQL can't express these stages; tests/llm/test_pipeline.py holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
