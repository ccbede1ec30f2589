"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import table, temporary, written
from lattica.llm.lines import drop_lines
from lattica.llm.packing import pack_documents
from lattica.llm.quality import keep_good
from lattica.llm.secrets import redact
from lattica.llm.simhash import one_of_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their language's perplexity bands keep, each row judged by its own text and lang: rows
    without a doc_id or with another's stand for themselves, repeated rows go or stay together. Null and empty texts go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without lines that an earlier line equals or nearly equals. Rows are told apart by doc_id and text; a text whose lines all
    stand earlier becomes empty, null and empty texts stay as they are."""
    return drop_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id (null last), ties by the text and then all columns. Null
    and empty texts are near duplicates of each other."""
    return one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with secrets in its text replaced; null and empty texts have none."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of up to 4096 tokens. A null or empty text is its end id alone; repeated rows are packed repeatedly."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: SQL expresses neither the language model nor the edit join; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over documents; what a stage writes for itself is removed once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
