"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents, other columns too, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe, exact_dedup, langid, mixing, simhash
from tallyloom.llm.common import table, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in known languages stay, those in mixtures too; null texts and texts without a letter go. An empty table stays empty, repeated rows stay together."""
    return langid.keep_identified(docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, that of the largest doc_id; null counts as the empty text, null ids lose, ties leave any one."""
    return exact_dedup.drop_copies(docs)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id; texts without words and rows without doc_id all stay."""
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null and blank texts are never taken, null sources are one source."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of each row; a null text is empty, repeated rows each have a row."""
    return bpe.digest(docs)


STAGES = [("language ID", identified), ("exact dedup", unique), ("near-dedup", distinct_enough), ("mixing", mixed), ("BPE encoding", encoded)]

#: SQL can express neither mixture inference, min-wise sketches nor BPE merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
