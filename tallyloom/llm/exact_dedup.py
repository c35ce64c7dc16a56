"""Exact dedup: groups by a 128-bit content hash, bytes compared inside the groups.

Grouping on (hash, text) compares every text's bytes with its group's, so a hash collision never joins two
texts; partial aggregation collapses hot groups before the shuffle, which each distinct text of a task crosses once.
Only digests are joined back to rows; hot groups are joined without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import meet, written


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256; a row per input row.

    A null text counts as empty. Null ids lose to others; if all of a group are null its keep_id is null and its
    rows are kept. Repeated rows of the keeper's doc_id are all marked kept: they are one document.
    Other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", hashed(F.col("text")))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    texts = rows.groupBy("h", "text").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id"))
    groups = texts.select("h", sha.alias("text_sha256"), "n", "keep_id").groupBy("h", "text_sha256").agg(F.max("n").alias("n"), F.max("keep_id").alias("keep_id"), F.count("*").alias("texts"))
    size = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share both digests")).cast("long")).otherwise(F.col("n"))
    groups = written(groups.select("h", "text_sha256", size.alias("n"), F.col("n").alias("group_size"), "keep_id"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = meet(written(rows.select("doc_id", "h", sha.alias("text_sha256"))), groups, ["h", "text_sha256"], "n", total)
    return met.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each set of equal texts, that of the largest doc_id, with all its columns; null counts as empty.

    Of rows that tie on text and doc_id any one stays: one row per text, always. One shuffle, no join."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(content_hash(text).alias("h"), text.alias("t"), F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id")).alias("rank"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"], F.col("text").isNull().alias("none")).alias("row"))
    best = rows.groupBy("h", "t").agg(F.max_by("row", "rank").alias("row"))
    return best.select(*[(F.when(~F.col("row.none"), F.col("t")) if c == "text" else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(docs.columns)])
