"""Four idioms over the ordered lines of a statement, from which all row parsers are made.

Lines are (statement, line_no, line). Every window is partitioned by statement: statements run in parallel, each is
sorted once, and the idioms of one parser share that sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _order():
    return Window.partitionBy("statement").orderBy("line_no")


def _so_far():
    return _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def to_lines(texts: DataFrame) -> DataFrame:
    """(statement, text) to lines."""
    return texts.select("statement", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def spread(texts: DataFrame) -> DataFrame:
    """The rows dealt by statement to twice as many tasks as there are cores: texts of few megabytes, which one task would read, are work for all."""
    return texts.repartition(2 * texts.sparkSession.sparkContext.defaultParallelism, "statement")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt by statement to many tasks, whose number small blocks of a shuffle don't lower: what one task sorts stays a small share of all."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism), "statement")


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with one more column, computed once a row: no filter or column that reads it is merged with it and computes it anew."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def carried(marker: Column) -> Column:
    """The last marker that isn't null, up to here."""
    return F.last(marker, ignorenulls=True).over(_so_far())


def coming(marker: Column) -> Column:
    """The first marker that isn't null, from here on."""
    return F.first(marker, ignorenulls=True).over(_order().rowsBetween(Window.currentRow, Window.unboundedFollowing))


def seen(flag: Column) -> Column:
    """Whether a line up to here has the flag."""
    return F.max(flag).over(_so_far())


def block_of(starts: Column) -> Column:
    """Number of the block that a line belongs to; 0 before the first."""
    return F.sum(F.when(starts, 1).otherwise(0)).over(_so_far())


def merged(lines: DataFrame, *carry: str) -> DataFrame:
    """Lines of a block (statement, block, line_no, line) joined by blanks in order; carry columns from its first line."""
    rows = lines.filter("block > 0").groupBy("statement", "block").agg(F.sort_array(F.collect_list(F.struct("line_no", "line", *carry))).alias("all"))
    first = F.element_at("all", 1)
    rows = rows.select("statement", "block", first["line_no"].alias("line_no"), F.col("all.line").alias("lines"), *[first[c].alias(c) for c in carry])
    return rows.withColumn("line", F.array_join("lines", " "))
