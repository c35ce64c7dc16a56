"""Ledgers dropped as files, normalised and summed as they come, with the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.money import total
from ..operators.ledger import prepare


def ledger_stream(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The prepared ledger of CSV files in a folder; statement is the file's name unless the files have one."""
    raw = spark.readStream.schema(schema).option("header", True).csv(path)
    if "statement" not in raw.columns:
        raw = raw.withColumn("statement", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return prepare(raw)


def daily_sums(ledger: DataFrame, late: str = "7 days") -> DataFrame:
    """Credits and debits of each day; a day is closed when the watermark has passed it."""
    rows = ledger.withColumn("at", F.col("Date").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", "1 day").alias("day")).agg(total(F.col("Credit")).alias("credits"), total(F.col("Debit")).alias("debits"), F.count("*").alias("rows"))
