"""Ledgers and statement text composed from the driver's tables, the same way every time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Descriptions that an event takes by its number.
DESCRIPTIONS = (
    "KAPITUS ACH DEBIT", "ONDECK DES:LOAN", "NSF FEE", "POS PURCHASE 8841", "LOAN PMT", "PARKING LOT 12", "KAPITUS FUNDING 12345", "KAPITUS 12345678",
    "KAPITUS REFERENCE # ACH DEBIT", "CCDDEBIT,FORWARDFINANCIN", "COFFEE SHOP", "SHOPIFY CAPITAL DES:PMT", "EXPANSION CAPITA FUNDING 5769267", "DIRECT DEPOSIT PAYROLL", "INTERAC PURCHASE 11", "OVERDRAFT FEE",
    "SBA LOAN 44", "RAPID FINANCE PMT", "SQ *MERCHANT", "PAYPAL TRANSFER", "ZELLE FROM A", "WIRE TRANSFER INCOMING ONDECK 55", "FUNDFICANADA 9", "MORTGAGE PAYMENT",
)
DEBIT_EVENTS = ("purchase", "click")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of events: a statement for each user and month; purchases and clicks are debits."""
    events = load(spark, sf_dir, "events")
    amount = F.round(F.abs("value"), 2)
    debit = F.col("event_type").isin(*DEBIT_EVENTS)
    description = F.element_at(F.array(*map(F.lit, DESCRIPTIONS)), (F.col("event_id") % len(DESCRIPTIONS) + 1).cast("int"))
    return events.select(
        F.concat(F.lit("u"), "user_id", F.lit("-"), F.date_format("ts", "yyyy-MM")).alias("statement"), F.col("event_id").alias("row_no"), F.col("ts").cast("timestamp_ntz").alias("Date"), description.alias("Description"),
        F.when(debit, amount).otherwise(0.0).alias("Debit"), F.when(debit, 0.0).otherwise(amount).alias("Credit"), F.when(debit, -amount).otherwise(amount).alias("Amount"),
        F.lit(None).cast("double").alias("Balance"), F.lit("").alias("Section"), F.lit("").alias("Raw Line"),
    )


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of orders: a statement for each customer and year; finished orders are credits, all others debits."""
    orders = load(spark, sf_dir, "orders")
    credit = F.col("o_orderstatus") == "F"
    amount = F.round("o_totalprice", 2)
    return orders.select(F.concat(F.lit("c"), "o_custkey", F.lit("-"), F.year("o_orderdate")).alias("statement"), F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("row_no"), F.col("o_orderdate").cast("timestamp_ntz").alias("Date"), F.when(credit, 0.0).otherwise(amount).alias("Debit"), F.when(credit, amount).otherwise(0.0).alias("Credit"))


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement text of the ledger, a row a line: under a section header each transaction as m/d, description, amount."""
    rows = ledger(spark, sf_dir)
    side = F.when(F.col("Debit") > 0, F.lit("ELECTRONIC WITHDRAWALS")).otherwise(F.lit("DEPOSITS AND ADDITIONS"))
    amount = F.greatest("Debit", "Credit").cast("decimal(18,2)").cast("string")
    line = F.concat_ws(" ", F.date_format("Date", "MM/dd"), "Description", amount)
    rank = F.when(F.col("Debit") > 0, 2).otherwise(1)
    body = rows.select("statement", rank.alias("part"), "row_no", line.alias("line"))
    heads = rows.select("statement", rank.alias("part"), F.lit(-1).cast("long").alias("row_no"), side.alias("line")).distinct()
    return body.union(heads).select("statement", (F.col("part") * 1_000_000_000 + F.col("row_no") + 1).alias("line_no"), "line")
