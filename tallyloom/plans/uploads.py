"""A folder of uploads to metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import normalise
from ..sources import files
from .readers import READERS, Reader
from .statements import process


def ledgers(spark: SparkSession, path: str, uploaded: DataFrame) -> DataFrame:
    """Ledger rows of the CSV files under a path and the spreadsheets among the uploads, amounts parsed, ready for process()."""
    sheets = files.xlsx_ledgers(uploaded)
    has_csv = not uploaded.filter(F.lower("statement").endswith(".csv")).isEmpty()
    raw = files.csv_ledgers(spark, f"{path.rstrip('/')}/*.[cC][sS][vV]").unionByName(sheets) if has_csv else sheets
    rows = normalise(raw).withColumns({"Section": F.lit(""), "Raw Line": F.lit("")})
    return rows.select("statement", "row_no", "Date", "Description", "Debit", "Credit", "Amount", "Balance", "Section", "Raw Line")


def process_folder(spark: SparkSession, path: str, year: Column, documents: Sequence[files.Tier], pictures: Sequence[files.Tier], readers: Sequence[Reader] = READERS) -> dict[str, DataFrame]:
    """process() of a folder's uploads: CSV and .xlsx files as ledgers, others as text by the tiers for documents or pictures.

    Also `errors`: statement, error of each file that a tier failed on."""
    uploaded = files.uploads(spark, path)
    name = F.lower("statement")
    table, picture = name.rlike(r"\.(csv|xlsx)$"), name.rlike("(" + "|".join(s.replace(".", r"\.") for s in files.PICTURES) + ")$")
    texts = files.extracted(uploaded.filter(~table & ~picture), documents).withColumn("kind", F.lit("document")).unionByName(files.extracted(uploaded.filter(picture), pictures).withColumn("kind", F.lit("image")))
    out = process(texts, year, ledgers=ledgers(spark, path, uploaded), readers=readers)
    return out | {"errors": texts.select("statement", F.explode("errors").alias("error"))}
