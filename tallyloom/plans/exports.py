"""What leaves the engine: files, JSON-safe rows, formatted summaries. Nothing is sent over a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_safe(table: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, times in ISO form."""
    out = []
    for c, kind in table.dtypes:
        x = F.col(f"`{c}`")
        if kind in ("double", "float"):
            x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        elif kind.startswith("timestamp") or kind == "date":
            x = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(x.alias(c))
    return table.select(*out)


def to_json(table: DataFrame) -> DataFrame:
    """One column, a JSON text a row; nulls are kept."""
    return json_safe(table).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def shown(table: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that exist, numbers as they are, all else as text."""
    kinds = dict(table.dtypes)
    number = ("double", "float", "int", "bigint", "boolean")
    return table.select(*[F.col(f"`{c}`") if kinds[c] in number else F.col(f"`{c}`").cast("string").alias(c) for c in columns if c in kinds])


def formatted_summary(totals: DataFrame) -> DataFrame:
    """metric, value of a totals row, as text."""
    money = {"Total Credits": "credits", "Total Debits": "debits", "Cash Flow": "cash_flow", "Lender Debits": "lender_debits", "Lender Credits": "lender_credits", "True Revenue": "true_revenue", "Average Daily Balance": "avg_daily_balance"}
    rows = [F.struct(F.lit(k).alias("metric"), F.concat(F.lit("$"), F.format_number(v, 2)).alias("value")) for k, v in money.items()]
    rows.append(F.struct(F.lit("Withholding Rate").alias("metric"), F.concat(F.format_number("withholding_rate", 2), F.lit("%")).alias("value")))
    rows += [F.struct(F.lit(k).alias("metric"), F.col(v).cast("string").alias("value")) for k, v in (("NSF Count", "nsf_count"), ("Loan Count", "loan_count"))]
    return totals.select(F.inline(F.array(*rows)))
