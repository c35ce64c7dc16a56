"""Raw uploads to prepared ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ledger_date
from ..functions.lexicon import AMOUNT_ALIASES, CREDIT_ALIASES, CREDIT_WORDS, DATE_ALIASES, DEBIT_ALIASES, DEBIT_WORDS, DESC_ALIASES, HEADER_PARTS
from ..functions.money import clean_money, lenient_of
from ..functions.text import any_of
from .lines import once
from .metrics import nsf_flag


def mapped_headers(columns: list[str]) -> dict[str, str]:
    """Column to standard name, by what its header contains; two columns of one name are an error."""
    out: dict[str, str] = {}
    for c in columns:
        name = next((n for n, parts in HEADER_PARTS if any(p in c.lower() for p in parts)), None)
        if name and name in out.values():
            raise ValueError(f"two columns look like {name}: {[k for k, v in out.items() if v == name] + [c]}")
        if name:
            out[c] = name
    return out


def normalise(raw: DataFrame) -> DataFrame:
    """Standard names, missing columns added, money parsed, a lone signed amount split into debit and credit."""
    names = mapped_headers(raw.columns)
    rows = raw.select(*[F.col(f"`{c}`").alias(names.get(c, c.strip())) for c in raw.columns])
    for c in ("Date", "Description"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(""))
    for c in ("Debit", "Credit", "Amount", "Balance"):
        if c in rows.columns or c != "Balance":
            rows = rows.withColumn(c, clean_money(F.col(c)) if c in rows.columns else F.lit(0.0))
    none = (F.col("Debit") == 0) & (F.col("Credit") == 0)
    debit = F.when(none & (F.col("Amount") < 0), -F.col("Amount")).otherwise(F.col("Debit"))
    credit = F.when(none & (F.col("Amount") > 0), F.col("Amount")).otherwise(F.col("Credit"))
    return rows.withColumns({"Debit": debit, "Credit": credit})


def direction(description: Column) -> Column:
    """Side of an unsigned amount; what no word tells is a debit."""
    lower = F.lower(description)
    return F.when(any_of(lower, DEBIT_WORDS), "Debit").when(any_of(lower, CREDIT_WORDS), "Credit").otherwise("Debit")


def prepare(raw: DataFrame, year: Column | None = None) -> DataFrame:
    """The prepared ledger: dates resolved (rows without one go), sides absolute, amount credit - debit, month, type, flags.

    Columns are found by their aliases, or by normalise()'s names. year: completes dates that name none; without it
    such rows are dropped."""
    lower = {c.strip().lower(): c for c in raw.columns}
    mapped = {v.lower(): k for k, v in mapped_headers(raw.columns).items()}

    def find(aliases: list[str]) -> str | None:
        return next((lower[a] for a in aliases if a in lower), None) or mapped.get(aliases[0])

    date, text, amount, debit, credit = map(find, (DATE_ALIASES, DESC_ALIASES, AMOUNT_ALIASES, DEBIT_ALIASES, CREDIT_ALIASES))
    if not date or not (debit or credit or amount):
        return raw.sparkSession.createDataFrame([], "statement string, row_no long, Date timestamp_ntz, Description string, Debit double, Credit double, Amount double, Month string, Type string, `NSF Flag` boolean, `Funding Detected` boolean, `Funded By` string")
    money = lambda c: F.abs(lenient_of(raw, c)) if c else F.lit(0.0)
    description = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")) if text else F.lit("")
    if debit or credit:
        d, c = money(debit), money(credit)
    else:
        side = direction(description)
        d, c = F.when(side == "Debit", money(amount)).otherwise(0.0), F.when(side == "Credit", money(amount)).otherwise(0.0)
    kind = dict(raw.dtypes)[date]
    when = ledger_date(F.col(f"`{date}`"), year) if kind == "string" else F.col(f"`{date}`").cast("timestamp_ntz")
    keys = [c for c in ("statement", "row_no") if c in raw.columns]
    balance = [lenient_of(raw, "Balance").alias("Balance")] if "Balance" in raw.columns else []
    rows = once(raw, "__when", when).select(*keys, F.col("__when").alias("Date"), description.alias("Description"), d.alias("Debit"), c.alias("Credit"), *balance).filter(F.col("Date").isNotNull())
    return rows.withColumns({"Amount": F.col("Credit") - F.col("Debit"), "Month": F.date_format("Date", "MMMM yyyy"), "Type": F.when(F.col("Debit") > 0, "Debit").otherwise("Credit"), "NSF Flag": nsf_flag(F.col("Description")), "Funding Detected": F.lit(False), "Funded By": F.lit("")})
