"""Counts and sums of a statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.lexicon import LOAN, NSF, NSF_FLAG, POS
from ..functions.money import total
from ..functions.text import any_of, matches, squeezed
from .lines import spread

_MONEY = r"\b\d{1,3}(?:,\d{3})*\.\d{2}\b|\b\d+\.\d{2}\b"


def nsf_rows(text: Column) -> Column:
    return F.count_if(matches(text, NSF, True))


def nsf_flag(text: Column) -> Column:
    return matches(text, NSF_FLAG, True)


def _counts() -> list[Column]:
    upper = F.upper("Description")
    return [nsf_rows(F.col("Description")).alias("nsf_count"), F.count_if(matches(upper, LOAN)).alias("loan_count"), F.count_if(matches(upper, POS)).alias("pos_count")]


def _sums() -> list[Column]:
    return [total(F.col("Credit")).alias("credits"), total(F.col("Debit")).alias("debits"), F.round(F.coalesce(F.avg(F.when(F.col("Balance") > 0, F.col("Balance"))), F.lit(0.0)), 2).alias("avg_daily_balance")]


def counts(ledger: DataFrame) -> DataFrame:
    """statement, nsf_count, loan_count, pos_count by description."""
    return ledger.groupBy("statement").agg(*_counts())


def nsf_in_text(text: Column) -> Column:
    """Dated lines under the first `Items returned unpaid`, up to an empty line."""
    section = F.regexp_extract(text, r"(?is)Items\s+returned\s+unpaid(.*?)(?:\n\n|\z)", 1)
    return F.size(F.regexp_extract_all(section, F.lit(r"(?m)^\s*\d{1,2}/\d{1,2}"), 0))


def sums_and_counts(ledger: DataFrame) -> DataFrame:
    """statement, credits, debits, avg_daily_balance (mean of the positive balances, 0 if none) and counts(), in one pass."""
    return ledger.groupBy("statement").agg(*_sums(), *_counts())


def nsf_charges(text: Column) -> Column:
    """How often a text names a charge for missing funds."""
    return F.size(F.regexp_extract_all(text, F.lit(f"(?i)({L.CAPITAL_ONE_NSF})"), 1))


def bank_nsf(text: Column, bank: Column) -> Column:
    """What a bank's statement says of missing funds: Chase lists returned items, Capital One names charges; null for other banks."""
    return F.when(bank == "Chase", nsf_in_text(text)).when(bank == "Capital One", nsf_charges(text))


def distinct_counts(ledger: DataFrame) -> DataFrame:
    """statement, credit_count, debit_count, total_count of rows that differ in date, text (whatever its case and blanks) or
    amounts; rows without text don't count, nor do dates given as text that don't begin with m/d."""
    rows = ledger.withColumn("Description", squeezed(F.upper("Description"))).dropDuplicates(["statement", "Date", "Description", "Debit", "Credit"])
    valid = F.col("Description") != ""
    if dict(ledger.dtypes)["Date"] == "string":
        valid = valid & F.trim("Date").rlike(r"^\d{1,2}/\d{1,2}")
    both = F.count_if(valid & (F.col("Credit") > 0)), F.count_if(valid & (F.col("Debit") > 0))
    return rows.groupBy("statement").agg(both[0].alias("credit_count"), both[1].alias("debit_count"), (both[0] + both[1]).alias("total_count"))


def blocks(section: Column) -> Column:
    """The rows of a section as an array: a line that begins with m/d and those that follow it, and what stands before the first."""
    lines = F.filter(F.transform(F.split(section, r"\r?\n"), squeezed), lambda x: x != "")
    return F.transform(F.split(F.array_join(lines, "\n"), r"\n(?=\d{1,2}/\d{1,2}\b)"), lambda b: F.replace(b, F.lit("\n"), F.lit(" ")))


def section_rows(text: Column, start: str, stop: str = "") -> Column:
    """Number of rows with an amount from a label to the next one (or the end), totals and balances left out."""
    section = F.regexp_extract(text, rf"(?is)\Q{start}\E(.*?)" + (rf"\Q{stop}\E" if stop else r"\z"), 1)
    return F.size(F.filter(blocks(section), lambda b: b.rlike(_MONEY) & ~b.rlike("(?i)" + L.COUNTS_TOTAL)))


def _printed(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, "(?i)" + pattern, 1).try_cast("int")


def printed_counts(text: Column) -> Column:
    """struct(credits, debits) by what a bank prints or lists; null if no rule counts anything."""
    upper = F.upper(text)
    added = lambda found: sum((F.coalesce(n, F.lit(0)) for n in found), F.lit(0))
    of = lambda credits, debits: F.struct(credits.cast("long").alias("credits"), debits.cast("long").alias("debits"))
    some = lambda credits, debits: F.when(credits + debits > 0, of(credits, debits))
    bofa = [_printed(text, p) for p in L.COUNTS_BOFA]
    listed = F.size(F.regexp_extract_all(F.regexp_extract(text, "(?is)" + L.COUNTS_TD_CHECK_PART, 1), F.lit(L.TD_CHECKS), 0))
    checks = F.coalesce(F.nullif(_printed(text, L.COUNTS_TD_CHECKS), F.lit(0)), listed)
    td = added(section_rows(text, a, b) for a, b in L.COUNTS_TD_CREDIT), checks + added(section_rows(text, a, b) for a, b in L.COUNTS_TD_DEBIT)
    history = F.coalesce(F.nullif(F.regexp_extract(text, "(?is)Transaction history(.*)", 1), F.lit("")), text)
    rows = F.filter(F.transform(blocks(history), F.upper), lambda b: b.rlike(_MONEY) & ~any_of(b, L.WELLS_SKIP))
    wells = F.size(F.filter(rows, lambda b: any_of(b, L.WELLS_CREDIT))), F.size(F.filter(rows, lambda b: any_of(b, L.WELLS_DEBIT)))
    return F.coalesce(
        F.when(F.coalesce(*bofa).isNotNull(), of(added(bofa[:1]), added(bofa[1:]))),
        F.when(upper.rlike("CHASE|JPMORGAN"), some(added(_printed(text, p) for p in L.COUNTS_CHASE_CREDIT), added(_printed(text, p) for p in L.COUNTS_CHASE_DEBIT))),
        F.when(upper.rlike("TD BANK|TD BUSINESS"), some(*td)), F.when(upper.contains("WELLS FARGO"), some(*wells)),
    )


def transaction_counts(texts: DataFrame, ledger: DataFrame) -> DataFrame:
    """statement, credit_count, debit_count, total_count of texts(statement, text): what the text tells, else distinct rows of the ledger, else 0."""
    said = spread(texts).select("statement", printed_counts(F.col("text")).alias("p")).join(distinct_counts(ledger), "statement", "left")
    counted = lambda part, column: F.coalesce(F.when(F.col("p").isNotNull(), F.col(f"p.{part}")).otherwise(F.col(column)), F.lit(0)).alias(column)
    return said.select("statement", counted("credits", "credit_count"), counted("debits", "debit_count")).withColumn("total_count", F.col("credit_count") + F.col("debit_count"))
