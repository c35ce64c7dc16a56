"""Statement metrics, and what is made of many statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import total
from .lenders import lender_credits, lender_debits, lender_monthly, with_lender
from .metrics import nsf_flag, sums_and_counts

SUMMED = ("credits", "debits", "cash_flow", "lender_debits", "lender_credits", "true_revenue", "nsf_count", "loan_count", "pos_count")


def percent(part, whole):
    """part of whole in per cent, 0 unless whole is positive."""
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def statement_metrics(ledger: DataFrame, summary: DataFrame | None = None, found: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """One row a statement of the ledger or of the summary; one without rows has sums and counts of 0.

    summary(statement, credits_amount, debits_amount), where it has an amount, overrules the ledger's sums; its
    nsf_in_text, if it has that column, overrules a smaller nsf_count. raw: the ledger before rows without a date
    went; its sums count where they are larger.

    All parts are grouped by statement, so they meet without another shuffle of the ledger."""
    found = found if found is not None else with_lender(ledger)
    obligation = lender_monthly(lender_debits(found)).groupBy("statement").agg(total(F.col("monthly")).alias("lender_debits"))
    advances = lender_credits(found).groupBy("statement").agg(total(F.col("amount")).alias("lender_credits"))
    how = "left" if raw is None else "full"
    rows = sums_and_counts(ledger).join(obligation, "statement", how).join(advances, "statement", how).fillna(0.0, ["lender_debits", "lender_credits"])
    if raw is not None:
        larger = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.coalesce(f"raw_{c}", F.lit(0.0)))
        rows = rows.join(raw.groupBy("statement").agg(total(F.col("Credit")).alias("raw_credits"), total(F.col("Debit")).alias("raw_debits")), "statement", "full")
        rows = rows.withColumns({"credits": larger("credits"), "debits": larger("debits")}).drop("raw_credits", "raw_debits").fillna(0)
    if summary is not None:
        said = summary if "nsf_in_text" in summary.columns else summary.withColumn("nsf_in_text", F.lit(0))
        rows = rows.join(said.select("statement", "credits_amount", "debits_amount", "nsf_in_text"), "statement", "full")
        rows = rows.fillna(0, ["credits", "debits", "nsf_count", "loan_count", "pos_count", "avg_daily_balance", "lender_debits", "lender_credits"])
        rows = rows.withColumn("nsf_count", F.greatest("nsf_count", F.coalesce("nsf_in_text", F.lit(0)).cast("long")))
        said = (F.coalesce("credits_amount", F.lit(0.0)) > 0) | (F.coalesce("debits_amount", F.lit(0.0)) > 0)
        rows = rows.withColumns({"credits": F.when(said, F.coalesce("credits_amount", F.lit(0.0))).otherwise(F.col("credits")), "debits": F.when(said, F.coalesce("debits_amount", F.lit(0.0))).otherwise(F.col("debits"))})
    rows = rows.withColumn("true_revenue", F.round(F.col("credits") - F.col("lender_credits"), 2)).withColumn("cash_flow", F.round(F.col("credits") - F.col("debits"), 2))
    rows = rows.withColumn("withholding_rate", F.round(percent(F.col("lender_debits"), F.col("true_revenue")), 4))
    return rows.select("statement", "credits", "debits", "cash_flow", "lender_debits", "lender_credits", "true_revenue", "withholding_rate", "nsf_count", "loan_count", "pos_count", "avg_daily_balance")


def totals(metrics: DataFrame) -> DataFrame:
    """One row: sums over statements, the mean balance, withholding of the sums."""
    exact = [(total(F.col(c)) if not c.endswith("count") else F.sum(c)).alias(c) for c in SUMMED]
    row = metrics.agg(F.count("*").alias("statements"), *exact, F.round(F.avg("avg_daily_balance"), 2).alias("avg_daily_balance"))
    return row.withColumn("withholding_rate", F.round(percent(F.col("lender_debits"), F.col("true_revenue")), 4))


def averages(totalled: DataFrame) -> DataFrame:
    """totals() over the number of statements; balance and withholding as they are."""
    return totalled.select("statements", *[F.round(F.col(c) / F.col("statements"), 2).alias(c) for c in SUMMED], "avg_daily_balance", "withholding_rate")


def with_manual(totalled: DataFrame, picked: DataFrame, removed: bool = False) -> DataFrame:
    """totals() with rows that a user assigned to lenders: picked(type `debit` or `credit`, amount), or with such rows taken back.

    Amounts that aren't above 0 do nothing; sums end at 0. Revenue and withholding follow. One row crosses the join."""
    side = lambda kind: F.coalesce(total(F.when((F.col("type") == kind) & (F.col("amount") > 0), F.col("amount"))), F.lit(0.0)) * (-1 if removed else 1)
    change = picked.agg(side("debit").alias("__debit"), side("credit").alias("__credit"))
    rows = totalled.withColumn("__k", F.lit(0)).join(change.withColumn("__k", F.lit(0)), "__k")
    rows = rows.withColumns({"lender_debits": F.round(F.greatest(F.lit(0.0), F.col("lender_debits") + F.col("__debit")), 2), "lender_credits": F.round(F.greatest(F.lit(0.0), F.col("lender_credits") + F.col("__credit")), 2)})
    rows = rows.withColumn("true_revenue", F.round(F.col("credits") - F.col("lender_credits"), 2))
    return rows.withColumn("withholding_rate", F.round(percent(F.col("lender_debits"), F.col("true_revenue")), 4)).select(totalled.columns)


def with_saved(totalled: DataFrame, matched: DataFrame) -> DataFrame:
    """totals() with the rows that saved keywords found: matched(type, amount) from apply_saved_keywords().

    Lender debits and credits grow by the amounts, withholding is taken anew of what is then left of the credits; true
    revenue stays as it was, and without a match so does all else. One row crosses the join."""
    side = lambda kind: total(F.when(F.col("type") == kind, F.col("amount")))
    more = matched.agg(side("debit").alias("__debit"), side("credit").alias("__credit"), F.count("*").alias("__n")).withColumn("__k", F.lit(0))
    rows = totalled.withColumn("__k", F.lit(0)).join(more, "__k")
    debits, credits = (F.col(f"lender_{c}s") + F.col(f"__{c}") for c in ("debit", "credit"))
    new = {"lender_debits": F.round(debits, 2), "lender_credits": F.round(credits, 2), "withholding_rate": F.round(percent(debits, F.col("credits") - credits), 4)}
    return rows.select(*[F.when(F.col("__n") > 0, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in totalled.columns])


def averages_with_saved(totalled: DataFrame, matched: DataFrame) -> DataFrame:
    """averages() of totals() with the rows that saved keywords found; withholding is that of the totals."""
    plain, more = averages(totalled), with_saved(totalled, matched)
    changed = ("lender_debits", "lender_credits")
    new = more.select(F.lit(0).alias("__k"), *[F.round(F.col(c) / F.col("statements"), 2).alias(f"__{c}") for c in changed], F.col("withholding_rate").alias("__rate"))
    rows = plain.withColumn("__k", F.lit(0)).join(new, "__k")
    return rows.withColumns({**{c: F.col(f"__{c}") for c in changed}, "withholding_rate": F.col("__rate")}).select(plain.columns)


def monthly_summary(ledger: DataFrame) -> DataFrame:
    """month, revenue, debits, transactions, nsf, cash flow and debit rate by calendar month."""
    rows = ledger.withColumn("Month", F.date_format("Date", "MMMM yyyy")).groupBy("Month").agg(total(F.col("Credit")).alias("Monthly_Revenue"), total(F.col("Debit")).alias("Monthly_Debits"), F.count("Amount").alias("Transaction_Count"), F.count_if(nsf_flag(F.col("Description"))).alias("NSF_Count"))
    return rows.withColumn("Monthly_Cash_Flow", F.round(F.col("Monthly_Revenue") - F.col("Monthly_Debits"), 2)).withColumn("Withholding_Rate", F.round(percent(F.col("Monthly_Debits"), F.col("Monthly_Revenue")), 4)).orderBy("Month")


def withholding_preview(totalled: DataFrame, picked: DataFrame) -> DataFrame:
    """One row: rate and change if picked(type, amount) joined the lender debits; the rate is of all credits, 0 without any."""
    added = picked.agg(F.coalesce(total(F.when(F.col("type") == "debit", F.col("amount"))), F.lit(0.0)).alias("added")).withColumn("__k", F.lit(0))
    rows = totalled.withColumn("__k", F.lit(0)).join(added, "__k")
    rate = percent(F.col("lender_debits") + F.col("added"), F.col("credits"))
    return rows.select(F.round(rate, 4).alias("rate"), F.round(rate - F.col("withholding_rate"), 4).alias("change"))


def gross_totals(metrics: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: totals with withholding of gross credits, NSF rows of all ledger rows, and whole mean NSF and loan counts."""
    sums = metrics.agg(*[total(F.col(c)).alias(c) for c in ("credits", "debits", "lender_debits", "lender_credits")], F.round(F.avg("avg_daily_balance"), 2).alias("avg_daily_balance"), F.floor(F.avg("nsf_count")).alias("monthly_nsf"), F.floor(F.avg("loan_count")).alias("monthly_loans"))
    flagged = ledger.agg(F.count_if(nsf_flag(F.col("Description"))).alias("nsf_count")).withColumn("__k", F.lit(0))
    rows = sums.withColumn("__k", F.lit(0)).join(flagged, "__k").drop("__k")
    return rows.withColumns({"cash_flow": F.round(F.col("credits") - F.col("debits"), 2), "withholding_rate": F.round(percent(F.col("lender_debits"), F.col("credits")), 4)})


def funders(found: DataFrame) -> DataFrame:
    """One row: whether any row of with_lender() names a lender, and their names in order."""
    return found.filter(F.col("lender").isNotNull()).agg((F.count("*") > 0).alias("funding_detected"), F.array_sort(F.collect_set("lender")).alias("funders"))
