import time

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.dates import ledger_date, statement_date
from tallyloom.functions.money import clean_money, plausible_balance
from tallyloom.functions.text import clean_text, short_labels, unspaced
from tallyloom.operators import ledger
from tallyloom.operators.summary import is_canada_trust


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("(1,234.56)", -1234.56), ("1,234.56-", -1234.56), ("-1,234.56", -1234.56), ("$-5.00", -5.0), ("1,234", 1.234), ("12,50", 12.5), ("1.234,56", 1.23456), ("1,234,567", 0.0), ("(5.00)-", 0.0), ("", 0.0), (None, 0.0), ("abc", 0.0)],
)
def test_money(spark, text, want):
    assert one(spark, text, clean_money) == pytest.approx(want)


def test_balances_and_labels(spark):
    assert one(spark, "10,000,001.00", plausible_balance) is None and one(spark, "9,999,999.00", plausible_balance) == 9999999.0
    assert one(spark, "Direct Deposit POS Purchase NSF Fee", short_labels) == "DEPOSIT PURCHASE NSF"
    assert one(spark, "ab-c_d. e", clean_text) == "AB C D E"
    assert one(spark, "T o t a l", unspaced) == "Total" and one(spark, "a b c", unspaced) == "a b c"


def test_dates(spark):
    assert one(spark, "12/05", ledger_date) is None
    assert str(one(spark, "12/05", lambda t: ledger_date(t, F.lit(2024)))) == "2024-12-05 00:00:00"
    today = F.lit("2026-01-01").cast("date")
    assert str(one(spark, "SEP 29/25 - OCT 31/25", lambda t: statement_date(t, F.lit(""), F.lit(None).cast("int"), today))) == "2025-10-31 00:00:00"
    assert str(one(spark, "", lambda t: statement_date(t, F.lit("summary 2025.csv"), F.lit(None).cast("int"), today))) == "2025-03-01 00:00:00"


def test_a_ledger_s_date_is_read_once_and_its_doubles_as_they_are(spark):
    texts = ("1/5", "01/05/2024", "2024-1-5", "05 JAN", "5 jan x", "JAN 5 2024", "january 5, 2024", "2024-01-05 00:00:00", "2/30", "5 foo", "", None)
    values = (1.5, -2.25, float("nan"), float("inf"), float("-inf"), -0.0, 1e-7, 1e17, None, 3.0, 4.0, 5.0)
    raw = spark.createDataFrame([("s", k, t, "x", v, 0.0, 0.0) for k, (t, v) in enumerate(zip(texts, values, strict=True))], "statement string, row_no long, Date string, Description string, Debit double, Credit double, Balance double")
    rows = ledger.prepare(raw, F.lit(2024))
    got = {r.row_no: (str(r.Date)[:10], r.Debit) for r in rows.collect()}
    assert got == dict(enumerate([("2024-01-05", v) for v in (1.5, 2.25, 0.0, 0.0, 0.0, 0.0, 1e-7, 1e17)]))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("initcap") == 2 and "cast(Debit" not in plan


def test_column_heads_of_a_long_text_are_looked_for_in_linear_time(spark):
    began = time.perf_counter()
    assert one(spark, "paid 1.00 " * 20_000, is_canada_trust) is False
    assert time.perf_counter() - began < 15
    assert one(spark, "x\nBusiness Cheque\nDeposit / Credit Cheque/Debit", is_canada_trust) and not one(spark, "Deposit/Credit Cheque/Debit", is_canada_trust)
