import pytest
from pyspark.sql import functions as F

from tallyloom.operators import balance, parsers
from tallyloom.operators.lines import to_lines


def lines(spark, text):
    return to_lines(spark.createDataFrame([("s", text)], "statement string, text string"))


def got(rows):
    return [(r.Date, r.Description, r.Debit, r.Credit) for r in rows.orderBy("line_no").collect()]


def test_universal(spark):
    text = "Checking Account\nDeposits and Other Credits\n01/05 MERCHANT BATCH 100.00 1,100.00\n01/06 ACME PAYMENT 40.00\n01/07 STORE SALE 10.00"
    assert got(parsers.universal(lines(spark, text))) == [("01/05", "MERCHANT BATCH 100.00", 0.0, 100.0), ("01/06", "ACME PAYMENT", 40.0, 0.0), ("01/07", "STORE SALE", 10.0, 0.0)]


def test_trailing_headers(spark):
    text = "12/01 A 1.00\ncont\nDEPOSITS AND ADDITIONS\n12/02 B 2.00\nFEES\n12/03 C 3.00"
    assert got(parsers.chase(lines(spark, text))) == [("12/01", "A cont", 0.0, 1.0), ("12/02", "B", 0.0, 2.0), ("12/03", "C", 3.0, 0.0)]


def test_checks(spark):
    text = "DAILY ACCOUNT ACTIVITY\nChecks Paid\n01/05 1001 50.00 01/06 1002* 60.00"
    assert sorted(got(parsers.td_bank(lines(spark, text), F.lit(2025)))) == [("01/05/2025", "Check #1001", 50.0, 0.0), ("01/06/2025", "Check #1002*", 60.0, 0.0)]


def test_capital_one_and_bank_of_america(spark):
    one = "CAPITAL ONE\nACCOUNT DETAIL\n01/02 Customer Deposit $10.00 $110.00\n01/03 Debit Card Purchase\nSTORE $5.00 $105.00\nTotal $15.00\n01/09 Deposit $1.00"
    assert got(parsers.capital_one(lines(spark, one))) == [("01/02", "Customer Deposit", 0.0, 10.0), ("01/03", "Debit Card Purchase STORE", 5.0, 0.0)]
    two = "Deposits and other credits\n01/02/24 SALE 10.00\nWithdrawals and other debits\n01/03/24 RENT 5.00 105.00"
    assert got(parsers.bank_of_america(lines(spark, two))) == [("01/02/24", "SALE", 0.0, 10.0), ("01/03/24", "RENT", 5.0, 0.0)]


def test_weighted_balance(spark):
    text = "in 2025\nBeginning balance on 1/1 100.00\n1/11 X 5.00 200.00\nEnding balance on 1/31"
    row = balance.average_balance(spark.createDataFrame([("s", text)], "statement string, text string")).first()
    assert (row.average, row.level) == (pytest.approx(166.67), 2)


