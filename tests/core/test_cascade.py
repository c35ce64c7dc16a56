import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import readers as R
from tallyloom.plans.readers import Sources, cascade, known
from tallyloom.plans.statements import process

RBC = "Royal Bank of Canada\nOpening balance 1,000.00\n02 Jan Interac purchase 40.00 960.00\n03 Jan Monthly fee 10.00 950.00\n04 Jan ATM deposit 60.00 1,010.00\nClosing balance 1,010.00"
TD = (
    "TD Bank\nStatement Period: Jan 01 2025-Jan 31 2025\nELECTRONIC DEPOSITS 100.00\nELECTRONIC PAYMENTS 55.00\nDAILY ACCOUNT ACTIVITY\nElectronic Deposits\nPOSTING DATE DESCRIPTION AMOUNT\n"
    "01/05 CCD DEPOSIT, JPMORGAN CHASE through gateway 100.00\nElectronic Payments\n01/07 ACH DEBIT RENT 55.00\nDAILY BALANCE SUMMARY\n01/07 45.00"
)
CHASE = "JPMorgan Chase Bank\nJanuary 1, 2025 through January 31, 2025\nDEPOSITS AND ADDITIONS\n01/05 Online transfer 20.00\nELECTRONIC WITHDRAWALS\n01/06 Rent 7.00\nDAILY ENDING BALANCE\n01/06 13.00"
#: Named Chase, but without rows that its reader finds: the next bank whose test it passes reads it.
CHASE_NAMED = "SAVINGS SUMMARY\nCapital One\npayments pass through Chase\nACCOUNT DETAIL\n01/05 Customer Deposit 30.00 130.00\n01/06 Rent 12.00 118.00\nTotal $42.00"
FEE = "Corner Credit Union\nSERVICE CHARGES\n01/31 MONTHLY SERVICE FEE 25.00\nDEPOSITS AND CREDITS\n01/30 DIRECT DEPOSIT ACME 80.00"


def texts(spark, *rows, kind=False):
    return spark.createDataFrame([(*r, "image" if kind else "pdf") for r in rows], "statement string, text string, kind string")


def read(spark, *rows, **more):
    got = cascade(Sources(known(texts(spark, *rows), more.pop("readers", R.READERS)), F.lit(2025), **{k: v for k, v in more.items()}))
    return sorted((r.statement, r.Date, r.Description, r.Debit, r.Credit, r.Balance) for r in got.collect())


def test_banks_are_read_by_their_readers_in_order(spark):
    got = read(spark, ("rbc", RBC), ("td", TD), ("chase", CHASE), ("one", CHASE_NAMED), ("fee", FEE), ("none", "nothing"), ("null", None))
    assert got == [
        ("chase", "01/05", "Online transfer", 0.0, 20.0, 0.0), ("chase", "01/06", "Rent", 7.0, 0.0, 0.0),
        ("fee", "01/30", "DEPOSIT ACME", 0.0, 80.0, 0.0), ("fee", "01/31", "MONTHLY FEE", 25.0, 0.0, 0.0),
        ("one", "01/05", "Customer Deposit", 0.0, 30.0, 130.0), ("one", "01/06", "Rent", 12.0, 0.0, 118.0),
        ("rbc", "02 Jan", "Interac purchase", 40.0, 0.0, 960.0), ("rbc", "03 Jan", "Monthly fee", 10.0, 0.0, 950.0), ("rbc", "04 Jan", "ATM deposit", 0.0, 60.0, 1010.0),
        ("td", "01/05/2025", "CCD DEPOSIT, JPMORGAN CHASE through gateway", 0.0, 100.0, 0.0), ("td", "01/07/2025", "ACH DEBIT RENT", 55.0, 0.0, 0.0),
    ]


def test_pictures_skip_the_banks(spark):
    got = cascade(Sources(known(texts(spark, ("chase", CHASE), kind=True)), F.lit(2025)))
    assert {(r.Description, r.Debit, r.Credit) for r in got.collect()} == {("TRANSFER", 0.0, 20.0), ("RENT", 7.0, 0.0), ("", 13.0, 0.0)}


def test_a_reader_of_one_s_own(spark):
    mine = R.Reader("Corner", lambda t: t.contains("Corner Credit Union"), lambda s: s.texts.select("statement", F.lit(0).alias("line_no"), F.lit("1/2").alias("Date"), F.lit("mine").alias("Description"), F.lit(1.0).alias("Debit"), F.lit(0.0).alias("Credit")))
    more = R.with_reader(mine, before="Chase")
    assert [r.name for r in more] == ["RBC", "TD Bank", "Corner", "Chase", "Capital One", "Regions"] and R.with_reader(mine, readers=more)[-1] is mine
    got = cascade(Sources(known(texts(spark, ("fee", FEE)), more), F.lit(2025)), more)
    assert [(r.Description, r.Amount, r.Section) for r in got.collect()] == [("mine", -1.0, "")]


def test_td_canada_from_words_and_rbc_from_cells(spark):
    heads = [("DESCRIPTION", 0, 50), ("CHEQUE/DEBIT", 190, 51), ("DEPOSIT/CREDIT", 290, 52), ("DATE", 380, 50)]
    body = [("PAY", 0, 60), ("5.00", 190, 63), ("OCT9", 380, 61)]
    words = spark.createDataFrame([("tdca", 1, 600.0, 800.0, k, t, float(a), float(a + 20), float(y)) for k, (t, a, y) in enumerate(heads + body)], R._WORDS)
    table = [["Date", "Description", "Cheques & Debits ($)", "Deposits & Credits ($)", "Balance ($)"], ["", "Opening balance", "", "", "9.00"], ["5 Jan", "Fee", "1.00", "", "8.00"], ["", "Pay\nroll", "", "3.50", ""]]
    cells = spark.createDataFrame([("rbc", 1, 0, r, c, t) for r, row in enumerate(table) for c, t in enumerate(row)], R._CELLS)
    said = ("tdca", "Toronto-Dominion Bank\nSEP 29/25 - OCT 31/25\nCHEQUE/DEBIT DEPOSIT/CREDIT"), ("rbc", RBC)
    assert read(spark, *said, words=words, cells=cells) == [("rbc", "5 Jan", "Fee", 1.0, 0.0, 8.0), ("rbc", "5 Jan", "Pay roll", 0.0, 3.5, 0.0), ("tdca", "2025-10-09", "PAY", 5.0, 0.0, 0.0)]


def test_regions_from_boxes_where_the_text_has_no_rows(spark):
    box = lambda k, text, x, y: ("reg", 1, k, [(x, y - 5.0), (x + 40, y - 5.0), (x + 40, y + 5.0), (x, y + 5.0)], text)
    boxes = [box(0, "DEPOSITS & CREDITS", 10.0, 50.0), box(1, "01/05", 10.0, 100.0), box(2, "Sale", 100.0, 101.0), box(3, "88.00", 500.0, 99.0)]
    boxes = spark.createDataFrame(boxes, "statement string, page int, box_no int, bbox array<struct<x: double, y: double>>, text string")
    got = read(spark, ("reg", "Regions Bank\n01/05\nSale\n88.00"), ("two", "Regions Bank\nWITHDRAWALS\n01/06 Rent 9.00"), boxes=boxes)
    assert got == [("reg", "01/05", "Sale", 0.0, 88.0, 0.0), ("two", "01/06", "Rent", 9.0, 0.0, 0.0)]


def test_process_takes_banks_and_ledgers(spark):
    ledgers = spark.createDataFrame([("x.csv", 0, "2025-01-09", "KAPITUS ACH DEBIT", 5.0, 0.0, -5.0, 70.0), ("x.csv", 1, "2025-01-10", "SALE", 0.0, 50.0, 50.0, 120.0)], "statement string, row_no long, Date string, Description string, Debit double, Credit double, Amount double, Balance double")
    got = process(texts(spark, ("rbc", RBC), ("fee", FEE)), F.lit(2025), ledgers=ledgers.withColumns({"Section": F.lit(""), "Raw Line": F.lit("")}))
    rows = {r.statement: r for r in got["metrics"].collect()}
    assert (rows["rbc"].credits, rows["rbc"].debits) == (60.0, 50.0) and (rows["fee"].credits, rows["fee"].debits) == (80.0, 25.0)
    assert (rows["x.csv"].credits, rows["x.csv"].debits, rows["x.csv"].avg_daily_balance) == (50.0, 5.0, 95.0) and rows["x.csv"].lender_debits > 0
    assert {(r.statement, r.Date.date()) for r in got["ledger"].collect() if r.statement == "x.csv"} == {("x.csv", datetime.date(2025, 1, 9)), ("x.csv", datetime.date(2025, 1, 10))}


@pytest.mark.parametrize("readers", [R.READERS, ()])
def test_no_statements(spark, readers):
    assert cascade(Sources(known(spark.createDataFrame([], "statement string, text string"), readers), F.lit(2025)), readers).count() == 0


def test_the_first_reader_of_a_statement_is_told_without_a_join_and_tests_without_a_lambda(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(R, "cut", lambda rows: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), rows)[1])
    row = lambda name: lambda s: s.texts.filter(F.col("text").contains(name)).select("statement", F.lit(0).alias("line_no"), F.lit("1/2").alias("Date"), F.lit(name).alias("Description"), F.lit(1.0).alias("Debit"), F.lit(0.0).alias("Credit"))
    two = tuple(R.Reader(n, lambda t: t.contains("Bank"), row(n)) for n in ("North", "South"))
    got = cascade(Sources(known(texts(spark, ("a", "Bank South"), ("b", "Bank North South"), ("c", "South")), two), F.lit(2025)), two, ())
    assert sorted((r.statement, r.Description) for r in got.collect()) == [("a", "South"), ("b", "North")]
    assert len(plans) == 2 and "lambda" not in plans[0] and "Join" not in plans[1]
