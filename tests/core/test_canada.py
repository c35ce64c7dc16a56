import re

from pyspark.sql import functions as F

from tallyloom.operators import canada


def test_td_tables_map_headers_and_split_merged_rows(spark):
    table = [
        ["x", "", "", "", ""], ["Description", "Cheque/Debit", "Deposit/Credit", "Date", "Balance"], ["BALANCE FORWARD", "", "", "SEP 30", "1.00"], ["FEE", "1,012.50", "", "OCT1", ""],
        ["TFR-TO 30 \nTFR-FR 11", "2.00", "3.00", "Oct 2", "9.00"], ["MSP C\nSEND E-TFR D\nE", "4.00", "5.00", "XYZ3", ""], ["NONE", "", "", "OCT4", ""], ["NO DATE", "1.00", "", "", ""],
    ]
    cells = spark.createDataFrame([("s", 1, 0, r, c, t) for r, row in enumerate(table) for c, t in enumerate(row)] + [("t", 1, 0, 0, 0, None)], "statement string, page int, table_no int, row int, col int, text string")
    pages = spark.createDataFrame([("s", 2, "SEP 29/24 - OCT"), ("s", 1, "SEP 29/25 - OCT 31/25"), ("t", 1, None)], "statement string, page int, text string")
    years = canada.statement_year(pages, F.lit(2020))
    assert {tuple(r) for r in years.collect()} == {("s", 2025), ("t", 2020)}
    got = [tuple(r)[2:] for r in canada.td_tables(cells, years).orderBy("row_no", "part").collect()]
    assert got == [
        (3, 1, "2025-10-01", "FEE", 1012.5, 0.0), (4, 0, "2025-10-02", "TFR-FR 11", 0.0, 3.0), (4, 1, "2025-10-02", "TFR-TO 30", 2.0, 0.0),
        (5, 0, "2025-01-03", "MSP C", 0.0, 5.0), (5, 1, "2025-01-03", "SEND E-TFR D E", 4.0, 0.0),
    ]


def test_td_words_cluster_lines_and_serve_pages_without_tables(spark):
    head = [("DESCRIPTION", 0, 60, 50), ("CHEQUE/DEBIT", 190, 210, 51), ("DEPOSIT/CREDIT", 290, 310, 52), ("DATE", 380, 400, 50)]
    body = [("PAY", 0, 20, 60), ("A", 30, 40, 62), ("5.00", 190, 210, 63), ("OCT9", 380, 400, 61), ("88.00", 450, 470, 60), ("IN", 0, 20, 63.5), ("7.00", 290, 310, 64), ("NOV10", 380, 400, 66)]
    words = spark.createDataFrame([("s", p, t, float(a), float(b), float(y)) for p in (1, 2) for t, a, b, y in head + body], "statement string, page int, text string, x0 double, x1 double, top double")
    cells = spark.createDataFrame([("s", 1, 0, r, c, t) for r, row in enumerate([["DESCRIPTION", "CHEQUE", "DEPOSIT", "DATE"], ["T", "1.00", "", "OCT1"]]) for c, t in enumerate(row)], "statement string, page int, table_no int, row int, col int, text string")
    pages = spark.createDataFrame([("s", 1, "/25 -")], "statement string, page int, text string")
    got = [tuple(r)[1:] for r in canada.td_canada(pages, cells, words, F.lit(2020)).orderBy("page", "row_no").collect()]
    assert got == [(1, 1, 1, "2025-10-01", "T", 1.0, 0.0), (2, 1, 0, "2025-10-09", "PAY A", 5.0, 0.0), (2, 2, 0, "2025-11-10", "IN", 0.0, 7.0)]


def test_rbc_text_follows_the_balance(spark):
    text = """before any date 5.00
Opening balance 1,000.00
1 of 2
02 jan COFFEE 10.00 990.00
SHOP 5.00 995.00
03JanRegular transaction fee 7 Drs @ 2.50 17.50
Misc Payment MRCH12
1234567 20.00
4 Feb unknown 3.00
e-Transfer received 4.00
Closing balance 1.00"""
    lines = spark.createDataFrame([("s", k, t) for k, t in enumerate(text.split("\n"))], "statement string, line_no int, line string")
    got = [tuple(r)[2:] for r in canada.rbc_text(lines).orderBy("line_no").collect()]
    assert got == [
        ("02 Jan", "COFFEE", 10.0, 0.0, 990.0), ("02 Jan", "SHOP", 0.0, 5.0, 995.0), ("03 Jan", "Regular transaction fee 7 Drs @", 17.5, 0.0, 0.0),
        ("03 Jan", "Misc Payment MRCH12", 0.0, 20.0, 0.0), ("4 Feb", "e-Transfer received", 0.0, 4.0, 0.0),
    ]


def test_rbc_words_then_text(spark):
    def put(page, y, *placed):
        return [("s", page, 600.0, t, float(x), float(x + 20), float(y)) for t, x in placed]

    got = (
        put(1, 50, ("Cheques", 300), ("Deposits", 400), ("Balance", 500)) + put(1, 60, ("02", 0)) + put(1, 70, ("Jan", 0), ("FEE", 30), ("5.00", 300), ("95.00", 500)) + put(1, 80, ("PART", 30)) + put(1, 90, ("TWO", 30), ("7.00", 400))
        + put(1, 100, ("Closing", 30), ("balance", 60), ("9.00", 500)) + put(1, 110, ("0033FFeebb", 0), ("X", 30), ("1.50", 300)) + put(2, 20, ("4Mar", 0), ("Y", 30), ("2.00", 322))
    )
    words = spark.createDataFrame(got, "statement string, page int, width double, text string, x0 double, x1 double, top double")
    cells = spark.createDataFrame([], "statement string, page int, table_no int, row int, col int, text string")
    lines = spark.createDataFrame([("s", 0, "1 Jan Monthly fee 1.00"), ("t", 0, "1 Jan Monthly fee 1.00")], "statement string, line_no int, line string")
    rows = canada.rbc(cells, words, lines).orderBy("statement", "page", "row_no").collect()
    assert [(r.statement, r.page, r.Date, r.Description, r.Debit, r.Credit, r.Balance) for r in rows] == [
        ("s", 1, "02 Jan", "FEE", 5.0, 0.0, 95.0), ("s", 1, "02 Jan", "PART TWO", 0.0, 7.0, 0.0), ("s", 1, "03 Feb", "X", 1.5, 0.0, 0.0), ("s", 2, "4 Mar", "Y", 2.0, 0.0, 0.0), ("t", None, "1 Jan", "Monthly fee", 1.0, 0.0, 0.0),
    ]


def test_rbc_tables_map_headers_carry_dates_and_take_the_first_cutting_with_rows(spark):
    head = ["Posted", "Description", "Cheques & Debits ($)", "Deposits & Credits ($)", "Balance ($)"]
    body = [["", "before a date", "1.00", "", ""], ["3 Jan", "Fee", "$1,001.50", "", "9.00"], ["", "Pay\nroll", "", "2.25", ""], ["4 Jan", "Closing balance", "7.00", "", ""], ["", "nothing", "", "", "8.00"], ["5 Feb x", "Both", "1.00", "2.00", "(3.00)"]]
    tables = {("s", 1, 0, 0): [["no head"], *body], ("s", 1, 1, 0): [["title"], head, *body], ("s", 1, 2, 0): [head, *body, *body], ("s", 2, 0, 0): [head[:4], ["6 Mar", "Short", "4.00", ""], ["", "", "", ""]], ("s", 2, 0, 1): [head, body[1]]}
    rows = [(s, p, a, t, r, c, x) for (s, p, a, t), table in tables.items() for r, row in enumerate(table) for c, x in enumerate(row)]
    cells = spark.createDataFrame(rows, "statement string, page int, attempt int, table_no int, row int, col int, text string")
    got = [tuple(r)[1:] for r in canada.rbc_tables(cells).orderBy("page", "row_no").collect()]
    assert got == [
        (1, 1, 0, "3 Jan", "Fee", 1001.5, 0.0, 9.0), (1, 2, 0, "3 Jan", "Pay roll", 0.0, 2.25, 0.0), (1, 3, 0, "5 Feb", "Both", 1.0, 2.0, 3.0), (2, 1, 0, "6 Mar", "Short", 4.0, 0.0, 0.0),
    ]
    words = spark.createDataFrame([], "statement string, page int, width double, text string, x0 double, x1 double, top double")
    lines = spark.createDataFrame([("s", 0, "1 Jan Monthly fee 1.00"), ("t", 0, "1 Jan Monthly fee 1.00")], "statement string, line_no int, line string")
    assert [(r.statement, r.Description) for r in canada.rbc(cells, words, lines).orderBy("statement", "page", "row_no").collect()] == [("s", "Fee"), ("s", "Pay roll"), ("s", "Both"), ("s", "Short"), ("t", "Monthly fee")]


def test_pages_are_dealt_to_many_tasks(spark):
    words = spark.createDataFrame([("s", 1, 600.0, "D", 1.0, 2.0, 3.0)], "statement string, page int, width double, text string, x0 double, x1 double, top double")
    years = spark.createDataFrame([("s", 2024)], "statement string, year int")
    least = 16 * spark.sparkContext.defaultParallelism
    for rows in (canada.td_words(words, years), canada.rbc_words(words)):
        dealt = [int(n) for n in re.findall(r"RepartitionByExpression \[statement[^]]*\], (\d+)", rows._jdf.queryExecution().optimizedPlan().toString())]
        assert dealt and min(dealt) >= least
