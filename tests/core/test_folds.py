import datetime
import time

from pyspark.sql import functions as F

from tallyloom.operators import canada, geometry, trends


def test_a_statement_of_100_000_rows_is_folded_in_linear_time(spark):
    """Four times the rows take nowhere near sixteen times as long."""
    took = []
    for n in (25_000, 100_000):
        rows = spark.range(n).select(F.lit("s").alias("statement"), F.lit(1000.0).alias("opening"), F.col("id").alias("line_no"), F.array(F.lit(1.0), 1000.0 + 1.0 * (F.col("id") + 1)).alias("amounts"))
        lines = spark.range(n).select(F.lit("s").alias("statement"), F.col("id").alias("line_no"), F.when(F.col("id") == 0, "Opening balance 1,000.00").otherwise(F.format_string("02 Jan ATM deposit 5.00 %.2f", 1000.0 + 5 * F.col("id"))).alias("line"))
        dates = spark.range(n).select(F.lit("s").alias("statement"), F.date_add(F.lit("2020-01-01"), (F.col("id") % 3000).cast("int")).alias("day"))
        began = time.perf_counter()
        balances = trends.running_balance(rows).agg(F.count("*"), F.max("balance"), F.count_if(F.col("section") == "Credit")).first()
        read = canada.rbc_text(lines).agg(F.count("*"), F.sum("Credit"), F.max("Balance")).first()
        fixed = trends.fix_year_gaps(dates, "statement", "day").count()
        took.append(time.perf_counter() - began)
        assert tuple(balances) == (n, 1000.0 + n, n) and tuple(read) == (n - 1, 5.0 * (n - 1), 1000.0 + 5 * (n - 1)) and fixed == n
    assert took[1] < 8 * took[0] + 2


def test_year_gaps_follow_the_corrected_date(spark):
    rows = spark.createDataFrame([("a", "2024-01-05"), ("a", "2024-02-29"), ("a", "2024-12-01"), ("a", "2025-03-01"), ("a", None), ("b", "2024-01-01"), ("b", "2024-01-01")], "k string, d string")
    got = [(r.k, r.position, r.fixed) for r in trends.fix_year_gaps(rows, "k", "d").orderBy("k", "position").collect()]
    day = datetime.date
    assert got == [("a", 0, day(2023, 12, 1)), ("a", 1, day(2024, 1, 5)), ("a", 2, day(2024, 2, 29)), ("a", 3, day(2024, 3, 1)), ("b", 0, day(2024, 1, 1)), ("b", 1, day(2024, 1, 1))]


def _boxes(spark, *placed):
    rows = [("s", page, k, [(x, y - 4.0), (x + 30, y - 4.0), (x + 30, y + 4.0), (x, y + 4.0)], text) for k, (page, text, x, y) in enumerate(placed)]
    return spark.createDataFrame(rows, "statement string, page int, box_no int, bbox array<struct<x: double, y: double>>, text string")


def test_box_rows_take_the_nearest_date_and_carry_sections(spark):
    boxes = _boxes(
        spark, (1, "01/01", 10.0, 20.0), (1, "EARLY", 100.0, 20.0), (1, "1.00", 500.0, 20.0), (1, "DEPOSITS & CREDITS", 300.0, 60.0), (1, "01/05", 10.0, 100.0), (1, "SALE", 100.0, 110.0), (1, "12.00", 500.0, 95.0),
        (1, "01/06", 10.0, 140.0), (1, "between", 100.0, 120.0), (1, "8.00", 510.0, 141.0), (1, "9.00", 500.0, 141.0), (1, "far", 100.0, 200.0), (1, "  ", 100.0, 141.0), (1, "WITHDRAWALS", 10.0, 300.0),
        (2, "01/07", 10.0, 50.0), (2, "RENT", 90.0, 73.0), (2, "$77.00", 500.0, 50.0), (2, "02/02", 400.0, 50.0), (3, "01/08", 10.0, 50.0), (3, "Total Withdrawals 5.00", 90.0, 50.0), (3, "01/09", 10.0, 90.0), (3, "no amount", 90.0, 90.0),
    )
    got = [tuple(r)[1:] for r in geometry.box_rows(boxes).orderBy("page", "row_no").collect()]
    assert got == [(1, 1, "01/05", "SALE between", 0.0, 12.0, "Credit"), (1, 2, "01/06", "9.00", 0.0, 8.0, "Credit"), (2, 1, "01/07", "RENT 02/02 $", 77.0, 0.0, "Debit")]


def test_pages_without_dates_still_carry_their_last_header(spark):
    boxes = _boxes(spark, (1, "FEES", 10.0, 10.0), (2, "DEPOSITS", 10.0, 90.0), (2, "WITHDRAWALS", 10.0, 50.0), (3, "01/07", 10.0, 50.0), (3, "5.00", 90.0, 50.0))
    assert [(r.Debit, r.Credit) for r in geometry.box_rows(boxes).collect()] == [(0.0, 5.0)]
    assert geometry.box_rows(boxes.filter("false")).count() == 0
