import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import application, balance, summary, trends
from tallyloom.plans import exports


def odd(spark):
    return spark.createDataFrame([("a", float("nan"), 1, "2024-01-05 10:00:00"), (None, float("-inf"), None, None), ('say "x",\nthen', 2.5, 3, "2024-02-29 00:00:00")], "name string, amount double, n int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))


def test_json_holds_no_values_that_json_lacks(spark):
    got = [json.loads(r.json) for r in exports.to_json(odd(spark)).collect()]
    assert got == [{"name": "a", "amount": None, "n": 1, "t": "2024-01-05T10:00:00"}, {"name": None, "amount": None, "n": None, "t": None}, {"name": 'say "x",\nthen', "amount": 2.5, "n": 3, "t": "2024-02-29T00:00:00"}]
    assert exports.to_json(odd(spark).limit(0)).count() == 0


def test_csv_reads_back_as_it_was_shown(spark, tmp_path):
    table = exports.shown(odd(spark).filter("name = 'a' OR n = 3"), ["t", "missing", "name", "n"])
    assert table.dtypes == [("t", "string"), ("name", "string"), ("n", "int")]
    exports.write_csv(table.coalesce(1), f"file://{tmp_path}/out")
    exports.write_csv(table.coalesce(1), f"file://{tmp_path}/out")  # over the first
    (path,) = glob.glob(f"{tmp_path}/out/*.csv")
    with open(path, newline="") as f:
        rows = [*csv.reader(f, escapechar="\\", doublequote=False)]
    assert rows == [["t", "name", "n"], ["2024-01-05 10:00:00", "a", "1"], ["2024-02-29 00:00:00", 'say "x",\nthen', "3"]]


@pytest.mark.parametrize(
    ("rule", "pairs"),
    [
        (application.ssn, {"123-45 6789": "123-45-6789", "12345": None, None: None}), (application.ein, {"12 3456789": "12-3456789", "12-34": "12-34", "": None}),
        (application.form_date, {"3/1999": "03-01-1999", "7-4-69": "07-04-1969", "7/4/05": "07-04-2005", "13/45/2000": "13/45/2000", "soon": "soon", " ": None}),
        (application.money, {"$1,200.50": "1200.50", "": None}), (application.percent, {"50": "50%", "50%": "50%", " ": None}),
        (application.entity, {"LLC X Other (please describe): a trust": "a trust", "X LLC": "LLC", "Corp: Inc: Other: Farm": "Farm", "": None}),
        (application.phone, {"1 (555) 123-4567": "(555) 123-4567", "555": "555"}), (application.state, {"ny": "NY", "New  York": None, "new york": "NY", "ZZ": None}),
    ],
)
def test_form_values(spark, rule, pairs):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(pairs)], "k int, v string").select("k", rule(F.col("v")).alias("x")).collect()
    assert [r.x for r in sorted(rows)] == [*pairs.values()]


def test_forms_of_one_largest_table(spark):
    cells = [("f", 1, 0, r, 0, "Business Legal Name: late") for r in range(9)] + [("f", 0, 0, 0, 0, "Business Legal Name: small"), ("f", 0, 1, 0, 0, "Business Legal Name: A"), ("f", 0, 1, 1, 0, "x"), ("f", 0, 2, 0, 0, "Business Legal Name: tie"), ("f", 0, 2, 1, 0, None)]
    table = application.largest_table(spark.createDataFrame(cells, "form string, page int, table_no int, row int, col int, text string"))
    assert [(r.field, r.value) for r in application.fields(table).collect()] == [("Business_Legal_Name", "A")]


def test_regions_between_headers(spark):
    text = F.lit("a DEPOSITS 1.00 total deposits 2.00 Withdrawals 3.00 WITHDRAWALS 4.00 FEES 5.00")
    cut = lambda *how: spark.range(1).select(summary.region(text, *how).alias("x")).first().x
    assert cut("DEPOSITS", "Total") == " 1.00 " and cut("FEES", "none") == " 5.00" and cut("WITHDRAWALS", "fees", "DEPOSITS") == " 4.00 " and cut("absent", "x") == ""


def test_labels_and_series(spark):
    row = spark.range(1).select(
        trends.full_dollars(F.lit(-1234.5)).alias("a"), trends.full_dollars(F.lit(None)).alias("b"), trends.shown(F.lit(12.25), "%").alias("c"), trends.shown(F.lit(-0.5)).alias("d"), trends.shown(F.lit(2.5)).alias("e"),
        trends.period_label(F.lit(None).cast("date"), F.lit("2024-01-01").cast("date"), F.lit("2024-03-09")).alias("f"), trends.period_label(F.lit(None).cast("date"), F.lit(None).cast("date"), F.lit(None)).alias("g"),
    ).first()
    assert tuple(row) == ("$-1,235", "$0", "12.3%", "0", "3", "2024-03", "—")
    series = spark.createDataFrame([("a", "2024-01", 10.0), ("a", "2024-02", 20.0), ("b", "2024-05", 7.0)], "k string, m string, v double")
    got = sorted(tuple(r) for r in trends.forecast_series(series, "k", "m", "v").select("k", "month", F.coalesce("revenue", F.lit(-1.0)), F.coalesce("forecast", F.lit(-1.0))).collect())
    assert got == [("a", "2024-01", 10.0, -1.0), ("a", "2024-02", 20.0, 20.0), ("a", "2024-03", -1.0, 30.0), ("b", "2024-05", 7.0, 7.0), ("b", "2024-06", -1.0, 7.0)]


def test_balances_of_torn_sections_and_lists(spark):
    texts = [
        ("torn", "*start*daily\n01/01 9.00\nDAILY ENDING BALANCE\n01/02 100.00 01/03 200.00\n*end*daily ending balance 1,500.00 3.00\n"), ("list", "01/02 x 5.00 7.00\n1-3 short\n01-03 another 9.00\n01/09 8"), ("none", "no balance"), ("null", None),
        ("tags only", "*end*daily ending balance 1,500.00"),
    ]
    got = {r.statement: (r.average, r.level) for r in balance.average_balance(spark.createDataFrame(texts, "statement string, text string")).collect()}
    assert got == {"torn": (600.0, 1), "list": (8.0, 3), "none": (None, None), "null": (None, None), "tags only": (1500.0, 1)}
