import os

from pyspark.sql import functions as F

from tallyloom.operators.metrics import transaction_counts
from tallyloom.plans.statements import process
from tallyloom.sources.files import save_keywords, saved_keywords
from tallyloom.streaming.drops import daily_sums, ledger_stream


def test_statements_without_rows_stay(spark):
    """A text without rows is a statement; returned items and printed totals in the text count; lenders are found in rows whose
    date can't be resolved; pages with columns stand in for a text without credits."""
    texts = [
        ("a", "01/05/2024 COFFEE SHOP 12.50\n01/06/2024 DEPOSIT 100.00\n"), ("b", "nothing here"), ("c", "Items returned unpaid\n01/02 CHECK\n01/03 CHECK\n\nend"),
        ("d", "WELLS FARGO\n7 Deposits/Credits $5,000.00\n9 Checks/Debits 700.00"), ("e", "ELECTRONIC WITHDRAWALS\n13/45 KAPITUS ACH DEBIT 50.00\n"), ("f", "CHECKING SUMMARY"),
    ]
    words = [("Deposits", 300.0, 50.0), ("Withdrawals", 400.0, 50.0), ("01/09", 10.0, 200.0), ("SALE", 60.0, 201.0), ("31.00", 305.0, 200.0), ("99.00", 500.0, 200.0)]
    words = spark.createDataFrame([("f", 0, 800.0, k, w, x, x + 30, y) for k, (w, x, y) in enumerate(words)], "statement string, page int, height double, word_no int, text string, x0 double, x1 double, top double")
    got = process(spark.createDataFrame(texts, "statement string, text string"), F.lit(2024), words)
    rows = {r.statement: r for r in got["metrics"].collect()}
    assert set(rows) == set("abcdef") and rows["b"].credits == rows["b"].debits == rows["b"].true_revenue == 0
    assert rows["c"].nsf_count == 2 and rows["b"].nsf_count == 0
    assert (rows["d"].credits, rows["d"].debits) == (5000, 700)
    assert rows["e"].debits == 50 and rows["e"].lender_debits > 0
    assert (rows["f"].credits, rows["f"].avg_daily_balance) == (31, 99)
    assert {r.statement for r in got["ledger"].collect()} == {"a", "f"}


def test_transaction_counts(spark):
    texts = spark.createDataFrame([("a", "Chase\nDeposits and Additions 2 9.00"), ("b", "TD BANK\nChecks Paid\n01/02 11 5.00 01/03 12* 6.00\nSubtotal: 11.00"), ("c", "x"), ("d", None)], "statement string, text string")
    rows = spark.createDataFrame([("c", "01/02", "Shop", 1.0, 0.0), ("c", "01/02", "shop ", 1.0, 0.0), ("c", "total", "shop", 1.0, 0.0), ("c", "01/03", "", 0.0, 2.0), ("a", "01/02", "x", 1.0, 0.0)], "statement string, Date string, Description string, Debit double, Credit double")
    got = {r.statement: (r.credit_count, r.debit_count, r.total_count) for r in transaction_counts(texts, rows).collect()}
    assert got == {"a": (2, 0, 2), "b": (0, 2, 2), "c": (0, 1, 1), "d": (0, 0, 0)}


def test_keywords_are_saved_over_the_file_they_are_read_from(spark, tmp_path):
    path = f"file://{tmp_path}/keywords"
    assert saved_keywords(spark, path).count() == 0
    save_keywords(spark.createDataFrame([("one", "debit")], "name string, type string"), path)
    for name in ("two", "three"):
        save_keywords(saved_keywords(spark, path).unionByName(spark.createDataFrame([(name, "credit")], "name string, type string")), path)
    assert sorted(r.name for r in saved_keywords(spark, path).collect()) == ["one", "three", "two"]
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["keywords"]
    versions = [f for f in os.listdir(tmp_path / "keywords") if f.startswith("version-")]
    assert len(versions) == 2 and (tmp_path / "keywords" / "CURRENT").read_text().strip() in versions


def test_a_reader_keeps_its_version_and_a_json_file_becomes_a_folder(spark, tmp_path):
    (tmp_path / "keywords").write_text('[{"name": "one", "type": "debit"},\n {"name": "two", "type": "credit"}]')
    path = f"file://{tmp_path}/keywords"
    before = saved_keywords(spark, path)
    save_keywords(before.filter("name = 'two'"), path)
    kept = saved_keywords(spark, path)
    save_keywords(kept.unionByName(spark.createDataFrame([("three", "debit")], "name string, type string")), path)
    assert [r.name for r in kept.collect()] == ["two"] and sorted(r.name for r in saved_keywords(spark, path).collect()) == ["three", "two"]
    (tmp_path / "broken").write_text("{not json")
    assert saved_keywords(spark, f"file://{tmp_path}/broken").count() == 0
    assert sorted(f for f in os.listdir(tmp_path) if not f.startswith(".")) == ["broken", "keywords"]


def test_dropped_files(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    (tmp_path / "in" / "a.csv").write_text("statement,row_no,Date,Description,Debit,Credit,Amount,Balance,Section,Raw Line\n" + "".join(f"s,{k},2024-01-05,shop,0.1,,,,,\n" for k in range(10)))
    schema = "statement string, row_no int, Date string, Description string, Debit string, Credit string, Amount string, Balance string, Section string, `Raw Line` string"
    query = daily_sums(ledger_stream(spark, f"file://{tmp_path}/in", schema)).writeStream.format("memory").queryName("dropped").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    row = spark.table("dropped").first()
    assert row.rows == 10 and row.debits == 1.0
