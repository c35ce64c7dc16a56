import pytest
from pyspark.sql import functions as F

from tallyloom.operators import lenders, risk, trends
from tallyloom.operators.summary import section_sum
from tallyloom.sources.adapters import load

SCHEMA = "statement string, row_no long, Date string, Description string, Debit double, Credit double, Amount double, Balance double, Section string, `Raw Line` string"


def rows(spark, texts, debit=700.0):
    return spark.createDataFrame([("s", i, f"2025-01-{6 + 7 * i:02d}", t, debit, 0.0, -debit, None, "", "") for i, t in enumerate(texts)], SCHEMA)


def test_detection(spark):
    texts = ["PARKING LOT 12", "ACH DEBIT ONDECK 55", "ONDECK 123", "CCDDEBIT,FORWARDFINANCIN", "COFFEE SHOP"]
    found = {r.Description: (r.lender, r.keyword) for r in lenders.detect(rows(spark, texts), "Description", lenders.dictionary(spark)).collect()}
    assert found == {"PARKING LOT 12": ("PAR FUNDING", "PAR"), "ACH DEBIT ONDECK 55": ("ONDECK", "ONDECK"), "ONDECK 123": ("ONDECK", "ON DECK"), "CCDDEBIT,FORWARDFINANCIN": ("FORWARD FINANCING", "FORWARDFINANCIN")}


@pytest.mark.parametrize(("text", "paid", "got"), [("KAPITUS ACH DEBIT", [700.0], []), ("KAPITUS FUNDING 12345", [], [700.0]), ("KAPITUS 12345678", [], [700.0]), ("KAPITUS REFERENCE # ACH DEBIT", [], [])])
def test_direction(spark, text, paid, got):
    found = lenders.with_lender(rows(spark, [text]))
    assert [r.amount for r in lenders.lender_debits(found).collect()] == paid
    assert [r.amount for r in lenders.lender_credits(found).collect()] == got


@pytest.mark.parametrize(
    ("days", "amounts", "frequency", "monthly"),
    [(["2025-01-06", "2025-01-13", "2025-01-20", "2025-01-27"], [500, 500, 700, 500], "weekly", 2165.0), (["2025-01-01", "2025-01-31"], [1000, 1000], "monthly", 2000.0), (["2025-01-06", "2025-01-07", "2025-01-08"], [100, 100, 100], "other", 300.0), (["2025-01-01"], [100], "weekly", 433.0), (["01/06", "01/07"], [100, 100], "weekly", 433.0)],
)
def test_obligation(spark, days, amounts, frequency, monthly):
    debits = spark.createDataFrame([("s", i, d, "L", float(a)) for i, (d, a) in enumerate(zip(days, amounts, strict=True))], "statement string, row_no long, Date string, lender string, amount double")
    row = lenders.lender_monthly(debits).first()
    assert (row.frequency, row.monthly) == (frequency, pytest.approx(monthly))


@pytest.mark.parametrize(("inputs", "want"), [((10000.0, 9000.0, 3, True), (100.0, "High Risk")), ((0.0, 0.0, 0, False), (30.0, "Medium Risk")), ((20000.0, 17000.0, 2, False), (0.0, "Low Risk"))])
def test_risk(spark, inputs, want):
    points = risk.score(*map(F.lit, inputs))
    assert tuple(spark.range(1).select(points, risk.level(points)).first()) == want


def test_keywords_of_any_length_are_found_as_parts(spark):
    texts = [f"PAY <K{i}> NOW" for i in range(10)] + ["é日本 x", "", "aa"]
    saved = spark.createDataFrame([(f"<k{i}>", "debit") for i in range(10)] + [("pay", "debit"), ("pay", "debit"), ("now", "credit"), ("W", "debit"), ("日本", "debit"), ("É日", "debit"), ("", "debit"), (None, "debit"), ("aaa", "debit")], "name string, type string")
    got = [(r.row_no, r.keyword, r.amount) for r in lenders.apply_saved_keywords(rows(spark, texts), saved).collect()]
    assert sorted(got) == sorted([(i, f"<k{i}>", 700.0) for i in range(10)] + [(i, "pay", 700.0) for i in range(10)] * 2 + [(i, "W", 700.0) for i in range(10)] + [(10, "日本", 700.0), (10, "É日", 700.0)])


def test_50_000_keywords_meet_the_ledger_by_equal_grams(spark):
    """The rows that looking for each keyword in each description gives, without a nested loop or a product of both."""
    words = [f"{a}{b}{c} {k}" for k, (a, b, c) in enumerate((a, b, c) for a in ("KAP", "ON", "FUND", "X") for b in ("ITUS", "DECK", "BOX", "") for c in range(3125))]
    saved = spark.createDataFrame([(w, "debit" if k % 2 else "credit") for k, w in enumerate(words)], "name string, type string")
    assert saved.count() == 50_000
    ledger = load(spark, "/root/testdata/sf0.1", "lineitem").select(F.col("l_orderkey").alias("statement"), F.col("l_linenumber").alias("row_no"), F.concat_ws(" ", F.lit("ach kapitus0"), F.col("l_partkey").cast("string")).alias("Description"), F.lit(1.0).alias("Debit"), F.lit(2.0).alias("Credit"))
    found = lenders.apply_saved_keywords(ledger, saved)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    listed = {w.lower() for w in words}
    want = 0
    for description, n in ledger.groupBy("Description").count().collect():
        want += n * len({description[i:j] for i in range(len(description)) for j in range(i + 1, len(description) + 1)} & listed)
    assert found.count() == want > 0


def test_many_lenders_are_one_dictionary(spark):
    names = {f"LENDER {k}": [f"ZQ{k} CAPITAL"] for k in range(20_000)}
    ledger = rows(spark, ["ACH ZQ77 CAPITAL 12", "ZQ19999CAPITAL", "ZQ20000 CAPITAL", "AZQ77 CAPITAL"])
    got = {(r.Description, r.lender) for r in lenders.detect(ledger, "Description", lenders.dictionary(spark, names)).collect()}
    assert got == {("ACH ZQ77 CAPITAL 12", "LENDER 77"), ("ZQ19999CAPITAL", "LENDER 19999")}


def test_section_sum_and_year_gaps(spark):
    got = spark.createDataFrame([("500.00 9.59 8509.59",), ("500.00 9.59",)], "t string").select(section_sum(F.col("t"))).collect()
    assert [r[0] for r in got] == [509.59, 509.59]
    dates = spark.createDataFrame([("k", d) for d in ("2024-01-01", "2024-12-01", "2025-03-01")], "k string, d string")
    assert [str(r.fixed)[:7] for r in trends.fix_year_gaps(dates, "k", "d").orderBy("position").collect()] == ["2023-12", "2024-01", "2024-03"]


def test_lenders_are_looked_for_only_in_rows_that_may_move(spark, monkeypatch):
    cases = [(700.0, 0.0, -700.0, "Credit"), (700.0, 0.0, -700.0, "Debit"), (0.0, 5.0, 5.0, "debit"), (0.0, 5.0, -5.0, None), (0.0, 5.0, 5.0, ""), (None, 5.0, -5.0, "")]
    made = [("s", 2 * k + n, "1/5", f"{name} {k}", d, c, a, None, s, "") for k, (d, c, a, s) in enumerate(cases) for n, name in enumerate(("KAPITUS", "COFFEE"))]
    searched, detect = [], lenders.detect
    monkeypatch.setattr(lenders, "detect", lambda texts, *rest: (searched.append(texts), detect(texts, *rest))[1])
    got = {r.row_no: (r.Debit, r.Credit, r.Amount) for r in lenders.repair_direction(spark.createDataFrame(made, SCHEMA)).collect()}
    stay = {2 * k + n: (d or 0.0, c, a) for k, (d, c, a, _) in enumerate(cases) for n in (0, 1)}
    assert got == stay | {0: (0.0, 700.0, 700.0), 4: (5.0, 0.0, -5.0), 6: (5.0, 0.0, -5.0), 10: (5.0, 0.0, -5.0)}
    assert {r.row_no // 2 for r in searched[0].collect()} == {0, 2, 3, 5}


def test_texts_without_a_prefix_are_tried_once(spark):
    found = lenders.detect(rows(spark, ["KAPITUS 1", "ACH DEBIT KAPITUS 2"]), "Description", lenders.dictionary(spark))
    assert {r.Description for r in found.collect()} == {"KAPITUS 1", "ACH DEBIT KAPITUS 2"}
    assert "filter(array(struct(variant" in found._jdf.queryExecution().optimizedPlan().toString()
