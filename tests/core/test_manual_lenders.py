from tallyloom.operators.rollup import with_manual


def test_rows_added_and_taken_back(spark):
    totalled = spark.createDataFrame([(1000.0, 50.0, 100.0, 900.0, 5.5556)], "credits double, lender_debits double, lender_credits double, true_revenue double, withholding_rate double")
    picked = spark.createDataFrame([("debit", 40.0), ("debit", -5.0), ("credit", 200.0), ("debit", None)], "type string, amount double")
    added = with_manual(totalled, picked)
    assert tuple(added.first()) == (1000.0, 90.0, 300.0, 700.0, 12.8571)
    assert tuple(with_manual(added, picked, removed=True).first()) == tuple(totalled.first())
    assert tuple(with_manual(totalled, picked, removed=True).first()) == (1000.0, 10.0, 0.0, 1000.0, 1.0)
    assert tuple(with_manual(totalled, picked.limit(0)).first()) == tuple(totalled.first())
