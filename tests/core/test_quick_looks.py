"""Quick looks that spare slow searches: they must let through whatever the search would find, and little else."""

import re

import pytest
from pyspark.sql import functions as F
from tallyloom.functions import lexicon as L
from tallyloom.functions.money import plausible_balance, plausible_balances
from tallyloom.functions.text import any_of, has_words, words_of
from tallyloom.operators import lines, summary


@pytest.mark.parametrize("pattern, words", [
    (r"(\d+)\s+Deposits/Credits\s+([\d,]+\.\d{2})", [["Deposits", "Credits"]]), (r"Service\s+Fees?\s+\$?x{0,2}", [["Service", "Fee"]]), (r"\bRBC\b|ROYAL\s+BANK|(?=.*A(?:B|C))", [["RBC"], ["ROYAL", "BANK"], []]),
    (r"Total\s+(?:Debits?\s*/?|)Credits?.*?\+?", [["Credit", "Total"]]), (r"total\s+des\s+d[ée]p[oô]ts*", [["total", "des"]]), (r"(?:Withdrawals|Checks)\s*/?\s*Debits", [["Debits"]]),
])
def test_words_that_a_match_holds(pattern, words):
    assert words_of(pattern) == words


def test_summaries_search_for_labels_whose_words_are_there(spark):
    held = spark.createDataFrame([("2 DEPOSITS/CREDITS 5.00",), ("deposits only",), ("",), (None,)], "line string")
    looked = held.select(has_words(F.lower("line"), F.from_json(F.lit('[["credits", "deposits"]]'), "array<array<string>>")).alias("x"))
    assert [r.x for r in looked.collect()] == [True, False, False, None]
    line = "PNC x 3 Credit(s) This Period $5.00 and 2 debit(S)  this period 6.00 Totals 7.00 8.00 Service Fees $1.00 Total des dépôts + 9,00 Total de depósitos 4,00"
    got = spark.createDataFrame([(line,)], "line string").select(summary.generic_summary(F.col("line")).alias("s")).first().s
    assert tuple(got) == (9.0, 8.0, 0, 0)


@pytest.mark.parametrize("words", [L.DEBIT_SECTION_WORDS, L.CREDIT_SECTION_WORDS, L.SKIP_LINE_KEYWORDS, L.CHECKING_SECTION_KEYWORDS, ["A", "A", "BA"]])
def test_words_within_others_are_looked_for_once(spark, words):
    texts = [f"x{w}y" for w in words] + [w[:-1] for w in words] + ["", "none"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = any_of(F.col("t"), words)
    assert [r.x for r in rows.select(found.alias("x")).collect()] == [any(w in t for w in words) for t in texts]
    longer = [w for w in words if any(x in w and x != w for x in words)]
    assert not any(re.search(rf"[\"|_, ]{re.escape(w)}[|\"),]", str(found)) for w in longer if w.isalpha())


def test_a_column_is_computed_once_for_a_filter_and_its_readers(spark):
    rows = lines.once(spark.range(3).selectExpr("cast(id as string) t"), "found", F.regexp_extract_all("t", F.lit("([12])"), F.lit(1))).filter(F.size("found") > 0).select("t", F.element_at("found", -1).alias("a")).filter("a > 1")
    assert rows.collect() == [("2", "2")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_balances_of_an_array_are_those_of_its_texts(spark):
    texts = ["1,234.50", "(7.25)", "99999999.00", "x", None, "-3"]
    one = [r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select(plausible_balance(F.col("t")).alias("b")).collect()]
    assert spark.createDataFrame([(texts,)], "t array<string>").select(plausible_balances(F.col("t")).alias("b")).first().b == [b for b in one if b is not None]


def test_totals_read_no_dates_or_charges(spark):
    from tallyloom.plans.statements import process

    out = process(spark.createDataFrame([("a", "DEPOSITS AND ADDITIONS\n01/02 SALE 5.00")], "statement string, text string"), F.lit(2024))
    plan = {k: out[k]._jdf.queryExecution().optimizedPlan().toString() for k in ("totals", "metrics")}
    assert "CHECKS AND CHARGES" in plan["metrics"] and "CHECKS AND CHARGES" not in plan["totals"]
    assert out["totals"].first().credits == 5.0
