"""Queries beside their SQL, on rows that the sample tables seldom or never hold."""

import datetime
import os
import re
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.operators import balance, metrics, summary

DAY = datetime.datetime(2024, 1, 5)
ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


@pytest.fixture
def agree(spark, tmp_path):
    """Whether a query and its SQL give the same rows, of tables given as (rows, schema) by name."""

    def check(query, **tables):
        db = duckdb.connect()
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
            db.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
        got = entry.queries()[query](spark, os.fspath(tmp_path))
        want = db.execute(f"SELECT {', '.join(f'\"{c}\"' for c in got.columns)} FROM ({entry.oracle_sql()[query]})").fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(want) and want

    return check


@pytest.mark.parametrize("query", ["q_lenient_amount", "q_money_parse"])
def test_half_thousands_go_to_the_even_one(agree, query):
    agree(query, orders=([(k, 1, "F", price, DAY, "x") for k in (1, 8) for price in (198500.0, 199500.0, 1200.5)], ORDER))


@pytest.mark.parametrize("query", ["q_lenient_amount", "q_money_parse"])
def test_prices_of_half_cents_are_cut_as_by_the_sql(agree, query):
    prices = (143755.925, 1.005, 8.575, 0.125, 0.375, -0.125, -1.005, 1000000.125, 0.004, -0.004, 99.994999, 1e9 + 0.005)
    agree(query, orders=([(42 * n + k, 1, "F", price, DAY, "x") for n, price in enumerate(prices) for k in range(42)], ORDER))


def test_monthly_obligations_of_half_cents_are_those_of_the_sql(agree):
    events = [(24 * k, DAY, k, "purchase", value) for k, value in enumerate((67.5, 15.5, 2.5, 1.5, 100.0, 33.5, 0.5))]
    agree("q_lender_monthly", events=(events, "event_id long, ts timestamp, user_id long, event_type string, value double"))


def test_words_below_a_long_order_join_none_of_its_rows(agree):
    items = [(1, 10 + k, k, 100.0 + k, DAY) for k in range(1, 31)] + [(2, 5, 1, 7.0, DAY)]
    agree("q_box_rows", lineitem=(items, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp"))


def test_rows_of_no_amount_give_nothing(agree):
    events = [(k, DAY, 1, kind, value) for k, (kind, value) in enumerate((("purchase", 5.0), ("view", 0.0), ("click", 0.0), ("view", 3.0), ("view", 0.004)))]
    agree("q_capital_one_rows", events=(events, "event_id long, ts timestamp, user_id long, event_type string, value double"))


def test_forms_are_shuffled_once_and_only_the_labels_are_joined(spark, agree, tmp_path):
    agree("q_application_forms", customer=([(k, f"Name {k}", 5.0 * k) for k in range(1, 40)], "c_custkey long, c_name string, c_acctbal double"))
    plan = entry.queries()["q_application_forms"](spark, os.fspath(tmp_path))._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan")[0]
    assert plan.count("Join") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_summaries_of_few_texts_are_many_tasks(spark):
    texts = spark.createDataFrame([(k, "Chase\nDeposits and Additions 9.00") for k in range(50)], "statement long, text string").coalesce(1)
    assert summary.route(texts).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("query", ["q_bank_summaries", "q_router_priority"])
def test_a_file_of_customers_is_work_for_all_cores(spark, agree, tmp_path, query):
    agree(query, customer=([(k, 5.0 * k) for k in range(1, 40)], "c_custkey long, c_acctbal double"))
    assert entry.queries()[query](spark, os.fspath(tmp_path)).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_texts_are_counted_by_all_cores(spark):
    texts = spark.createDataFrame([("a", "Chase\nDeposits and Additions 2 9.00")], "statement string, text string")
    rows = spark.createDataFrame([("a", "01/02", "x", 1.0, 0.0)], "statement string, Date string, Description string, Debit double, Credit double")
    assert "RepartitionByExpression" in metrics.transaction_counts(texts, rows)._jdf.queryExecution().optimizedPlan().toString()


ITEM = "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp, l_quantity double"
ITEMS = [(k, 10 * k + n, n, 1234.5 + k + n, DAY, float(5 * n)) for k in range(1, 20) for n in range(1, 6)]


@pytest.fixture
def physical(spark, tmp_path):
    """The physical plan of a query on the tables of `agree`."""
    return lambda query: entry.queries()[query](spark, os.fspath(tmp_path))._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan")[0]


def test_checks_and_other_rows_are_read_in_one_pass(agree, physical):
    agree("q_check_row_explode", lineitem=(ITEMS, ITEM))
    plan = physical("q_check_row_explode")
    assert "Union" not in plan and len(re.findall(r"\bWindow \[", plan)) == 2


def test_sections_of_equal_rows_are_told_once_without_sets_of_rows(agree, physical):
    agree("q_asof_section", lineitem=([*ITEMS, *ITEMS[:7]], ITEM), orders=([(k, 1, "F", 1.0, DAY, "x") for k in range(1, 15)], ORDER))
    assert "Aggregate" not in physical("q_asof_section")


def test_words_of_columns_are_grouped_once(agree, physical):
    agree("q_columnar_rows", lineitem=(ITEMS, ITEM))
    assert "Join" not in physical("q_columnar_rows")


def test_amounts_of_labels_that_a_text_lacks_are_not_searched_for(spark):
    texts = spark.createDataFrame([(1, "Credit Union\n5 Credit(s) This Period 7.00\n6 Debit(s) This Period 8.00"), (2, "x")], "statement long, text string")
    routed = summary.route(texts)
    assert {tuple(r) for r in routed.collect()} == {(1, "generic", 7.0, 8.0, 5, 6), (2, None, 0.0, 0.0, 0, 0)}
    assert re.search(r"CASE WHEN \(size\(.{0,60}> 0\) THEN zip_with", routed._jdf.queryExecution().optimizedPlan().toString())


def test_means_at_half_cents_are_of_exact_sums(spark):
    means = spark.sql("SELECT transform(sequence(1, 400), k -> array(0.1D * k, 0.2D, 0.3D, round(0.1D * k, 1), 7.7D, 0.15D + 0.01D * k, 1.01D, 2.2D)) AS v").selectExpr("inline(transform(v, x -> struct(transform(x, y -> round(y, 2)) AS v)))")
    for values, mean in means.select("v", balance.mean(F.col("v")).alias("m")).collect():
        assert mean == float(sum(Decimal(str(x)) for x in values)) / len(values)
