"""Catalogue: whole statements, from their text to metrics and totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import catalogue_sql as S
from . import queries_lines
from .functions import lexicon as L
from .operators import geometry, metrics, rollup, summary
from .operators.lines import to_lines
from .plans.statements import process
from .queries import _short_sql, query
from .sources.adapters import load, statement_lines

_YEAR = 2024
_TAIL = "\nItems returned unpaid\n01/02 A\n01/03 B\n\nend"


def _texts(spark, d):
    """A text a statement: its lines, before them a printed average if its name has an even length, after them two returned items."""
    body = statement_lines(spark, d).groupBy("statement").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.when(F.length("statement") % 2 == 0, "Average Daily Balance $1,234.50\n").otherwise("")
    return body.select("statement", F.concat(head, "body", F.lit(_TAIL)).alias("text"))


_RAW = f"""m AS (SELECT *, CASE WHEN {S.contains_any('upper(line)', L.DEBIT_SECTION_WORDS)} THEN 'Debit' WHEN {S.contains_any('upper(line)', L.CREDIT_SECTION_WORDS)} THEN 'Credit' END AS mark FROM (SELECT statement, line_no, row_no, {_short_sql('line')} AS line FROM lines)),
    c AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY statement ORDER BY line_no) AS section FROM m), a AS (SELECT *, {queries_lines._AMOUNT} AS a FROM c WHERE row_no >= 0 AND NOT {S.contains_any('upper(line)', L.SKIP_LINE_KEYWORDS)} AND {queries_lines._AMOUNT} > 0),
    ledger AS (SELECT statement, line_no AS row_no, make_date({_YEAR}, "Date"[1:2]::INT, "Date"[4:5]::INT) AS date, "Description" AS description, CASE WHEN section = 'Debit' THEN a ELSE 0 END::DOUBLE AS debit, CASE WHEN section = 'Debit' THEN 0 ELSE a END::DOUBLE AS credit FROM (SELECT *, {queries_lines._SPLIT} FROM a))"""
_COLUMNS = "credits, debits, cash_flow, lender_debits, lender_credits, true_revenue, withholding_rate"
_PROCESSED = (
    S.upto(S.METRICS).replace(S.LEDGER, S.LEDGER.replace("ledger AS (", "source AS (", 1) + ", " + queries_lines._LINES.replace("FROM ledger)", "FROM source)") + ", " + _RAW)
    + f""", processed AS (SELECT statement, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _COLUMNS.split(', '))}, greatest(coalesce(nsf_count, 0), 2) AS nsf_count, coalesce(loan_count, 0) AS loan_count, coalesce(pos_count, 0) AS pos_count,
    CASE WHEN length(statement) % 2 = 0 THEN 1234.5 ELSE listed END::DOUBLE AS avg_daily_balance FROM (SELECT statement, round(avg(TRY_CAST({queries_lines._AMOUNT.removesuffix('::DOUBLE')} AS DOUBLE)) FILTER (row_no >= 0), 2) AS listed FROM lines GROUP BY statement) LEFT JOIN metrics USING (statement))"""
)
_SUMS = ", ".join(f"{S.total(c)} AS {c}" if not c.endswith("count") else f"sum({c})::BIGINT AS {c}" for c in rollup.SUMMED)
_TOTALS = _PROCESSED + f""", t AS (SELECT count(*) AS statements, {_SUMS}, round(avg(avg_daily_balance), 2) AS avg_daily_balance FROM processed), totals AS (SELECT *, CASE WHEN true_revenue > 0 THEN round(lender_debits / true_revenue * 100, 4) ELSE 0 END AS withholding_rate FROM t)"""


@query(_PROCESSED + f"SELECT statement, {_COLUMNS}, nsf_count, loan_count, pos_count, avg_daily_balance FROM processed")
def q_process_metrics(spark, d):
    return process(_texts(spark, d), F.lit(_YEAR))["metrics"].select("statement", *_COLUMNS.split(", "), "nsf_count", "loan_count", "pos_count", "avg_daily_balance")


@query(_TOTALS + "SELECT * FROM totals")
def q_process_totals(spark, d):
    return process(_texts(spark, d), F.lit(_YEAR))["totals"]


@query("""WITH k AS (SELECT c_custkey AS statement, c_custkey % 5 AS k, c_custkey % 7 AS n FROM customer), o AS (SELECT DISTINCT o_custkey, strftime(o_orderdate, '%m/%d') AS day, upper(o_orderpriority) AS text, o_orderstatus = 'F' AS credit, round(o_totalprice, 2) AS amount FROM orders),
    r AS (SELECT o_custkey AS statement, count(*) FILTER (credit) AS c, count(*) FILTER (NOT credit) AS d FROM o WHERE amount > 0 GROUP BY 1)
    SELECT statement, (CASE k WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN n ELSE coalesce(c, 0) END)::BIGINT AS credit_count, (CASE k WHEN 0 THEN n + 2 WHEN 1 THEN n + 2 WHEN 2 THEN n + 4 WHEN 3 THEN n + 1 ELSE coalesce(d, 0) END)::BIGINT AS debit_count,
    (CASE k WHEN 0 THEN n + 7 WHEN 1 THEN n + 6 WHEN 2 THEN n + 8 WHEN 3 THEN 2 * n + 1 ELSE coalesce(c, 0) + coalesce(d, 0) END)::BIGINT AS total_count FROM k LEFT JOIN r USING (statement)""")
def q_transaction_counts(spark, d):
    k, n = F.col("c_custkey") % 5, (F.col("c_custkey") % 7).cast("int")
    number = n.cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("# of deposits/credits: 5\n# of withdrawals/debits: "), number, F.lit("\nTotal # of checks 2")))
        .when(k == 1, F.concat(F.lit("JPMorgan\nDeposits and Additions 4 100.00\nChecks Paid 2 -5.00\nFees "), number, F.lit(" 3.00")))
        .when(k == 2, F.concat(F.lit("TD BANK\nDeposits\n01/02 DEPOSIT 10.00\nElectronic Deposits\n01/03 A\n  MORE 5.00\n01/04 B 6.00\nOther Credits\n01/05 C 7.00\nChecks Paid No. Checks: 3\nElectronic Payments\n"), F.repeat(F.lit("01/06 P 1.00\n"), n), F.lit("Other Withdrawals\n01/08 W 8.00\nSubtotal: 8.00\nService Charges\n01/09 FEE 9.00\nDAILY BALANCE")))
        .when(k == 3, F.concat(F.lit("WELLS FARGO\n01/01 Deposit before 1.00\nTransaction history\n"), F.repeat(F.lit("01/05 PURCHASE RETURN 3.00\n"), n), F.lit("01/06 Zelle to A\n 5.00\n01/07 Ending balance deposit 9.00")))
        .otherwise("Credit Union")
    )
    credit, amount = F.col("o_orderstatus") == "F", F.round("o_totalprice", 2)
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("statement"), F.date_format("o_orderdate", "MM/dd").alias("Date"), F.lower("o_orderpriority").alias("Description"), F.when(credit, 0.0).otherwise(amount).alias("Debit"), F.when(credit, amount).otherwise(0.0).alias("Credit"))
    return metrics.transaction_counts(load(spark, d, "customer").select(F.col("c_custkey").alias("statement"), text.alias("text")), rows)


@query("""SELECT c_custkey AS statement, CASE k WHEN 0 THEN 20.0 WHEN 1 THEN 68770.44 ELSE 12.0 END::DOUBLE AS credits_amount, CASE k WHEN 0 THEN 1234.56 WHEN 1 THEN 7.0 ELSE 15.5 END::DOUBLE AS debits_amount,
    CASE k WHEN 0 THEN 3 WHEN 1 THEN 44 ELSE 0 END::INT AS credit_count, CASE k WHEN 0 THEN n WHEN 1 THEN n ELSE 0 END::INT AS debit_count FROM (SELECT c_custkey, c_custkey % 3 AS k, c_custkey % 9 AS n FROM customer)""")
def q_line_scan(spark, d):
    k, n = F.col("c_custkey") % 3, (F.col("c_custkey") % 9).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("2 Deposits/Credits 10.00\n3  Deposits/Credits 20.00 99.00\n"), n, F.lit(" C h e c k s/Debits 1,234.56\nno amount Deposits/Credits")))
        .when(k == 1, F.concat(F.lit("Total deposits & credits (44) + 68,770.44\nTotal cheques & debits ("), n, F.lit(") - 7.00")))
        .otherwise("Electronic Deposits 5.00\nDeposits 7.00\nChecks Paid 10.00\nElectronic Payments 5.50\nChecks Paid No. 4 3.00\nSubtotal Deposits 1.00")
    )
    text = F.regexp_replace(text, "C h e c k s", "Checks")
    return summary.line_scan(to_lines(load(spark, d, "customer").select(F.col("c_custkey").alias("statement"), text.alias("text"))))


@query("""SELECT l_orderkey AS statement, strftime(l_shipdate, '%m/%d') AS "Date", 'part ' || l_partkey AS "Description", CASE WHEN l_partkey % 2 = 0 THEN a ELSE 0 END::DOUBLE AS debit, CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE a END::DOUBLE AS credit, 77.25::DOUBLE AS balance
    FROM (SELECT *, l_extendedprice::DECIMAL(18,2)::DOUBLE AS a FROM lineitem) WHERE l_orderkey % 3 > 0""")
def q_columnar_rows(spark, d):
    items = load(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    page = lambda rows, words: rows.select(F.col("l_orderkey").alias("statement"), F.lit(0).alias("page"), F.lit(800.0).alias("height"), F.inline(F.array(*words)))
    word = lambda no, text, x, top: F.struct(no.cast("long").alias("word_no"), text.alias("text"), F.lit(x).alias("x0") if isinstance(x, float) else x.alias("x0"), (x + 40.0 if not isinstance(x, float) else F.lit(x + 40)).alias("x1"), top.cast("double").alias("top"))
    # every third page says nothing of withdrawals
    heads = page(items.select("l_orderkey").distinct(), [word(F.lit(0), F.lit("Deposits"), 300.0, F.lit(100)), word(F.lit(1), F.when(F.col("l_orderkey") % 3 > 0, "Withdrawals").otherwise("Date"), 400.0, F.lit(100))])
    no, top = F.col("n") * 10, 150 + 12 * F.col("n")
    side = F.when(F.col("l_partkey") % 2 == 0, 405.0).otherwise(305.0)
    body = page(items, [word(no, F.date_format("l_shipdate", "MM/dd"), 10.0, top), word(no + 1, F.lit("part"), 60.0, top), word(no + 2, F.col("l_partkey").cast("string"), 90.0, top), word(no + 3, F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)), side, top), word(no + 4, F.lit("77.25"), 500.0, top)])
    rows = geometry.columnar_rows(heads.unionByName(body))
    return rows.select("statement", "Date", "Description", F.col("Debit").alias("debit"), F.col("Credit").alias("credit"), F.col("Balance").alias("balance"))
