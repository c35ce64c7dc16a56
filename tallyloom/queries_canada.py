"""Catalogue: Canadian statements, labels and previews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import catalogue_sql as S
from .functions import lexicon as L
from .operators import canada, lenders, rollup, trends
from .queries import query
from .sources.adapters import ledger, load


@query(f"""WITH {S.LEDGER}, l AS (SELECT *, round(greatest(debit, credit) + 1, 2) AS amount, row_no % 4 = 0 AS fee FROM ledger),
    b AS (SELECT *, fee OR debit > 0 AS paid, 10000000 + sum((CASE WHEN fee OR debit > 0 THEN -amount ELSE amount END)::DECIMAL(18,2)) OVER (PARTITION BY statement ORDER BY row_no) AS balance FROM l)
    SELECT statement, row_no AS line_no, strftime(date, '%d %b') AS "Date", CASE WHEN fee THEN 'NSF item fee' ELSE description END AS "Description", CASE WHEN paid THEN amount ELSE 0 END AS "Debit", CASE WHEN paid THEN 0 ELSE amount END AS "Credit", CASE WHEN fee THEN 0 ELSE balance::DOUBLE END AS "Balance" FROM b""")
def q_rbc_text_rows(spark, d):
    fee = F.col("row_no") % 4 == 0
    amount = (F.greatest("Debit", "Credit") + 1).cast("decimal(18,2)")
    moved = F.when(fee | (F.col("Debit") > 0), -F.col("amount")).otherwise(F.col("amount"))
    rows = ledger(spark, d).withColumn("amount", amount)
    rows = rows.withColumn("balance", F.lit(10_000_000) + F.sum(moved).over(Window.partitionBy("statement").orderBy("row_no")))
    said = F.when(fee, F.concat_ws(" ", F.lit("NSF item fee"), F.format_number("amount", 2))).otherwise(F.concat_ws(" ", "Description", F.format_number("amount", 2), F.format_number("balance", 2)))
    lines = rows.select("statement", F.col("row_no").alias("line_no"), F.concat_ws(" ", F.date_format("Date", "dd MMM"), said).alias("line"))
    opening = rows.select("statement", F.lit(-1).cast("long").alias("line_no"), F.lit("Opening balance $10,000,000.00").alias("line")).distinct()
    return canada.rbc_text(lines.union(opening))


@query(f"""WITH {S.LEDGER}, l AS (SELECT *, round(greatest(debit, credit) + 1, 2) AS amount, '20' || statement[-5:-4] || strftime(date, '-%m-%d') AS day FROM ledger),
    t AS (SELECT statement, 1 AS page, row_no + 1 AS row_no, day, row_no % 10 = 0 AS two, row_no AS n, debit > 0 AS paid, amount FROM l WHERE row_no % 2 = 0),
    w AS (SELECT statement, 2 AS page, row_number() OVER (PARTITION BY statement ORDER BY row_no) AS row_no, day, row_no AS n, debit > 0 AS paid, amount FROM l WHERE row_no % 2 = 1)
    SELECT statement, page, row_no, 0 AS part, day AS "Date", CASE WHEN two THEN 'TFR-FR ' ELSE 'D' END || n AS "Description", 0.0::DOUBLE AS "Debit", amount AS "Credit" FROM t WHERE two OR NOT paid
    UNION ALL SELECT statement, page, row_no, 1, day, CASE WHEN two THEN 'TFR-TO ' ELSE 'D' END || n, amount, 0.0 FROM t WHERE two OR paid
    UNION ALL SELECT statement, page, row_no, 0, day, 'D' || n, CASE WHEN paid THEN amount ELSE 0 END, CASE WHEN paid THEN 0 ELSE amount END FROM w""")
def q_td_canada_rows(spark, d):
    amount = F.format_number((F.greatest("Debit", "Credit") + 1).cast("decimal(18,2)"), 2)
    rows = ledger(spark, d).select("statement", "row_no", "Date", (F.col("Debit") > 0).alias("paid"), amount.alias("amount"), (F.col("row_no") % 10 == 0).alias("two"))
    day, n = F.upper(F.date_format("Date", "MMMd")), F.col("row_no").cast("string")
    paid, got = F.when(F.col("paid") | F.col("two"), F.col("amount")).otherwise(""), F.when(~F.col("paid") | F.col("two"), F.col("amount")).otherwise("")
    row = F.array(F.when(F.col("two"), F.concat(F.lit("TFR-TO "), n, F.lit("\nTFR-FR "), n)).otherwise(F.concat(F.lit("D"), n)), paid, got, day, F.lit("1.00"))
    key = F.col("statement"), F.lit(1).alias("page"), F.lit(0).alias("table_no")
    body = rows.filter("row_no % 2 = 0").select(*key, (F.col("row_no") + 1).alias("row"), F.posexplode(row).alias("col", "text"))
    statements = rows.select("statement").distinct()
    names = F.array(*map(F.lit, ("Description", "Cheque/Debit", "Deposit/Credit", "Date", "Balance")))
    cells = body.union(statements.select(*key, F.lit(0).cast("long").alias("row"), F.posexplode(names).alias("col", "text")))
    at = lambda text, x: F.struct(text.alias("text"), x.alias("x0"), (x + 20).alias("x1"))
    words = F.array(at(F.concat(F.lit("D"), n), F.lit(10.0)), at(F.col("amount"), F.when(F.col("paid"), 190.0).otherwise(290.0)), at(day, F.lit(380.0)), at(F.lit("1.00"), F.lit(450.0)))
    body = rows.filter("row_no % 2 = 1").select("statement", F.lit(2).alias("page"), (100.0 + 10 * F.col("row_no")).alias("top"), F.inline(words))
    head = F.array(*[at(F.lit(t), F.lit(x)) for t, x in (("DESCRIPTION", 10.0), ("CHEQUE/DEBIT", 190.0), ("DEPOSIT/CREDIT", 290.0), ("DATE", 380.0), ("BALANCE", 450.0))])
    words = body.union(statements.select("statement", F.lit(2).alias("page"), F.lit(50.0).alias("top"), F.inline(head)))
    pages = statements.select("statement", F.lit(1).alias("page"), F.concat(F.lit("JAN 01/"), F.substring("statement", -5, 2), F.lit(" - JAN 31")).alias("text"))
    return canada.td_canada(pages, cells, words, F.lit(2000))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%b ''%y') ELSE ('f' || o_orderkey || '.statement')[:10] END AS label FROM orders")
def q_month_label(spark, d):
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return load(spark, d, "orders").select("o_orderkey", trends.month_label(day, F.concat(F.lit("f"), "o_orderkey", F.lit(".statement.pdf"))).alias("label"))


@query("""SELECT c_custkey, '$' || CASE WHEN abs(v) >= 1000000 THEN format('{:.1f}', round(v / 1000000, 1)) || 'M' WHEN abs(v) >= 1000 THEN round(v / 1000)::BIGINT || 'k' WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END AS label
    FROM (SELECT c_custkey, c_acctbal * CASE WHEN c_custkey % 2 = 0 THEN 1000 ELSE 1 END AS v FROM customer)""")
def q_short_dollars(spark, d):
    value = F.col("c_acctbal") * F.when(F.col("c_custkey") % 2 == 0, 1000).otherwise(1)
    return load(spark, d, "customer").select("c_custkey", trends.short_dollars(value).alias("label"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'rep ' || c_nationkey ELSE 'unknown' END AS rep FROM customer")
def q_sales_rep(spark, d):
    k = F.col("c_custkey") % 3
    client = F.when(k == 0, F.concat(F.lit(" rep "), "c_nationkey", F.lit(" - 5-6"))).when(k == 1, F.lit(" -7"))
    return load(spark, d, "customer").select("c_custkey", trends.sales_rep(client).alias("rep"))


@query("SELECT year(o_orderdate + INTERVAL 8 YEAR)::INT AS year FROM orders GROUP BY 1 ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1")
def q_usual_year(spark, d):
    name = F.concat(F.lit("Statement "), F.date_format(F.add_months("o_orderdate", 96), "yyyy-MM"), F.lit(".pdf"))
    return trends.usual_year(load(spark, d, "orders").select(F.col("o_orderkey").alias("position"), name.alias("filename")), F.lit(1999))


@query(S.upto(S.METRICS) + "SELECT statement, strftime((statement[-7:] || '-01')::DATE, '%b %Y') AS label, credits, debits, lender_debits, cash_flow FROM metrics")
def q_month_bars(spark, d):
    metrics = rollup.statement_metrics(ledger(spark, d)).withColumn("day", F.to_date(F.concat(F.substring("statement", -7, 7), F.lit("-01"))))
    return trends.month_bars(metrics, "day")


@query(S.upto(S.METRICS) + f""", p AS (SELECT {S.total("CASE WHEN description LIKE '%COFFEE%' THEN debit END")} AS d FROM ledger), t AS (SELECT {S.total('credits')} AS c, {S.total('lender_debits')} AS l, {S.total('true_revenue')} AS r FROM metrics)
    SELECT round((l + d) / c * 100, 4) AS rate, round((l + d) / c * 100 - CASE WHEN r > 0 THEN round(l / r * 100, 4) ELSE 0 END, 4) AS change FROM t, p""")
def q_withholding_preview(spark, d):
    rows = ledger(spark, d)
    picked = rows.filter(F.col("Description").contains("COFFEE")).select(F.lit("debit").alias("type"), F.col("Debit").alias("amount"))
    return rollup.withholding_preview(rollup.totals(rollup.statement_metrics(rows)), picked)


@query(S.upto(S.METRICS) + f""", t AS (SELECT {', '.join(f'{S.total(c)} AS {c}' for c in ('credits', 'debits', 'lender_debits', 'lender_credits'))}, 0.0::DOUBLE AS avg_daily_balance, floor(avg(nsf_count))::BIGINT AS monthly_nsf, floor(avg(loan_count))::BIGINT AS monthly_loans FROM metrics),
    n AS (SELECT count(*) FILTER ({S.matches_any('description', L.NSF_FLAG, 'i')}) AS nsf_count FROM ledger)
    SELECT *, round(credits - debits, 2) AS cash_flow, CASE WHEN credits > 0 THEN round(lender_debits / credits * 100, 4) ELSE 0 END AS withholding_rate FROM t, n""")
def q_gross_totals(spark, d):
    rows = ledger(spark, d)
    return rollup.gross_totals(rollup.statement_metrics(rows), rows)


@query(S.upto(S.FOUND) + "SELECT count(*) > 0 AS funding_detected, array_to_string(list_sort(list_distinct(list(lender))), '; ') AS funders FROM found")
def q_funders(spark, d):
    return rollup.funders(lenders.with_lender(ledger(spark, d))).select("funding_detected", F.array_join("funders", "; ").alias("funders"))


@query(f"""WITH {S.LEDGER}, l AS (SELECT *, round(greatest(debit, credit) + 1, 2) AS amount, last_value(CASE WHEN row_no % 3 <> 0 THEN strftime(date, '%d %b') END IGNORE NULLS) OVER (PARTITION BY statement ORDER BY row_no) AS day FROM ledger)
    SELECT statement, 1 AS page, row_number() OVER (PARTITION BY statement ORDER BY row_no) AS row_no, 0 AS part, day AS "Date", 'D' || row_no AS "Description", CASE WHEN debit > 0 THEN amount ELSE 0 END AS "Debit", CASE WHEN debit > 0 THEN 0 ELSE amount END AS "Credit", 1.0::DOUBLE AS "Balance" FROM l WHERE day IS NOT NULL""")
def q_rbc_word_rows(spark, d):
    rows = ledger(spark, d)
    at = lambda text, x: F.struct(text.alias("text"), x.alias("x0"), (x + 20).alias("x1"))
    dated = F.when(F.col("row_no") % 3 != 0, F.date_format("Date", "ddMMM"))
    amount = F.format_number((F.greatest("Debit", "Credit") + 1).cast("decimal(18,2)"), 2)
    placed = F.array(at(dated, F.lit(0.0)), at(F.concat(F.lit("D"), "row_no"), F.lit(40.0)), at(amount, F.when(F.col("Debit") > 0, 300.0).otherwise(400.0)), at(F.lit("1.00"), F.lit(500.0)))
    page = F.col("statement"), F.lit(1).alias("page"), F.lit(600.0).alias("width")
    body = rows.select(*page, (100.0 + 10 * F.col("row_no")).alias("top"), F.inline(placed)).filter("text IS NOT NULL")
    head = F.array(*[at(F.lit(t), F.lit(x)) for t, x in (("Cheques", 300.0), ("Deposits", 400.0), ("Balance", 500.0))])
    return canada.rbc_words(body.union(rows.select("statement").distinct().select(*page, F.lit(50.0).alias("top"), F.inline(head))))
