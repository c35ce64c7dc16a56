"""Catalogue: statements in time, exports, forms, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalogue_sql as S
from .operators import application, balance, geometry, lenders, rollup, trends
from .plans import exports
from .queries import query
from .sources.adapters import ledger, load, orders_ledger

_MONTHS = f"months AS (SELECT o_custkey AS customer, strftime(o_orderdate, '%Y-%m') AS month, {S.total('o_totalprice')} AS credits FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)"


def _months(spark, d):
    from .functions.money import total

    rows = orders_ledger(spark, d).filter("Credit > 0")
    return rows.groupBy("customer", F.date_format("Date", "yyyy-MM").alias("month")).agg(total(F.col("Credit")).alias("credits"))


@query(f"WITH {_MONTHS}, b AS (SELECT *, lag(credits) OVER (PARTITION BY customer ORDER BY month) AS b FROM months) SELECT customer, month, CASE WHEN b > 0 THEN round((credits - b) / b * 100, 1) + 0.0 ELSE 0 END AS change FROM b WHERE b IS NOT NULL")
def q_mom_change(spark, d):
    return trends.month_over_month(_months(spark, d), "customer", "month", "credits")


_FORECAST = f"""WITH {_MONTHS}, x AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY month) - 1 AS x, round(credits * 100)::BIGINT AS y FROM months),
    g AS (SELECT customer, count(*) AS n, arg_max(credits, month) AS last, strftime((max(month) || '-01')::DATE + INTERVAL 1 MONTH, '%Y-%m') AS next_month, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x * x)::BIGINT AS sxx, sum(x * y)::BIGINT AS sxy FROM x GROUP BY customer),
    u AS (SELECT *, n * sxx - sx * sx AS d, greatest(sy * (n * sxx - sx * sx) + (n * sxy - sx * sy) * (n * n - sx), 0) AS u FROM g),
    f AS (SELECT customer, n, last, next_month, CASE WHEN n = 1 THEN greatest(round(last, 2), 0) ELSE ((2 * u + n * d) // (2 * n * d)) / 100 END AS predicted FROM u)"""


@query(_FORECAST + """ SELECT *, round(predicted - last, 2) AS delta, CASE WHEN n >= 6 THEN 'High' WHEN n >= 3 THEN 'Medium' ELSE 'Low' END AS confidence FROM f""")
def q_forecast(spark, d):
    return trends.forecast(_months(spark, d), "customer", "month", "credits")


@query(_FORECAST + """ SELECT customer, month, credits AS revenue, CASE WHEN month = max(month) OVER (PARTITION BY customer) THEN credits END AS forecast FROM months UNION ALL SELECT customer, next_month, NULL, predicted FROM f""")
def q_forecast_series(spark, d):
    return trends.forecast_series(_months(spark, d), "customer", "month", "credits")


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS customer, o_orderdate::DATE AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
    r AS (SELECT customer, k, d AS f FROM o WHERE k = 1 UNION ALL SELECT o.customer, o.k, CASE WHEN (year(d) * 12 + month(d)) - (year(f) * 12 + month(f)) > 6 THEN (d - INTERVAL 12 MONTH)::DATE ELSE d END FROM r JOIN o ON o.customer = r.customer AND o.k = r.k + 1)
    SELECT customer, row_number() OVER (PARTITION BY customer ORDER BY f) - 1 AS position, strftime(f, '%Y-%m-%d') AS fixed FROM r""")
def q_year_gap_fix(spark, d):
    fixed = trends.fix_year_gaps(load(spark, d, "orders").select(F.col("o_custkey").alias("customer"), "o_orderdate"), "customer", "o_orderdate")
    return fixed.select("customer", F.col("position").cast("long").alias("position"), F.date_format("fixed", "yyyy-MM-dd").alias("fixed"))


@query("""WITH l AS (SELECT o_custkey AS statement, o_orderkey AS line_no, round(o_totalprice, 2) AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN -1 ELSE 1 END AS side FROM orders),
    t AS (SELECT *, CASE WHEN side <> 0 THEN round(5000000 + sum((side * amount)::DECIMAL(18,2)) OVER (PARTITION BY statement ORDER BY line_no)::DOUBLE, 2) END AS printed FROM l)
    SELECT statement, line_no, amount, coalesce(last_value(printed IGNORE NULLS) OVER (PARTITION BY statement ORDER BY line_no), 5000000) AS balance, CASE side WHEN 1 THEN 'Credit' WHEN -1 THEN 'Debit' ELSE '' END AS section FROM t""")
def q_running_balance(spark, d):
    from pyspark.sql import Window

    k = F.col("o_orderkey") % 3
    side = F.when(k == 0, 0).when(k == 1, -1).otherwise(1)
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("statement"), F.col("o_orderkey").alias("line_no"), F.round("o_totalprice", 2).alias("a"), side.alias("side"))
    printed = F.round(5000000 + F.sum((F.col("side") * F.col("a")).cast("decimal(18,2)")).over(Window.partitionBy("statement").orderBy("line_no")).cast("double"), 2)
    rows = rows.withColumn("amounts", F.when(F.col("side") == 0, F.array("a")).otherwise(F.array(F.col("a"), printed))).withColumn("opening", F.lit(5000000.0))
    return trends.running_balance(rows).select("statement", "line_no", "amount", F.round("balance", 2).alias("balance"), "section")


@query("""WITH p AS (SELECT o_custkey AS statement, o_orderdate::DATE AS day, arg_max(round(o_totalprice, 2), o_orderkey) AS balance FROM orders GROUP BY ALL), n AS (SELECT *, date_diff('day', day, coalesce(lead(day) OVER (PARTITION BY statement ORDER BY day), DATE '2001-12-31')) AS w FROM p),
    g AS (SELECT statement, count(*) AS days, sum(greatest(w, 0)) AS w, sum(balance::DECIMAL(18,4) * greatest(w, 0))::DOUBLE AS v FROM n GROUP BY statement) SELECT statement, round(v / w, 2) AS average FROM g WHERE days >= 2 AND w > 0""")
def q_weighted_avg_balance(spark, d):
    points = load(spark, d, "orders").select(F.col("o_custkey").alias("statement"), F.to_date("o_orderdate").alias("day"), F.round("o_totalprice", 2).alias("balance"), F.col("o_orderkey").alias("place"), F.lit("2001-12-31").cast("date").alias("until"))
    return balance.weighted_average(points)


@query(f"""SELECT c_custkey AS statement, CASE WHEN c_custkey % 3 = 0 THEN round(abs(c_acctbal)::DECIMAL(18,2)::DOUBLE, 2) WHEN c_custkey % 3 = 1 THEN round((abs(c_acctbal)::DECIMAL(18,2)::DOUBLE + 201.01) / 3, 2) END AS average, CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 3 END::INT AS level FROM customer""")
def q_average_balance(spark, d):
    money = F.format_number(F.abs("c_acctbal").cast("decimal(18,2)"), 2)
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Statement 2024\nAverage Ledger Balance $"), money)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("DAILY ENDING BALANCE\n01/02 $"), money, F.lit("\n01/05 100.50\n01/06 100.51\nSERVICE CHARGE SUMMARY\n01/09 7.00"))).otherwise("nothing here")
    return balance.average_balance(load(spark, d, "customer").select(F.col("c_custkey").alias("statement"), text.alias("text")))


@query(S.upto(S.METRICS) + """SELECT statement, credits, debits, cash_flow, lender_debits, lender_credits, round(greatest(0, debits - lender_debits), 2) AS other_debits, CASE WHEN debits > 0 THEN round(lender_debits / debits * 100, 1) ELSE 0 END AS lender_share,
    CASE WHEN lender_debits > 0 THEN round(least(avg_daily_balance / lender_debits, 15), 4) END AS coverage, CASE WHEN lender_debits > 0 THEN 'red' END AS colour FROM metrics""")
def q_chart_series(spark, d):
    return trends.chart_series(rollup.statement_metrics(ledger(spark, d)))


@query(S.upto(S.METRICS) + """SELECT statement, CASE WHEN withholding_rate > 15 THEN 'red' WHEN withholding_rate > 8 THEN 'amber' ELSE 'green' END AS withholding_flag, CASE WHEN nsf_count > 2 THEN 'red' WHEN nsf_count > 0 THEN 'amber' ELSE 'green' END AS nsf_flag,
    least(withholding_rate, 100) AS gauge, CASE WHEN withholding_rate > 30 THEN 'red' WHEN withholding_rate > 15 THEN 'amber' ELSE 'green' END AS gauge_flag FROM metrics""")
def q_kpi_flags(spark, d):
    return trends.flags(rollup.statement_metrics(ledger(spark, d)))


@query(f"WITH {S.LEDGER} SELECT row_no, description, debit FROM ledger WHERE contains(lower(description), 'kapitus') OR contains(row_no::VARCHAR, 'kapitus') ORDER BY debit DESC, row_no LIMIT 20 OFFSET 20")
def q_search_sort_page(spark, d):
    rows = ledger(spark, d).select("row_no", F.col("Description").alias("description"), F.col("Debit").alias("debit"))
    return trends.search(rows, "Kapitus", "debit", 2, descending=True, tie="row_no")


_SUMS = ", ".join(f"{S.total(c)} AS {c}" if not c.endswith("count") else f"sum({c})::BIGINT AS {c}" for c in rollup.SUMMED)
_SHOWN = {"Total Credits": "credits", "Total Debits": "debits", "Cash Flow": "cash_flow", "Lender Debits": "lender_debits", "Lender Credits": "lender_credits", "True Revenue": "true_revenue", "Average Daily Balance": "avg_daily_balance"}


@query(S.upto(S.METRICS) + f""", t AS (SELECT {_SUMS}, 0.0::DOUBLE AS avg_daily_balance FROM metrics), r AS (SELECT *, CASE WHEN true_revenue > 0 THEN round(lender_debits / true_revenue * 100, 4) ELSE 0 END AS rate FROM t)
    SELECT unnest([{S.listed([*_SHOWN, 'Withholding Rate', 'NSF Count', 'Loan Count'])}]) AS metric, unnest([{', '.join(f"'$' || format('{{:,.2f}}', {c})" for c in _SHOWN.values())}, format('{{:,.2f}}', rate) || '%', nsf_count::VARCHAR, loan_count::VARCHAR]) AS value FROM r""")
def q_export_summary(spark, d):
    return exports.formatted_summary(rollup.totals(rollup.statement_metrics(ledger(spark, d))))


@query(f"WITH {S.LEDGER} SELECT statement, strftime(min(date), '%b %Y') || ' – ' || strftime(max(date), '%b %Y') AS label FROM ledger GROUP BY statement")
def q_date_range_label(spark, d):
    return ledger(spark, d).groupBy("statement").agg(trends.date_range(F.col("Date")).alias("label"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '2024-' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') WHEN c_custkey % 3 = 1 THEN '2023-' || ['02', '11'][c_custkey % 2 + 1] ELSE '0000-00' END AS sort_month FROM customer")
def q_statement_sort(spark, d):
    k = F.col("c_custkey")
    date = F.when(k % 3 == 0, F.make_date(F.lit(2024), (k % 12 + 1).cast("int"), F.lit(5)))
    name = F.when(k % 3 == 1, F.concat(F.lit("stmt_"), F.element_at(F.array(F.lit("feb"), F.lit("11")), (k % 2 + 1).cast("int")), F.lit("_2023.pdf"))).otherwise("scan.pdf")
    return load(spark, d, "customer").select("c_custkey", trends.sort_month(date, name).alias("sort_month"))


_FORM = "[(1, 0, 'Business Legal Name: ' || c_name), (2, 0, 'State: ' || 'new york'), (2, 1, 'Phone: 1' || lpad(c_custkey::VARCHAR, 10, '5')), (3, 0, 'OWNER INFORMATION'), (4, 0, 'Email: City:'), (5, 0, 'Email: o' || c_custkey || '@x.org'), (5, 1, 'Ownership %: 50')]"


@query("""SELECT c_custkey AS form, unnest(['Business_Legal_Name', 'Business_State', 'Business_Phone', 'Principle_Email', 'Principle_Ownership']) AS field,
    unnest([c_name, 'NY', '(' || p[1:3] || ') ' || p[4:6] || '-' || p[7:10], 'o' || c_custkey || '@x.org', '50%']) AS value FROM (SELECT *, lpad(c_custkey::VARCHAR, 10, '5') AS p FROM customer)""")
def q_application_fields(spark, d):
    k = F.col("c_custkey").cast("string")
    cell = lambda row, col, text: F.struct(F.lit(row).alias("row"), F.lit(col).alias("col"), text.alias("text"))
    cells = F.array(
        cell(1, 0, F.concat(F.lit("Business Legal Name: "), "c_name")), cell(2, 0, F.lit("State: new york")), cell(2, 1, F.concat(F.lit("Phone: 1"), F.lpad(k, 10, "5"))), cell(3, 0, F.lit("OWNER INFORMATION")),
        cell(4, 0, F.lit("Email: City:")), cell(5, 0, F.concat(F.lit("Email: o"), k, F.lit("@x.org"))), cell(5, 1, F.lit("Ownership %: 50")),
    )
    return application.masked(application.fields(load(spark, d, "customer").select(F.col("c_custkey").alias("form"), F.inline(cells))))


_PAGE = "p AS (SELECT l_orderkey AS statement, 0 AS page, l_linenumber AS word_no, l_quantity * 10 + l_linenumber AS y FROM lineitem), a AS (SELECT o_orderkey AS statement, 0 AS page, unnest(range(5)) AS anchor, unnest(range(5)) * 40.0 + 60 AS y FROM orders)"


@query(f"WITH {_PAGE} SELECT p.statement, p.page, word_no, arg_min(anchor, abs(p.y - a.y) * 100 + anchor) AS anchor FROM p JOIN a USING (statement, page) WHERE abs(p.y - a.y) <= 24 GROUP BY ALL")
def q_nearest_anchor(spark, d):
    words = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("statement"), F.lit(0).alias("page"), F.col("l_linenumber").alias("word_no"), (F.col("l_quantity") * 10 + F.col("l_linenumber")).alias("y"))
    anchors = load(spark, d, "orders").select(F.col("o_orderkey").alias("statement"), F.lit(0).alias("page"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("anchor")).withColumn("y", F.col("anchor") * 40.0 + 60)
    return geometry.nearest_anchor(words, anchors)


@query("""WITH h AS (SELECT o_orderkey AS statement, unnest([0, 1]) AS page, unnest([100.0, 250.0]) AS y, unnest(['Credit', 'Debit']) AS section FROM orders), r AS (SELECT l_orderkey AS statement, l_linenumber AS n, l_linenumber % 2 AS page, l_quantity * 10.0 AS y FROM lineitem)
    SELECT r.statement, n, r.y, arg_max(h.section, h.page * 10000 + h.y) AS section FROM r LEFT JOIN h ON h.statement = r.statement AND (h.page < r.page OR h.page = r.page AND h.y <= r.y) GROUP BY ALL""")
def q_asof_section(spark, d):
    mark = lambda page, y, s: F.struct(F.lit(page).alias("page"), F.lit(y).alias("y"), F.lit(s).alias("section"))
    heads = load(spark, d, "orders").select(F.col("o_orderkey").alias("statement"), F.inline(F.array(mark(0, 100.0, "Credit"), mark(1, 250.0, "Debit"))))
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("statement"), F.col("l_linenumber").alias("n"), (F.col("l_linenumber") % 2).alias("page"), (F.col("l_quantity") * 10.0).alias("y"))
    return geometry.carried_headers(heads, rows, "n").select("statement", "n", "y", "section")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN x >= 420 THEN 'Balance' WHEN abs(x - 200) <= abs(x - 320) THEN 'Debit' ELSE 'Credit' END AS nearest, CASE WHEN x > 430 THEN 'Balance' WHEN x <= 260 THEN 'Debit' ELSE 'Credit' END AS midpoint FROM (SELECT *, l_quantity * 10.0 AS x FROM lineitem)""")
def q_column_assign(spark, d):
    x = F.col("l_quantity") * 10.0
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geometry.column_of(x, F.lit(200.0), F.lit(320.0), F.lit(450.0)).alias("nearest"), geometry.side_of_midpoint(x, F.lit(260.0), F.lit(430.0)).alias("midpoint"))


@query("""WITH t AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DOUBLE AS a, o_orderkey % 3 AS k FROM orders) SELECT o_orderkey AS statement, s AS "Description", CASE WHEN s = 'debit' THEN a ELSE 0 END AS debit, CASE WHEN s = 'debit' THEN 0 ELSE a END AS credit FROM t, (VALUES ('credit'), ('debit')) v(s)
    WHERE a > 0 AND (k = 2 OR (k = 0 AND s = 'debit') OR (k = 1 AND s = 'credit'))""")
def q_table_rows(spark, d):
    k, price = F.col("o_orderkey") % 3, F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    cell = lambda col, text: F.struct(F.lit(col).alias("col"), text.alias("text"))
    cells = F.array(cell(0, F.lit("JAN 02")), cell(1, F.lit("x")), cell(2, F.when(k != 1, price).otherwise("")), cell(3, F.when(k != 0, price).otherwise("")))
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("statement"), F.lit(0).alias("page"), F.lit(0).alias("table_no"), F.lit(0).alias("row"), F.inline(cells))
    return geometry.table_rows(rows).select("statement", F.when(F.col("Debit") > 0, "debit").otherwise("credit").alias("Description"), F.col("Debit").alias("debit"), F.col("Credit").alias("credit"))


@query(f"WITH {S.LEDGER}, n AS (SELECT DISTINCT description FROM ledger) SELECT description, CASE " + " ".join(rf"WHEN regexp_matches({S.clean('description')}, '\b{w}\b') THEN '{w}'" for w in __import__("tallyloom.functions.lexicon", fromlist=["x"]).FALSE_LENDERS) + " END AS keyword FROM n")
def q_false_lenders(spark, d):
    return ledger(spark, d).select(F.col("Description").alias("description")).distinct().withColumn("keyword", lenders.is_false_lender(F.col("description")))
