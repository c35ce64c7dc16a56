"""Catalogue: statement text."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalogue_sql as S
from .functions import dates
from .functions import lexicon as L
from .operators import metrics, parsers, summary
from .operators.lines import to_lines
from .queries import query
from .sources.adapters import ledger, load, statement_lines

_LINES = """body AS (SELECT statement, CASE WHEN debit > 0 THEN 2 ELSE 1 END AS part, row_no, strftime(date, '%m/%d') || ' ' || description || ' ' || greatest(debit, credit)::DECIMAL(18,2)::VARCHAR AS line FROM ledger),
    lines AS (SELECT statement, part * 1000000000 + row_no + 1 AS line_no, line, row_no FROM body UNION ALL SELECT DISTINCT statement, part * 1000000000, CASE part WHEN 2 THEN 'ELECTRONIC WITHDRAWALS' ELSE 'DEPOSITS AND ADDITIONS' END, -1 FROM body)"""
_AMOUNT = r"regexp_extract(line, '([0-9]+\.[0-9][0-9])$', 1)::DOUBLE"
_SPLIT = rf"regexp_extract(line, '^(\d\d/\d\d)', 1) AS \"Date\", trim(line[7:length(line) - length(regexp_extract(line, '([0-9]+\.[0-9][0-9])$', 1))]) AS \"Description\"".replace('\\"', '"')


@query(f"""WITH {S.LEDGER}, {_LINES}, m AS (SELECT *, CASE WHEN {S.contains_any('upper(line)', L.DEBIT_SECTION_WORDS)} THEN 'Debit' WHEN {S.contains_any('upper(line)', L.CREDIT_SECTION_WORDS)} THEN 'Credit' END AS mark FROM lines),
    c AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY statement ORDER BY line_no) AS section FROM m), a AS (SELECT *, {_AMOUNT} AS a FROM c WHERE row_no >= 0 AND NOT {S.contains_any('upper(line)', L.SKIP_LINE_KEYWORDS)} AND {_AMOUNT} > 0)
    SELECT statement, line_no, {_SPLIT}, CASE WHEN section = 'Debit' THEN a ELSE 0 END AS debit, CASE WHEN section = 'Debit' THEN 0 ELSE a END AS credit, section FROM a""")
def q_universal_rows(spark, d):
    rows = parsers.universal(statement_lines(spark, d))
    return rows.select("statement", "line_no", "Date", "Description", F.col("Debit").alias("debit"), F.col("Credit").alias("credit"), F.col("Section").alias("section"))


@query(f"""WITH {S.LEDGER}, {_LINES} SELECT statement, line_no, {_SPLIT}, CASE WHEN line_no > 2000000000 THEN {_AMOUNT} ELSE 0 END AS debit, CASE WHEN line_no > 2000000000 THEN 0 ELSE {_AMOUNT} END AS credit FROM lines WHERE row_no >= 0 AND {_AMOUNT} > 0""")
def q_chase_rows(spark, d):
    rows = parsers.chase(statement_lines(spark, d))
    return rows.select("statement", "line_no", "Date", "Description", F.col("Debit").alias("debit"), F.col("Credit").alias("credit"))


@query(f"""WITH {S.LEDGER}, {_LINES} SELECT statement, line_no, {_SPLIT}, CASE WHEN line_no > 2000000000 THEN {_AMOUNT} ELSE 0 END AS debit, CASE WHEN line_no > 2000000000 THEN 0 ELSE {_AMOUNT} END AS credit FROM lines WHERE row_no >= 0 AND {_AMOUNT} > 0""")
def q_regions_rows(spark, d):
    lines = statement_lines(spark, d)
    heads = F.when(F.col("line") == "DEPOSITS AND ADDITIONS", "DEPOSITS & CREDITS").when(F.col("line") == "ELECTRONIC WITHDRAWALS", "WITHDRAWALS").otherwise(F.col("line"))
    rows = parsers.regions(lines.withColumn("line", heads))
    return rows.select("statement", "line_no", "Date", "Description", F.col("Debit").alias("debit"), F.col("Credit").alias("credit"))


@query(f"""WITH {S.LEDGER}, {_LINES}, m AS (SELECT *, CASE WHEN {S.contains_any('upper(line)', L.OCR_DEBIT_WORDS)} THEN 'Debit' WHEN {S.contains_any('upper(line)', L.OCR_CREDIT_WORDS)} THEN 'Credit' END AS mark FROM lines),
    c AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY statement ORDER BY line_no) AS section, {_AMOUNT} AS a FROM m WHERE true), r AS (SELECT * FROM c WHERE row_no >= 0)
    SELECT statement, line_no, "Date", "Description" || ' =' AS "Description", CASE WHEN section = 'Debit' THEN a ELSE 0 END AS debit, CASE WHEN section = 'Debit' THEN 0 ELSE a END AS credit FROM (SELECT *, {_SPLIT} FROM r)""".replace(f", {_AMOUNT} AS a FROM m WHERE true", f", CASE WHEN row_no >= 0 THEN {_AMOUNT} END AS a FROM m"))
def q_ocr_rows(spark, d):
    rows = statement_lines(spark, d)
    # an amount must not run together with the number that ends a description
    rows = rows.withColumn("line", F.regexp_replace("line", r" (\d+\.\d{2})$", r" = \$$1"))
    return parsers.simple(rows).select("statement", "line_no", "Date", "Description", F.col("Debit").alias("debit"), F.col("Credit").alias("credit"))


@query(f"""WITH {S.LEDGER}, {_LINES} SELECT statement, line_no, {_SPLIT}, CASE WHEN line_no > 2000000000 THEN {_AMOUNT} ELSE 0 END AS debit, CASE WHEN line_no > 2000000000 THEN 0 ELSE {_AMOUNT} END AS credit FROM lines WHERE row_no >= 0 AND {_AMOUNT} > 0""")
def q_bofa_rows(spark, d):
    heads = F.when(F.col("line") == "DEPOSITS AND ADDITIONS", L.BOFA_HEADERS[0][0]).when(F.col("line") == "ELECTRONIC WITHDRAWALS", next(w for w, side in L.BOFA_HEADERS if side == "Debit")).otherwise(F.col("line"))
    # an amount must not run together with the number that ends a description
    line = F.regexp_replace(heads, r" (\d+\.\d{2})$", r" \$$1")
    rows = parsers.bank_of_america(statement_lines(spark, d).withColumn("line", line))
    return rows.select("statement", "line_no", "Date", "Description", F.col("Debit").alias("debit"), F.col("Credit").alias("credit"))


@query(f"""WITH {S.LEDGER}, {_LINES}, p AS (SELECT *, line_no < 2000000000 AND line_no = max(line_no) FILTER (row_no >= 0 AND line_no < 2000000000) OVER (PARTITION BY statement) AND count(*) FILTER (line_no >= 2000000000) OVER (PARTITION BY statement) > 0 AS joined FROM lines),
    q AS (SELECT *, {_SPLIT}, {_AMOUNT} AS a FROM (FROM p WHERE row_no >= 0) WHERE NOT regexp_matches(line, '(?i){L.CAPITAL_ONE_SKIP}')),
    r AS (SELECT * REPLACE ("Description" || CASE WHEN joined THEN ' ELECTRONIC WITHDRAWALS' ELSE '' END AS "Description") FROM q)
    SELECT statement, line_no, "Date", "Description", CASE WHEN gain THEN 0 ELSE a END AS debit, CASE WHEN gain THEN a ELSE 0 END AS credit, 77.25::DOUBLE AS balance FROM (SELECT *, regexp_matches("Description", '(?i){L.CAPITAL_ONE_CREDIT}') AS gain FROM r) WHERE a > 0""")
def q_capital_one_rows(spark, d):
    """Rows with a balance, headers between them, lines of noise, and a row before the detail and one after its total. A header is joined to the row above."""
    lines = statement_lines(spark, d)
    lines = lines.withColumn("line", F.when(F.col("line").rlike(r"^\d"), F.concat("line", F.lit(" 77.25"))).otherwise(F.col("line")))
    extra = lambda at, *texts: lines.select("statement").distinct().select("statement", F.posexplode(F.array(*map(F.lit, texts))).alias("k", "line")).select("statement", (at + F.col("k")).cast("long").alias("line_no"), "line")
    before = extra(0, "Capital One", "01/01 BEFORE 1.00 2.00", "ACCOUNT DETAIL", "MANAGE YOUR CASH", "Page 1 of 3", "CONTINUED FOR PERIOD")
    after = extra(4_000_000_000, "THANK YOU FOR BANKING", "Total $12.00", "01/09 AFTER 3.00 4.00")
    rows = parsers.capital_one(lines.unionByName(before).unionByName(after))
    return rows.select("statement", "line_no", "Date", "Description", F.col("Debit").alias("debit"), F.col("Credit").alias("credit"), F.col("Balance").alias("balance"))


@query(f"""WITH {S.LEDGER}, {_LINES} SELECT statement, line_no, kw AS keyword, line, {_AMOUNT} AS amount FROM (SELECT *, CASE {' '.join(rf"WHEN regexp_matches(upper(line), '\b{w}\b') THEN '{w}'" for w in L.FLAGGED)} END AS kw FROM lines) WHERE kw IS NOT NULL""")
def q_flagged_lines(spark, d):
    return parsers.flagged(statement_lines(spark, d))


@query(f"""WITH {S.LEDGER}, {_LINES} SELECT statement, line_no, {_SPLIT.replace('"Date"', 'date').replace('"Description"', 'description')}, {_AMOUNT} AS amount FROM lines WHERE row_no >= 0 AND line_no > 2000000000""")
def q_charges_section(spark, d):
    heads = F.when(F.col("line") == "ELECTRONIC WITHDRAWALS", "Checks and Charges").otherwise(F.col("line"))
    return parsers.charges(statement_lines(spark, d).withColumn("line", heads))


@query("""SELECT l_orderkey AS statement, 'Check #' || l_partkey AS "Description", strftime(l_shipdate, '%m/%d') || '/2025' AS date, l_extendedprice::DECIMAL(18,2)::DOUBLE AS debit FROM lineitem""")
def q_check_row_explode(spark, d):
    items = load(spark, d, "lineitem")
    check = F.concat_ws(" ", F.date_format("l_shipdate", "MM/dd"), F.col("l_partkey").cast("string"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    body = items.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("|", F.lpad("l_linenumber", 3, "0"), check))), "\n").alias("c"))
    text = F.concat(F.lit("Statement Period: Jan 01 2025\nDAILY ACCOUNT ACTIVITY\nChecks Paid\n"), F.regexp_replace("c", r"(?m)^\d{3}\|", ""), F.lit("\nDAILY BALANCE SUMMARY"))
    rows = parsers.td_bank(to_lines(body.select(F.col("l_orderkey").alias("statement"), text.alias("text"))), F.lit(2025))
    return rows.select("statement", "Description", F.col("Date").alias("date"), F.col("Debit").alias("debit"))


_A, _B = "(abs(c_acctbal) + 1)::DECIMAL(18,2)::DOUBLE", "(c_custkey % 1000 + 0.25)::DOUBLE"


@query(f"""SELECT c_custkey AS statement, ['Chase', 'Wells Fargo', 'PNC', 'generic'][c_custkey % 4 + 1] AS bank, {_A} AS credits_amount, {_B} AS debits_amount,
    CASE WHEN c_custkey % 4 IN (1, 2, 3) THEN 7 ELSE 0 END::INT AS credit_count, CASE WHEN c_custkey % 4 IN (1, 2, 3) THEN 9 ELSE 0 END::INT AS debit_count FROM customer""")
def q_router_priority(spark, d):
    a = (F.abs("c_acctbal") + 1).cast("decimal(18,2)").cast("string")
    b = F.concat((F.col("c_custkey") % 1000).cast("string"), F.lit(".25"))
    k = F.col("c_custkey") % 4
    texts = (
        F.when(k == 0, F.concat(F.lit("JPMORGAN Chase\nJanuary 1 through January 31\nDeposits and Additions $"), a, F.lit("\nElectronic Withdrawals "), b))
        .when(k == 1, F.concat(F.lit("Wells Fargo\n7 Deposits/Credits $"), a, F.lit("\n9 Checks/Debits "), b))
        .when(k == 2, F.concat(F.lit("PNC Bank; WELLS FARGO\n7 Credits This Period "), a, F.lit("\n9 Debits This Period "), b))
        .otherwise(F.concat(F.lit("Some Credit Union\n7 Credit(s) This Period $"), a, F.lit("\n9 Debit(s) This Period "), b))
    )
    return summary.route(load(spark, d, "customer").select(F.col("c_custkey").alias("statement"), texts.alias("text")))


@query("SELECT l_orderkey AS statement, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS total FROM lineitem GROUP BY l_orderkey")
def q_section_sum(spark, d):
    money = F.format_number("l_extendedprice", 2)
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"), F.count("*").alias("n"), F.array_join(F.collect_list(money), " ").alias("t"))
    return rows.select(F.col("l_orderkey").alias("statement"), summary.section_sum(F.when(F.col("n") > 1, F.concat_ws(" ", "t", F.format_number("s", 2))).otherwise(F.col("t"))).alias("total"))


_READ = "CASE WHEN year({0}) < 2000 THEN {0} + INTERVAL 100 YEAR ELSE {0} END"  # the text has two digits of the year


@query(f"""SELECT o_orderkey, strftime({_READ.format('d')}, '%Y-%m-%d') AS start, strftime({_READ.format('e')}, '%Y-%m-%d') AS stop FROM (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE + 30 AS e FROM orders)""")
def q_period(spark, d):
    day = lambda c: F.upper(F.date_format(c, "MMM dd/yy"))
    text = F.concat(F.lit("Account 1\n"), day(F.col("o_orderdate")), F.lit(" - "), day(F.date_add("o_orderdate", 30)))
    return load(spark, d, "orders").withColumn("p", dates.period(text)).select("o_orderkey", F.date_format("p.start", "yyyy-MM-dd").alias("start"), F.date_format("p.stop", "yyyy-MM-dd").alias("stop"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '2023-03-01' ELSE '2024-07-01' END AS day FROM orders""")
def q_statement_date(spark, d):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("Statement date: "), F.date_format("o_orderdate", "MMMM d, yyyy"))).when(k == 1, F.concat(F.lit("as of "), F.date_format("o_orderdate", "MM/dd/yyyy"))).otherwise("none")
    name = F.when(k == 2, F.lit("summary 2023.pdf")).otherwise("july.pdf")
    out = dates.statement_date(text, name, F.lit(2024), F.lit("2026-01-01").cast("date"))
    return load(spark, d, "orders").select("o_orderkey", F.date_format(out, "yyyy-MM-dd").alias("day"))


@query("SELECT c_custkey, (c_custkey % 5)::INT AS nsf FROM customer")
def q_nsf_in_text(spark, d):
    line = F.lit("01/05 CHECK RETURNED 10.00\n")
    text = F.concat(F.lit("x\nItems returned unpaid\n"), F.repeat(line, (F.col("c_custkey") % 5).cast("int")), F.lit("\n\n01/09 LATER 1.00"))
    return load(spark, d, "customer").select("c_custkey", metrics.nsf_in_text(text).alias("nsf"))


@query(f"WITH {S.LEDGER} SELECT row_no, {S.contains_any('upper(description)', ['SQ', 'PAYPAL'])} AS hit FROM ledger")
def q_contains_words(spark, d):
    from .functions.text import any_of

    return ledger(spark, d).select("row_no", any_of(F.upper("Description"), ["SQ", "PAYPAL"]).alias("hit"))
