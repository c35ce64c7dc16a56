"""Query catalogue: name to (DataFrame function, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalogue_sql as S
from .functions import lexicon as L
from .functions.money import clean_money, lenient_amount, plausible_balance
from .functions.text import clean_text, short_labels, unspaced
from .operators import lenders, metrics, risk, rollup
from .sources.adapters import ledger, load

QUERIES: dict = {}


def query(sql: str | None = None):
    """Register a query under its name with its oracle."""

    def put(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return put


_METRICS = "statement, credits, debits, cash_flow, lender_debits, lender_credits, true_revenue, withholding_rate, nsf_count, loan_count, pos_count, avg_daily_balance"


@query(S.upto(S.METRICS) + f"""SELECT {_METRICS}, points AS risk_score, CASE WHEN points < 30 THEN 'Low Risk' WHEN points < 60 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_level FROM
    (SELECT *, (CASE WHEN credits < 15000 THEN 30.0 ELSE 0 END + CASE WHEN credits > 0 AND debits / credits > 0.85 THEN 30.0 ELSE 0 END + CASE WHEN nsf_count >= 3 THEN 25.0 ELSE 0 END + CASE WHEN lender_debits > 0 OR lender_credits > 0 THEN 15.0 ELSE 0 END)::DOUBLE AS points FROM metrics)""")
def q_statement_metrics(spark, d):
    m = rollup.statement_metrics(ledger(spark, d))
    points = risk.score(F.col("credits"), F.col("debits"), F.col("nsf_count"), (F.col("lender_debits") > 0) | (F.col("lender_credits") > 0))
    return m.withColumn("risk_score", points).withColumn("risk_level", risk.level(F.col("risk_score")))


_SUMS = ", ".join(f"{S.total(c)} AS {c}" if not c.endswith("count") else f"sum({c})::BIGINT AS {c}" for c in rollup.SUMMED)


@query(S.upto(S.METRICS) + f"""SELECT *, CASE WHEN true_revenue > 0 THEN round(lender_debits / true_revenue * 100, 4) ELSE 0 END AS withholding_rate FROM (SELECT count(*) AS statements, {_SUMS}, 0.0::DOUBLE AS avg_daily_balance FROM metrics)""")
def q_totals(spark, d):
    return rollup.totals(rollup.statement_metrics(ledger(spark, d)))


@query(S.upto(S.METRICS) + f""", p AS (SELECT {S.total("CASE WHEN description LIKE '%COFFEE%' THEN debit END")} AS d, {S.total("CASE WHEN description LIKE '%ZELLE%' THEN credit END")} AS c FROM ledger),
    t AS (SELECT count(*) AS statements, {_SUMS} FROM metrics), a AS (SELECT statements, credits, round(lender_debits + d, 2) AS lender_debits, round(lender_credits + c, 2) AS lender_credits FROM t, p)
    SELECT statements, lender_debits, lender_credits, round(credits - lender_credits, 2) AS true_revenue, CASE WHEN credits > lender_credits THEN round(lender_debits / round(credits - lender_credits, 2) * 100, 4) ELSE 0 END AS withholding_rate FROM a""")
def q_manual_lenders(spark, d):
    rows = ledger(spark, d)
    picked = rows.filter(F.col("Description").contains("COFFEE")).select(F.lit("debit").alias("type"), F.col("Debit").alias("amount")).union(rows.filter(F.col("Description").contains("ZELLE")).select(F.lit("credit"), "Credit"))
    return rollup.with_manual(rollup.totals(rollup.statement_metrics(rows)), picked).select("statements", "lender_debits", "lender_credits", "true_revenue", "withholding_rate")


@query(S.upto(S.METRICS) + f"""SELECT statements, {', '.join(f'round({c} / statements, 2) AS {c}' for c in rollup.SUMMED)}, avg_daily_balance, CASE WHEN true_revenue > 0 THEN round(lender_debits / true_revenue * 100, 4) ELSE 0 END AS withholding_rate
    FROM (SELECT count(*) AS statements, {_SUMS}, 0.0::DOUBLE AS avg_daily_balance FROM metrics)""")
def q_averages(spark, d):
    return rollup.averages(rollup.totals(rollup.statement_metrics(ledger(spark, d))))


@query(S.upto(S.DETECTED) + "SELECT d AS description, lender, kw AS keyword FROM detected")
def q_detect_lender(spark, d):
    return lenders.detect(ledger(spark, d), "Description", lenders.dictionary(spark)).withColumnRenamed("Description", "description")


@query(S.upto(S.DEBITS) + "SELECT statement, row_no, description, lender, keyword, amount FROM debits")
def q_lender_debits(spark, d):
    return lenders.lender_debits(lenders.with_lender(ledger(spark, d))).select("statement", "row_no", F.col("desc").alias("description"), "lender", "keyword", "amount")


@query(S.upto(S.CREDITS) + "SELECT statement, row_no, description, lender, keyword, amount FROM credits")
def q_lender_credits(spark, d):
    return lenders.lender_credits(lenders.with_lender(ledger(spark, d))).select("statement", "row_no", F.col("desc").alias("description"), "lender", "keyword", "amount")


@query(S.upto(S.MONTHLY) + "SELECT statement, lender, n, frequency, typical, paid, monthly FROM monthlies")
def q_lender_monthly(spark, d):
    return lenders.lender_monthly(lenders.lender_debits(lenders.with_lender(ledger(spark, d))))


def _listed(spark, d):
    found = lenders.with_lender(ledger(spark, d))
    return lenders.lender_list(lenders.lender_debits(found), lenders.lender_credits(found))


@query(S.upto(S.LENDER_LIST) + "SELECT * FROM lender_list")
def q_lender_list(spark, d):
    return _listed(spark, d)


@query(S.upto(S.LENDER_LIST) + f"""SELECT lender, total, round(total / max(total) OVER (), 6) AS share_of_max FROM (SELECT lender, {S.total('CASE WHEN m > 0 THEN m ELSE 0 END + loose')} AS total FROM
    (SELECT lender, statement, max(monthly_amount) AS m, {S.total('CASE WHEN monthly_amount <= 0 THEN amount END')} AS loose FROM lender_list GROUP BY ALL) GROUP BY lender)""")
def q_lender_breakdown(spark, d):
    return lenders.lender_breakdown(_listed(spark, d))


@query(S.upto(S.DEBITS) + f"SELECT lender, {S.total('amount')} AS total, strftime(max(date), '%Y-%m-%d') AS last_date FROM debits GROUP BY lender ORDER BY total DESC, lender LIMIT 8")
def q_top_lenders(spark, d):
    return lenders.top_lenders(lenders.lender_debits(lenders.with_lender(ledger(spark, d))))


_SAVED = [("paypal", "debit"), ("pay", "debit"), ("Deposit", "credit"), ("loan", "credit")]


def _saved(spark):
    return spark.createDataFrame(_SAVED, "name string, type string")


@query(f"WITH {S.LEDGER}, saved AS (SELECT * FROM (VALUES {', '.join(map(str, _SAVED))}) t(name, type)) SELECT statement, row_no, description, name AS keyword, type, CASE WHEN type = 'debit' THEN debit ELSE credit END AS amount FROM ledger JOIN saved ON contains(lower(description), lower(name)) AND CASE WHEN type = 'debit' THEN debit ELSE credit END > 0")
def q_saved_keywords(spark, d):
    return lenders.apply_saved_keywords(ledger(spark, d), _saved(spark)).withColumnRenamed("Description", "description")


_SAVED_ROWS = f"saved AS (SELECT * FROM (VALUES {', '.join(map(str, _SAVED))}) t(name, type)), matched AS (SELECT type, CASE WHEN type = 'debit' THEN debit ELSE credit END AS amount FROM ledger JOIN saved ON contains(lower(description), lower(name)) AND CASE WHEN type = 'debit' THEN debit ELSE credit END > 0)"
_SAVED_TOTALS = S.upto(S.METRICS) + f""", {_SAVED_ROWS}, t AS (SELECT count(*) AS statements, {_SUMS}, 0.0::DOUBLE AS avg_daily_balance FROM metrics),
    p AS (SELECT {S.total("CASE WHEN type = 'debit' THEN amount END")} AS d, {S.total("CASE WHEN type = 'credit' THEN amount END")} AS c FROM matched),
    u AS (SELECT t.* REPLACE (round(lender_debits + d, 2) AS lender_debits, round(lender_credits + c, 2) AS lender_credits), CASE WHEN credits > lender_credits + c THEN round((lender_debits + d) / (credits - (lender_credits + c)) * 100, 4) ELSE 0 END AS withholding_rate FROM t, p)"""


@query(_SAVED_TOTALS + "SELECT * FROM u")
def q_saved_keyword_totals(spark, d):
    rows = ledger(spark, d)
    return rollup.with_saved(rollup.totals(rollup.statement_metrics(rows)), lenders.apply_saved_keywords(rows, _saved(spark)))


@query(_SAVED_TOTALS + f"SELECT statements, {', '.join(f'round({c} / statements, 2) AS {c}' for c in rollup.SUMMED)}, avg_daily_balance, withholding_rate FROM u")
def q_saved_keyword_averages(spark, d):
    rows = ledger(spark, d)
    return rollup.averages_with_saved(rollup.totals(rollup.statement_metrics(rows)), lenders.apply_saved_keywords(rows, _saved(spark)))



#: Keywords of parts: each brand and type, of debits where the size is even.
_KEPT = "SELECT DISTINCT {} AS name, CASE WHEN p_size % 2 = 0 THEN 'debit' ELSE 'credit' END AS type FROM part"


def _kept(spark, d, name):
    return load(spark, d, "part").select(name.alias("name"), F.when(F.col("p_size") % 2 == 0, "debit").otherwise("credit").alias("type")).distinct()


@query(f"WITH saved AS ({_KEPT.format('p_brand')}), new AS ({_KEPT.format('upper(p_brand)')} UNION SELECT trim(p_type), 'debit' FROM part) SELECT name, type FROM saved UNION ALL SELECT name, type FROM new WHERE NOT EXISTS (FROM saved s WHERE lower(s.name) = lower(new.name) AND s.type = new.type)")
def q_add_keyword(spark, d):
    new = _kept(spark, d, F.upper("p_brand")).unionByName(load(spark, d, "part").select(F.trim("p_type").alias("name"), F.lit("debit").alias("type"))).unionByName(load(spark, d, "part").select(F.lit(" ").alias("name"), F.lit("debit").alias("type")))
    return lenders.add_keyword(_kept(spark, d, F.col("p_brand")), new)


@query(f"WITH saved AS ({_KEPT.format('p_brand')}), gone AS ({_KEPT.format('lower(p_brand)')}) SELECT name, type FROM saved WHERE type = 'credit' OR NOT EXISTS (FROM gone WHERE gone.name = lower(saved.name) AND gone.type = 'credit')")
def q_remove_keyword(spark, d):
    gone = _kept(spark, d, F.lower("p_brand")).filter("type = 'credit'").withColumn("type", F.lit("DEBIT"))
    return lenders.remove_keyword(_kept(spark, d, F.col("p_brand")), gone)


@query(f"WITH {S.LEDGER} SELECT strftime(date, '%B %Y') AS \"Month\", {S.total('credit')} AS \"Monthly_Revenue\", {S.total('debit')} AS \"Monthly_Debits\", count(*) AS \"Transaction_Count\", count(*) FILTER ({S.matches_any('description', L.NSF_FLAG, 'i')}) AS \"NSF_Count\", round({S.total('credit')} - {S.total('debit')}, 2) AS \"Monthly_Cash_Flow\", round({S.total('debit')} / {S.total('credit')} * 100, 4) AS \"Withholding_Rate\" FROM ledger GROUP BY 1")
def q_monthly_summary(spark, d):
    return rollup.monthly_summary(ledger(spark, d))


@query(f"WITH {S.LEDGER}, u AS (SELECT DISTINCT statement, date, description, debit, credit FROM ledger) SELECT statement, count(*) FILTER (credit > 0) AS credit_count, count(*) FILTER (debit > 0) AS debit_count, count(*) FILTER (credit > 0) + count(*) FILTER (debit > 0) AS total_count FROM u GROUP BY statement")
def q_distinct_counts(spark, d):
    return metrics.distinct_counts(ledger(spark, d))


@query(f"WITH {S.LEDGER} SELECT statement, count(*) FILTER ({S.matches_any('description', L.NSF, 'i')}) AS nsf_count, count(*) FILTER ({S.matches_any('upper(description)', L.LOAN)}) AS loan_count, count(*) FILTER ({S.matches_any('upper(description)', L.POS)}) AS pos_count FROM ledger GROUP BY statement")
def q_nsf_loan_pos(spark, d):
    return metrics.counts(ledger(spark, d))


#: Shapes that the money queries give to an order's price.
_FORMS = "(VALUES (0, '(', ')'), (1, '$', ''), (2, '-', ''), (3, '', '-'), (4, ' + ', ''), (5, '', ' x'))"
_PRICE = "CASE WHEN o_orderkey % 7 = 0 THEN replace(o_totalprice::DECIMAL(18,2)::VARCHAR, '.', ',') WHEN o_orderkey % 7 = 1 THEN (o_totalprice::DECIMAL(18,2) / 1000)::INT || ',' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '.25' ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END"


def _prices(spark, d):
    cents = (F.round(F.col("o_totalprice") * 100).cast("decimal(18,0)") / 100).cast("decimal(18,2)")  # as the SQL casts a double: 1.005 is 1.00
    price, k = cents.cast("string"), F.col("o_orderkey") % 7
    shaped = F.when(k == 0, F.replace(price, F.lit("."), F.lit(","))).when(k == 1, F.concat(F.rint(cents.cast("double") / 1000).cast("int").cast("string"), F.lit(","), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(".25"))).otherwise(price)
    forms = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("(", ")"), ("$", ""), ("-", ""), ("", "-"), (" + ", ""), ("", " x"))]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return load(spark, d, "orders").select("o_orderkey", F.concat(forms["a"], shaped, forms["b"]).alias("raw"))


_RAW = f"p AS (SELECT o_orderkey, a || ({_PRICE}) || b AS raw FROM orders JOIN {_FORMS} f(k, a, b) ON o_orderkey % 6 = k)"
_NUMBER = r"CASE WHEN regexp_matches(v, '^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN v::DOUBLE ELSE 0 END"


@query(rf"""WITH {_RAW}, a AS (SELECT *, translate(trim(raw), '$+ ', '') AS t FROM p), b AS (SELECT *, starts_with(t, '(') AND ends_with(t, ')') AS n1, CASE WHEN starts_with(t, '(') AND ends_with(t, ')') THEN t[2:-2] ELSE t END AS u FROM a),
    c AS (SELECT *, n1 OR ends_with(u, '-') OR starts_with(u, '-') AS negative, regexp_replace(regexp_replace(u, '-$', ''), '^-', '') AS w FROM b), e AS (SELECT *, CASE WHEN contains(w, ',') AND NOT contains(w, '.') THEN replace(w, ',', '.') ELSE replace(w, ',', '') END AS v FROM c),
    f AS (SELECT *, CASE WHEN negative THEN -({_NUMBER}) ELSE {_NUMBER} END + 0.0 AS money FROM e) SELECT o_orderkey, raw, money, CASE WHEN abs(money) <= 10000000 THEN money END AS balance FROM f""")
def q_money_parse(spark, d):
    return _prices(spark, d).select("o_orderkey", "raw", clean_money(F.col("raw")).alias("money"), plausible_balance(F.col("raw")).alias("balance"))


@query(rf"WITH {_RAW}, a AS (SELECT *, translate(trim(raw), '$,() ', '') AS v FROM p) SELECT o_orderkey, raw, {_NUMBER} AS amount FROM a")
def q_lenient_amount(spark, d):
    return _prices(spark, d).select("o_orderkey", "raw", lenient_amount(F.col("raw")).alias("amount"))


def _short_sql(column: str) -> str:
    out = f"upper({column})"
    for a, b in L.SHORT_FORMS.items():
        out = f"replace({out}, {S.literal(a)}, {S.literal(b)})"
    return out


@query(f"SELECT p_partkey, {S.clean('p_name')} AS clean, {_short_sql(chr(39) + 'Direct Deposit POS Purchase NSF Fee ' + chr(39) + ' || p_name')} AS short FROM part")
def q_clean_text(spark, d):
    return load(spark, d, "part").select("p_partkey", clean_text(F.col("p_name")).alias("clean"), short_labels(F.concat(F.lit("Direct Deposit POS Purchase NSF Fee "), "p_name")).alias("short"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE array_to_string(string_split(s_name, ''), ' ') END AS raw, s_name AS fixed FROM supplier")
def q_spaced_ocr(spark, d):
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.array_join(F.split("s_name", ""), " "))
    return load(spark, d, "supplier").select("s_suppkey", raw.alias("raw"), unspaced(raw).alias("fixed"))


@query(f"""WITH {S.LEDGER} SELECT row_no, CASE WHEN {S.contains_any('lower(description)', L.DEBIT_WORDS)} THEN 'Debit' WHEN {S.contains_any('lower(description)', L.CREDIT_WORDS)} THEN 'Credit' ELSE 'Debit' END AS side FROM ledger""")
def q_amount_direction(spark, d):
    from .operators.ledger import direction

    return ledger(spark, d).select("row_no", direction(F.col("Description")).alias("side"))


@query(f"""WITH {S.LEDGER} SELECT row_no, strftime(date, '%Y-%m-%d') AS date, debit, credit, credit - debit AS amount, strftime(date, '%B %Y') AS month, CASE WHEN debit > 0 THEN 'Debit' ELSE 'Credit' END AS type, {S.matches_any('description', L.NSF_FLAG, 'i')} AS nsf FROM ledger""")
def q_prepare_ledger(spark, d):
    from .operators.ledger import prepare

    raw = ledger(spark, d).select("statement", "row_no", F.date_format("Date", "yyyy-MM-dd").alias("Posted Date"), F.col("Description").alias("Memo"), F.concat(F.lit("$"), F.col("Debit").cast("decimal(18,2)").cast("string")).alias("Withdrawal"), F.col("Credit").cast("string").alias("Deposit"))
    return prepare(raw).select("row_no", F.date_format("Date", "yyyy-MM-dd").alias("date"), F.col("Debit").alias("debit"), F.col("Credit").alias("credit"), F.col("Amount").alias("amount"), F.col("Month").alias("month"), F.col("Type").alias("type"), F.col("NSF Flag").alias("nsf"))


@query(f"""WITH {S.LEDGER} SELECT row_no, debit, credit, credit - debit AS amount FROM ledger""")
def q_header_map_split_amount(spark, d):
    from .operators.ledger import normalise

    raw = ledger(spark, d).select("statement", "row_no", F.date_format("Date", "yyyy-MM-dd").alias("Transaction Date"), F.col("Description").alias("Details"), F.col("Amount").cast("string").alias("Amount (USD)"))
    return normalise(raw).select("row_no", F.col("Debit").alias("debit"), F.col("Credit").alias("credit"), F.col("Amount").alias("amount"))


@query(S.upto(S.DETECTED) + """SELECT row_no, CASE WHEN lender IS NOT NULL AND credit > 0 AND row_no % 3 = 0 THEN credit WHEN lender IS NOT NULL AND debit > 0 AND row_no % 3 = 1 THEN 0 ELSE debit END AS debit,
    CASE WHEN lender IS NOT NULL AND credit > 0 AND row_no % 3 = 0 THEN 0 WHEN lender IS NOT NULL AND debit > 0 AND row_no % 3 = 1 THEN debit ELSE credit END AS credit FROM ledger LEFT JOIN detected ON description = d""")
def q_direction_repair(spark, d):
    section = F.when(F.col("row_no") % 3 == 0, "Debit").when(F.col("row_no") % 3 == 1, "Credit").otherwise("")
    return lenders.repair_direction(ledger(spark, d).withColumn("Section", section)).select("row_no", F.col("Debit").alias("debit"), F.col("Credit").alias("credit"))


@query(S.upto(S.METRICS) + """SELECT statement, array_to_string([CASE WHEN credits >= 100000 THEN 'Strong monthly revenue detected.' ELSE 'Monthly revenue is on the lower side.' END, CASE WHEN cash_flow > 0 THEN 'Positive cash flow detected.' ELSE 'Negative cash flow detected — debits exceed credits.' END,
    CASE WHEN nsf_count > 0 THEN nsf_count || ' NSF / overdraft transaction(s) detected.' ELSE 'No NSF activity detected.' END, CASE WHEN len(funders) > 0 THEN 'Existing MCA/loan funding detected: ' || array_to_string(funders, ', ') ELSE 'No existing funding detected.' END, format('Estimated withholding rate: {:.2f}%.', round(withholding_rate, 2))], ' ') AS notes
    FROM metrics LEFT JOIN (SELECT statement, list_sort(list_distinct(list(lender))) AS funders FROM (SELECT statement, lender FROM debits UNION ALL SELECT statement, lender FROM credits) GROUP BY statement) USING (statement)""")
def q_risk_notes(spark, d):
    rows = ledger(spark, d)
    found = lenders.with_lender(rows)
    funders = lenders.lender_debits(found).union(lenders.lender_credits(found)).groupBy("statement").agg(F.array_sort(F.collect_set("lender")).alias("funders"))
    m = rollup.statement_metrics(rows, found=found).join(funders, "statement", "left")
    names = F.coalesce("funders", F.array().cast("array<string>"))
    return m.select("statement", F.array_join(risk.notes(F.col("credits"), F.col("cash_flow"), F.col("nsf_count"), F.size(names) > 0, names, F.col("withholding_rate")), " ").alias("notes"))


from . import queries_banks, queries_canada, queries_lines, queries_plans, queries_trends  # noqa: E402,F401  they register theirs
