"""Lender activity in ledgers: detection, direction, monthly obligations, saved keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import full_date
from ..functions.lexicon import ALWAYS_CREDIT, ALWAYS_DEBIT, DEBIT_ONLY, FALSE_LENDERS, FUNDING_DEPOSIT, LENDERS, PREFIXES, SKIPPED, WEEKS_PER_MONTH
from ..functions.money import money_of, total
from ..functions.text import any_of, clean_text, matches
from .needles import containing

#: Longer descriptions are scanning noise.
LONGEST = 400
#: Keywords of at least so many letters also match the beginning of a longer word.
COMPOUND = 6


def dictionary(spark, lenders: dict[str, list[str]] | None = None) -> DataFrame:
    """lender_ord, lender, kw_ord, kw: the order is that in which matches win."""
    rows = [(i, name, k, kw) for i, (name, kws) in enumerate((lenders or LENDERS).items()) for k, kw in enumerate(kws)]
    return spark.createDataFrame(rows, "lender_ord int, lender string, kw_ord int, kw string").withColumn("kw", clean_text(F.col("kw")))


def detect(texts: DataFrame, column: str, keywords: DataFrame) -> DataFrame:
    """distinct texts of a column with lender and keyword: the first keyword, in dictionary order, that matches the clean text,
    else the first that matches it without its payment prefix. Only texts with a match come back.

    A keyword matches as a whole word, at the start (also written together), or, if long, as the start of a word.
    Each distinct text is matched once; keywords meet the texts that hold them by an equi-join, however many there are."""
    clean = texts.select(column).distinct().withColumn("__clean", clean_text(F.col(column)))
    tries = F.array(F.struct(F.lit(0).alias("variant"), F.col("__clean").alias("v")), F.struct(F.lit(1).alias("variant"), F.trim(F.regexp_replace("__clean", PREFIXES, "")).alias("v")))
    # most texts have no prefix: a second try would find what the first does
    tried = clean.select(column, F.inline(F.filter(tries, lambda t: (t["variant"] == 0) | (t["v"] != F.col("__clean")))))
    written = keywords.withColumn("together", F.replace(F.col("kw"), F.lit(" "), F.lit("")))
    met = containing(tried, "v", written.withColumn("needle", F.explode(F.array_distinct(F.array("kw", "together")))), "needle")
    inside = F.col("v").contains(F.col("kw")) & (F.col("v").startswith(F.col("kw")) | F.expr(r"v rlike concat('\\b\\Q', kw, '\\E\\b')") | ((F.length("kw") >= COMPOUND) & F.expr(r"v rlike concat('\\b\\Q', kw, '\\E')")))
    met = met.filter(inside | F.col("v").startswith(F.col("together")))
    return met.groupBy(column).agg(F.min(F.struct("variant", "lender_ord", "kw_ord", "lender", "kw")).alias("m")).select(column, F.col("m.lender").alias("lender"), F.col("m.kw").alias("keyword"))


def description(ledger: DataFrame) -> Column:
    """The description, or where it is empty all other values of the row."""
    others = [c for c in ("Date", "Debit", "Credit", "Amount", "Balance", "Section", "Raw Line") if c in ledger.columns]
    return F.when(F.trim("Description") != "", F.trim("Description")).otherwise(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in others]))


def looks_like_funding(text: Column, keyword: Column) -> Column:
    """The lender's name comes first, with a batch number or a date, and nothing says repayment."""
    upper = F.upper(text)
    return ~matches(upper, DEBIT_ONLY) & F.ltrim(upper).startswith(keyword) & (text.rlike(r"\d{5,}") | text.rlike(r"\d{2}/\d{2}/\d{2,4}"))


def with_lender(ledger: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """Rows that name a lender, with desc, lender, keyword and the marks that decide their direction."""
    keywords = keywords if keywords is not None else dictionary(ledger.sparkSession)
    rows = ledger.withColumn("desc", description(ledger)).filter(F.length("desc") <= LONGEST)
    found = rows.join(detect(rows, "desc", keywords), "desc")
    upper = F.upper("desc")
    return found.withColumns({
        "always_credit": any_of(upper, ALWAYS_CREDIT), "always_debit": any_of(upper, ALWAYS_DEBIT), "skipped": any_of(upper, SKIPPED),
        "deposit": matches(upper, FUNDING_DEPOSIT), "funding": looks_like_funding(F.col("desc"), F.col("keyword")),
        "bounced": upper.contains("REFERENCE #") & any_of(upper, ["ACH ITEMS", "ACH DEBIT"]),
    })


def lender_debits(found: DataFrame) -> DataFrame:
    """statement, row_no, Date, desc, lender, keyword, amount of repayments; `found` from with_lender()."""
    kept = found.filter(F.when(F.col("always_debit"), ~F.col("bounced")).otherwise(~(F.col("always_credit") | F.col("deposit") | F.col("funding"))))
    debit, credit = money_of(found, "Debit"), money_of(found, "Credit")
    amount = F.when((debit <= 0) & F.col("always_debit"), credit).otherwise(debit)
    return kept.withColumn("amount", F.round(amount, 2)).filter(amount > 0).select("statement", "row_no", "Date", "desc", "lender", "keyword", "amount")


def lender_credits(found: DataFrame) -> DataFrame:
    """statement, row_no, Date, desc, lender, keyword, amount of advances; of rows alike in date, text and amount the first."""
    debit, credit = money_of(found, "Debit"), money_of(found, "Credit")
    amount = F.when(credit > 0, credit).when((debit > 0) & (F.col("always_credit") | F.col("deposit") | F.col("funding")), debit)
    rows = found.filter(~F.col("skipped") & ~F.col("always_debit")).withColumn("amount", F.round(amount, 2)).filter(amount > 0)
    first = F.row_number().over(Window.partitionBy("statement", "Date", "desc", "amount").orderBy("row_no"))
    return rows.withColumn("__first", first).filter("__first = 1").select("statement", "row_no", "Date", "desc", "lender", "keyword", "amount")


def payment_frequency(debits: DataFrame) -> DataFrame:
    """statement, lender, n, frequency, typical (median), paid: weekly if at least half of the gaps between dated payments are
    5 to 9 days, or there are fewer than two; monthly if half are 25 to 35; else other."""
    day = F.to_date(F.col("Date")) if dict(debits.dtypes)["Date"] != "string" else F.to_date(full_date(F.col("Date")))
    dated = debits.withColumn("__day", day)
    order = Window.partitionBy("statement", "lender").orderBy("__day", "row_no")
    gap = F.when(F.col("__day").isNotNull(), F.datediff("__day", F.lag("__day").over(order)))
    rows = dated.withColumn("__gap", gap)
    hits = lambda a, b: F.count_if(F.col("__gap").between(a, b)) * 2 >= F.count("__gap")
    frequency = F.when(F.count("__day") < 2, "weekly").when(hits(5, 9), "weekly").when(hits(25, 35), "monthly").otherwise("other")
    return rows.groupBy("statement", "lender").agg(F.count("*").alias("n"), frequency.alias("frequency"), F.median("amount").alias("typical"), total(F.col("amount")).alias("paid"))


def lender_monthly(debits: DataFrame) -> DataFrame:
    """payment_frequency and the monthly obligation: a weekly payment times the weeks of a month, else what was paid.

    The product is rounded in cents: 67.5 x 4.33 is a little under 292.275, though its digits say otherwise."""
    monthly = F.when(F.col("frequency") == "weekly", F.round(F.col("typical") * WEEKS_PER_MONTH * 100) / 100).otherwise(F.col("paid"))
    return payment_frequency(debits).withColumn("monthly", monthly)


def lender_list(debits: DataFrame, credits: DataFrame) -> DataFrame:
    """lender, keyword, amount, monthly_amount, statement, type of all lender rows; advances have no monthly amount."""
    monthly = lender_monthly(debits).select("statement", "lender", "monthly")
    paid = debits.join(monthly, ["statement", "lender"], "left").select("lender", "keyword", "amount", F.coalesce("monthly", F.lit(0.0)).alias("monthly_amount"), "statement", F.lit("debit").alias("type"))
    return paid.unionByName(credits.select("lender", "keyword", "amount", F.lit(0.0).alias("monthly_amount"), "statement", F.lit("credit").alias("type")))


def lender_breakdown(listed: DataFrame) -> DataFrame:
    """lender, total, share of the largest: a lender counts once a statement by its monthly amount, else by its rows."""
    by = listed.groupBy("lender", "statement").agg(F.max("monthly_amount").alias("m"), total(F.when(F.col("monthly_amount") <= 0, F.col("amount"))).alias("loose"))
    sums = by.groupBy("lender").agg(total(F.when(F.col("m") > 0, F.col("m")).otherwise(0.0) + F.col("loose")).alias("total"))
    return sums.withColumn("share_of_max", F.round(F.try_divide(F.col("total"), F.max("total").over(Window.partitionBy())), 6))


def top_lenders(debits: DataFrame, k: int = 8) -> DataFrame:
    """lender, total, last_date of the k lenders that were paid most."""
    sums = debits.groupBy("lender").agg(total(F.col("amount")).alias("total"), F.date_format(F.max("Date"), "yyyy-MM-dd").alias("last_date"))
    return sums.orderBy(F.desc("total"), "lender").limit(k)


def repair_direction(ledger: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """Rows that name a lender in description or raw line, moved to the side that their section or sign says.

    Lenders are looked for only in rows whose section or sign says another side; all others stay as they are, whoever they name."""
    keywords = keywords if keywords is not None else dictionary(ledger.sparkSession)
    debit, credit, amount, section = F.abs(money_of(ledger, "Debit")), F.abs(money_of(ledger, "Credit")), money_of(ledger, "Amount"), F.upper("Section")
    only_credit, only_debit = (credit > 0) & (debit == 0), (debit > 0) & (credit == 0)
    to_debit = only_credit & ((section == "DEBIT") | ((section != "CREDIT") | ~only_debit) & (amount < 0))
    to_credit = only_debit & (section == "CREDIT")
    astray = F.coalesce(to_debit, F.lit(False)) | F.coalesce(to_credit, F.lit(False))
    text = F.concat_ws(" ", "Description", "`Raw Line`")
    rows = ledger.filter(astray).withColumn("__text", text)
    rows = rows.join(detect(rows, "__text", keywords).select("__text", F.lit(True).alias("__lender")), "__text", "left")
    moved = F.when(F.col("__lender") & to_debit, F.struct(credit.alias("d"), F.lit(0.0).alias("c"), (-credit).alias("a"))).when(F.col("__lender") & to_credit, F.struct(F.lit(0.0).alias("d"), debit.alias("c"), debit.alias("a")))
    rows = rows.withColumn("__m", moved).withColumns({"Debit": F.coalesce("__m.d", money_of(ledger, "Debit")), "Credit": F.coalesce("__m.c", money_of(ledger, "Credit")), "Amount": F.coalesce("__m.a", amount)}).drop("__m", "__text", "__lender")
    return ledger.filter(~astray).withColumns({"Debit": money_of(ledger, "Debit"), "Credit": money_of(ledger, "Credit"), "Amount": amount}).unionByName(rows)


def is_false_lender(text: Column) -> Column:
    """The first name that only looks like a lender's, else null."""
    clean = clean_text(text)
    return F.coalesce(*[F.when(clean.rlike(rf"\b{w}\b"), F.lit(w)) for w in FALSE_LENDERS])


def apply_saved_keywords(ledger: DataFrame, saved: DataFrame) -> DataFrame:
    """saved(name, type) against a ledger: a row for every keyword found in a description whose side has an amount; one transaction may count for several.

    All keywords count, whatever their case and number; blank names are found nowhere. Each distinct description is searched once."""
    side = F.when(F.col("type") == "debit", F.col("Debit")).otherwise(F.col("Credit"))
    rows = ledger.withColumn("__text", F.lower("Description"))
    found = containing(rows.select("__text").distinct(), "__text", saved.select("name", "type", F.lower("name").alias("__needle")), "__needle")
    met = rows.join(found, "__text").filter(side > 0)
    return met.select("statement", "row_no", "Description", F.col("name").alias("keyword"), "type", F.round(side, 2).alias("amount"))


def add_keyword(saved: DataFrame, new: DataFrame) -> DataFrame:
    """saved with those of new(name, type) whose name and type, whatever their case, it lacks."""
    key = lambda c: F.lower(F.trim(c))
    n = new.filter(F.trim("name") != "").dropDuplicates(["name", "type"]).select(F.col("name").alias("n"), F.col("type").alias("t"))
    fresh = n.join(saved, (key(F.col("n")) == key(F.col("name"))) & (F.lower("t") == F.lower("type")), "left_anti")
    return saved.select("name", "type").unionByName(fresh.select(F.col("n").alias("name"), F.col("t").alias("type")))


def remove_keyword(saved: DataFrame, gone: DataFrame) -> DataFrame:
    """saved without gone(name, type), whatever their case."""
    g = gone.select(F.lower("name").alias("n"), F.lower("type").alias("t"))
    return saved.join(g, (F.lower("name") == F.col("n")) & (F.lower("type") == F.col("t")), "left_anti").select("name", "type")
