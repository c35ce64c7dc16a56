"""Row parsers: lines of a statement to (statement, line_no, Date, Description, Debit, Credit, Amount, Balance, Section)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.money import clean_money, let
from ..functions.text import any_of, has_word, quoted, squeezed, tidied
from .lines import block_of, carried, coming, merged, once, seen

_DATED = r"^(\d{1,2}/\d{1,2}(?:/\d{2,4})?)\s+(.*)$"


def _tidy(lines: DataFrame) -> DataFrame:
    """Lines with white space squeezed, empty ones gone, and `upper`."""
    rows = lines.select("statement", "line_no", tidied(F.col("line")).alias("line")).filter(F.col("line") != "")
    return rows.withColumn("upper", F.upper("line"))


def _amounts(text: Column, pattern: str = L.MONEY, signed: bool = False, zeros: bool = False) -> Column:
    """Amounts of a text in order, those of 0 only if asked for."""
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda x: clean_money(x) if signed else F.abs(clean_money(x)))
    return found if zeros else F.filter(found, lambda x: x != 0)


def _second_last(amounts: Column) -> Column:
    return F.when(F.size(amounts) >= 2, F.try_element_at(amounts, F.lit(-2))).otherwise(F.try_element_at(amounts, F.lit(-1)))


def _before_last(text: Column, pattern: str) -> Column:
    """The text before the last match of a pattern."""

    def cut(token: Column) -> Column:
        return F.substring(text, F.lit(1), F.length(text) - F.instr(F.reverse(text), F.reverse(token)) - F.length(token) + 1)

    return squeezed(let(F.try_element_at(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.lit(-1)), cut))


def _rows(rows: DataFrame, date: Column, description: Column, amount: Column, section: Column, balance: Column | None = None, raw: bool = True) -> DataFrame:
    """The parsers' output; section Debit or Credit places the amount, without one its sign does."""
    flat = rows.select("statement", "line_no", date.alias("Date"), description.alias("Description"), amount.alias("a"), F.coalesce(section, F.lit("")).alias("Section"), (F.coalesce(balance, F.lit(0.0)) if balance is not None else F.lit(0.0)).alias("Balance"), (F.col("line") if raw else F.lit("")).alias("Raw Line")).filter(F.col("a").isNotNull())
    debit = (F.col("Section") == "Debit") | ((F.col("Section") == "") & (F.col("a") < 0))
    size = F.round(F.abs("a"), 2)
    flat = flat.withColumns({"Debit": F.when(debit, size).otherwise(0.0), "Credit": F.when(debit, 0.0).otherwise(size)})
    return flat.select("statement", "line_no", "Date", "Description", "Debit", "Credit", F.round(F.col("Credit") - F.col("Debit"), 2).alias("Amount"), F.round("Balance", 2).alias("Balance"), "Section", "Raw Line")


def universal(lines: DataFrame) -> DataFrame:
    """Any bank whose rows begin with a date: savings parts dropped, sections carried over every line (debit words first),
    continuation lines joined; of two or more amounts the last is the balance, the one before it the amount."""
    rows = lines.select("statement", "line_no", F.trim("line").alias("line")).filter("line <> ''").withColumns({"lower": F.lower("line"), "upper": F.upper("line")})
    savings, checking = any_of(F.col("lower"), L.SAVINGS_SECTION_KEYWORDS), any_of(F.col("lower"), L.CHECKING_SECTION_KEYWORDS)
    rows = rows.withColumn("account", carried(F.when(savings, "savings").when(checking, "checking"))).filter(~savings & (F.coalesce("account", F.lit("checking")) != "savings"))
    section = F.when(any_of(F.col("upper"), L.DEBIT_SECTION_WORDS), "Debit").when(any_of(F.col("upper"), L.CREDIT_SECTION_WORDS), "Credit")
    rows = rows.withColumn("section", carried(section)).filter(~any_of(F.col("upper"), L.SKIP_LINE_KEYWORDS))
    blocks = merged(rows.withColumn("block", block_of(F.col("line").rlike("(?i)" + L.DATE_START))), "section")
    date = F.regexp_extract("line", "(?i)" + L.DATE_START, 1)
    blocks = blocks.withColumn("date", date).withColumn("rest", F.expr("trim(substring(line, length(date) + 1))"))
    blocks = once(blocks, "amounts", _amounts(F.col("rest"), signed=True)).filter(F.size("amounts") > 0)
    balance = F.when(F.size("amounts") >= 2, F.try_element_at("amounts", F.lit(-1)))
    return _rows(blocks, F.col("date"), _before_last(F.col("rest"), L.MONEY), _second_last(F.col("amounts")), F.col("section"), balance)


def simple(lines: DataFrame) -> DataFrame:
    """One row a line: credit words then debit words set the section; excluded words zero a positive amount."""
    rows = lines.select("statement", "line_no", F.trim("line").alias("line")).filter("line <> ''").withColumns({"lower": F.lower("line"), "upper": F.upper("line")})
    savings, checking = any_of(F.col("lower"), L.SAVINGS_SECTION_KEYWORDS), any_of(F.col("lower"), L.CHECKING_SECTION_KEYWORDS)
    rows = rows.withColumn("account", carried(F.when(checking, "checking").when(savings, "savings"))).filter(~savings & ~checking & (F.coalesce("account", F.lit("checking")) != "savings"))
    rows = rows.withColumn("section", carried(F.when(any_of(F.col("upper"), L.OCR_DEBIT_WORDS), "Debit").when(any_of(F.col("upper"), L.OCR_CREDIT_WORDS), "Credit")))
    row = "(?i)" + L.OCR_ROW
    rows = rows.filter(F.col("line").rlike(row)).withColumn("amount", F.abs(clean_money(F.regexp_extract("line", row, 3))))
    excluded = any_of(F.col("lower"), L.EXCLUDED_REVENUE_WORDS) & (F.coalesce("section", F.lit("")) != "Debit")
    side = F.when(F.col("section") == "Debit", "Debit").otherwise("Credit")
    return _rows(rows, F.regexp_extract("line", row, 1), F.trim(F.regexp_extract("line", row, 2)), F.when(excluded, 0.0).otherwise(F.col("amount")), side)


def chase(lines: DataFrame) -> DataFrame:
    """Headers may follow their rows: a block's section is the last header before it, else the first after it, else by its words."""
    rows = _tidy(lines).filter(~F.col("line").startswith("*"))
    rows = rows.withColumn("stop", seen(F.col("upper").rlike(L.CHASE_STOP))).filter("not stop")
    header = F.when(F.col("upper").rlike(f"^({quoted(L.CHASE_CREDIT_HEADERS)})"), "Credit").when(F.col("upper").rlike(f"^({quoted(L.CHASE_DEBIT_HEADERS)})"), "Debit")
    dated = F.col("line").rlike(_DATED)
    rows = rows.withColumn("header", header).withColumn("dated", dated & F.col("header").isNull())
    rows = rows.withColumns({"before": carried(F.col("header")), "after": coming(F.col("header"))})
    rows = rows.filter(~(F.col("dated") & F.col("line").rlike(L.CHASE_BALANCE_ROW)) & ~(~F.col("dated") & F.col("header").isNull() & F.col("line").rlike("(?i)" + L.CHASE_SKIP)))
    rows = rows.withColumn("block", block_of(F.col("dated") | F.col("header").isNotNull()))
    blocks = merged(rows, "dated", "before", "after").filter("dated")
    text = F.regexp_extract("line", "(?s)" + _DATED, 2)
    amounts = _amounts(text)
    section = F.coalesce("before", "after", F.when(F.col("line").rlike("(?i)" + L.CHASE_CREDIT), "Credit").otherwise("Debit"))
    return _rows(blocks, F.regexp_extract("line", _DATED, 1), F.trim(F.regexp_replace(F.regexp_replace(text, L.MONEY, ""), r"\s{2,}", " ")), F.try_element_at(amounts, F.lit(-1)), section, raw=False)


def capital_one(lines: DataFrame) -> DataFrame:
    """Rows from the account detail to its totals; words tell the side, the last of two amounts is the balance.

    A row whose amount is 0 gives nothing; its balance isn't taken for one."""
    rows = _tidy(lines)
    begins = F.col("upper").contains("ACCOUNT DETAIL")
    rows = rows.withColumn("begins", begins).withColumn("on", seen(begins)).filter("on")
    rows = rows.withColumn("off", seen(F.col("line").rlike(r"(?i)^Total\s+\$[\d,]+\.\d{2}"))).filter("not off")
    rows = rows.filter(F.col("begins") | ~F.col("line").rlike("(?i)" + L.CAPITAL_ONE_SKIP)).withColumn("dated", F.col("line").rlike(r"^\d{2}/\d{2}\s+.+$") & ~F.col("begins"))
    blocks = merged(rows.withColumn("block", block_of(F.col("dated") | F.col("begins"))), "dated").filter("dated")
    text = F.regexp_extract("line", r"^\d{2}/\d{2}\s+(.+)$", 1)
    blocks = blocks.withColumn("amounts", _amounts(text, r"[\d,]+\.\d{2}", zeros=True)).withColumn("moved", _second_last(F.col("amounts"))).filter("moved > 0")
    side = F.when(text.rlike("(?i)" + L.CAPITAL_ONE_CREDIT), "Credit").otherwise("Debit")
    balance = F.when(F.size("amounts") >= 2, F.try_element_at("amounts", F.lit(-1)))
    return _rows(blocks, F.substring("line", 1, 5), F.trim(F.regexp_replace(F.regexp_replace(text, L.CAPITAL_ONE_AMOUNT, ""), r"\s{2,}", " ")), F.col("moved"), side, balance, raw=False)


def bank_of_america(lines: DataFrame) -> DataFrame:
    """One row a line under a section label, which may stand anywhere in a line; of two amounts the one before the last."""
    rows = _tidy(lines)
    label = F.coalesce(*[F.when(F.col("upper").contains(w), F.lit(s)) for w, s in L.BOFA_HEADERS])
    rows = rows.withColumn("section", carried(label)).filter(F.col("section").isNotNull() & F.col("line").rlike(_DATED))
    rest = F.trim(F.regexp_extract("line", _DATED, 2))
    rows = rows.withColumn("rest", rest).withColumn("amounts", _amounts(rest))
    description = F.when(F.size("amounts") >= 2, let(_before_last(F.col("rest"), L.MONEY), lambda x: _before_last(x, L.MONEY))).otherwise(_before_last(F.col("rest"), L.MONEY))
    return _rows(rows.filter(F.size("amounts") > 0), F.regexp_extract("line", _DATED, 1), description, _second_last(F.col("amounts")), F.col("section"))


def td_bank(lines: DataFrame, year: Column) -> DataFrame:
    """Rows of the daily account activity by section; a block of checks holds several, each a row; dates get the statement's year."""
    rows = _tidy(lines)
    switch = F.when(F.col("upper").rlike(L.TD_ON), "on").when(F.col("upper").rlike(L.TD_OFF), "off")
    dated = F.col("line").rlike(r"^\d{2}/\d{2}\s?")
    header = F.when(~dated & F.col("upper").rlike(L.TD_CREDIT_HEADER), "Credit").when(~dated & F.col("upper").rlike(L.TD_DEBIT_HEADER), "Debit")
    # what a line says by itself goes before the windows, which then carry less and are two
    period = F.nullif(F.regexp_extract("line", r"Statement\s*Period:.*?\d{4}", 0), F.lit(""))
    rows = rows.withColumns({"switch": switch, "header": header, "period": F.when(period.isNotNull(), F.col("line"))})
    rows = rows.withColumns({"dated": dated & F.col("switch").isNull(), "noise": F.col("header").isNull() & F.col("switch").isNull() & F.col("line").rlike("(?i)" + L.TD_NOISE)}).drop("upper")
    whole = Window.partitionBy("statement").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"state": carried(F.col("switch")), "period": F.max("period").over(whole)})
    rows = rows.filter(((F.col("state") == "on") & F.col("switch").isNull() | (F.col("switch") == "off")) & ~F.col("noise"))
    rows = rows.withColumns({"section": carried(F.col("header")), "block": block_of(F.col("dated") | F.col("header").isNotNull() | F.col("switch").isNotNull())}).filter("section IS NOT NULL")
    printed = F.nullif(F.regexp_extract("period", r"Statement\s*Period:.*?(\d{4})", 1), F.lit(""))
    blocks = merged(rows.withColumn("year", F.coalesce(printed, year.cast("string"))), "dated", "section", "year").filter("dated")
    first = F.element_at("lines", 1)
    blocks = blocks.withColumn("found", F.when(F.col("section") == "Debit", F.regexp_extract_all("line", F.lit(L.TD_CHECKS), 0)))
    checks = F.when((F.size("found") >= 2) | (F.size("found") > 0) & first.rlike("^" + L.TD_CHECKS), F.col("found"))
    # a block without checks is one row of all its lines
    pieces = blocks.withColumn("checks", checks).select("statement", "line_no", "section", "year", "lines", F.col("checks").isNotNull().alias("check"), F.explode(F.coalesce("checks", F.array("line"))).alias("line"))
    part = lambda k: F.regexp_extract("line", L.TD_CHECKS, k)
    tail = r"\s+[\d,]+\.\d{2}\s*$"
    head = F.trim(F.regexp_replace(F.regexp_replace(first, r"^\d{2}/\d{2}\s+", ""), r"\s*[\d,]+\.\d{2}\s*$", ""))
    more = F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda x: ~x.rlike(r"^\d{12,20}$"))
    text = F.trim(F.regexp_replace(F.trim(F.concat_ws(" ", head, F.array_join(more, " "))), tail, ""))
    said = lambda check, other: F.when(F.col("check"), check).otherwise(other)
    amount = said(clean_money(part(3)), F.try_element_at(_amounts(F.col("line"), r"[\d,]+\.\d{2}"), F.lit(-1)))
    return _rows(pieces, F.concat_ws("/", said(part(1), F.substring("line", 1, 5)), "year"), said(F.concat(F.lit("Check #"), part(2)), text), amount, F.col("section"), raw=False)


def regions(lines: DataFrame) -> DataFrame:
    """One row a line under an upper-case header."""
    rows = lines.select("statement", "line_no", F.trim(F.regexp_replace("line", "[ \t]+", " ")).alias("line")).filter("line <> ''")
    header = F.when(F.col("line").rlike(L.REGIONS_CREDIT_HEADER), "Credit").when(F.col("line").rlike(L.REGIONS_DEBIT_HEADER), "Debit")
    rows = rows.withColumn("header", header).withColumn("section", carried(F.col("header")))
    rows = rows.filter(F.col("header").isNull() & F.col("section").isNotNull() & ~F.col("line").rlike("(?i)" + L.REGIONS_STOP) & F.col("line").rlike(L.REGIONS_ROW))
    part = lambda k: F.regexp_extract("line", L.REGIONS_ROW, k)
    return _rows(rows.withColumn("amount", F.abs(clean_money(part(3)))).filter("amount > 0"), part(1), F.trim(part(2)), F.col("amount"), F.col("section"), raw=False)


def charges(lines: DataFrame) -> DataFrame:
    """statement, line_no, date, description, amount of the rows between `Checks and charges` and the check summary."""
    rows = _tidy(lines)
    switch = F.when(F.col("upper").contains("CHECKS AND CHARGES"), True).when(F.col("upper").contains("SUMMARY BY CHECK NUMBER"), False)
    rows = rows.withColumn("switch", switch).withColumn("on", carried(F.col("switch")))
    rows = rows.filter(F.col("on") & F.col("switch").isNull() & ~F.col("upper").contains("CHECK #") & F.col("line").rlike(L.CHARGE_ROW))
    part = lambda k: F.regexp_extract("line", L.CHARGE_ROW, k)
    return rows.select("statement", "line_no", part(1).alias("date"), part(2).alias("description"), F.abs(clean_money(part(3))).alias("amount"))


def flagged(lines: DataFrame) -> DataFrame:
    """statement, line_no, keyword, line, amount (the line's first, or 0) of lines that name a payment processor."""
    upper = F.upper("line")
    rows = lines.withColumn("keyword", F.coalesce(*[F.when(has_word(upper, w), F.lit(w)) for w in L.FLAGGED])).filter(F.col("keyword").isNotNull())
    return rows.select("statement", "line_no", "keyword", F.trim("line").alias("line"), F.abs(clean_money(F.regexp_extract("line", f"({L.MONEY})", 1))).alias("amount"))


def first_found(*parsed: DataFrame) -> DataFrame:
    """Rows of each statement from the first parser that found any."""
    rows = parsed[0].withColumn("__k", F.lit(0))
    for k, more in enumerate(parsed[1:], 1):
        rows = rows.unionByName(more.withColumn("__k", F.lit(k)))
    return rows.withColumn("__first", F.min("__k").over(Window.partitionBy("statement"))).filter("__k = __first").drop("__k", "__first")
