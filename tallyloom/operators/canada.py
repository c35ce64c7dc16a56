"""Rows of Canadian statements: tables, words and text of TD Canada and RBC."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.money import clean_money
from ..functions.text import any_of
from .folds import folded
from .lines import dealt

_MONEY = r"\d{1,3}(?:,\d{3})*\.\d{2}"
_AMOUNT = r"[\d,]+\.\d{2}"
_CREDIT, _DEBIT, _MERCHANT = (re.compile(p, re.IGNORECASE) for p in (L.RBC_CREDIT, L.RBC_DEBIT, L.RBC_MERCHANT))
_ROWS = "statement", "page", "row_no", "part", "Date", "Description", "Debit", "Credit"


def statement_year(pages: DataFrame, otherwise: Column) -> DataFrame:
    """statement, year: of the first `/yy -` in page order of pages(statement, page, text), else the given one."""
    yy = F.nullif(F.regexp_extract("text", r"/(\d{2})\s*[-–]", 1), F.lit(""))
    return pages.groupBy("statement").agg(F.coalesce(F.min_by(F.concat(F.lit("20"), yy).cast("int"), F.when(yy.isNotNull(), F.col("page"))), otherwise).alias("year"))


def month_day(text: Column, year: Column) -> Column:
    """yyyy-MM-dd of the first `OCT10` or `Oct 10` in a text, null without one; a month of no such name is January."""
    name, day = F.upper(F.regexp_extract(text, r"(?i)([A-Z]{3})\s*(\d{1,2})", 1)), F.regexp_extract(text, r"(?i)([A-Z]{3})\s*(\d{1,2})", 2)
    months = F.array(*[F.lit(m[:3].upper()) for m in L.MONTHS])
    number = F.greatest(F.array_position(months, name), F.lit(1)).cast("string")
    return F.when(day != "", F.concat_ws("-", year.cast("string"), F.lpad(number, 2, "0"), F.lpad(day, 2, "0")))


def _transaction(text: Column) -> Column:
    upper = F.upper(text)
    return F.when(upper.rlike(L.TD_CANADA_CREDIT), "credit").when(upper.rlike(L.TD_CANADA_DEBIT), "debit").otherwise("unknown")


def td_tables(cells: DataFrame, years: DataFrame) -> DataFrame:
    """Ledger rows of cells(statement, page, table_no, row, col, text), by the columns that a table's first row with CHEQUE and DEPOSIT names.

    A row with both amounts is two, the credit first; two lines of description are dealt to them by what they say.
    Tables without such a header, rows without description, date or amount give nothing. One shuffle, by statement."""
    key = "statement", "page", "table_no"
    text = F.coalesce("text", F.lit(""))
    rows = dealt(cells).groupBy(*key, "row").agg(F.array_sort(F.collect_list(F.struct("col", text.alias("text")))).alias("c"))
    said = F.upper(F.array_join("c.text", " "))
    names = F.when(said.contains("CHEQUE") & said.contains("DEPOSIT"), F.col("c"))
    rows = rows.withColumn("h", F.first(names, ignorenulls=True).over(Window.partitionBy(*key).orderBy("row").rowsBetween(Window.unboundedPreceding, -1))).filter("h IS NOT NULL")

    def place(of) -> Column:
        return F.array_min(F.transform(F.filter("h", lambda x: of(F.upper(x["text"]))), lambda x: x["col"]))

    debit = lambda t: ~t.contains("DESCRIPTION") & (t.contains("CHEQUE") | (t.contains("DEBIT") & ~t.contains("CREDIT")))
    rows = rows.withColumns({
        "description_at": F.coalesce(place(lambda t: t.contains("DESCRIPTION")), F.lit(0)), "debit_at": place(debit),
        "credit_at": place(lambda t: ~t.contains("DESCRIPTION") & ~debit(t) & (t.contains("DEPOSIT") | t.contains("CREDIT"))), "date_at": place(lambda t: F.trim(t) == "DATE"),
    }).filter("debit_at IS NOT NULL AND credit_at IS NOT NULL")
    at = lambda c: F.coalesce(F.trim(F.try_element_at(F.filter("c", lambda x: x["col"] == F.col(c)), F.lit(1))["text"]), F.lit(""))
    money = lambda c: clean_money(F.regexp_extract(at(c), _MONEY, 0))
    rows = rows.withColumns({"text": at("description_at"), "d": money("debit_at"), "c_": money("credit_at"), "said": at("date_at")})
    rows = rows.join(years, "statement").withColumn("Date", month_day(F.col("said"), F.col("year")))
    rows = rows.filter(F.col("Date").isNotNull() & (F.col("text") != "") & ~F.col("text").rlike(L.TD_CANADA_SKIP) & (F.col("d") + F.col("c_") > 0))
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first, second, rest = F.element_at("parts", 1), F.try_element_at("parts", F.lit(2)), F.slice("parts", F.lit(3), F.greatest(F.size("parts") - 2, F.lit(0)))
    swapped = (_transaction(first) == "debit") | (_transaction(second) == "credit")
    both, two = (F.col("d") > 0) & (F.col("c_") > 0), F.size("parts") > 1
    credit_text = F.when(both & two, F.when(swapped, second).otherwise(first)).otherwise(F.col("text"))
    debit_text = F.when(both & two, F.array_join(F.concat(F.array(F.when(swapped, first).otherwise(second)), rest), " ")).otherwise(F.col("text"))
    side = lambda k, text, d, c: F.struct(F.lit(k).alias("part"), text.alias("Description"), d.alias("Debit"), c.alias("Credit"))
    sides = F.filter(F.array(side(0, credit_text, F.lit(0.0), F.col("c_")), side(1, debit_text, F.col("d"), F.lit(0.0))), lambda s: s["Debit"] + s["Credit"] > 0)
    return rows.withColumn("parts", parts).select("statement", "page", F.col("row").alias("row_no"), "Date", F.inline(sides)).select(*_ROWS)


def td_words(words: DataFrame, years: DataFrame, reach: float = 3.0) -> DataFrame:
    """Ledger rows of words(statement, page, text, x0, x1, top): the page's first line with CHEQUE, DEBIT and DEPOSIT places the columns.

    A line takes the words that begin at most `reach` below its first. Amounts left of the columns' middle are debits,
    right of it credits, from the date column on balances; the last amount of a side counts. Pages bound every group."""
    key = "statement", "page"
    tops = dealt(words).groupBy(*key).agg(F.array_sort(F.collect_set(F.col("top").cast("double"))).alias("t"), F.collect_list(F.struct(F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), F.col("top").cast("double").alias("top"), "text")).alias("w"))
    begins = F.aggregate("t", F.array().cast("array<double>"), lambda a, t: F.when((F.size(a) == 0) | (t - F.try_element_at(a, F.lit(-1)) > reach), F.concat(a, F.array(t))).otherwise(a))
    word = tops.withColumn("begins", begins).select(*key, "begins", F.inline("w"))
    lines = word.withColumn("top", F.array_max(F.filter("begins", lambda b: b <= F.col("top"))))
    lines = lines.groupBy(*key, "top").agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("w"))
    said = F.upper(F.array_join("w.text", " "))
    head = F.when(said.contains("CHEQUE") & said.contains("DEBIT") & said.contains("DEPOSIT"), F.col("w"))
    lines = lines.withColumn("h", F.first(head, ignorenulls=True).over(Window.partitionBy(*key).orderBy("top").rowsBetween(Window.unboundedPreceding, -1))).filter("h IS NOT NULL")
    centre = lambda x: (x["x0"] + x["x1"]) / 2
    column = lambda of: F.try_element_at(F.transform(F.filter("h", lambda x: of(F.upper(x["text"]))), centre), F.lit(1))
    lines = lines.withColumns({"debit_x": column(lambda t: t.contains("CHEQUE")), "credit_x": column(lambda t: t.contains("DEPOSIT") & ~t.contains("CHEQUE")), "date_x": column(lambda t: t == "DATE")}).filter("debit_x IS NOT NULL AND credit_x IS NOT NULL")
    middle, end = (F.col("debit_x") + F.col("credit_x")) / 2, F.coalesce("date_x", F.lit(float("inf")))
    is_date, is_money = (lambda x: x["text"].rlike(r"(?i)^[A-Z]{3}\d{1,2}$")), (lambda x: x["text"].rlike(rf"^{_MONEY}$"))
    amount = lambda on: F.coalesce(clean_money(F.try_element_at(F.filter("w", lambda x: is_money(x) & on(centre(x))), F.lit(-1))["text"]), F.lit(0.0))
    text = F.trim(F.array_join(F.transform(F.filter("w", lambda x: ~is_date(x) & ~is_money(x) & (centre(x) < F.col("debit_x") - 5)), lambda x: x["text"]), " "))
    lines = lines.withColumns({"Description": text, "Debit": amount(lambda x: (x < end) & (x <= middle)), "Credit": amount(lambda x: (x < end) & (x > middle)), "said": F.try_element_at(F.filter("w", is_date), F.lit(-1))["text"]})
    rows = lines.join(years, "statement").withColumn("Date", month_day(F.col("said"), F.col("year")))
    rows = rows.filter(F.col("Date").isNotNull() & (F.col("Description") != "") & ~F.col("Description").rlike(L.TD_CANADA_SKIP) & (F.col("Debit") + F.col("Credit") > 0))
    return rows.withColumn("row_no", F.row_number().over(Window.partitionBy(*key).orderBy("top")).cast("long")).withColumn("part", F.lit(0)).select(*_ROWS)


def td_canada(pages: DataFrame, cells: DataFrame, words: DataFrame, otherwise: Column) -> DataFrame:
    """Each page's rows from its tables, or from its words if the tables give none."""
    years = statement_year(pages, otherwise)
    tables = td_tables(cells, years)
    rest = td_words(words.join(tables.select("statement", "page").distinct(), ["statement", "page"], "left_anti"), years)
    return tables.withColumn("row_no", F.col("row_no").cast("long")).unionByName(rest)


def rbc_words(words: DataFrame) -> DataFrame:
    """Ledger rows of words(statement, page, width, text, x0, x1, top), as td_words has them, with Balance.

    Words of one height of tens are a line; a day alone joins the line below if that begins with a month. The first line
    with CHEQUES and DEPOSITS places the columns, else shares 0.55, 0.72 and 0.88 of the width do. Dates carry on within a
    page; lines without an amount lend their text to the next, until a date or a skipped line. Pages bound every group."""
    key = "statement", "page"
    on_page = Window.partitionBy(*key).orderBy("y")
    lines = dealt(words).groupBy(*key, F.col("width").cast("double").alias("width"), F.bround(F.col("top") / 10).cast("long").alias("y"))
    lines = lines.agg(F.array_sort(F.collect_list(F.struct(F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), "text"))).alias("w"))
    months = "|".join(m[:3] for m in L.MONTHS)
    text_at = lambda k: F.coalesce(F.try_element_at("w", F.lit(k))["text"], F.lit(""))
    lines = lines.withColumns({"lone": (F.size("w") == 1) & text_at(1).rlike(r"^\d{1,2}$"), "month": text_at(1).rlike(f"(?i)^({months})$")})
    lines = lines.withColumns({"above": F.when(F.lag("lone").over(on_page) & F.col("month"), F.lag("w").over(on_page)), "taken": F.col("lone") & F.coalesce(F.lead("month").over(on_page), F.lit(False))})
    lines = lines.filter(~F.col("taken")).withColumn("w", F.when(F.col("above").isNotNull(), F.concat("above", "w")).otherwise(F.col("w")))
    said = F.upper(F.array_join("w.text", " "))
    lines = lines.withColumn("head", said.contains("CHEQUES") & said.contains("DEPOSITS"))
    lines = lines.withColumn("h", F.first(F.when(F.col("head"), F.struct("y", "w")), ignorenulls=True).over(Window.partitionBy(*key).orderBy("y").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    centre = lambda x: (x["x0"] + x["x1"]) / 2
    column = lambda of: F.try_element_at(F.transform(F.filter(F.col("h.w"), of), centre), F.lit(1))
    lines = lines.withColumns({"dx": column(lambda x: F.upper(x["text"]).contains("CHEQUES")), "cx": column(lambda x: F.upper(x["text"]).contains("DEPOSITS")), "bx": column(lambda x: F.upper(x["text"]).contains("BALANCE") & (x["x0"] > F.col("width") * 0.5))})
    placed = F.col("dx").isNotNull() & F.col("cx").isNotNull()
    lines = lines.withColumns({"dx": F.when(placed, F.col("dx")).otherwise(F.col("width") * 0.55), "cx": F.when(placed, F.col("cx")).otherwise(F.col("width") * 0.72), "bx": F.coalesce(F.when(placed, F.col("bx")), F.col("width") * 0.88)})
    lines = lines.filter(F.col("h").isNull() | (F.col("h.y") != F.col("y")))
    once = F.when(text_at(1).rlike(r"^(?:(.)\1)+$"), F.regexp_replace(text_at(1), r"(.)\1", "$1")).otherwise(text_at(1))
    lines = lines.withColumn("once", once)
    apart = F.col("once").rlike(r"^\d{1,2}$") & text_at(2).rlike(f"(?i)^({months})$")
    joined = rf"(?i)^(\d{{1,2}})({months})(.*)$"
    day = F.when(apart, F.concat_ws(" ", "once", text_at(2))).when(F.col("once").rlike(joined), F.concat_ws(" ", F.regexp_extract("once", joined, 1), F.initcap(F.regexp_extract("once", joined, 2))))
    dropped = F.when(apart, 2).when(F.col("day").isNotNull(), 1).otherwise(0)
    lines = lines.withColumn("day", day).withColumns({"rest": F.slice("w", dropped + 1, F.greatest(F.size("w") - dropped, F.lit(0))), "stuck": F.when(F.col("day").isNotNull() & ~apart, F.regexp_extract("once", joined, 3)).otherwise("")})
    is_money = lambda x: x["text"].rlike(rf"^-?\$?{_AMOUNT}$") & (centre(x) >= F.least("dx", "cx") - 40)
    side = lambda on: F.coalesce(F.abs(clean_money(F.try_element_at(F.filter("rest", lambda x: is_money(x) & (clean_money(x["text"]) != 0) & on(centre(x))), F.lit(-1))["text"])), F.lit(0.0))
    nearer = lambda x: F.abs(x - F.col("dx")) <= F.abs(x - F.col("cx"))
    text = F.trim(F.concat_ws(" ", F.nullif("stuck", F.lit("")), F.array_join(F.transform(F.filter("rest", lambda x: ~is_money(x)), lambda x: x["text"]), " ")))
    before = F.col("bx") - 30
    lines = lines.withColumns({"said": text, "Debit": side(lambda x: (x < before) & nearer(x)), "Credit": side(lambda x: (x < before) & ~nearer(x)), "Balance": side(lambda x: x >= before), "Date": F.last("day", ignorenulls=True).over(on_page)})
    lines = lines.filter("Date IS NOT NULL").withColumns({"skipped": F.lower("said").rlike(L.RBC_SKIP), "paid": F.col("Debit") + F.col("Credit") + F.col("Balance") > 0})
    # texts that wait for an amount: those since the last amount, date or skipped line
    ends = F.coalesce(F.lag((F.col("paid") | F.col("skipped")).cast("int")).over(on_page), F.lit(1))
    begins = F.when(F.col("day").isNotNull() | F.col("skipped"), 1).otherwise(ends)
    lines = lines.withColumn("run", F.sum(begins).over(on_page))
    waiting = F.array_join(F.filter(F.collect_list("said").over(Window.partitionBy(*key, "run").orderBy("y")), lambda x: x != ""), " ")
    rows = lines.withColumn("Description", waiting).filter(~F.col("skipped") & (F.col("Debit") + F.col("Credit") > 0))
    return rows.withColumns({"row_no": F.row_number().over(on_page).cast("long"), "part": F.lit(0)}).select(*_ROWS, "Balance")


def rbc_tables(cells: DataFrame) -> DataFrame:
    """Ledger rows of cells(statement, page, table_no, row, col, text), as rbc_words has them, of tables with a row that names CHEQUES and DEPOSITS.

    The first such row names the columns; one that it doesn't name is taken by position. Dates carry on within a table,
    rows before the first, without an amount, or of balances and fees give nothing; tables of fewer than three rows neither.
    Cells may have been cut in several ways (attempt): of each page the first that yields rows counts. One shuffle, by statement."""
    cells = cells if "attempt" in cells.columns else cells.withColumn("attempt", F.lit(0))
    table, of_table = ("statement", "page", "attempt", "table_no"), Window.partitionBy("statement", "page", "attempt", "table_no")
    rows = dealt(cells).groupBy(*table, "row").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("text")))).alias("c"))
    said = F.upper(F.array_join("c.text", " "))
    head = F.min(F.when(said.contains("CHEQUES") & said.contains("DEPOSITS"), F.struct("row", "c"))).over(of_table)
    rows = rows.withColumns({"n": F.count("*").over(of_table), "h": head}).filter("n >= 3 AND row > h.row")

    def place(word: str, otherwise: int) -> Column:
        named = F.array_min(F.transform(F.filter("h.c", lambda x: F.upper(x["text"]).contains(word)), lambda x: x["col"]))
        return F.coalesce(named, F.when(F.element_at("h.c", -1)["col"] >= otherwise, F.lit(otherwise)))

    rows = rows.withColumns({f"{word}_at": place(word, k) for k, word in enumerate(("DATE", "DESCRIPTION", "CHEQUE", "DEPOSIT", "BALANCE"))})
    at = lambda word: F.coalesce(F.trim(F.try_element_at(F.filter("c", lambda x: x["col"] == F.col(f"{word}_at")), F.lit(1))["text"]), F.lit(""))
    money = lambda word: F.round(F.abs(clean_money(at(word))), 2)
    day = r"^(\d{1,2})\s+([A-Za-z]{3})\b"
    rows = rows.withColumns({"Description": F.trim(F.replace(at("DESCRIPTION"), F.lit("\n"), F.lit(" "))), "Debit": money("CHEQUE"), "Credit": money("DEPOSIT"), "Balance": money("BALANCE"), "said": at("DATE")})
    dated = F.when(F.col("said").rlike(day), F.concat_ws(" ", F.regexp_extract("said", day, 1), F.regexp_extract("said", day, 2)))
    rows = rows.withColumn("Date", F.last(dated, ignorenulls=True).over(of_table.orderBy("row").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter(F.col("Date").isNotNull() & (F.col("Debit") + F.col("Credit") > 0) & ~any_of(F.lower("Description"), L.RBC_TABLE_SKIP))
    rows = rows.withColumn("first", F.min("attempt").over(Window.partitionBy("statement", "page"))).filter("attempt = first")
    number = F.row_number().over(Window.partitionBy("statement", "page").orderBy("table_no", "row")).cast("long")
    return rows.withColumns({"row_no": number, "part": F.lit(0)}).select(*_ROWS, "Balance")


def rbc(cells: DataFrame, words: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of pages from their tables, of pages without such rows from their words, of statements without either from their lines (page null)."""
    tables = rbc_tables(cells)
    rest = rbc_words(words.join(tables.select("statement", "page").distinct(), ["statement", "page"], "left_anti"))
    found = tables.unionByName(rest)
    text = rbc_text(lines.join(found.select("statement").distinct(), "statement", "left_anti")).withColumnRenamed("line_no", "row_no")
    return found.unionByName(text.withColumn("part", F.lit(0)), allowMissingColumns=True)


class _Follow:
    """State of rbc_text: the balance, the text that waits for an amount, and whether an amount of digits may follow a merchant's payment."""

    def __init__(self, row: dict) -> None:
        self.balance, self.waiting, self.follows = 0.0, "", False

    def side(self, row: dict, text: str) -> tuple[str, float, float]:
        """Side (or none), amount, printed balance (or 0) of a row with amounts."""
        *_, last = amounts = row["amounts"]
        if len(amounts) > 1 and self.balance > 0:
            for name, sign in (("Debit", -1), ("Credit", 1)):
                if round(abs(self.balance + sign * amounts[-2] - last), 2) < 2:
                    return name, amounts[-2], last
        said = f"{text} {self.waiting}"
        return "Debit" if _DEBIT.search(said) else "Credit" if _CREDIT.search(said) else "", last, 0.0


def _follow(state: _Follow, row: dict) -> tuple[_Follow, dict | None]:
    """The next row's amount, side and balance: each depends on the balance that the row before left."""
    if row["opening"] >= 0:
        state.balance = row["opening"]
        return state, None
    state.follows = state.follows and not row["dated"]
    if not row["amounts"]:
        state.waiting, state.follows = row["rest"], bool(_MERCHANT.search(row["rest"]))
        return state, None
    text = row["text"] or state.waiting
    if state.follows and state.waiting and re.match(r"\d{6}", row["rest"]):
        side, amount, printed, text, state.follows = "Credit", row["amounts"][-1], 0.0, state.waiting, False
    else:
        side, amount, printed = state.side(row, text)
        state.follows = bool(_MERCHANT.search(text))
    if not side:
        state.waiting = text
        return state, None
    state.waiting = ""
    state.balance = printed or round(max(0.0, state.balance - amount) if side == "Debit" else state.balance + amount, 2)
    return state, {"statement": row["statement"], "line_no": row["line_no"], "Date": row["date"], "Description": text, "Debit": amount * (side == "Debit"), "Credit": amount * (side == "Credit"), "Balance": printed}


def rbc_text(lines: DataFrame) -> DataFrame:
    """Ledger rows of lines(statement, line_no, line): dated `5 Jan`, dates carry on; of several amounts the last is a
    balance if the balance before comes to it within 2 by the amount before it, which tells the side; else keywords tell
    it, debits before credits. A line of unknown side or without an amount lends its text to the next; an amount after
    digits under a merchant payment is its credit. Balance is 0 where none is printed; lines before a date give nothing.

    A statement's lines are folded in one pass; only the balance and the waiting text are carried."""
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    rows = lines.withColumn("line", line).filter("line <> ''")
    amounts = lambda c: F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"({_AMOUNT})"), 1), clean_money), lambda x: x > 0)
    opens = F.lower("line").rlike(r"opening\s*balance")
    rows = rows.withColumn("opening", F.when(opens, F.try_element_at(amounts(F.col("line")), F.lit(-1))))
    rows = rows.filter(F.col("opening").isNotNull() | ~(F.lower("line").rlike(L.RBC_SKIP) | F.col("line").rlike(r"^\d+ of \d+$")))
    pattern = rf"(?i)^(\d{{1,2}})\s*({'|'.join(m[:3] for m in L.MONTHS)})\s*(.*)"
    dated = F.col("line").rlike(pattern) & F.col("opening").isNull()
    rows = rows.withColumn("dated", dated).withColumn("rest", F.when(dated, F.regexp_extract("line", pattern, 3)).otherwise(F.col("line")))
    day = F.when(F.col("dated"), F.concat_ws(" ", F.regexp_extract("line", pattern, 1), F.initcap(F.regexp_extract("line", pattern, 2))))
    rows = rows.withColumn("date", F.last(day, ignorenulls=True).over(Window.partitionBy("statement").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter("date IS NOT NULL OR opening IS NOT NULL")
    text = F.trim(F.regexp_extract("rest", rf"^(.*?){_AMOUNT}", 1))
    rows = rows.select("statement", F.col("line_no").cast("long").alias("line_no"), F.coalesce("opening", F.lit(-1.0)).alias("opening"), "date", "dated", "rest", text.alias("text"), amounts(F.col("rest")).alias("amounts"))
    kind = dict(lines.dtypes)["statement"]
    return folded(rows, "statement", ["line_no"], _Follow, _follow, f"statement {kind}, line_no long, Date string, Description string, Debit double, Credit double, Balance double")
