"""Rows from words, boxes and cells on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.money import clean_money
from ..functions.text import squeezed

_MONEY = r"^-?\$?[\d,]+\.\d{2}$"


def carried_headers(headers: DataFrame, rows: DataFrame, *once: str) -> DataFrame:
    """rows(statement, page, y, ...) with `section`: that of the last header(statement, page, y, section) at or above, also on earlier pages.

    Rows of a statement that agree in page, y and the columns named are one row. That is seen in the same sorted pass: sets of rows would take memory beside the sort."""
    marks = headers.select("statement", "page", "y", F.lit(0).alias("__k"), "section")
    both = rows.withColumns({"__k": F.lit(1), "section": F.lit(None).cast("string")}).unionByName(marks, allowMissingColumns=True)
    place = "page", "y", "__k", *once
    order = Window.partitionBy("statement").orderBy(*place)
    again = F.lag(F.struct(*place)).over(order).eqNullSafe(F.struct(*place)) if once else F.lit(False)
    both = both.withColumns({"section": F.last("section", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "__again": again})
    return both.filter("__k = 1 AND NOT __again").drop("__k", "__again")


def _usual(gaps: Column, otherwise: float = 40.0) -> Column:
    """The upper median of an array."""
    return F.coalesce(F.try_element_at(F.array_sort(gaps), F.floor(F.size(gaps) / 2).cast("int") + 1), F.lit(otherwise))


def nearest_anchor(words: DataFrame, anchors: DataFrame, least_reach: float = 18.0, share: float = 0.6) -> DataFrame:
    """words(statement, page, word_no, y) with the nearest of anchors(statement, page, anchor, y) on their page: within the
    larger of least_reach and a share of the page's usual gap (the upper median, 40 without a gap); of equally near ones the first.

    Pages bound the join: a page holds a screenful of words and anchors."""
    order = Window.partitionBy("statement", "page").orderBy("y")
    gaps = anchors.withColumn("gap", F.col("y") - F.lag("y").over(order)).groupBy("statement", "page").agg(F.collect_list("gap").alias("g"))
    reach = gaps.select("statement", "page", F.greatest(F.lit(least_reach), share * _usual(F.col("g"))).alias("reach"))
    met = words.join(anchors.select("statement", "page", "anchor", F.col("y").alias("ay")), ["statement", "page"]).join(reach, ["statement", "page"])
    near = met.withColumn("d", F.abs(F.col("y") - F.col("ay"))).filter("d <= reach")
    return near.groupBy("statement", "page", "word_no").agg(F.min_by("anchor", F.struct("d", "anchor")).alias("anchor"))


def box_rows(boxes: DataFrame, least_reach: float = 18.0, share: float = 0.6, left: float = 0.3) -> DataFrame:
    """Ledger rows of boxes(statement, page, box_no, bbox array<struct<x, y>>, text): words of scanned pages.

    A date at the left begins a row; each other word goes to the nearest date above or below its middle (of equally near
    ones the upper), if that is within the larger of least_reach and a share of the page's usual gap between dates. The
    last header at or above a date, also on earlier pages, tells its side; rows before any header, totals, and rows
    without an amount give nothing. Blank boxes are nothing. Everything is windows over a statement: one shuffle, no join."""
    page, down = Window.partitionBy("statement", "page"), ("y", "box_no")
    x, y = F.col("bbox.x"), F.col("bbox.y")
    words = boxes.select("statement", "page", "box_no", F.trim("text").alias("text"), ((F.array_min(y) + F.array_max(y)) / 2).cast("double").alias("y"), F.array_min(x).cast("double").alias("x0")).filter("text <> ''").repartition("statement")
    wide = F.max("x0").over(page)
    words = words.withColumn("dated", F.col("text").rlike(L.REGIONS_BOX_DATE) & (F.col("x0") <= F.when(wide == 0, 1.0).otherwise(wide) * left))
    header = F.when(F.col("text").rlike(L.REGIONS_BOX_CREDIT), "Credit").when(F.col("text").rlike(L.REGIONS_BOX_DEBIT), "Debit")
    # headers at a date's own height count, whichever box comes first
    sections = Window.partitionBy("statement").orderBy("page", *down)
    words = words.withColumn("header", header).withColumn("said", F.last("header", ignorenulls=True).over(sections.rowsBetween(Window.unboundedPreceding, 0)))
    level = Window.partitionBy("statement", "page", "y").orderBy("box_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = words.withColumn("section", F.last("said", ignorenulls=True).over(level))
    anchor = F.first(F.when(F.col("dated"), F.struct("y", "box_no")), ignorenulls=True).over(level)
    upto, after = page.orderBy(*down).rowsBetween(Window.unboundedPreceding, 0), page.orderBy(*down).rowsBetween(0, Window.unboundedFollowing)
    words = words.withColumn("own", anchor).withColumns({"above": F.last("own", ignorenulls=True).over(upto), "below": F.first("own", ignorenulls=True).over(after)})
    nearer = F.when(F.col("above").isNull() | (F.col("below.y") - F.col("y") < F.col("y") - F.col("above.y")), F.col("below")).otherwise(F.col("above"))
    words = words.withColumn("to", F.when(F.col("dated"), F.struct("y", "box_no")).otherwise(nearer)).filter("to IS NOT NULL")
    part = F.when(~F.col("dated"), F.struct("x0", "box_no", "text", F.abs(F.col("y") - F.col("to.y")).alias("d")))
    mine = lambda c: F.max(F.when(F.col("dated"), F.col(c)))
    rows = words.groupBy("statement", "page", F.col("to.y").alias("y"), F.col("to.box_no").alias("box_no")).agg(mine("text").alias("Date"), mine("section").alias("Section"), F.array_sort(F.collect_list(part)).alias("parts"))
    gaps = F.collect_list(F.col("y") - F.col("before")).over(page)
    rows = rows.withColumn("before", F.lag("y").over(page.orderBy(*down))).withColumn("reach", F.greatest(F.lit(least_reach), share * _usual(gaps)))
    line = F.trim(F.array_join(F.transform(F.filter("parts", lambda p: p["d"] <= F.col("reach")), lambda p: p["text"]), " "))
    rows = rows.withColumn("line", line).filter(F.col("Section").isNotNull() & ~F.col("line").rlike("(?i)" + L.REGIONS_STOP))
    last = F.try_element_at(F.regexp_extract_all("line", F.lit(r"([\d,]+\.\d{2})"), 1), F.lit(-1))
    rows = rows.withColumn("last", last).withColumn("amount", F.round(F.abs(clean_money(F.col("last"))), 2)).filter("amount > 0")
    before_last = F.expr("substring(line, 1, length(line) - instr(reverse(line), reverse(last)) - length(last) + 1)")
    debit = F.col("Section") == "Debit"
    number = F.row_number().over(page.orderBy(*down)).cast("long")
    rows = rows.withColumns({"row_no": number, "Description": squeezed(before_last), "Debit": F.when(debit, F.col("amount")).otherwise(0.0), "Credit": F.when(debit, 0.0).otherwise(F.col("amount"))})
    return rows.select("statement", "page", "row_no", "Date", "Description", "Debit", "Credit", "Section")


def column_of(x: Column, debit: Column, credit: Column, balance: Column) -> Column:
    """Side of an amount by its nearest column; the balance column begins 30 before its header; ties are debits."""
    return F.when(x >= balance - 30, "Balance").when(F.abs(x - debit) <= F.abs(x - credit), "Debit").otherwise("Credit")


def side_of_midpoint(x: Column, middle: Column, balance_from: Column) -> Column:
    """Side of an amount on a page whose debits stand left of the middle and whose balances stand right of the date column."""
    return F.when(x > balance_from, "Balance").when(x <= middle, "Debit").otherwise("Credit")


def columnar_rows(words: DataFrame, bucket: float = 4.0, head: float = 0.4) -> DataFrame:
    """Ledger rows of words(statement, page, height, word_no, text, x0, x1, top) whose line begins with a date.

    The first words for deposits and for withdrawals in the head of a page tell its columns; a page without both gives no
    rows. Of a line's amounts the leftmost is the transaction, a credit left of the middle between the columns, and the
    rightmost of two or more the balance. Words of one height bucket are a line."""
    upper, middle = F.upper("text"), (F.col("x0") + F.col("x1")) / 2
    line = (F.bround(F.col("top") / bucket) * bucket).cast("long").alias("line_no")
    value = F.when(F.col("text").rlike(_MONEY), clean_money(F.col("text"))).otherwise(0.0)  # once a word
    first = lambda hit: F.min(F.when((F.col("top") <= head * F.col("height")) & hit & F.col("word_no").isNotNull(), F.struct("word_no", middle.alias("middle"))))
    word = F.struct("x0", "word_no", middle.alias("middle"), "text", value.alias("value"))
    rows = words.groupBy("statement", "page", line).agg(F.sort_array(F.collect_list(word)).alias("w"), first(upper.contains("DEPOSIT")).alias("in"), first(upper.contains("WITHDRAWAL") | (upper.contains("CHECK") & upper.contains("DEBIT"))).alias("out"))
    dated = F.element_at("w", 1)["text"].rlike(r"^\d{1,2}/\d{1,2}")
    page = Window.partitionBy("statement", "page")
    rows = rows.withColumn("w", F.when(dated, F.col("w"))).withColumn("split", (F.min("in").over(page)["middle"] + F.min("out").over(page)["middle"]) / 2).filter("w IS NOT NULL AND split IS NOT NULL")
    rest = F.slice("w", F.lit(2), F.size("w"))
    valued = F.transform(F.filter(rest, lambda x: x["value"] != 0), lambda x, k: F.struct(x["middle"].alias("middle"), k.alias("k"), x["value"].alias("value")))
    rows = rows.withColumn("amounts", F.sort_array(valued)).filter(F.size("amounts") > 0)
    text = F.array_join(F.transform(F.filter(rest, lambda x: x["value"] == 0), lambda x: x["text"]), " ")
    leftmost = F.element_at("amounts", 1)
    credit, value = leftmost["middle"] < F.col("split"), F.round(F.abs(leftmost["value"]), 2)
    rows = rows.select("statement", "page", "line_no", F.element_at("w", 1)["text"].alias("Date"), text.alias("Description"), F.when(credit, 0.0).otherwise(value).alias("Debit"), F.when(credit, value).otherwise(0.0).alias("Credit"), F.when(F.size("amounts") > 1, F.round(F.element_at("amounts", -1)["value"], 2)).otherwise(0.0).alias("Balance"))
    return rows.withColumn("Amount", F.round(F.col("Credit") - F.col("Debit"), 2))


def table_rows(cells: DataFrame, date: int = 0, description: int = 1, debit: int = 2, credit: int = 3) -> DataFrame:
    """cells(statement, page, table_no, row, col, text) to ledger rows: a row with both amounts becomes two, the credit first; empty dates carry on."""
    at = lambda k: F.max(F.when(F.col("col") == k, F.trim("text")))
    rows = cells.groupBy("statement", "page", "table_no", "row").agg(F.nullif(at(date), F.lit("")).alias("Date"), F.coalesce(at(description), F.lit("")).alias("Description"), F.abs(clean_money(at(debit))).alias("d"), F.abs(clean_money(at(credit))).alias("c"))
    order = Window.partitionBy("statement").orderBy("page", "table_no", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("Date", F.last("Date", ignorenulls=True).over(order)).filter(F.col("Date").isNotNull())
    sides = F.filter(F.array(F.struct(F.lit(0).alias("part"), F.lit(0.0).alias("Debit"), F.col("c").alias("Credit")), F.struct(F.lit(1).alias("part"), F.col("d").alias("Debit"), F.lit(0.0).alias("Credit"))), lambda s: (s["Debit"] + s["Credit"]) > 0)
    return rows.select("statement", "page", "table_no", "row", "Date", "Description", F.inline(sides))


def first_write(cells: DataFrame, key: str, field: str, value: str, *order: str) -> DataFrame:
    """key, field, value: the first value, in order, that isn't null."""
    return cells.filter(F.col(value).isNotNull()).groupBy(key, field).agg(F.min_by(value, F.struct(*order)).alias(value))
