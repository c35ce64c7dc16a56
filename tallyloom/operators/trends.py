"""Statements in time: changes, forecasts, chart series, flags, and tables to look through."""

from __future__ import annotations

import calendar
import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import MONTHS
from .folds import folded


def month_over_month(series: DataFrame, key: str, month: str, value: str) -> DataFrame:
    """key, month, change in per cent to the month before (0 unless that was positive), one decimal; without each key's first month."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(month))
    change = F.when(F.col("__b") > 0, F.round((F.col(value) - F.col("__b")) / F.col("__b") * 100, 1)).otherwise(0.0)
    return series.withColumn("__b", before).filter(F.col("__b").isNotNull()).select(key, month, change.alias("change"))


def next_month(month: Column) -> Column:
    """yyyy-MM to the next one."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), 1), "yyyy-MM")


def forecast(series: DataFrame, key: str, month: str, value: str) -> DataFrame:
    """key, n, last, predicted, delta, confidence, next_month: least squares on the position in time, at least 0; one point predicts itself."""
    x = F.row_number().over(Window.partitionBy(key).orderBy(month)) - 1
    rows = series.withColumns({"__x": x.cast("long"), "__y": F.round(F.col(value) * 100).cast("long")})
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.max_by(value, month).alias("last"), next_month(F.max(month)).alias("next_month"), F.sum("__x").alias("sx"), F.sum("__y").alias("sy"), F.sum(F.col("__x") * F.col("__x")).alias("sxx"), F.sum(F.col("__x") * F.col("__y")).alias("sxy"))
    # the line's value at n as an exact fraction of cents, rounded half up
    sums = sums.withColumn("d", F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")).withColumn("u", F.greatest(F.col("sy") * F.col("d") + (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) * (F.col("n") * F.col("n") - F.col("sx")), F.lit(0)))
    cents = F.expr("CASE WHEN n > 1 THEN (2 * u + n * d) div (2 * n * d) END")
    out = sums.select(key, "n", "last", "next_month", F.when(F.col("n") == 1, F.greatest(F.round("last", 2), F.lit(0.0))).otherwise(cents / 100).alias("predicted"))
    confidence = F.when(F.col("n") >= 6, "High").when(F.col("n") >= 3, "Medium").otherwise("Low")
    return out.withColumn("delta", F.round(F.col("predicted") - F.col("last"), 2)).withColumn("confidence", confidence)


def fix_year_gaps(dates: DataFrame, key: str, date: str) -> DataFrame:
    """key, position, fixed: in date order, a date over six months after the one before it, as corrected, loses a year; null dates go.

    Each step depends on the corrected one before. Positions are those of the corrected dates, in their order."""

    def step(before: datetime.date | None, row: dict) -> tuple[datetime.date, dict]:
        day = row["d"]
        if before is not None and (day.year - before.year) * 12 + day.month - before.month > 6:
            day = day.replace(year=day.year - 1, day=min(day.day, calendar.monthrange(day.year - 1, day.month)[1]))
        return day, {"k": row["k"], "fixed": day}

    kind = dict(dates.dtypes)[key]
    rows = dates.select(F.col(key).alias("k"), F.to_date(date).alias("d")).filter("d IS NOT NULL")
    fixed = folded(rows, "k", ["d"], lambda _: None, step, f"k {kind}, fixed date")
    place = F.row_number().over(Window.partitionBy("k").orderBy("fixed")) - 1
    return fixed.select(F.col("k").alias(key), place.alias("position"), "fixed")


def running_balance(rows: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(statement, opening, line_no, amounts): line_no, amount, balance, section of each row by the balance before it.

    Of the amounts the last is a balance if the balance before, plus or minus the amount before it, comes to it within
    the tolerance; that also tells the side. Otherwise the last is an amount of unknown side and the balance stays."""

    def step(balance: float, row: dict) -> tuple[float, dict]:
        amounts, section = row["amounts"], ""
        amount = amounts[-1] if amounts else None
        if len(amounts) > 1:
            for name, sign in (("Credit", 1), ("Debit", -1)):
                if not section and abs(balance + sign * amounts[-2] - amounts[-1]) <= tolerance:
                    section, amount = name, amounts[-2]
        balance = amounts[-1] if section else balance
        return balance, {"statement": row["statement"], "line_no": row["line_no"], "amount": amount, "balance": balance, "section": section}

    kind = dict(rows.dtypes)["statement"]
    ordered = rows.select("statement", F.col("opening").cast("double").alias("opening"), F.col("line_no").cast("long").alias("line_no"), F.col("amounts").cast("array<double>").alias("amounts"))
    return folded(ordered, "statement", ["line_no"], lambda row: row["opening"], step, f"statement {kind}, line_no long, amount double, balance double, section string")


def sort_month(date: Column, name: Column) -> Column:
    """yyyy-MM to sort statements by: of the date, else the month named in the file name, else a month number in it, else 0000-00."""
    lower = F.lower(name)
    year = F.coalesce(F.nullif(F.regexp_extract(lower, r"(20\d{2})", 1), F.lit("")), F.lit("0000"))
    named = F.coalesce(*[F.when(lower.contains(m[:3]), F.lit(f"{k:02d}")) for k, m in enumerate(MONTHS, 1)], F.nullif(F.regexp_extract(lower, r"(?<!\d)(0[1-9]|1[0-2])(?!\d)", 1), F.lit("")))
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.concat(year, F.lit("-"), named), F.lit("0000-00"))


def chart_series(metrics: DataFrame) -> DataFrame:
    """The charts' values of each statement: debt load, its share, coverage of the obligation and its colour."""
    other = F.greatest(F.lit(0.0), F.col("debits") - F.col("lender_debits"))
    cover = F.when(F.col("lender_debits") > 0, F.least(F.col("avg_daily_balance") / F.when(F.col("lender_debits") > 0, F.col("lender_debits")), F.lit(15.0)))
    share = F.when(F.col("debits") > 0, F.round(F.col("lender_debits") / F.when(F.col("debits") > 0, F.col("debits")) * 100, 1)).otherwise(0.0)
    colour = F.when(cover.isNull(), None).when(cover >= 2, "green").when(cover >= 1, "amber").otherwise("red")
    return metrics.select("statement", "credits", "debits", "cash_flow", "lender_debits", "lender_credits", F.round(other, 2).alias("other_debits"), share.alias("lender_share"), F.round(cover, 4).alias("coverage"), colour.alias("colour"))


def flags(metrics: DataFrame) -> DataFrame:
    """statement, withholding and NSF flags, gauge: over 15 red, over 8 amber; over 2 red, any amber; gauge at most 100."""
    level = lambda c, red, amber: F.when(F.col(c) > red, "red").when(F.col(c) > amber, "amber").otherwise("green")
    return metrics.select("statement", level("withholding_rate", 15, 8).alias("withholding_flag"), level("nsf_count", 2, 0).alias("nsf_flag"), F.least("withholding_rate", F.lit(100.0)).alias("gauge"), F.when(F.col("withholding_rate") > 30, "red").when(F.col("withholding_rate") > 15, "amber").otherwise("green").alias("gauge_flag"))


def search(table: DataFrame, text: str, sort: str, page: int, size: int = 20, descending: bool = False, tie: str | None = None) -> DataFrame:
    """A page of the rows in which any column holds the text, whatever its case, in the order of a column."""
    hit = F.exists(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns]), lambda x: F.lower(x).contains(text.lower()))
    order = [F.desc(sort) if descending else F.asc(sort)] + ([F.asc(tie)] if tie else [])
    return table.filter(hit).orderBy(*order).offset((page - 1) * size).limit(size)


def date_range(dates: Column) -> Column:
    """First to last month, as an aggregate."""
    return F.concat_ws(" – ", F.date_format(F.min(dates), "MMM yyyy"), F.date_format(F.max(dates), "MMM yyyy"))


def month_label(day: Column, name: Column) -> Column:
    """`Jan '24` of a yyyy-MM-dd text, else up to ten characters of the file's name without its extension, else empty."""
    month = F.regexp_extract(day, r"^[^-]*-(\d+)", 1).try_cast("int")
    labels = F.array(*[F.lit(m[:3].title()) for m in MONTHS])
    label = F.concat(F.element_at(labels, F.when(month.between(1, 12), month)), F.lit(" '"), F.substring(F.split(day, "-")[0], 3, 100))
    return F.coalesce(label, F.substring(F.regexp_replace(name, r"\.[^.]+$", ""), 1, 10), F.lit(""))


def short_dollars(value: Column) -> Column:
    """$1.2M from a million on, $3k from a thousand on, else the value as it is."""
    scaled = lambda by, digits: F.round(value / by, digits).cast(f"decimal(30,{digits})").cast("string")
    plain = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return F.when(F.abs(value) >= 1_000_000, F.concat(F.lit("$"), scaled(1_000_000, 1), F.lit("M"))).when(F.abs(value) >= 1000, F.concat(F.lit("$"), scaled(1000, 0), F.lit("k"))).otherwise(F.concat(F.lit("$"), plain))


def full_dollars(value: Column) -> Column:
    """$1,234: whole dollars, halves away from 0; null counts as 0."""
    return F.concat(F.lit("$"), F.format_number(F.round(F.coalesce(value, F.lit(0)), 0), 0))


def shown(value: Column, unit: str = "") -> Column:
    """12.3% or 12.3×: one decimal and the unit; without a unit a whole number, halves up. Null counts as 0."""
    value = F.coalesce(value, F.lit(0)).cast("double")
    return F.concat(F.round(value, 1).cast("decimal(30,1)").cast("string"), F.lit(unit)) if unit else F.floor(value + 0.5).cast("string")


def period_label(start: Column, stop: Column, day: Column) -> Column:
    """`Jan 5, '24 – Feb 4, '24` of a period's dates, else the month of a yyyy-MM-dd text, else a dash."""
    short = lambda d: F.date_format(d, "MMM d, ''yy")
    both = F.concat(short(start), F.lit(" – "), short(stop))
    return F.coalesce(both, F.substring(F.nullif(day, F.lit("")), 1, 7), F.lit("—"))


def forecast_series(series: DataFrame, key: str, month: str, value: str) -> DataFrame:
    """key, month, revenue, forecast of a sparkline: each month's value, the last of them also as the forecast's beginning, and
    a month more with what forecast() predicts."""
    last = F.max(month).over(Window.partitionBy(key))
    seen = series.select(key, F.col(month).alias("month"), F.col(value).alias("revenue"), F.when(F.col(month) == last, F.col(value)).alias("forecast"))
    ahead = forecast(series, key, month, value).select(key, F.col("next_month").alias("month"), F.lit(None).cast("double").alias("revenue"), F.col("predicted").alias("forecast"))
    return seen.unionByName(ahead)


def usual_year(names: DataFrame, otherwise: Column) -> DataFrame:
    """One row, year: the most frequent 20yy in names(position, filename), of equally frequent ones that met first, else the given one."""
    years = names.select("position", F.posexplode(F.regexp_extract_all(F.lower("filename"), F.lit(r"\b(20\d{2})\b"), 1)).alias("k", "year"))
    counted = years.groupBy("year").agg(F.count("*").alias("n"), F.min(F.struct("position", "k")).alias("first"))
    return counted.agg(F.coalesce(F.min_by(F.col("year").cast("int"), F.struct(-F.col("n"), F.col("first"))), otherwise).alias("year"))


def sales_rep(client: Column) -> Column:
    """Client number up to its first hyphen, `unknown` if that is blank."""
    return F.coalesce(F.nullif(F.trim(F.split(client, "-")[0]), F.lit("")), F.lit("unknown"))


def month_bars(metrics: DataFrame, day: str) -> DataFrame:
    """The grouped bars and the cash flow line of statements, labelled `Jan 2024`, by date with undated ones last."""
    return metrics.orderBy(F.asc_nulls_last(day)).select("statement", F.date_format(day, "MMM yyyy").alias("label"), "credits", "debits", "lender_debits", F.round(F.col("credits") - F.col("debits"), 2).alias("cash_flow"))
