"""Average daily balances of statement texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.dates import with_year
from ..functions.money import let, plausible_balance, plausible_balances
from ..functions.text import any_of, extracted, flat

def printed_average(text: Column) -> Column:
    """The bank's own figure: the first pattern whose first match has no disqualifying word in it or just before it."""

    def found(line: Column) -> Column:
        def one(p: Column) -> Column:
            context = F.upper(extracted(line, F.concat(F.lit("(?i)(.{0,30}"), p, F.lit(")")), 1))
            pattern = F.concat(F.lit("(?i)"), p)
            return F.when(F.rlike(line, pattern) & ~any_of(context, L.AVERAGE_NOT_AFTER), plausible_balance(extracted(line, pattern, 1)))

        return F.get(F.filter(F.transform(F.array(*map(F.lit, L.PRINTED_AVERAGES)), one), lambda x: x.isNotNull()), F.lit(0))

    return let(flat(text), found)


def daily_balances(text: Column, stop: str = L.BALANCE_STOP) -> Column:
    """Balances of the first daily-balance section, as an array."""
    section = F.regexp_extract(text, rf"(?is)((?:{'|'.join(L.BALANCE_SECTIONS)}).*?)(?:{stop}|\z)", 1)
    return plausible_balances(F.regexp_extract_all(section, F.lit(L.DAILY_PAIR), 2))


def mean(values: Column) -> Column:
    """Of an array; null if it is empty. The sum is exact, so half cents are not lost to the order of the values."""
    zero = F.lit(0).cast("decimal(28,4)")
    return F.when(F.size(values) > 0, F.aggregate(values, zero, lambda a, x: (a + x.cast("decimal(18,4)")).cast("decimal(28,4)")).cast("double") / F.size(values))


def sparse_points(texts: DataFrame) -> DataFrame:
    """statement, day, balance, place, until: the opening balance, and the last amount of each dated line that has two."""
    year = F.nullif(F.regexp_extract("text", r"\b(20\d{2})\b", 1), F.lit("")).cast("int")
    base = texts.withColumns({"year": F.coalesce(year, F.col("year") if "year" in texts.columns else F.lit(None).cast("int")), "flat": flat(F.col("text"))})
    opening = "(?i)" + L.BEGINNING_BALANCE
    base = base.withColumn("until", with_year(F.regexp_extract("flat", "(?i)" + L.ENDING_BALANCE, 1), F.col("year")))
    first = base.filter(F.col("flat").rlike(opening)).select("statement", with_year(F.regexp_extract("flat", opening, 1), F.col("year")).alias("day"), plausible_balance(F.regexp_extract("flat", opening, 2)).alias("balance"), F.lit(-1).alias("place"), "until")
    lines = base.filter(F.col("text").rlike("(?i)" + L.RUNNING_BALANCES)).select("statement", "year", "until", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    rows = lines.filter(F.col("line").rlike(L.DAILY_ROW) & ~any_of(F.upper("line"), L.DAILY_SKIPPED) & (F.size(F.regexp_extract_all("line", F.lit(r"-?\$?[\d,]+\.\d{2}"), 0)) >= 2))
    day = with_year(F.concat_ws("/", F.slice(F.split(F.regexp_extract("line", L.DAILY_ROW, 1), "/"), 1, 2)), F.col("year"))
    more = rows.select("statement", day.alias("day"), plausible_balance(F.regexp_extract("line", L.DAILY_ROW, 2)).alias("balance"), "place", "until")
    return first.unionByName(more).filter("day is not null and balance is not null")


def weighted_average(points: DataFrame) -> DataFrame:
    """statement, average: each day's last balance weighs the days to the next point, the last one those to `until`; needs two days."""
    days = points.groupBy("statement", "day").agg(F.max_by("balance", "place").alias("balance"), F.max("until").alias("until"))
    following = F.lead("day").over(Window.partitionBy("statement").orderBy("day"))
    weight = F.greatest(F.datediff(F.coalesce(following, "until", "day"), "day"), F.lit(0))
    rows = days.withColumn("weight", weight).groupBy("statement").agg(F.count("*").alias("days"), F.sum("weight").alias("w"), F.sum(F.col("balance").cast("decimal(18,4)") * F.col("weight")).cast("double").alias("v"))
    return rows.filter("days >= 2 and w > 0").select("statement", F.round(F.col("v") / F.col("w"), 2).alias("average"))


def _tagless(text: Column) -> Column:
    return F.regexp_replace(text, L.BALANCE_TAGS, "\n")


def section_mean(text: Column) -> Column:
    """Mean of the first daily-balance section and, where there is one, of the amounts in lines whose closing tag swallowed an ending balance."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("*end*") & F.lower(x).contains("balance") & F.lower(x).contains("ending"))
    torn = plausible_balances(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(f"({L.TORN_BALANCE})"), 1))))
    headed = text.rlike(f"(?i){'|'.join(L.BALANCE_SECTIONS)}")
    return let(F.when(headed, F.concat(daily_balances(_tagless(text)), torn)), mean)


def listed_balances(text: Column) -> Column:
    """Balances to fall back on: those of the first daily-balance section, else the last amount of each line that begins with m/d or m-d."""
    lines = F.filter(F.transform(F.split(_tagless(text), "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 10) & x.rlike(r"^\d{1,2}[/\-]\d{1,2}"))
    amounts = F.filter(lines, lambda x: x.rlike(r"[\d,]+\.\d{2}"))
    lasts = plausible_balances(F.transform(amounts, lambda x: F.try_element_at(F.regexp_extract_all(x, F.lit(r"(-?[\d,]+\.\d{2})"), 1), F.lit(-1))))
    return let(daily_balances(_tagless(text), L.BALANCE_LIST_STOP), lambda found: F.when(F.size(found) > 0, found).otherwise(lasts))


def average_balance(texts: DataFrame) -> DataFrame:
    """statement, average, level: printed (0), mean of a daily section (1), weighted by days (2), mean of whatever balances are listed (3), or null."""
    base = texts.withColumns({"printed": printed_average(F.col("text")), "daily": section_mean(F.col("text")), "listed": let(listed_balances(F.col("text")), mean)})
    rows = base.join(weighted_average(sparse_points(texts)).withColumnRenamed("average", "weighted"), "statement", "left")
    names = ("printed", "daily", "weighted", "listed")
    level = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(k)) for k, c in enumerate(names)])
    return rows.select("statement", F.round(F.coalesce(*names), 2).alias("average"), level.alias("level"))
