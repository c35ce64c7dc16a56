"""Dates of transactions and statements. The current day is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import MONTHS
from .money import let

_FORMATS = (("\\d{4}-\\d{1,2}-\\d{1,2}", "yyyy-M-d"), ("\\d{1,2}/\\d{1,2}/\\d{4}", "M/d/yyyy"), ("[A-Za-z]{3} \\d{1,2}, \\d{4}", "MMM d, yyyy"), ("[A-Za-z]{4,} \\d{1,2},? \\d{4}", "MMMM d, yyyy"))
_RANGE = r"(?i)([A-Z]{3})\s*(\d{1,2})/(\d{2})\s*[-–]\s*([A-Z]{3})\s*(\d{1,2})/(\d{2})"
_NAMES = "|".join(m.capitalize() for m in MONTHS)


def full_date(text: Column) -> Column:
    """A date that names its year, as a timestamp; else null."""

    def read(text: Column) -> Column:
        found = [F.when(text.rlike(f"^{pattern}$"), F.try_to_timestamp(text, F.lit(form))) for pattern, form in _FORMATS]
        return F.coalesce(*found, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]"), text.try_cast("timestamp")))

    # digits and marks, all that most dates are of, have no case
    capital = lambda x: F.when(x.rlike(r"[^\x20-\x40]"), F.initcap(x)).otherwise(x)
    return let(let(F.regexp_replace(F.trim(text), r"(?<=\d) +(?=\d{4}$)", ", "), capital), read).cast("timestamp_ntz")


def with_year(text: Column, year: Column) -> Column:
    """m/d, m/d/yy or m/d/yyyy to a date; a missing year is `year`, two digits are 20yy; impossible days are null."""

    def day(parts: Column) -> Column:
        part = lambda k: F.get(parts, F.lit(k))
        y = F.coalesce(F.when(F.length(part(2)) <= 2, part(2).try_cast("int") + 2000), part(2).try_cast("int"), year)
        return F.try_to_date(F.concat_ws("-", y.cast("string"), part(0), part(1)), "yyyy-M-d")

    return F.when(text.rlike(r"^\d{1,2}/\d{1,2}(/\d{2,4})?$"), let(F.split(text, "/"), day))


def ledger_date(text: Column, year: Column | None = None) -> Column:
    """full_date; with a year (of the statement) also m/d and `d Mon`. Without one, dates that lack a year are null."""
    found = [full_date(text)]
    if year is not None:
        named = r"^(\d{1,2} [A-Za-z]{3})"
        day_month = F.when(text.rlike(named), F.try_to_date(F.concat_ws(" ", F.initcap(F.regexp_extract(text, named, 1)), year.cast("string")), "d MMM yyyy"))
        found += [with_year(text, year).cast("timestamp_ntz"), day_month.cast("timestamp_ntz")]
    return F.coalesce(*found)


def _day(month: Column, day: Column, year: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", F.initcap(month), day, F.concat(F.lit("20"), year)), F.lit("MMM d yyyy")).cast("timestamp_ntz")


def period(text: Column) -> Column:
    """struct(start, stop) of a `MON DD/YY - MON DD/YY` range; nulls if there is none."""
    g = lambda k: F.regexp_extract(text, _RANGE, k)
    start, stop = _day(g(1), g(2), g(3)), _day(g(4), g(5), g(6))
    both = start.isNotNull() & stop.isNotNull()
    return F.struct(F.when(both, start).alias("start"), F.when(both, stop).alias("stop"))


def statement_date(text: Column, name: Column, usual_year: Column, today: Column) -> Column:
    """End of the period, else after `through`, else a date in the text, else month and year of the file name.

    The name's year: its own, else usual_year (the most frequent one among the files), else that of today."""
    first = lambda pattern: full_date(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")))
    dates = [
        period(text)["stop"], first(rf"(?i)(?:{_NAMES})\s+\d{{1,2}},?\s+\d{{4}}\s+through\s+((?:{_NAMES})\s+\d{{1,2}},?\s+\d{{4}})"),
        first(r"(?i)statement\s+(?:period|date)[:\s]+([A-Z]+\s+\d{1,2}[\s,]+\d{4})"), first(r"(?i)period\s+ending\s+([A-Z]+\s+\d{1,2},?\s+\d{4})"),
        first(r"\b(\d{1,2}/\d{1,2}/\d{4})\b"), first(r"\b(\d{4}-\d{2}-\d{2})\b"),
    ]
    lower = F.lower(name)
    year = F.coalesce(F.nullif(F.regexp_extract(lower, r"\b(20\d{2})\b", 1), F.lit("")).cast("int"), usual_year, F.year(today))
    month = F.coalesce(*[F.when(lower.contains(m) | lower.contains(m[:3]), F.lit(k)) for k, m in enumerate(MONTHS, 1)])
    return F.coalesce(*dates, F.make_date(year, month, F.lit(1)).cast("timestamp_ntz"))
