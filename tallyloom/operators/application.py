"""Funding-application forms: cells of a table to normalised fields. Identity numbers are masked unless asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .geometry import first_write

_PARTS = (("business", L.FORM_BUSINESS), ("principal", L.FORM_PRINCIPAL), ("secondary", L.FORM_SECONDARY), ("property", L.FORM_PROPERTY))
_SECRET = ("Principle_SSN", "Secondary_SSN", "Principle_DOB", "Secondary_DOB", "Federal_Tax_ID")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _given(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def state(value: Column) -> Column:
    """Two-letter code of a state's code or name; else null."""
    codes = F.create_map(*[F.lit(x) for pair in L.STATES.items() for x in pair])
    upper = F.upper(F.trim(value))
    return F.when(upper.isin(*L.STATES.values()), upper).otherwise(F.try_element_at(codes, F.lower(F.trim(value))))


def phone(value: Column) -> Column:
    """(AAA) BBB-CCCC of ten digits, or eleven that begin with 1; else as it is."""
    d = _digits(value)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))).otherwise(_given(value))


def ssn(value: Column) -> Column:
    d = _digits(value)
    return F.when(F.length(d) == 9, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)))


def ein(value: Column) -> Column:
    d = _digits(value)
    return F.when(F.length(d) == 9, F.concat_ws("-", F.substring(d, 1, 2), F.substring(d, 3, 7))).otherwise(_given(value))


def form_date(value: Column) -> Column:
    """MM-dd-yyyy of a day or month with two- or four-digit year (69 to 99: 19yy); else as it is."""
    text = F.translate(F.trim(value), "-", "/")
    pieces = F.split(text, "/")
    year = F.element_at(pieces, -1)
    full = F.when(F.length(year) == 4, year).when(year.try_cast("int") >= 69, F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
    day = F.when(F.size(pieces) == 3, F.get(pieces, F.lit(1))).otherwise("1")
    parsed = F.when(text.rlike(r"^\d{1,2}/(\d{1,2}/)?(\d{4}|\d{2})$"), F.try_to_date(F.concat_ws("-", full, F.element_at(pieces, 1), day), "yyyy-M-d"))
    return F.coalesce(F.date_format(parsed, "MM-dd-yyyy"), _given(value))


def percent(value: Column) -> Column:
    v = _given(value)
    return F.when(v.endswith("%"), v).otherwise(F.concat(v, F.lit("%")))


def money(value: Column) -> Column:
    return _given(F.regexp_replace(value, "[,$]", ""))


def entity(value: Column) -> Column:
    """What is described after a check box, else what follows Other, else the text without the cross."""
    described = _given(F.regexp_extract(value, r"(?i)\(please\s+describe\)\s*:\s*(.+)", 1))
    other = _given(F.regexp_replace(F.regexp_extract(value, r"(?i)\bOther\s*:\s*([^(].+)", 1), r"(?i)\(please describe\).*", ""))
    bare = _given(F.regexp_replace(value, r"\bX\b", ""))
    return F.coalesce(described, other, F.when(~bare.contains(":") & (F.length(bare) <= 60), bare), _given(value))


def valid(value: Column) -> Column:
    """The value, unless it is empty, a label, or holds one."""
    v = _given(value)
    return F.when(~v.endswith(":") & ~v.rlike(L.FORM_LABEL) & ~v.rlike(L.FORM_LABEL_INSIDE), v)


_RULES = {"State": state, "Phone": phone, "SSN": ssn, "Tax_ID": ein, "DOB": form_date, "Started": form_date, "Ownership": percent, "Amount": money, "Rev": money, "Deposits": money, "Entity_Type1": entity}


def fields(cells: DataFrame) -> DataFrame:
    """cells(form, row, col, text) to (form, field, value): `Label: value` cells by the part of the form their row is in; of several the first valid one.

    Parts begin at the rows that hold their heads; labels are looked up by part, in a table of fixed size. Only that table is
    joined: what a form's cells say of each other is windows over the form."""
    text = F.trim("text")
    heads = {c: F.min(F.when(text.rlike(p), F.col("row"))).over(Window.partitionBy("form")) for c, p in (("owner", "(?i)^OWNER INFORMATION$"), ("second", "(?i)Secondary Owner Name"), ("property", "(?i)^BUSINESS PROPERTY INFORMATION$"))}
    part = F.when(F.col("row") > F.col("property"), "property").when(F.col("row") > F.col("owner"), F.when(F.col("row") >= F.col("second"), "secondary").otherwise("principal")).otherwise("business")
    labels = cells.sparkSession.createDataFrame([(p, label, field) for p, known in _PARTS for label, field in known.items()], "part string, label string, field string")
    split = F.split("text", ":", 2)
    rows = cells.filter("form IS NOT NULL").withColumns(heads).filter(F.col("text").contains(":")).withColumns({"part": part, "label": F.lower(F.trim(F.get(split, F.lit(0)))), "value": valid(F.get(split, F.lit(1)))})
    found = first_write(rows.join(F.broadcast(labels), ["part", "label"]), "form", "field", "value", "row", "col")
    ruled = F.coalesce(*[F.when(F.col("field").endswith(end), rule(F.col("value"))) for end, rule in _RULES.items()], F.when(~F.col("field").rlike("(" + "|".join(_RULES) + ")$"), F.col("value")))
    return found.select("form", "field", ruled.alias("value")).filter("value is not null")


def largest_table(cells: DataFrame) -> DataFrame:
    """cells(form, row, col, text) of the table with most rows, of equal ones the first, on the first page of cells(form, page, table_no, row, col, text)."""
    # the rank of a table's last row is the number of its rows
    rank = F.dense_rank().over(Window.partitionBy("form", "page", "table_no").orderBy("row"))
    ranked = cells.filter("form IS NOT NULL").repartition("form").withColumn("n", rank)
    best = F.min(F.struct("page", -F.col("n"), "table_no")).over(Window.partitionBy("form"))
    return ranked.withColumn("at", best).filter("page = at.page AND table_no = at.table_no").select("form", "row", "col", "text")


def masked(found: DataFrame) -> DataFrame:
    """Identity numbers and birth dates to their last two characters."""
    return found.withColumn("value", F.when(F.col("field").isin(*_SECRET), F.concat(F.lit("***"), F.substring("value", -2, 2))).otherwise(F.col("value")))


def wide(found: DataFrame, today: Column) -> DataFrame:
    """One row a form with all fields and those that are derived from others. Column names don't tell cases apart, so the
    second names of state and zip are state_of_business and zip_of_business."""
    names = sorted({f for _, known in _PARTS for f in known.values()})
    row = found.groupBy("form").pivot("field", names).agg(F.first("value"))
    started = F.nullif(F.regexp_extract("Date_Current_Ownership_Started", r"(\d{4})", 1), F.lit("")).cast("int")
    row = row.withColumns({
        "Industry_App": F.coalesce("Industry_App", "_industry_fallback"), "Time_in_Business": F.year(today) - started, "Percent_Ownership": F.col("Principle_Ownership"),
        "Portal_Email": F.coalesce("Principle_Email", "Business_Email"), "Portal_Mobile": F.coalesce("Principle_Phone", "Business_Phone"), "estimated_fico_score": F.when(F.col("_fico_raw").rlike(r"^\d+$"), F.col("_fico_raw").cast("int")),
    }).drop("_industry_fallback", "_fico_raw")
    names = {"business_description": "Industry_App", "ownership_percentage": "Principle_Ownership", "time_in_business_years": "Time_in_Business", "state_of_business": "Business_State", "zip_of_business": "Business_Zip"}
    return row.withColumns({new: F.col(old) for new, old in names.items()})
