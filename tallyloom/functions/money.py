"""Money in text to doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLAIN = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Most amounts: no bracket, no sign at the end, a point; a cast reads them as all the rules below do, without their lambdas.
_USUAL = r"\A[$]?-?[$]?[0-9][0-9,]*\.[0-9]+\z"
#: Balances beyond this are misread digits.
LARGEST_BALANCE = 10_000_000


def _number(text: Column) -> Column:
    return F.when(text.rlike(_PLAIN), text.try_cast("double"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; keeps generated code small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_money(value: Column) -> Column:
    """Dollar text to a signed amount: (x), x- and -x are negative, a lone comma is a decimal point, what isn't a number is 0."""

    def signs(text: Column) -> Column:
        bracketed = text.startswith("(") & text.endswith(")")
        return let(F.when(bracketed, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text), lambda x: F.struct((bracketed | x.rlike("^-|-$")).alias("negative"), F.regexp_replace(F.regexp_replace(x, "-$", ""), "^-", "").alias("digits")))

    def amount(parts: Column) -> Column:
        digits = parts["digits"]
        number = F.when(digits.contains(",") & ~digits.contains("."), F.replace(digits, F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
        return let(number, lambda x: F.coalesce(_number(x), F.lit(0.0))) * F.when(parts["negative"], -1.0).otherwise(1.0)

    text = F.coalesce(F.translate(F.trim(value.cast("string")), "$+ ", ""), F.lit(""))
    return F.when(value.cast("string").rlike(_USUAL), F.translate(value.cast("string"), "$,", "").cast("double")).otherwise(let(let(text, signs), amount)) + F.lit(0.0)


def money_of(df: DataFrame, column: str) -> Column:
    """A money column of a ledger: doubles as they are (null: 0), anything else parsed."""
    return F.coalesce(F.col(column), F.lit(0.0)) if dict(df.dtypes).get(column) == "double" else clean_money(F.col(column))


def lenient_amount(value: Column) -> Column:
    """Currency signs, commas, blanks and brackets dropped (brackets don't negate); what isn't a number is 0."""
    return F.coalesce(_number(F.translate(F.trim(value.cast("string")), "$,() ", "")), F.lit(0.0))


def lenient_of(df: DataFrame, column: str) -> Column:
    """lenient_amount() of a column of a ledger; doubles needn't be written and read again, those that aren't finite are 0."""
    value = F.col(f"`{column}`")
    return F.coalesce(F.when(F.abs(value) < float("inf"), value), F.lit(0.0)) if dict(df.dtypes).get(column) == "double" else lenient_amount(value)


def plausible_balance(value: Column) -> Column:
    """clean_money, or null beyond LARGEST_BALANCE."""
    amount = clean_money(value)
    return F.when(F.abs(amount) <= LARGEST_BALANCE, amount)


def plausible_balances(values: Column) -> Column:
    """plausible_balance() of an array's texts, nulls left out; each text is read once."""
    return F.filter(F.transform(values, clean_money), lambda x: F.abs(x) <= LARGEST_BALANCE)


def total(amount: Column) -> Column:
    """A sum that doesn't depend on the order of its rows, to cents."""
    return F.round(F.coalesce(F.sum(amount.cast("decimal(18,4)")), F.lit(0)).cast("double"), 2)
