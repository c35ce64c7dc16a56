"""Rule-based risk and its notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (points, limit): low revenue, high debits, returned items, existing funding.
LOW_REVENUE, HIGH_DEBITS, RETURNED, FUNDED = (30, 15_000), (30, 0.85), (25, 3), (15, None)
STRONG_REVENUE = 100_000


def score(revenue: Column, debits: Column, nsf: Column, funded: Column) -> Column:
    points = lambda condition, n: F.when(condition, F.lit(float(n))).otherwise(F.lit(0.0))
    return points(revenue < LOW_REVENUE[1], LOW_REVENUE[0]) + points((revenue > 0) & (debits / F.when(revenue > 0, revenue) > HIGH_DEBITS[1]), HIGH_DEBITS[0]) + points(nsf >= RETURNED[1], RETURNED[0]) + points(funded, FUNDED[0])


def level(points: Column) -> Column:
    return F.when(points < 30, "Low Risk").when(points < 60, "Medium Risk").otherwise("High Risk")


def notes(revenue: Column, cash_flow: Column, nsf: Column, funded: Column, funders: Column, withholding: Column) -> Column:
    """Five sentences: revenue, cash flow, returned items, funding, withholding."""
    names = F.when(F.size(funders) > 0, F.concat(F.lit(": "), F.array_join(funders, ", "))).otherwise(F.lit("."))
    return F.array(
        F.when(revenue >= STRONG_REVENUE, "Strong monthly revenue detected.").otherwise("Monthly revenue is on the lower side."),
        F.when(cash_flow > 0, "Positive cash flow detected.").otherwise("Negative cash flow detected — debits exceed credits."),
        F.when(nsf > 0, F.concat(nsf.cast("string"), F.lit(" NSF / overdraft transaction(s) detected."))).otherwise("No NSF activity detected."),
        F.when(funded, F.concat(F.lit("Existing MCA/loan funding detected"), names)).otherwise("No existing funding detected."),
        F.format_string("Estimated withholding rate: %.2f%%.", F.round(withholding, 2)),
    )
