"""Many short texts looked for in many others, by an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram; shorter needles are grams of their own.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The different runs of n letters."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Rows of texts with each row of needles whose needle is part of the text; null and empty needles are part of none.

    A needle is met by one of its grams, the one that fewest needles share, which a text must hold to contain it, and
    then looked for as a whole. So the work grows with the texts' letters and the needles they share a gram with, not
    with the number of needles. Texts should be distinct: each is taken apart once."""
    length = F.length(needle)
    listed = needles.filter(length > 0)
    each = listed.select(needle).distinct().withColumn("__gram", F.explode(F.when(length < GRAM, F.array(needle)).otherwise(_grams(F.col(needle), GRAM))))
    shared = each.join(each.groupBy("__gram").agg(F.count("*").alias("__n")), "__gram")
    chosen = listed.join(shared.groupBy(needle).agg(F.min_by("__gram", F.struct("__n", "__gram")).alias("__gram")), needle)
    sizes = range(1 if not listed.filter(length < GRAM).isEmpty() else GRAM, GRAM + 1)
    held = texts.withColumn("__gram", F.explode(F.concat(*[_grams(F.col(text), n) for n in sizes])))
    return held.join(chosen, "__gram").filter(F.contains(F.col(text), F.col(needle))).drop("__gram")
