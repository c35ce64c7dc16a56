"""Row readers by bank, in the order in which they are tried, and the cascade that tries them.

A reader has a test on a statement's text and makes rows of what is known of the statements that pass it: their text,
and the words, table cells and scanned boxes of their pages, where an extractor brings them. What the banks' readers
leave empty goes to the generic ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_labels
from ..operators import canada, geometry, parsers, summary
from ..operators.lines import spread, to_lines
from .cuts import cut

_CELLS = "statement string, page int, table_no int, row int, col int, text string"
_WORDS = "statement string, page int, width double, height double, word_no int, text string, x0 double, x1 double, top double"
_ROWS = {"Date": "string", "Description": "string", "Debit": "double", "Credit": "double", "Amount": "double", "Balance": "double", "Section": "string", "Raw Line": "string"}


@dataclass(frozen=True)
class Sources:
    """What is known of statements. texts: statement, text, and maybe kind (`image`: a scanned picture, read by the generic
    readers only; else a document). pages: statement, page, text. words, cells, boxes: see operators.geometry and canada."""

    texts: DataFrame
    year: Column
    pages: DataFrame | None = None
    words: DataFrame | None = None
    cells: DataFrame | None = None
    boxes: DataFrame | None = None

    def of(self, statements: DataFrame) -> Sources:
        """Of some statements only, given by their texts."""
        ids = statements.select("statement")
        mine = {c: getattr(self, c).join(ids, "statement", "left_semi") for c in ("pages", "words", "cells", "boxes") if getattr(self, c) is not None}
        return replace(self, texts=statements, **mine)

    def some(self, name: str) -> DataFrame:
        """Cells or words, none if none are known; a page whose width isn't known ends where its last word does."""
        found = getattr(self, name)
        if found is None:
            return self.texts.sparkSession.createDataFrame([], {"cells": _CELLS, "words": _WORDS}[name])
        return found.withColumn("width", F.max("x1").over(Window.partitionBy("statement", "page"))) if name == "words" and "width" not in found.columns else found

    @property
    def lines(self) -> DataFrame:
        """Of texts dealt by statement, as the readers' windows need them: lines, which are many more, cross no shuffle."""
        return to_lines(spread(self.texts))


@dataclass(frozen=True)
class Reader:
    """A bank's name, the test on a statement's text, and the rows of sources that pass it."""

    name: str
    test: Callable[[Column], Column]
    rows: Callable[[Sources], DataFrame]


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of pages with one number in place of page, row and part."""
    return rows.withColumn("line_no", (F.coalesce(F.col("page"), F.lit(0)).cast("long") * 1_000_000_000 + F.col("row_no") * 2 + F.col("part")))


def _rbc(sources: Sources) -> DataFrame:
    if sources.cells is None and sources.words is None:
        return canada.rbc_text(sources.lines)
    return _placed(canada.rbc(sources.some("cells"), sources.some("words"), sources.lines))


def _td(sources: Sources) -> DataFrame:
    """By the layout of the first page: tables and words in Canada, else the sections of the whole text."""
    first = sources.texts.select("statement", F.lit(1).alias("page"), "text") if sources.pages is None else sources.pages
    layout = first.groupBy("statement").agg(F.min_by(summary.is_canada_trust(F.col("text")), F.col("page")).alias("canada"))
    known = sources.texts.join(layout, "statement", "left")
    other = known.filter(~F.coalesce("canada", summary.is_canada_trust(F.col("text")))).select("statement", "text")
    rows = _ledger(parsers.td_bank(to_lines(spread(other)), sources.year))
    if sources.cells is None and sources.words is None:
        return rows
    mine = sources.of(known.filter("canada").select("statement", "text"))
    pages = first.join(mine.texts.select("statement"), "statement", "left_semi")
    return rows.unionByName(_ledger(_placed(canada.td_canada(pages, mine.some("cells"), mine.some("words"), sources.year))))


def _regions(sources: Sources) -> DataFrame:
    """From the text's lines; statements without rows there from their boxes."""
    rows = _ledger(parsers.regions(sources.lines))
    if sources.boxes is None:
        return rows
    rest = sources.boxes.join(rows.select("statement").distinct(), "statement", "left_anti")
    return rows.unionByName(_ledger(_placed(geometry.box_rows(rest).withColumn("part", F.lit(0)))))


def _of_bank(name: str) -> Callable[[Column], Column]:
    return lambda text: summary.is_bank(text, name)


#: Banks with readers of their own, in the order in which they are tried.
READERS = (
    Reader("RBC", _of_bank("RBC"), _rbc),
    Reader("TD Bank", _of_bank("TD Bank"), _td),
    Reader("Chase", _of_bank("Chase"), lambda s: parsers.chase(s.lines)),
    Reader("Capital One", _of_bank("Capital One"), lambda s: parsers.capital_one(s.lines)),
    Reader("Regions", _of_bank("Regions"), _regions),
)
#: A reader that READERS leaves out, for those who want it: its rows replace those of the generic readers.
BANK_OF_AMERICA = Reader("Bank of America", _of_bank("Bank of America"), lambda s: parsers.bank_of_america(s.lines))
#: Readers of any statement, on texts with short labels.
GENERIC = (Reader("universal", lambda _: F.lit(True), lambda s: parsers.universal(s.lines)), Reader("simple", lambda _: F.lit(True), lambda s: parsers.simple(s.lines)))


def with_reader(reader: Reader, before: str | None = None, readers: Sequence[Reader] = READERS) -> tuple[Reader, ...]:
    """The readers with one more, before that of a name, else last; one of its own name it replaces."""
    others = [r for r in readers if r.name != reader.name]
    at = next((k for k, r in enumerate(others) if r.name == before), len(others))
    return (*others[:at], reader, *others[at:])


def _ledger(rows: DataFrame) -> DataFrame:
    """statement, line_no and the columns of a raw ledger, those that a reader doesn't make empty."""
    empty = {"double": F.lit(0.0), "string": F.lit("")}
    rows = rows if "Amount" in rows.columns else rows.withColumn("Amount", F.round(F.col("Credit") - F.col("Debit"), 2))
    return rows.select("statement", F.col("line_no").cast("long").alias("line_no"), *[F.coalesce(F.col(f"`{c}`"), empty[kind]).cast(kind).alias(c) if c in rows.columns else empty[kind].alias(c) for c, kind in _ROWS.items()])


def known(texts: DataFrame, readers: Sequence[Reader] = READERS) -> DataFrame:
    """statement, text, short (with short labels) and candidates (places of the readers whose test the text passes), computed now and once."""
    document = F.coalesce(F.col("kind"), F.lit("")) != "image" if "kind" in texts.columns else F.lit(True)
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<int>")
    # no lambda stands around the tests, so what they have in common is computed once
    passes = F.array_remove(F.array(*[F.when(r.test(text), F.lit(k)).otherwise(-1) for k, r in enumerate(readers)]), F.lit(-1)) if readers else none
    return cut(texts.select("statement", text.alias("text"), short_labels(text).alias("short"), F.when(document, passes).otherwise(none).alias("candidates")))


def cascade(sources: Sources, readers: Sequence[Reader] = READERS, generic: Sequence[Reader] = GENERIC) -> DataFrame:
    """Raw ledger (statement, row_no, ...) of sources whose texts come from known(): each statement's rows are those of the
    first reader that passes its test and finds any, else those of the first generic one that does.

    All readers of banks run at once on the statements that pass their tests, which is seldom more than one of them."""
    texts, found = sources.texts, []
    for k, reader in enumerate(readers):
        mine = texts.filter(F.array_contains("candidates", k)).select("statement", "text")
        found.append(_ledger(reader.rows(sources.of(mine))).withColumn("reader", F.lit(k)))
    rows = []
    if found:
        # dealt by statement, so the first reader is told where its rows are, by no join
        every = spread(reduce(DataFrame.unionByName, found)).withColumn("first", F.min("reader").over(Window.partitionBy("statement")))
        rows.append(cut(every.filter("reader = first").drop("reader", "first")))
    left = texts
    for reader in generic:
        left = left.join(rows[-1].select("statement").distinct(), "statement", "left_anti") if rows else left
        rows.append(cut(_ledger(reader.rows(sources.of(left.filter(reader.test(F.col("text"))).select("statement", F.col("short").alias("text")))))))
    return reduce(DataFrame.unionByName, rows).withColumnRenamed("line_no", "row_no")
