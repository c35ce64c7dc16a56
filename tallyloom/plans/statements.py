"""Uploaded statements to metrics, lender rows, flags and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.money import total
from ..operators import balance, geometry, ledger, lenders, parsers, rollup, summary, trends
from ..operators.lines import to_lines
from ..operators.metrics import nsf_in_text
from .cuts import cut
from .readers import READERS, Reader, Sources, cascade, known

def with_columns_of(raw: DataFrame, words: DataFrame) -> DataFrame:
    """raw, and for statements that it has no credits of the rows by columns on their pages, if those have any."""
    columns = geometry.columnar_rows(words)
    credited = lambda rows: rows.groupBy("statement").agg(F.max("Credit").alias("c")).filter("c > 0").select("statement")
    better = credited(columns).join(credited(raw), "statement", "left_anti")
    rows = columns.join(better, "statement", "left_semi").withColumns({"row_no": F.col("page") * 1_000_000 + F.col("line_no"), "Section": F.lit(""), "Raw Line": F.lit("")})
    return raw.join(better, "statement", "left_anti").unionByName(rows.select(raw.columns))


def process(
    texts: DataFrame, year: Column, words: DataFrame | None = None, today: Column | None = None, *, pages: DataFrame | None = None, cells: DataFrame | None = None,
    boxes: DataFrame | None = None, ledgers: DataFrame | None = None, readers: Sequence[Reader] = READERS,
) -> dict[str, DataFrame]:
    """ledger, metrics, lenders, flagged, totals, averages of (statement, text), a row in metrics for each statement. The
    texts are taken and the rows read now and once, all else when it is used; keyed by statement throughout.

    Lenders are found in the rows as read, also in those whose date can't be resolved; the ledger holds the others only.
    pages, words, cells, boxes: see readers.Sources. ledgers: statements that came as rows (see files.ledgers), which join
    the others' rows. today: for statements without any date, else the year's first day."""
    if ledgers is not None:
        ledgers = cut(ledgers)
        whole = ledgers.select("statement").distinct().withColumn("text", F.lit(""))
        texts = texts.select("statement", "text", *[c for c in ("kind",) if c in texts.columns]).unionByName(whole.join(texts.select("statement"), "statement", "left_anti"), allowMissingColumns=True)
    texts = known(texts, readers)
    raw = cascade(Sources(texts, year, pages, words, cells, boxes), readers)
    raw = cut(with_columns_of(raw, words)) if words is not None else raw
    if ledgers is not None:
        raw = raw.unionByName(ledgers.select(raw.columns))
    raw = cut(lenders.repair_direction(raw))
    rows = ledger.prepare(raw, year).withColumns({"Section": F.lit(""), "Raw Line": F.lit("")})
    found = lenders.with_lender(raw).withColumn("Date", dates.ledger_date(F.col("Date"), year))
    text, short = F.col("text"), texts.select("statement", F.col("short").alias("text"))
    printed = texts.select("statement", nsf_in_text(text).alias("nsf_in_text")).join(summary.route_or_scan(texts, "short"), "statement", "left")
    metrics = rollup.statement_metrics(rows, printed, found, raw)
    span, name = dates.period(text), F.col("statement").cast("string")
    # one row: the year that most of the files' names hold
    usual = trends.usual_year(texts.select(name.alias("position"), name.alias("filename")), year).select(F.lit(0).alias("__k"), F.col("year").alias("usual"))
    own = texts.withColumn("__k", F.lit(0)).join(F.broadcast(usual), "__k").select(
        "statement", span["start"].alias("period_start"), span["stop"].alias("period_end"),
        dates.statement_date(text, name, F.col("usual"), F.make_date(year, F.lit(1), F.lit(1)) if today is None else today).alias("statement_date"),
    )
    charged = parsers.charges(to_lines(short)).groupBy("statement").agg(total(F.col("amount")).alias("charges_only"))
    estimated = F.when(summary.is_bank(text, "Regions"), summary.estimated_balance(text))
    balances = texts.select("statement", estimated.alias("estimated")).join(balance.average_balance(texts).select("statement", "average"), "statement", "left")
    average = F.coalesce("average", "avg_daily_balance")
    metrics = metrics.join(balances, "statement", "left").withColumn("avg_daily_balance", F.when(average == 0, F.coalesce("estimated", F.lit(0.0))).otherwise(average)).drop("average", "estimated")
    sums = rollup.totals(metrics)  # of no dates or charges, which need not be read for them
    metrics = metrics.join(own, "statement", "left").join(charged, "statement", "left").fillna(0.0, ["charges_only"])
    return {
        "ledger": rows, "metrics": metrics, "lenders": lenders.lender_list(lenders.lender_debits(found), lenders.lender_credits(found)), "flagged": parsers.flagged(to_lines(short)),
        "totals": sums, "averages": rollup.averages(sums),
    }
