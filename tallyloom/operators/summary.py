"""Which bank a statement is from, and the totals it prints."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.money import clean_money, let, total
from ..functions.text import extracted, flat, has_words, squeezed, unspaced, words_of
from .lines import spread, to_lines

_COLUMNS = ("credits_amount", "debits_amount", "credit_count", "debit_count")
#: A pattern, its number of groups, and the words (in lower case, of a test in upper case) that its matches hold.
_PATTERN = "struct<p: string, groups: int, words: array<array<string>>>"
#: A rule: how amounts of a pattern count, and for either side alternatives of patterns.
_RULE = f"struct<how: string, counted: boolean, totals: string, sides: array<array<array<{_PATTERN}>>>>"
_BANK = f"struct<name: string, tests: array<array<{_PATTERN}>>, rule: {_RULE}>"


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups


def _pattern(p: str) -> dict:
    """In any case."""
    return {"p": "(?i)" + p, "groups": _groups(p), "words": [[w.lower() for w in words] for words in words_of(p)]}


def _test(p: str) -> dict:
    return {"p": p, "groups": _groups(p), "words": words_of(p)}


def _listed(patterns: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps([_pattern(p) for p in patterns])), f"array<{_PATTERN}>")


def _likely(lower: Column, patterns: Column) -> Column:
    """The patterns whose words a text in lower case holds; most labels aren't there."""
    return F.filter(patterns, lambda p: has_words(lower, p["words"]))


def _rule(name: str) -> dict:
    how, *sides = L.SUMMARIES[name]
    listed = [[[_pattern(p) for p in patterns] for patterns in side] for side in sides]
    return {"how": how, "counted": name != "TD Canada", "totals": "(?i)" + L.SUMMARY_TOTALS if name == "Capital One" else None, "sides": listed}


def _banks() -> Column:
    """All banks with their tests and rules, in the order in which they are tried: a constant, so the plan holds the expression that reads it once.

    TD is two entries, of its Canadian and its other layout; a statement is of one of them."""
    out = []
    for name, tests in L.BANKS:
        if name == "TD Bank":
            out.append({"name": name, "tests": [[_test(p) for p in (*t, L.CANADA_TRUST)] for t in tests], "rule": _rule("TD Canada")})
            tests = [[*t, f"^(?!.*(?:{L.CANADA_TRUST}))"] for t in tests]
        out.append({"name": name, "tests": [[_test(p) for p in t] for t in tests], "rule": _rule(name)})
    return F.from_json(F.lit(json.dumps(out)), f"array<{_BANK}>")


def _sum(amounts: Column) -> Column:
    return F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x)


def _amounts(text: Column, pattern: Column, group: Column) -> Column:
    """All amounts that a pattern finds."""
    return F.transform(F.regexp_extract_all(text, pattern, group), lambda x: F.abs(clean_money(x)))


def _value(text: Column, pattern: Column, how: Column) -> Column:
    """What a pattern's amounts come to: the first, the sum of all, or the sum of those that differ."""
    return let(_amounts(text, pattern["p"], pattern["groups"]), lambda f: F.when(how == "first", F.coalesce(F.get(f, F.lit(0)), F.lit(0.0))).when(how == "each", _sum(f)).otherwise(_sum(F.array_distinct(f))))


def _added(text: Column, patterns: list[str], how: str = "first") -> Column:
    """Some patterns' values added up."""
    likely = let(F.lower(text), lambda lower: _likely(lower, _listed(patterns)))
    return F.round(_sum(F.transform(likely, lambda p: _value(text, p, F.lit(how)))), 2)


def _side(text: Column, alternatives: Column, rule: Column) -> Column:
    """struct(amount, count): the first alternative that isn't 0, and the first count that any pattern with one finds."""
    first = lambda found, keep, otherwise: F.coalesce(F.get(F.filter(found, keep), F.lit(0)), F.lit(otherwise))

    def read(likely: Column) -> Column:
        added = F.transform(likely, lambda patterns: F.round(_sum(F.transform(patterns, lambda p: _value(text, p, rule["how"]))), 2))
        counted = F.filter(F.flatten(likely), lambda p: rule["counted"] & (p["groups"] == 2))
        counts = F.transform(counted, lambda p: extracted(text, p["p"], 1).try_cast("int"))
        return F.struct(first(added, lambda x: x != 0, 0.0).alias("amount"), first(counts, lambda x: x.isNotNull(), 0).alias("count"))

    return let(let(F.lower(text), lambda lower: F.transform(alternatives, lambda patterns: _likely(lower, patterns))), read)


def _of(credits: Column, debits: Column, credit_count: Column | None = None, debit_count: Column | None = None) -> Column:
    zero = F.lit(0)
    return F.struct(credits.alias("credits_amount"), debits.alias("debits_amount"), (zero if credit_count is None else credit_count).cast("int").alias("credit_count"), (zero if debit_count is None else debit_count).cast("int").alias("debit_count"))


def is_bank(text: Column, name: str) -> Column:
    upper = F.upper(squeezed(text))
    return reduce(or_, [reduce(and_, [upper.rlike(p) for p in patterns]) for patterns in dict(L.BANKS)[name]])


def is_canada_trust(text: Column) -> Column:
    """Whether a statement of TD has the Canadian layout."""
    return F.upper(squeezed(text)).rlike(L.CANADA_TRUST)


def section_sum(region: Column) -> Column:
    """Sum of the amounts of a section without the printed total: the first amount that equals the sum of all others, give or
    take 0.2 % and also after a leading 8 that stands for a dollar sign."""
    tokens = F.filter(F.transform(F.regexp_extract_all(region, F.lit(r"([\d,]+\.\d{2})"), 1), clean_money), lambda x: x > 0)

    def without_total(all_: Column) -> Column:
        whole = _sum(all_)

        def is_total(x: Column) -> Column:
            rest, text = whole - x, F.format_string("%.2f", x)
            bare = F.when(text.rlike(r"^8\d+\."), F.substring(text, F.lit(2), F.length(text)).try_cast("double"))
            near = lambda v: F.abs(v - rest) <= F.greatest(F.lit(0.05), rest * 0.002)
            return (rest > 0) & (near(x) | F.coalesce(near(bare), F.lit(False)))

        return F.round(whole - F.coalesce(F.get(F.filter(all_, is_total), F.lit(0)), F.lit(0.0)), 2)

    return F.element_at(F.transform(F.array(tokens), without_total), 1)


def region(text: Column, start: str, stop: str, after: str | None = None) -> Column:
    """What stands between a case-sensitive header (after another, if given) and the next stop, in any case."""
    body = F.regexp_extract(text, f"(?s)(?:{after})(.*)$", 1) if after else text
    body = F.coalesce(F.nullif(body, F.lit("")), text)
    return F.regexp_extract(body, rf"(?s)(?:{start})(.*?)(?:(?i:{stop})|\z)", 1)


def _regions(line: Column, said: Column) -> Column:
    """Labelled totals, else the sums of the sections."""
    withdrawals, _, checks = L.SUMMARIES["Regions"][2][0]
    credits = F.when(said["credits_amount"] > 0, said["credits_amount"]).otherwise(section_sum(region(line, r"DEPOSITS\s*&?\s*CREDITS", r"Total\s+Deposits|WITHDRAWALS")))
    fee = F.coalesce(F.nullif(_added(line, [r"Monthly\s+Fee\s+\$?\s*([\d,]+\.\d{2})"]), F.lit(0.0)), section_sum(region(line, r"\bFEES\b", r"Total\s+Overdraft|Total\s+Returned")))
    summed = section_sum(region(line, "WITHDRAWALS", r"Total\s+Withdrawals|\bFEES\b", r"DEPOSITS\s*&?\s*CREDITS")) + fee + _added(line, [checks])
    return _of(credits, F.when(_added(line, [withdrawals]) > 0, said["debits_amount"]).otherwise(F.round(summed, 2)))


def _bank_summary(line: Column, bank: Column) -> Column:
    """The printed totals of a flat text by the labels of a bank."""
    rule = bank["rule"]
    line = F.when(bank["name"] == "RBC", F.translate(F.replace(line, F.lit("&amp;"), F.lit("&")), "–—−", "---")).otherwise(line)

    def whole(line: Column, sides: Column) -> Column:
        credit, debit = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
        said = _of(credit["amount"], debit["amount"], credit["count"], debit["count"])
        both = lambda k: F.abs(clean_money(extracted(line, rule["totals"], k)))
        none = (said["credits_amount"] == 0) & (said["debits_amount"] == 0)
        return F.when(rule["totals"].isNotNull() & none, _of(both(1), both(2))).when(bank["name"] == "Regions", _regions(line, said)).otherwise(said)

    return let(line, lambda text: let(F.transform(rule["sides"], lambda alternatives: _side(text, alternatives, rule)), lambda sides: whole(text, sides)))


def generic_summary(line: Column) -> Column:
    """Of a flat text: of each side the largest amount with its count, the earliest of equals; a layout of sections is summed instead."""

    def largest(patterns: Column) -> Column:
        def ranked(pattern: Column, k: Column) -> Column:
            pattern = pattern["p"]
            counts = F.transform(F.regexp_extract_all(line, pattern, F.lit(1)), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
            # most labels aren't there: the text is searched for their amounts only where a count was found
            amounts = lambda n: F.zip_with(_amounts(line, pattern, F.lit(2)), n, lambda x, y: F.struct(x.alias("amount"), (-k).alias("earlier"), y.alias("count")))
            return let(counts, lambda n: F.when(F.size(n) > 0, amounts(n)).otherwise(F.array().cast("array<struct<amount: double, earlier: int, count: int>>")))

        return F.array_max(F.flatten(F.transform(patterns, ranked)))

    special = line.rlike("(?i)" + L.SPECIAL_LAYOUT[0]) & line.rlike("(?i)" + L.SPECIAL_LAYOUT[1])
    summed = lambda patterns: F.when(special, let(_added(line, patterns, "each"), lambda x: F.when(x != 0, x)))
    amount = lambda x: F.round(F.coalesce(x["amount"], F.lit(0.0)), 2)

    def whole(found: Column) -> Column:
        credit, debit = F.get(found, F.lit(0)), F.get(found, F.lit(1))
        return _of(F.coalesce(summed(L.SPECIAL_CREDIT), amount(credit)), F.coalesce(summed(L.SPECIAL_DEBIT), amount(debit)), F.coalesce(credit["count"], F.lit(0)), F.coalesce(debit["count"], F.lit(0)))

    likely = let(F.lower(line), lambda lower: F.transform(F.array(_listed(L.GENERIC_CREDIT), _listed(L.GENERIC_DEBIT)), lambda patterns: _likely(lower, patterns)))
    return let(F.transform(likely, largest), whole)


def _some(summary: Column) -> Column:
    return (summary["credits_amount"] > 0) | (summary["debits_amount"] > 0)


def route(texts: DataFrame, text: str = "text", translated: str | None = None) -> DataFrame:
    """statement, bank, and the summary's columns: the first bank that matches and finds an amount (in the text, then its
    translation), else the generic labels, else zeros. A bank that matches and finds nothing passes on to the next.

    Banks and labels are data: one expression reads them, so the plan doesn't grow with the rules."""
    rows = spread(texts).select("statement", F.upper(squeezed(F.col(text))).alias("upper"), F.array(*[flat(F.col(c)) for c in dict.fromkeys((text, translated or text))]).alias("lines"))
    named = F.filter(_banks(), lambda b: F.exists(b["tests"], lambda patterns: F.forall(patterns, lambda p: has_words(F.col("upper"), p["words"]) & F.rlike(F.col("upper"), p["p"]))))
    one = lambda bank, said: F.struct(bank.alias("bank"), said.alias("s"))
    by_bank = F.flatten(F.transform(named, lambda b: F.transform("lines", lambda line: one(b["name"], _bank_summary(line, b)))))
    by_any = F.transform("lines", lambda line: one(F.lit("generic"), generic_summary(line)))
    first = lambda found: F.get(F.filter(found, lambda c: _some(c["s"])), F.lit(0))
    best = rows.select("statement", F.coalesce(first(by_bank), first(by_any)).alias("best"))
    return best.select("statement", "best.bank", *[F.coalesce(f"best.s.{c}", F.lit(0)).alias(c) for c in _COLUMNS])


def line_scan(lines: DataFrame) -> DataFrame:
    """statement and the summary's columns, read line by line: of each side the last labelled line counts.

    Where at least two kinds of debits are listed apart, their sums count if they are larger."""
    rows = lines.select("statement", "line_no", squeezed(unspaced(F.col("line"))).alias("line"))
    rows = rows.withColumns({"upper": F.upper("line"), "amounts": F.transform(F.regexp_extract_all("line", F.lit(L.LINE_AMOUNT), 1), lambda x: F.abs(clean_money(x)))}).filter(F.size("amounts") > 0)
    has = F.col("upper").contains
    first, last = F.element_at("amounts", 1), F.element_at("amounts", -1)
    number = lambda pattern: F.coalesce(F.regexp_extract("line", pattern, 1).try_cast("int"), F.lit(0))
    one = lambda side, amount, count: F.struct(F.lit(side).alias("side"), amount.alias("amount"), count.alias("count"))
    cases = [(has(w), one(side, first, number(r"^(\d+)"))) for w, side in L.LINE_FIRST] + [(has(w), one(side, first, F.lit(None).cast("int"))) for w, side in L.LINE_UNCOUNTED]
    cases += [(has("DEPOSITS") & has("CREDITS") & has("&"), one("credit", last, number(r"\((\d+)\)"))), (has("CHEQUES") & has("DEBITS"), one("debit", last, number(r"\((\d+)\)")))]
    label = F.when(*cases[0])
    for case in cases[1:]:
        label = label.when(*case)
    debit = (has("CHECKS PAID") & ~has("NO.")) | has("ELECTRONIC PAYMENTS") | has("OTHER WITHDRAWALS") | (has("SERVICE CHARGES") & ~has("SUMMARY"))
    credit = has("ELECTRONIC DEPOSITS") | has("OTHER CREDITS") | (has("DEPOSITS") & ~F.col("upper").rlike("ELECTRONIC|OTHER|SUBTOTAL|POSTING"))
    rows = rows.withColumns({"s": label, "debit": debit, "credit": credit, "last": last})
    latest = lambda side, part: F.coalesce(F.max_by(f"s.{part}", F.when((F.col("s.side") == side) & F.col(f"s.{part}").isNotNull(), F.col("line_no"))), F.lit(0))
    sums = rows.groupBy("statement").agg(
        *[latest(side, part).alias(f"{side}_{part}") for side in ("credit", "debit") for part in ("amount", "count")], F.count_if("debit").alias("kinds"),
        total(F.when(F.col("credit"), F.col("last"))).alias("credits"), total(F.when(F.col("debit"), F.col("last"))).alias("debits"),
    )
    amount = lambda side: F.round(F.when(F.col("kinds") >= 2, F.greatest(f"{side}_amount", f"{side}s")).otherwise(F.col(f"{side}_amount")), 2).alias(f"{side}s_amount")
    return sums.select("statement", amount("credit"), amount("debit"), F.col("credit_count").cast("int").alias("credit_count"), F.col("debit_count").cast("int").alias("debit_count"))


def route_or_scan(texts: DataFrame, translated: str | None = None) -> DataFrame:
    """route(), and for statements that it finds nothing in line_scan(), as bank `lines`."""
    scanned = line_scan(to_lines(texts)).select("statement", F.struct(*_COLUMNS).alias("scan"))
    rows = route(texts, translated=translated).join(scanned, "statement", "left")
    use = F.col("bank").isNull() & _some(F.col("scan"))
    return rows.select("statement", F.when(use, "lines").otherwise(F.col("bank")).alias("bank"), *[F.when(use, F.col(f"scan.{c}")).otherwise(F.col(c)).alias(c) for c in _COLUMNS])


def estimated_balance(text: Column) -> Column:
    """Midpoint of the first and last amount of an upper-case SUMMARY block, where no average is printed."""
    block = F.regexp_extract(flat(text), r"(?s)SUMMARY(.*?)(?:DEPOSITS\s*&?\s*CREDITS|\z)", 1)
    tokens = F.filter(F.transform(F.regexp_extract_all(block, F.lit(r"([\d,]+\.\d{2})"), 1), clean_money), lambda x: x > 0)
    return F.round(F.when(F.size(tokens) > 0, (F.try_element_at(tokens, F.lit(1)) + F.try_element_at(tokens, F.lit(-1))) / 2).otherwise(0.0), 2)
