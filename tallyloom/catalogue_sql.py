"""DuckDB SQL building blocks of the catalogue's oracles: common table expressions, each on those before it."""

from __future__ import annotations

from .functions import lexicon as L
from .sources.adapters import DEBIT_EVENTS, DESCRIPTIONS


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return ", ".join(map(literal, words))


def contains_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {literal(w)})" for w in words) + ")"


def matches_any(column: str, patterns, flags: str = "") -> str:
    return f"regexp_matches({column}, {literal('|'.join(f'(?:{p})' for p in patterns))}{', ' + literal(flags) if flags else ''})"


def clean(column: str) -> str:
    return rf"trim(regexp_replace(translate(upper({column}), '-_.,*#/\', '        '), '\s+', ' ', 'g'))"


def total(column: str) -> str:
    return f"round(coalesce(sum(({column})::DECIMAL(18,4)), 0)::DOUBLE, 2)"


def python_clean(text: str) -> str:
    return " ".join("".join(" " if c in "-_.,*#/\\" else c for c in text.upper()).split())


LEDGER = f"""ledger AS (SELECT 'u' || user_id || '-' || strftime(ts, '%Y-%m') AS statement, event_id AS row_no, ts AS date, ([{listed(DESCRIPTIONS)}])[event_id % {len(DESCRIPTIONS)} + 1] AS description,
    CASE WHEN event_type IN ({listed(DEBIT_EVENTS)}) THEN round(abs(value), 2) ELSE 0.0::DOUBLE END AS debit, CASE WHEN event_type IN ({listed(DEBIT_EVENTS)}) THEN 0.0::DOUBLE ELSE round(abs(value), 2) END AS credit FROM events)"""

_KEYWORDS = ", ".join(f"({i}, {literal(name)}, {k}, {literal(python_clean(kw))})" for i, (name, kws) in enumerate(L.LENDERS.items()) for k, kw in enumerate(kws))
DETECTED = rf"""kw AS (SELECT * FROM (VALUES {_KEYWORDS}) t(lender_ord, lender, kw_ord, kw)),
    cleaned AS (SELECT DISTINCT description AS d, {clean('description')} AS c FROM ledger),
    tried AS (SELECT d, 0 AS variant, c AS v FROM cleaned UNION ALL SELECT d, 1, trim(regexp_replace(c, {literal(L.PREFIXES)}, '')) FROM cleaned),
    detected AS (SELECT DISTINCT ON (d) d, lender, kw FROM tried JOIN kw ON regexp_matches(v, '\b' || regexp_escape(kw) || '\b') OR starts_with(v, kw) OR starts_with(v, replace(kw, ' ', ''))
        OR (length(kw) >= 6 AND regexp_matches(v, '\b' || regexp_escape(kw))) ORDER BY d, variant, lender_ord, kw_ord)"""

FOUND = rf"""found AS (SELECT l.*, lender, kw AS keyword, {contains_any('upper(description)', L.ALWAYS_CREDIT)} AS always_credit, {contains_any('upper(description)', L.ALWAYS_DEBIT)} AS always_debit,
        {matches_any('upper(description)', L.FUNDING_DEPOSIT)} AS deposit, contains(upper(description), 'REFERENCE #') AS skipped,
        NOT {matches_any('upper(description)', L.DEBIT_ONLY)} AND starts_with(ltrim(upper(description)), kw) AND (regexp_matches(description, '\d{{5,}}') OR regexp_matches(description, '\d{{2}}/\d{{2}}/\d{{2,4}}')) AS funding,
        contains(upper(description), 'REFERENCE #') AND (contains(upper(description), 'ACH ITEMS') OR contains(upper(description), 'ACH DEBIT')) AS bounced FROM ledger l JOIN detected ON description = d)"""

DEBITS = """debits AS (SELECT statement, row_no, date, description, lender, keyword, CASE WHEN debit <= 0 AND always_debit THEN credit ELSE debit END AS amount FROM found
        WHERE CASE WHEN always_debit THEN NOT bounced ELSE NOT (always_credit OR deposit OR funding) END AND CASE WHEN debit <= 0 AND always_debit THEN credit ELSE debit END > 0)"""
CREDITS = """credits AS (SELECT DISTINCT ON (statement, date, description, amount) * FROM (SELECT statement, row_no, date, description, lender, keyword,
        CASE WHEN credit > 0 THEN credit WHEN debit > 0 AND (always_credit OR deposit OR funding) THEN debit END AS amount FROM found WHERE NOT skipped AND NOT always_debit) WHERE amount > 0 ORDER BY statement, date, description, amount, row_no)"""
MONTHLY = f"""gaps AS (SELECT *, date_diff('day', lag(date::DATE) OVER (PARTITION BY statement, lender ORDER BY date::DATE, row_no), date::DATE) AS gap FROM debits),
    frequencies AS (SELECT statement, lender, count(*) AS n, CASE WHEN count(*) < 2 OR count(*) FILTER (gap BETWEEN 5 AND 9) * 2 >= count(gap) THEN 'weekly' WHEN count(*) FILTER (gap BETWEEN 25 AND 35) * 2 >= count(gap) THEN 'monthly' ELSE 'other' END AS frequency,
        median(amount) AS typical, {total('amount')} AS paid FROM gaps GROUP BY statement, lender),
    monthlies AS (SELECT *, CASE WHEN frequency = 'weekly' THEN round(typical * {L.WEEKS_PER_MONTH}, 2) ELSE paid END AS monthly FROM frequencies)"""
METRICS = f"""base AS (SELECT statement, {total('credit')} AS credits, {total('debit')} AS debits, count(*) FILTER ({matches_any('description', L.NSF, 'i')}) AS nsf_count,
        count(*) FILTER ({matches_any('upper(description)', L.LOAN)}) AS loan_count, count(*) FILTER ({matches_any('upper(description)', L.POS)}) AS pos_count FROM ledger GROUP BY statement),
    obligations AS (SELECT statement, {total('monthly')} AS lender_debits FROM monthlies GROUP BY statement), advances AS (SELECT statement, {total('amount')} AS lender_credits FROM credits GROUP BY statement),
    joined AS (SELECT b.statement, credits, debits, round(credits - debits, 2) AS cash_flow, coalesce(lender_debits, 0) AS lender_debits, coalesce(lender_credits, 0) AS lender_credits, round(credits - coalesce(lender_credits, 0), 2) AS true_revenue, nsf_count, loan_count, pos_count, 0.0::DOUBLE AS avg_daily_balance
        FROM base b LEFT JOIN obligations USING (statement) LEFT JOIN advances USING (statement)),
    metrics AS (SELECT *, CASE WHEN true_revenue > 0 THEN round(lender_debits / true_revenue * 100, 4) ELSE 0 END AS withholding_rate FROM joined)"""
LENDER_LIST = """lender_list AS (SELECT lender, keyword, amount, coalesce(monthly, 0) AS monthly_amount, statement, 'debit' AS type FROM debits LEFT JOIN monthlies USING (statement, lender)
        UNION ALL SELECT lender, keyword, amount, 0.0, statement, 'credit' FROM credits)"""
_CHAIN = [LEDGER, DETECTED, FOUND, DEBITS, CREDITS, MONTHLY, METRICS, LENDER_LIST]


def upto(part: str) -> str:
    """WITH all blocks up to one of them."""
    return "WITH " + ",\n".join(_CHAIN[: _CHAIN.index(part) + 1]) + "\n"
