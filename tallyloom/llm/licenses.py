"""Licence scans: ordered signature rules, gated by keywords, overlaps resolved by priority and containment.

A text becomes its words, set apart by single blanks; rules whose gate words it lacks are not tried. Of the matches, one
that overlaps a match of a higher level goes, then one that lies within another of its level; of equal ones the earlier
rule's stays. Work is a row at a time and needs no shuffle, so neither copies nor long texts gather anywhere.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .importance import words
from .license_rules import BASE, LEVELS, MACROS, TABLE

_FOUND = "array<struct<label: string, level: string, start: long, stop: long, text: string>>"
_SCANNED = f"doc_id long, n_words long, base array<struct<label: string, start: long>>, found {_FOUND}"


@dataclass(frozen=True)
class Rule:
    """place: its number in the table; gate: sets of words of which a text needs one each."""

    place: int
    level: int
    label: str
    gate: tuple[frozenset[bytes], ...]
    pattern: re.Pattern[bytes]
    base: bool


@cache
def rules(table: str = TABLE) -> tuple[Rule, ...]:
    """The rules of a table, in its order."""
    out, level = [], 0
    names = list(LEVELS)
    based = BASE.split()
    for line in filter(None, table.splitlines()):
        if line.startswith("["):
            level = names.index(line.strip("[]"))
            continue
        label, gate, pattern = line.split(": ", 2)
        for name, phrase in MACROS.items():
            pattern = pattern.replace(f"{{{name}}}", phrase)
        needs = tuple(frozenset(w.encode() for w in any_of.split("/")) for any_of in gate.split("+"))
        base = names[level] == "notice" and label in based
        if base:
            based.remove(label)  # the first notice of each base label is its phrase
        out.append(Rule(len(out), level, label, needs, re.compile(rb"(?<= )(?:%b)(?= )" % pattern.encode()), base))
    return tuple(out)


@cache
def _keyed(table: str) -> dict[bytes, list[Rule]]:
    """Rules by each word of their first gate."""
    out: dict[bytes, list[Rule]] = {}
    for rule in rules(table):
        for word in rule.gate[0]:
            out.setdefault(word, []).append(rule)
    return out


def tried(present: set[bytes], table: str = TABLE) -> list[Rule]:
    """Rules that a text with these words can match, in order."""
    keyed = _keyed(table)
    found = {rule.place: rule for word in keyed.keys() & present for rule in keyed[word] if all(not present.isdisjoint(need) for need in rule.gate)}
    return [found[place] for place in sorted(found)]


def matches(text: bytes, among: list[Rule]) -> list[tuple[int, int, Rule]]:
    """All matches as (first byte, byte after the last, rule); text has a blank before and after each word."""
    return [(m.start(), m.end(), rule) for rule in among for m in rule.pattern.finditer(text)]


def resolved(hits: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The matches that stay, by place in the text."""
    kept: list[tuple[int, int, Rule]] = []
    covered: list[tuple[int, int]] = []  # by matches of higher levels, apart and in order
    for level in range(len(LEVELS)):
        begins, ends = [a for a, _ in covered], [b for _, b in covered]
        free = (h for h in hits if h[2].level == level and bisect_left(begins, h[1]) == bisect_right(ends, h[0]))
        reach, stay = -1, []
        for h in sorted(free, key=lambda h: (h[0], -h[1], h[2].place)):
            if h[1] > reach:
                stay.append(h)
                reach = h[1]
        kept += stay
        merged: list[tuple[int, int]] = []
        for a, b in sorted(covered + [h[:2] for h in stay]):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        covered = merged
    return sorted(kept, key=lambda h: (h[0], h[1], h[2].place))


def _place(text: bytes, offsets: list[int]) -> dict[int, int]:
    """Number of the word that begins at each offset."""
    out, at, n = {}, 0, -1
    for offset in sorted(set(offsets)):
        n += text.count(b" ", at, offset)
        at, out[offset] = offset, n
    return out


def scan(docs: DataFrame, table: str = TABLE) -> DataFrame:
    """doc_id, n_words, base (label, start of each place of a base phrase), found (label, level, start, stop, text of each
    detection that stays); a row per row, words counted from 0, stop the word after the last.

    Whole texts; null counts as empty. Null ids and repeated rows come back as they are; other columns are ignored."""
    names = list(LEVELS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: dict[str, list] = {"n_words": [], "base": [], "found": []}
        for value in batch["text"]:
            in_order = words(value.as_py())
            among = tried(set(in_order), table)
            base, found = [], []
            if among:
                text = b" " + b" ".join(in_order) + b" "
                hits = matches(text, among)
                stay = resolved(hits)
                at = _place(text, [h[0] for h in hits])
                base = [{"label": h[2].label, "start": at[h[0]]} for h in hits if h[2].base]
                for a, b, rule in stay:
                    found.append({"label": rule.label, "level": names[rule.level], "start": at[a], "stop": at[a] + text.count(b" ", a, b) + 1, "text": text[a:b].decode()})
            for column, one in zip(columns.values(), (len(in_order), base, found), strict=True):
                column.append(one)
        kinds = (pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("level", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())])))
        return pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | {c: pa.array(v, k) for (c, v), k in zip(columns.items(), kinds, strict=True)})

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _SCANNED)


def spans(docs: DataFrame, table: str = TABLE) -> DataFrame:
    """doc_id, label, level, start, stop, text: a row per detection that stays; documents without one have none."""
    return scan(docs, table).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def report(docs: DataFrame, table: str = TABLE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; a row per row.

    labels are those of the detections that stay and of all base places; score is the confidence of the surest of both
    by LEVELS, 0 without any. Texts without a base place have null first_word and last_word and empty base_labels."""
    sure = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    starts, found = F.col("base.start"), F.col("found.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.array_max(F.concat(F.transform("found", lambda f: sure[f["level"]]), F.transform("base", lambda _: F.lit(LEVELS["notice"])), F.array(F.lit(0.0))))
    return scan(docs, table).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat(F.col("base.label"), found)).alias("labels"), best.alias("score"),
    )
