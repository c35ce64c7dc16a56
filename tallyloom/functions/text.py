"""Text as the matchers see it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import SHORT_FORMS


def quoted(words: list[str]) -> str:
    """A pattern that matches any of some literal texts."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words)


def words_of(pattern: str) -> list[list[str]]:
    """Of each alternative of a pattern the words, as written, that whatever it matches holds, the longest first: letters outside of groups, classes and optional parts."""
    plain = re.sub(r"\\.", " ", pattern)
    plain = re.sub(r"\[[^\]]*\]", " ", plain)
    while (fewer := re.sub(r"\([^()]*\)", " ", plain)) != plain:
        plain = fewer
    plain = re.sub(r".(?:[?*]|\{[^}]*\})", " ", plain)
    return [sorted(re.findall("[A-Za-z]{3,}", part), key=len, reverse=True) for part in plain.split("|")]


def has_words(text: Column, wanted: Column) -> Column:
    """Whether a text holds all words of any alternative of words_of(), as any match does: a quick look before a slow search."""
    return F.exists(wanted, lambda words: F.forall(words, lambda w: text.contains(w)))


def any_of(text: Column, words: list[str]) -> Column:
    """Whether a text holds any of some words; those that hold another one needn't be looked for."""
    return text.rlike(quoted([w for k, w in enumerate(words) if not any(x in w and (x != w or n < k) for n, x in enumerate(words))]))


def matches(text: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns))


def squeezed(text: Column) -> Column:
    """Runs of white space to one blank, ends stripped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tidied(line: Column) -> Column:
    """squeezed() of a column: lines of single blanks and visible ASCII, which most are, need no replacing."""
    return F.when(line.rlike(r"[^\x21-\x7e ]|  "), squeezed(line)).otherwise(F.trim(line))


def clean_text(text: Column) -> Column:
    """Upper case, marks -_.,*#/\\ as blanks, white space squeezed."""
    return squeezed(F.translate(F.upper(text), "-_.,*#/\\", "        "))


def short_labels(text: Column) -> Column:
    """Upper case with long labels replaced by short ones, one after the other."""
    out = F.upper(text)
    for long, short in SHORT_FORMS.items():
        out = F.replace(out, F.lit(long), F.lit(short))
    return out


def has_word(text: Column, word: str) -> Column:
    return text.rlike(rf"\b{quoted([word])}\b")


def unspaced(line: Column) -> Column:
    """A line of more than four tokens, none over two characters, without its blanks."""
    parts = F.split(line, " ")
    return F.when((F.size(parts) > 4) & F.forall(F.filter(parts, lambda x: x != ""), lambda x: F.length(x) <= 2), F.replace(line, F.lit(" "), F.lit(""))).otherwise(line)


def flat(text: Column) -> Column:
    """Lines, bars and tabs to single blanks."""
    return F.regexp_replace(F.translate(text, "\n|\t", "   "), r"(?U)\s+", " ")


def extracted(text: Column, pattern: Column, group: int) -> Column:
    """regexp_extract by a pattern that is itself a column."""
    return F.call_function("regexp_extract", text, pattern, F.lit(group))
