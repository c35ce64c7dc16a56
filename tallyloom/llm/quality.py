"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Everything is built from native array and string expressions over the row's own text: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP

#: Frequent words of English; French; German; Spanish; Italian and Portuguese; Dutch, Danish, Norwegian
#: and Swedish; Polish and Czech; Turkish, Finnish and Hungarian; Romanian, Indonesian and Vietnamese.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "with", "as", "be", "by", "at", "this", "are", "or", "from",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "dans", "pour", "par",
    "der", "die", "das", "und", "ein", "eine", "ist", "nicht", "von", "den", "zu", "auf", "für", "mit", "sich",
    "el", "los", "las", "y", "es", "en", "por", "con", "no", "se", "del", "al",
    "il", "di", "che", "non", "per", "una", "e", "o", "os", "um", "uma", "do", "da", "não", "para",
    "het", "een", "van", "niet", "met", "og", "er", "det", "til", "som", "av", "på", "och", "att",
    "i", "w", "z", "na", "nie", "jest", "že", "je", "v",
    "ve", "bir", "bu", "da", "ja", "ei", "az", "egy", "és", "nem", "hogy",
    "și", "în", "cu", "yang", "dan", "và", "là", "của", "không",
)
#: Scripts whose words aren't set apart by blanks; characters of words that aren't of the script that STOP_WORDS are
#: written in; words with a letter (tried at their beginnings only, so long words without one cost no more than others).
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
LATE = r"[\x{0E00}-\x{10FFFF}&&" + UNSPACED + "]"  # the same: none of them comes earlier, and looking a script up is dear
NO_LATIN = r"[^\x20\x09-\x0D\p{IsLatin}]"
LETTER_WORD = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D](?<!\p{L}))*+\p{L}[^\x20\x09-\x0D]*+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8  # 1 doubled three times, see repeated_words
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words


@dataclass(frozen=True)
class Rule:
    """A document fails if its measure is under `least` or over `most`; the rule speaks only of texts where `where` holds."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    where: str = "true"


SPACED = "n_unspaced * 2 <= word_chars"

#: The table. Ratios are to words, lines or letters as named; limits are far from what running prose shows. Word lengths
#: are judged where words are set apart by blanks, stop words where most characters are Latin letters: texts in other
#: scripts pass both. Prose of a Latin-script language that shares no frequent word with STOP_WORDS fails few_stop_words.
RULES = (
    Rule("short_words", "word_chars / n_words", least=2.0),
    Rule("long_words", "word_chars / n_words", most=15.0, where=SPACED),
    Rule("symbols", "n_symbols / n_words", most=0.15),
    Rule("exclamations", "n_exclamations / n_words", most=0.3),
    Rule("no_letters", "n_letter_words / n_words", least=0.6),
    Rule("few_stop_words", "n_stop_words / n_words", least=0.02, where="(word_chars - n_no_latin) * 2 > word_chars"),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", most=0.4),
    Rule("capitals", "n_capitals / greatest(word_chars, 1)", most=0.6),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hash, made of those of their halves, halves of halves and words. Sorting (hash,
    position) puts equal ones side by side; a window's words that an earlier repeated window hasn't counted are those past it."""

    def doubled(width: int) -> Callable[[Column], Column]:
        def of(hs: Column) -> Column:
            n = F.size(hs) - width
            return F.zip_with(F.slice(hs, F.lit(1), n), F.slice(hs, F.lit(1 + width), n), lambda a, b: F.xxhash64(a, b))

        return of

    hashes = F.transform(words, lambda w: F.xxhash64(w))  # noqa: PLW0108
    for width in (1, 2, 4):
        hashes = let(hashes, doubled(width))

    def positions(pairs: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(pairs, k)["h"] == p["h"], F.lit(False))
        return F.filter(F.transform(pairs, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"])), lambda i: i.isNotNull())

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, zero, lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])

    def count(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) < F.size(hs), let(pairs, lambda p: covered(F.sort_array(positions(p))))).otherwise(F.lit(0))

    return F.when(F.size(words) > WINDOW, let(hashes, count)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """A struct of all counts of a text; null counts as empty. Characters and words of a kind are counted by matches, words of the list in the text lower-cased once."""
    text = F.coalesce(text, F.lit(""))
    listed = lambda t: F.filter(F.split(t, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    of_words = let(listed(text), lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    stop_words = F.size(F.filter(F.split(F.lower(text), GAP), lambda x: x.isin(*STOP_WORDS)))
    return F.struct(
        of_words.alias("w"), of_lines.alias("l"), stop_words.alias("n_stop_words"), count(LETTER_WORD).alias("n_letter_words"), count(SYMBOLS).alias("n_symbols"), count("!").alias("n_exclamations"), count(r"\p{Lu}").alias("n_capitals"),
        count(LATE).alias("n_unspaced"), count(NO_LATIN).alias("n_no_latin"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row of measures fails."""
    checks = []
    for r in rules:
        value = F.expr(f"try_divide({', '.join(r.measure.split(' / '))})")
        over = F.lit(False)
        if r.least is not None:
            over = over | (value < r.least)
        if r.most is not None:
            over = over | (value > r.most)
        checks.append(F.when(F.coalesce(over, F.lit(True)) & F.expr(r.where), F.lit(r.name)))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed (rule names); a row per row.

    A null or blank text has no words: it fails base and every ratio that speaks of it. base_failed: under MIN_WORDS words, or over
    MAX_REPEATED per cent of them in repeated windows. Repeated rows come back repeated, null ids as null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measures(F.col("text")).alias("m"))
    flat = rows.select("doc_id", *[F.col(f"m.{p}{c}").cast("long").alias(c) for p, c in (("w.", "n_words"), ("w.", "word_chars"), ("", "n_symbols"), ("l.", "n_dup_lines"), ("w.", "n_repeat_words"), ("", "n_stop_words"), ("", "n_letter_words"), ("l.", "n_lines"), ("", "n_exclamations"), ("", "n_capitals"), ("", "n_unspaced"), ("", "n_no_latin"))])
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return flat.withColumn("base_failed", base).withColumn("failed", compiled(rules)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")
