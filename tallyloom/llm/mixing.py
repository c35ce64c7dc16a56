"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u)/quality, u from a seeded hash of its id, so reruns agree and the
order by key is a weighted sample without replacement. A source's target gives whole epochs first; the rest is
the key-ordered prefix that comes nearest to the remaining token budget. Prefixes are found without sorting a
source: sizes are summed by ever finer buckets of the logarithm of the key, each time in the one bucket of a source
in which its budget ends, and only the documents of the last such bucket are ordered. What leaves this step is one
row per source, which is broadcast to the documents up to a checked size, so they are never shuffled with their
texts; above it documents and rows meet by source and a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, running, written

#: Weights that the sources take in turn.
WEIGHTS = (1, 2, 3)
#: A source repeats at most this often.
MAX_EPOCHS = 3
#: Buckets of 2 to the -FINE of an octave of keys, found from whole octaves down: each pass drops fewer bits of the bucket number.
FINE = 14
SHIFTS = (14, 7, 0)
#: Rows and bytes of source names up to which per-source rows are broadcast; and the salts of a source above that.
MOST_SOURCES, MOST_BYTES, SALTS = 200_000, 32 << 20, 64
NOISE = r"[0-9#*$%&|<>=_~^@]"


def quality_weight(text: Column) -> Column:
    """Share of characters that are not digits or symbols; 1 for no text."""
    size = F.coalesce(F.length(text), F.lit(0))
    return (F.lit(1.0) + F.coalesce(F.length(F.regexp_replace(text, NOISE, "")), F.lit(0))) / (F.lit(1.0) + size)


def _draws(docs: DataFrame, seed: int) -> DataFrame:
    """row (the document's columns, apart from the names used here), name, id, size, source (name, with null told apart), key, bucket.

    A null id draws by its text. Keys of any scale spread over the buckets, as these go by the key's logarithm."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    key = -F.log(u) / quality_weight(F.col("text"))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    draws = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"), F.col("source").alias("name"), number.alias("id"), n_words(F.col("text")).alias("size"), source.alias("source"), key.alias("key"))
    return draws.withColumn("bucket", F.floor(F.log2("key") * (1 << FINE)).cast("int"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of (source, source_size) rows, one per source.

    Sources by code point, null last, take WEIGHTS in turn and share the sum of all sizes; a target stops at
    MAX_EPOCHS times its source and the excess is dealt again by weight until none is above. Sorted by cap per
    weight, the capped sources come first, so the level is that of the first source that fits under it. Sums in
    that order go by ranges, so sources may be as many as hosts; a single row, the level, reaches the driver."""
    sizes = written(sizes)
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    rows = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"i": "one"})
    rows = rows.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("i", F.lit(len(WEIGHTS))).cast("int") + 1).cast("long")).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    rows = running(rows, [F.col("cap") / F.col("w"), F.col("i")], {"caps": "cap", "ws": "w"})
    weights = n // len(WEIGHTS) * sum(WEIGHTS) + sum(WEIGHTS[: n % len(WEIGHTS)])
    fits = (total - F.col("caps")) * F.col("w") <= F.col("cap") * (weights - F.col("ws"))
    first = rows.filter(fits).agg(F.min(F.struct(F.col("cap") / F.col("w"), "i", "caps", "ws"))).first()[0]
    if first is None:  # no rows
        return rows.select("source", "source_size", F.col("cap").cast("double").alias("target"))
    order, i, caps, ws = first
    at_level = (F.col("cap") / F.col("w") > order) | ((F.col("cap") / F.col("w") == order) & (F.col("i") >= i))
    target = F.when(at_level, F.col("w") * F.lit(total - caps).cast("long") / F.lit(weights - ws).cast("long")).otherwise(F.col("cap").cast("double"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _few(sources: DataFrame) -> bool:
    """Whether rows of these sources, one each, may be broadcast."""
    n, size = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    return n <= MOST_SOURCES and size <= MOST_BYTES


def _by_source(draws: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Inner join of draws to one row per source: broadcast if they are few, else by source and salt, so that a hot source is dealt over SALTS tasks."""
    if few:
        return draws.join(F.broadcast(sources), "source")
    salt = F.pmod(F.xxhash64("id", "key"), F.lit(SALTS))
    return draws.withColumn("salt", salt).join(sources.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["source", "salt"]).drop("salt")


def _cuts(draws: DataFrame) -> tuple[DataFrame, bool]:
    """Per source: source, source_size, target, whole epochs, and the key and id of the last document that the remainder takes; and whether they are few. draws: written."""
    total = draws.groupBy("source").agg(F.first("name").alias("name"), F.sum("size").alias("source_size"))
    targets = source_targets(total.select(F.col("name").alias("source"), "source_size")).select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("source"), "source_size", "target")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = written(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    few = _few(targets)
    at = targets.select("source", "rest", F.lit(0).cast("int").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for above, shift in zip((None, *SHIFTS), SHIFTS, strict=False):
        met = _by_source(draws, at, few)
        if above is not None:
            met = met.filter(F.shiftright("bucket", above) == F.col("prefix"))
        sums = met.groupBy("source", "rest", "before", F.shiftright("bucket", shift).alias("digit")).agg(F.sum("size").alias("s"))
        upto = F.col("before") + F.sum("s").over(Window.partitionBy("source").orderBy("digit"))
        ends = sums.withColumn("upto", upto).filter(F.col("upto") >= F.col("rest")).groupBy("source", "rest").agg(F.min(F.struct("digit", (F.col("upto") - F.col("s")).alias("before"))).alias("at"))
        at = written(ends.select("source", "rest", F.col("at.digit").alias("prefix"), F.col("at.before").alias("before")))
    inside = _by_source(draws, at, few).filter(F.col("bucket") == F.col("prefix")).groupBy("source", "rest", "before", "key", "id").agg(F.sum("size").alias("s"))
    upto = F.col("before") + F.sum("s").over(Window.partitionBy("source").orderBy("key", "id"))
    taken = inside.withColumn("upto", upto).filter(F.col("upto") - F.col("s") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("key", "id")).alias("last"))
    cuts = targets.join(at.select("source", F.col("prefix").alias("cut_bucket")), "source", "left").join(taken, "source", "left")
    return written(cuts.select("source", "source_size", "target", "epochs", "cut_bucket", F.col("last.key").alias("cut_key"), F.col("last.id").alias("cut_id"))), few


def _copies(draws: DataFrame, cuts: DataFrame, few: bool) -> DataFrame:
    """draws with copies: how often the mix takes each document. A document without words is never taken."""
    inside = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("id") <= F.col("cut_id")))
    extra = (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & F.coalesce(inside, F.lit(False)))
    return _by_source(draws, cuts, few).withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(F.lit(0)).cast("long"))


def mix_report(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), key; a row per input row.

    Null text: size 0, never taken. Null sources are a source of their own, last. Repeated rows draw the same key
    and are cut alike: all are taken once more or none. An empty table gives no rows; other columns are ignored."""
    draws = written(_draws(docs.select("doc_id", "text", "source"), seed).withColumn("doc_id", F.col("row.c0").cast("long")).drop("row"))
    out = _copies(draws, *_cuts(draws))
    return out.select("doc_id", F.col("name").alias("source"), "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "key")


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with its own columns, whatever their names.

    Null and blank texts are never taken; null sources are one source; a null doc_id draws by its text, so rows that
    repeat a doc_id, or a text without one, are taken alike. An empty table gives no rows."""
    draws = _draws(docs, seed)
    out = _copies(draws, *_cuts(written(draws.drop("row")))).filter(F.col("copies") > 0)
    out = out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
