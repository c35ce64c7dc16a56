"""Importance resampling towards a target: documents drawn by how much more often the target holds their features.

Identical texts are collapsed by grouping on the full text, so features and weight are computed once a text and
counted by its multiplicity; weights are joined back to documents before the noise that each document has of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, map_batches, meet, running, small_batches, written

#: Words are runs of ASCII letters, digits and characters beyond ASCII: every other ASCII byte is a gap, A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or c >= 97 and c <= 122 or c >= 128 else 32 for c in range(256))
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Longest run of words that is a feature.
LONGEST = 1
#: Distinct features whose bucket a task remembers.
_KNOWN = 200_000


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, in UTF-8; null has none."""
    return (text or "").encode().translate(_FOLD).split()


class _Buckets(dict):
    """Bucket of each feature asked for so far."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def _vectors(longest: int, buckets: int):
    """From distinct texts to sparse feature vectors: n_words, n_features, at (buckets, ascending), n (counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for text in batch["text"]:
                found = words(text.as_py())
                grams = found if longest == 1 else [b" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]
                at, n = np.unique(np.fromiter(map(known.__getitem__, grams), np.int32, len(grams)), return_counts=True)
                if len(known) > _KNOWN:
                    known.clear()
                for column, value in zip(columns, (len(found), len(grams), at, n), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            made = dict(zip(("n_words", "n_features", "at", "n"), (pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), strict=True))
            yield pa.RecordBatch.from_pydict({"key": batch["key"], "copies": batch["copies"]} | made)

    return run


def collapsed(rows: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """key (SHA-256 of the text), copies, n_words, n_features, at, n: a row for each distinct text; null counts as empty.

    Grouped by the full text beside its key; partial aggregation collapses copies before the shuffle, which each
    distinct text of a task crosses once."""
    small_batches(rows.sparkSession)
    texts = rows.select(_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text")).groupBy("key", "text").agg(F.count("*").alias("copies"))
    return texts.mapInArrow(_vectors(longest, buckets), "key binary, copies long, n_words long, n_features long, at array<int>, n array<long>")


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def bucket_counts(vectors: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds, copies counted: `buckets` numbers, whatever the rows. Each task sums its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in filter(len, batches):
            at, n = batch["at"], batch["n"]
            lengths = np.diff(at.offsets.to_numpy())
            np.add.at(total, at.flatten().to_numpy(), n.flatten().to_numpy() * np.repeat(batch["copies"].to_numpy(), lengths))
        (held,) = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"b": pa.array(held, pa.int32()), "s": pa.array(total[held], pa.int64())})

    sums = vectors.select("copies", "at", "n").mapInArrow(run, "b int, s long").groupBy("b").agg(F.sum("s").alias("s"))
    out = np.zeros(buckets, np.int64)
    for b, s in sums.collect():
        out[b] = s
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: floor(1000 ln) of its smoothed share in the target over that in the source."""
    all_s, all_t, k = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda s, t: float(t + 1) * float(all_s + k) / (float(s + 1) * float(all_t + k))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(source, target, strict=True)], np.int64)


def _weighed(vectors: DataFrame, gain: np.ndarray) -> DataFrame:
    """Each text's sum of gains; gain has one number a bucket."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, n = batch["at"], batch["n"]
        offsets = at.offsets.to_numpy() - at.offsets[0].as_py()
        upto = np.concatenate(([0], np.cumsum(gain[at.flatten().to_numpy()] * n.flatten().to_numpy())))
        weight = pa.array(upto[offsets[1:]] - upto[offsets[:-1]], pa.int64())
        return pa.RecordBatch.from_pydict({c: batch[c] for c in ("key", "copies", "n_words", "n_features")} | {"weight": weight})

    return map_batches(vectors, run, "key binary, copies long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) with g the Gumbel number of the first 32 bits of sha256(`seed:doc_id`); a null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row of docs by the features of target's texts.

    Null and wordless texts have no features and weight 0. Repeated rows come back repeated. An empty target counts
    as one that holds every bucket alike. Columns other than doc_id and text are ignored."""
    vectors = written(collapsed(docs, longest, buckets))
    gain = gains(bucket_counts(vectors, buckets), bucket_counts(collapsed(target, longest, buckets), buckets))
    weighed = _weighed(vectors, gain)
    total = vectors.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("text")).alias("key"))
    met = meet(rows, weighed, ["key"], "copies", total)
    return met.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank; a row per row of docs, rank null for those not drawn.

    Of the rows with at least least_words words, percent of a hundred (rounded down) are drawn: the highest scores, ties
    to the smaller doc_id, null ids last; of equal rows any come first. Ranks come from sums over ranges of scores, so
    no task sees more than its range. Empty docs give no rows."""
    scored = written(weigh(docs, target, longest, buckets, seed))
    eligible = scored.filter(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    ranked = running(eligible.withColumn("one", F.lit(1)), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], {"before": "one"})
    rank = F.when(F.col("before") < drawn, F.col("before") + 1).cast("long").alias("rank")
    others = scored.filter(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank).unionByName(others)


def sample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of docs with all their columns; docs' doc_id should be unique: of an id that repeats all rows come if one is drawn."""
    drawn = written(resample(docs, target, **how).filter("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct())
    return docs.join(if_small(drawn), docs["doc_id"].cast("long").eqNullSafe(F.col("__drawn")), "left_semi")
