"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash. Pass two shuffles each bucket by
Fisher-Yates (Spark's shuffle() is its inside-out form), lays the buckets end to end, a random permutation of all
rows, and writes them. Position p goes to shard p mod n, slot p div n, so shards differ by at most one row and slots
have no gap (law `rows`). A bucket's places are drawn beforehand from row counts, so texts are shuffled once: each
task that gets a bucket writes its rows, a run of slots in every shard, without moving them again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import running, written

SHARDS = 8
#: Bytes of documents that a bucket holds on average.
BUCKET_BYTES = 4 << 20
#: Equal rows of over a bucket's size and this share of all bytes are hot: fewer than 1 / HOT_SHARE groups.
HOT_SHARE = 1e-5
LAW = "rows"


def _own(docs: DataFrame) -> DataFrame:
    """doc (the whole row, apart from the names used here), place: what tells equal rows apart, the same in every scan however it is split."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place")
    try:
        return docs.select(doc, place)
    except AnalysisException:  # not read from Parquet files
        return written(docs.select(doc)).select("doc", place)


def _text_columns(rows: DataFrame, *more: str) -> DataFrame:
    raw = F.coalesce(F.col("doc.text"), F.lit("")).cast("binary")
    return rows.select(F.col("doc.doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *more)


def _scattered(rows: DataFrame, hot: DataFrame, buckets: int, seed: int) -> DataFrame:
    """rows with bucket: by id and text, so that copies with ids of their own spread, and for hot groups of equal rows by place."""
    same = F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("text_crc32") == F.col("hot_crc"))
    bucket: Column = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", F.when(F.col("hot_crc").isNotNull(), F.col("place"))), F.lit(buckets)).cast("int")
    return rows.join(F.broadcast(hot), same, "left").withColumn("bucket", bucket).drop("hot_id", "hot_crc")


class Scatter:
    """The buckets of documents: how many, which groups of equal rows are dealt by place, and the places drawn for each bucket's rows."""

    def __init__(self, slim: DataFrame, seed: int = 29, bucket_bytes: int = BUCKET_BYTES):
        """slim: doc_id, size, text_crc32, place of each row; written."""
        total = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        self.buckets, self.seed = max(1, -(-total // bucket_bytes)), seed
        groups = slim.groupBy("doc_id", "text_crc32").agg(F.sum("size").alias("s")).filter(F.col("s") > max(bucket_bytes, total * HOT_SHARE))
        self.hot = written(groups.select(F.col("doc_id").alias("hot_id"), F.col("text_crc32").alias("hot_crc")))
        counts = self.scattered(slim).groupBy("bucket").agg(F.count("*").alias("n"))
        counts = running(counts, [F.col("bucket")], {"before": "n"})
        # one row a bucket; sorted, so that a task that runs again draws the same
        draws = counts.repartitionByRange("bucket").sortWithinPartitions("bucket")
        self.places = written(draws.select("bucket", "before", F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(seed)).alias("places")))

    def scattered(self, rows: DataFrame) -> DataFrame:
        return _scattered(rows, self.hot, self.buckets, self.seed)

    def placed(self, rows: DataFrame, shards: int) -> DataFrame:
        """rows (doc_id, size, text_crc32, place and others) with shard and slot; they are shuffled once, by bucket."""
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size", "place"))
        met = self.scattered(rows).withColumn("rank", rank).join(self.places, "bucket")
        position = F.col("before") + F.element_at("places", F.col("rank"))
        return met.select(*rows.columns, position.alias("position")).select(*rows.columns, F.pmod("position", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("position") / shards).cast("long").alias("slot"))


def _report(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = 29, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32, law, shard, slot, grown_shard (null under this law); a row per row.

    A null text is empty: size 1. Rows that tie on id and text are told apart by where they are stored; which of
    them is which is of no consequence. An empty table gives no rows; other columns are ignored."""
    slim = written(_text_columns(_own(docs), "place"))
    return _report(Scatter(slim, seed, bucket_bytes).placed(slim, shards))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 29, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write docs as Parquet under path/shard=k: files of (doc, slot), doc the whole row with all its columns, in slot order.

    Rows are assigned as by `assign`. Null texts and ids, repeated rows and columns of any name, `shard` and `slot`
    too, are written as they are; an empty table writes no row. Each file holds the slots of its task's buckets."""
    rows = _own(docs)
    scatter = Scatter(written(_text_columns(rows, "place")), seed, bucket_bytes)
    out = scatter.placed(_text_columns(rows, "place", "doc"), shards)
    out.select("doc", "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """doc, slot, shard of the shards under path; schema: that of the documents. Nulls, repeated rows and columns of any name
    come back as they were written; shards of an empty table give no rows."""
    return spark.read.schema(StructType().add("doc", schema).add("slot", "long").add("shard", "integer")).parquet(path)


def report_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The columns of assign, taken from the texts and slots in the shards that write_shards wrote; null texts count as empty, null ids stay null, an empty table gives no rows."""
    return _report(_text_columns(read_shards(spark, path, schema), "shard", "slot"))
