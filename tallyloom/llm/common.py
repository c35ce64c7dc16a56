"""What the operators of this subpackage share: inputs, written cuts, Arrow batches, fixed expressions."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is set: a temporary one on a local master, an error on a cluster, whose machines don't share one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder, read back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete written cuts that only other written cuts were made from: nothing will read them again."""
    for cut in cuts:
        jvm, conf = cut.sparkSession._jvm, cut.sparkSession.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(cut.written_at)
        place.getFileSystem(conf).delete(place, True)


def settle(spark: SparkSession) -> None:
    """After a cut: let Spark delete the shuffle files before it, ahead of the next ones.

    Spark deletes a shuffle's files when the driver's JVM collects the plan that made it, which Python's references
    keep alive. A driver with a heap to spare may not collect for hours, so both are asked to; it takes well under a second."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: hold Arrow batches to fewer rows than Spark's default unless the session already asks for fewer.

    This changes the session. Spark reads the setting when a plan is made ready to run, which for the DataFrames
    returned from here is after the call, so it can't be put back; it alters the size of batches and no result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


#: A key is hot with over this share of all rows (and some number at least): there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1e-4


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, least: int = 1000) -> DataFrame:
    """Inner join of rows to groups (one row a key; `size`: its number of rows out of `total`) on keys without nulls, dropping `size`.

    Groups of over `least` rows and HOT_SHARE of all are fewer than 1 / HOT_SHARE, whatever the input, and are broadcast,
    so their rows stay where they are; each of the others is small enough for one task of a shuffled join."""
    if total <= least:
        return rows.join(groups.drop(size), keys)
    hot = F.col(size) > max(least, total * HOT_SHARE)
    values = [c for c in groups.columns if c not in (*keys, size)]
    marked = rows.join(F.broadcast(groups.filter(hot).drop(size).withColumn("__hot", F.lit(True))), keys, "left")
    others = marked.filter("__hot is null").select(*rows.columns).join(groups.filter(~hot).drop(size), keys)
    return marked.filter("__hot").select(*rows.columns, *values).unionByName(others)


#: Rows of numbers that a task can hold of a broadcast side.
FEW = 1_000_000


def if_small(ids: DataFrame) -> DataFrame:
    """A written cut of ids, marked for a broadcast if it has at most FEW rows; larger ones meet by a shuffle."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with a column for each of sums (new name: column): its sum over all rows before, in a total order.

    Rows are dealt by ranges of the order and summed within each; only one row a range is summed in a single task."""
    parts = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    whole = parts.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begun = whole.select("__part", *[F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = parts.join(F.broadcast(begun), "__part")
    return met.select(*rows.columns, *[(F.col(f"__{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(n) for n, c in sums.items()])


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply f to each Arrow batch."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
