"""Where a plan is cut: rows that several parts of it read are computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share. Only a local session may leave it unset; it then gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", "")
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-cuts-"))
    return context.getCheckpointDir().rstrip("/")


def cut(rows: DataFrame) -> DataFrame:
    """The rows, computed now and kept in folder(), where they survive lost executors."""
    folder(rows.sparkSession)
    return rows.checkpoint()
