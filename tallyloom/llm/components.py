"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import meet, written


#: Links of one node, of 16 bytes each, that a task takes in its stride.
HUB = 100_000


def _star(pairs: DataFrame, larger: bool, total: int) -> DataFrame:
    """pairs(u, v) both ways round. Large star: larger neighbours go to the least node around u; small star: u and its smaller neighbours do."""
    side = pairs.filter(F.col("v") > F.col("u")) if larger else pairs.filter(F.col("v") < F.col("u"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    moved = meet(side, least, ["u"], "n", total, HUB).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node in edges(a, b); rounds grow with the logarithm of the longest chain.

    Links with a null end and those of a node to itself are none; without links there are no rows. Minima are pre-aggregated. A hub's links meet its minimum in one task up to HUB links; the hubs above that which
    hold a notable share of all links are few and meet theirs by a broadcast of bounded size. Only two numbers a round, count and checksum, reach the driver."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        edges = written(_star(_both(_star(_both(edges), True, mark[0])), False, mark[0]))
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
