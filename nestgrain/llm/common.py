"""Pieces that several corpus operators share: tables, measured broadcasts, ranks, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

BROADCAST_BYTES = 32 << 20  # what a measured table may hold and still be sent to every executor
TOP_BIT = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast a materialised table of narrow rows when its counted size allows, else leave the join to Spark."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def held_out(doc_id: str | Column, parts: int, part: int) -> Column:
    """crc32 of the id as text modulo ``parts`` equals ``part``; a null id is never held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts == part, F.lit(False))


def with_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Zero-based position in the total order of ``order``, by range partitions and their counts.

    ``df`` is read twice (once to sample the ranges), so it should be materialised. Only
    one count per partition goes through the driver.
    """
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    at = materialise(at)
    part = F.shiftright("__at", 33)
    counts = sorted((r["p"], r["n"]) for r in at.groupBy(part.alias("p")).count().withColumnRenamed("count", "n").collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    if not offsets:
        return at.withColumn(name, F.lit(0).cast("long")).drop("__at")
    starts = df.sparkSession.createDataFrame(offsets, "__p long, __before long")
    ranked = at.withColumn("__p", part).join(F.broadcast(starts), "__p")
    return ranked.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__p", "__before")


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): smallest node reachable, for every node that has an edge.

    Alternates large-star and small-star steps, each two grouped minima and two joins of
    narrow rows, until the edge set stops changing. No edge list leaves the executors.
    """
    now = materialise(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct()
    )

    def state(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(
            low.select("u", F.col("m").alias("v")))
        now = materialise(small.distinct())
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
