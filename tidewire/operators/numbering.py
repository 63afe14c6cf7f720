"""Global positions without a single task: sorted partitions and their offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.storage import stored


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with its position (from 0) by ``order``.

    Rows are dealt by ranges of the order and written once, so that the ranges,
    which are sampled anew by each evaluation, hold for counts and rows alike;
    one row a partition is summed up by a window over the partition numbers.
    """
    ranged = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    ranged = stored(ranged, "numbered")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_start"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("_part", "_start", before.alias("_base"))
    return ranged.join(F.broadcast(base), "_part").withColumn(name, F.col("_id") - F.col("_start") + F.col("_base")).drop("_part", "_id", "_start", "_base")


def numbered_within(df: DataFrame, group: str, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with its position (from 0) inside its group: the global position
    less that of the group's first row, so a large group is not one task."""
    placed = stored(numbered(df, [group, *order], "_at"), "placed")
    firsts = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_at").alias("_first"))
    joined = placed.join(F.broadcast(firsts), F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, F.col("_at") - F.col("_first")).drop("_at", "_group", "_first")
