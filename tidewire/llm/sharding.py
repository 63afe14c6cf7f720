"""Contiguous balanced shards from global byte-size prefix sums (native).

Rows are dealt by ranges of their key, so that partition p holds the p-th
slice of the global order. Each partition's total and, inside it, each row's
running sum are window functions; a prefix sum over the partition totals (one
row a partition) turns the running sums into global offsets. A row goes to the
shard that its offset falls into when the total is cut at equal targets.

Only the key, the size and what the caller carries are shuffled. The key is
extended by a salt, so that one key with a third of all rows is cut like any
other range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import materialize

PARTITION, SALT, RUN, POSITION = "_part", "_salt", "_run", "_pos"


def balanced_shards(rows: DataFrame, key: list[str], size: Column, shards: int = 16) -> DataFrame:
    """``rows`` with ``size``, ``shard`` (0 to ``shards`` - 1) and ``slot``.

    Order: by ``key`` (nulls first), equal keys in an arbitrary but fixed
    order, so repeated rows are each placed once. A null size counts as 0, an
    empty table gives an empty result, and if all sizes are 0 every row is in
    shard 0. Shard sizes differ from the equal target by less than one row.
    ``slot`` counts from 0 without gaps inside each shard. Existing columns
    ``size``, ``shard`` or ``slot`` of ``rows`` are replaced; the other columns
    are kept.
    """
    sized = rows.drop("shard", "slot").withColumn("size", F.coalesce(size.cast("long"), F.lit(0).cast("long")))
    salted = sized.withColumn(SALT, F.xxhash64(F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange(*[F.col(k).asc_nulls_first() for k in key], F.col(SALT))
    # The partition number must be fixed before it is grouped by, and is
    # computed once: bounds of a range partitioning are sampled anew each time.
    numbered = ranged.withColumn(PARTITION, F.spark_partition_id())
    order = Window.partitionBy(PARTITION).orderBy(*[F.col(k).asc_nulls_first() for k in key], SALT)
    running = numbered.select(
        "*",
        F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(RUN),
        F.row_number().over(order).alias(POSITION),
    )
    running = materialize(running, "running")
    totals = running.groupBy(PARTITION).agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    # One row a partition: the bounded tail of the work.
    before = Window.orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = totals.select(
        PARTITION,
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_above"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    offset = F.col("_before") + F.col(RUN) - F.col("size")
    cut = F.when(F.col("_total") > 0, F.floor((offset * 2 + F.col("size")) * shards / (F.col("_total") * 2))).otherwise(0)
    placed = running.join(F.broadcast(starts), PARTITION).withColumn("shard", F.least(cut, F.lit(shards - 1)).cast("int"))
    # A shard's first row, globally: few rows, one a shard and partition at most.
    placed = placed.withColumn("_index", F.col("_above") + F.col(POSITION) - 1)
    firsts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", (F.col("_index") - F.col("_first")).cast("long")).select(*sized.columns, "shard", "slot")


def op9_shards(spark, root: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes (the law ``bytes``)."""
    documents = spark.read.parquet(f"{root}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = balanced_shards(narrow, ["doc_id", "text_crc32", "size"], F.col("size"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP9_SQL = """
WITH t AS (
  SELECT [list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for i in range(256)] AS t),
d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, [CAST('0x' || x AS BIGINT) for x in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS b FROM documents),
c AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t.t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
p AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run,
         CAST(sum(size) OVER () AS BIGINT) AS total FROM c),
s AS (
  SELECT *, CAST(least(15, ((run - size) * 2 + size) * 16 // (total * 2)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
