"""Joins and merges: idempotent insert, upsert, anti-joins, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of each key by position (the rank filter runs before the
    shuffle, so a common key does not gather)."""
    window = Window.partitionBy(*keys).orderBy(position)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def insert_or_ignore(new: DataFrame, stored: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The rows of ``new`` to append: first of each key, not stored yet."""
    return first_rows(new, keys, position).join(stored.select(*keys), keys, "left_anti")


def fold_batch(new: DataFrame, key: str, overwrite: list[str], keep: list[str], position: str) -> DataFrame:
    """One row a key: overwritten columns from the last row, kept ones from the
    last row that has a value."""
    last = [F.max_by(c, position).alias(c) for c in overwrite]
    filled = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in keep]
    return new.where(F.col(key).isNotNull()).groupBy(key).agg(*last, *filled)


def upsert(new: DataFrame, stored: DataFrame, key: str, overwrite: list[str], keep: list[str]) -> DataFrame:
    """Stored rows merged with new ones (one row a key on both sides)."""
    n, s = new.alias("n"), stored.alias("s")
    there = F.col(f"n.{key}").isNotNull()
    columns = [F.coalesce(f"n.{key}", f"s.{key}").alias(key)]
    columns += [F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in overwrite]
    columns += [F.coalesce(f"n.{c}", f"s.{c}").alias(c) for c in keep]
    return n.join(s, F.col(f"n.{key}") == F.col(f"s.{key}"), "full_outer").select(*columns)


def append_new(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``base`` and the rows of ``more`` whose key it lacks; rows of ``more``
    without a key are kept."""
    keyless = F.col(key).isNull() | (F.col(key).cast("string") == "")
    fresh = more.where(~keyless).join(base.select(key), key, "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True).unionByName(more.where(keyless), allowMissingColumns=True)


def distinct_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Parts one after another, each key from the first part that has it."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return first_rows(out, [key], "part")


def coverage(configured: DataFrame, counts: DataFrame, key: str, count: str) -> DataFrame:
    """Configured keys with their counts, and counted keys that no one configured."""
    marked = configured.select(key).distinct().withColumn("configured", F.lit(True))
    return marked.join(counts, key, "full_outer").select(key, F.coalesce("configured", F.lit(False)).alias("configured"), F.coalesce(count, F.lit(0)).alias(count))


def url_key(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def write_counters(attempted: DataFrame, inserted: DataFrame) -> DataFrame:
    """One row: rows that a write attempted, inserted and skipped."""
    both = attempted.select(F.lit(1).alias("a"), F.lit(0).alias("i")).unionByName(inserted.select(F.lit(0).alias("a"), F.lit(1).alias("i")))
    return both.agg(F.sum("a").alias("attempted"), F.sum("i").alias("inserted"), (F.sum("a") - F.sum("i")).alias("skipped"))


def left_lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of the table's row of their key, or nulls; the
    table has a key once."""
    return rows.join(table, key, "left")


def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of both sides that share a key."""
    return left.join(right, key)


def stamped_upsert(new: DataFrame, stored: DataFrame, key: str, overwrite: list[str], keep: list[str], flags: list[str], now: str) -> DataFrame:
    """As ``upsert``; rows that are written get ``updated_at`` and have their
    processing flags reset to 0, the others keep theirs."""
    fresh = new.withColumns({**{f: F.lit(0) for f in flags}, "updated_at": F.lit(now)})
    return upsert(fresh, stored, key, [*overwrite, *flags, "updated_at"], keep)
