"""Access to the input tables and the article adapter view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root`` (a file or a folder of parts)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
