"""The article store: run log, flags, schema growth, results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.operators.numbering import numbered


def run_log(articles: DataFrame, started: str) -> DataFrame:
    """One row of counts for a finished run."""
    n = lambda test: F.count_if(F.coalesce(F.expr(test), F.lit(False)))
    return articles.agg(
        F.lit(started).alias("started"),
        F.count("*").alias("articles"),
        n("article_text <> ''").alias("with_text"),
        n("article_type IS NOT NULL").alias("classified"),
        n("threat_level IN ('HIGH', 'CRITICAL')").alias("high_threat"),
        n("army_monitoring_needed = 'YES'").alias("monitoring"),
    )


def mark(articles: DataFrame, done: DataFrame, flag: str, key: str = "article_id") -> DataFrame:
    """Sets a 0/1 flag of the rows whose key is in ``done``; others keep theirs."""
    seen = done.select(F.col(key).alias("_key")).distinct().withColumn("_seen", F.lit(1))
    joined = articles.join(seen, articles[key] == F.col("_key"), "left")
    return joined.withColumn(flag, F.coalesce("_seen", F.col(flag), F.lit(0)).cast("int")).drop("_key", "_seen")


def grow(articles: DataFrame, schema: StructType) -> DataFrame:
    """Adds the columns that the schema has and the table lacks, as nulls."""
    return articles.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in articles.columns})


def keep_or(existing: str, computed, least: int = 1):
    """The stored value if it has that many characters, else the computed one."""
    return F.when(F.length(F.coalesce(F.col(existing), F.lit(""))) >= least, F.col(existing)).otherwise(computed)


def number_clusters(rows: DataFrame, leader: str, position: str) -> DataFrame:
    """Numbers clusters by their first appearance, from 0. Only one row a
    cluster is ordered, and the numbers come from a join on the leader."""
    firsts = rows.groupBy(leader).agg(F.min(position).alias("_first"))
    return rows.join(numbered(firsts, ["_first"], "cluster").drop("_first"), leader)


def labelling_file(articles: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV file for annotators: the columns and two empty ones."""
    out = articles.select(*columns, F.lit("").alias("gold_category"), F.lit("").alias("annotation_notes"))
    out.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_results(results: DataFrame, path: str) -> None:
    """Results for readers, a few rows: as JSON lines and as CSV with a header."""
    results.coalesce(1).write.mode("overwrite").json(f"{path}/results.json")
    results.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/confusion.csv")
