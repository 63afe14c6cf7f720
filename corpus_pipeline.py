"""A corpus pipeline of the training-data operators.

Quality filter, near-duplicate removal, benchmark decontamination, redaction of
personal data, packing. Each stage takes ``(spark, docs, sf_dir)``; ``run``
writes each stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, neardup, packing, pii, quality
from tidewire.llm.common import fold, materialize, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    Each row is judged by its own text, so repeated rows and repeated keys stay
    or go each by itself; null and empty texts have the score of the empty text;
    an empty table stays empty, and without labels every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = unused("stats", docs.columns)
    counted = materialize(quality.with_statistics(docs, "text", stats), "stats")
    model = quality.train(counted.select("doc_id", F.col(stats).alias("stats")), labels, "doc_id", "quality", fold("doc_id", 5) != 0)
    return counted.where(quality.score_of(F.col(stats), model) >= quality.THRESHOLD).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the least key.

    Null and empty texts are one class; rows without a key take part and stay
    only if their class has no key; an empty table stays empty.
    """
    return neardup.one_of_each(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark.

    Null and empty texts stay, repeated rows stay or go together, an empty
    table stays empty, and with an empty benchmark every document stays.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced; ``n_chars`` follows the text.

    No row goes. A null text stays null and keeps its ``n_chars``; an empty
    table stays empty.
    """
    clean = pii.redact_column(docs, "text", pii.train(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, as ``op2`` reports them.

    Null and empty texts have one piece, the end id; repeated rows are packed
    as often as they occur; an empty table gives no piece.
    """
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "ids")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Signatures, models and tokenizers are beyond SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
