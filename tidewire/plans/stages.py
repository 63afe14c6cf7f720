"""The batch pipeline as named stages with a snapshot after each."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import categories, entities, severity
from tidewire.functions import vocabulary as V
from tidewire.functions.models import Model, with_scores
from tidewire.functions.text import summary_of_new
from tidewire.operators import ingest
from tidewire.storage import new_path

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def snapshot_exists(spark: SparkSession, path: str) -> bool:
    """Whether a stage's snapshot was written to its end."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


class Pipeline:
    """Runs stages in order. Each result is written below ``folder`` and reread;
    with ``resume`` a stage whose snapshot is whole is not run again."""

    def __init__(self, spark: SparkSession, stages: list[Stage], folder: str | None = None):
        self.spark, self.stages = spark, stages
        self.folder = (folder or new_path(spark, "stages")).rstrip("/")
        self.seconds: dict[str, float] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def run(self, df: DataFrame, resume: bool = False) -> DataFrame:
        for name, stage in self.stages:
            began = time.perf_counter()
            if not (resume and snapshot_exists(self.spark, self.path(name))):
                stage(df).write.mode("overwrite").parquet(self.path(name))
            df = self.spark.read.parquet(self.path(name))
            self.seconds[name] = time.perf_counter() - began
        return df


def classified(df: DataFrame, model: Model | None = None) -> DataFrame:
    """Labels by a model's scores; by the scorer that needs none where it has none."""
    texts = df.withColumn("_text", categories.label_text(F.col("title"), F.col("article_text"), F.col("summary")))
    scored = with_scores(texts, "_text", "_scores", model, lambda text: categories.overlap_scores(text, V.CATEGORIES))
    return categories.classify(scored, "_scores", "_text").drop("_text", "_scores", "_scores_by")


def summarised(df: DataFrame) -> DataFrame:
    done = F.col("ai_summary") if "ai_summary" in df.columns else F.lit(None).cast("string")
    return df.withColumn("ai_summary", summary_of_new(done, F.col("summary"), F.col("article_text")))


def article_stages(model: Model | None = None) -> list[Stage]:
    """From raw articles (``title, article_text, summary``) to judged ones; ``model``
    scores the labels."""
    return [
        ("cleaning", lambda df: ingest.clean_articles(df, "title", "article_text")),
        ("classification", lambda df: classified(df, model)),
        ("entities_and_places", lambda df: entities.recognise(df, "title", "article_text")),
        ("summaries", summarised),
        ("severity", lambda df: severity.severity(df, "title", "article_text", "summary")),
    ]
