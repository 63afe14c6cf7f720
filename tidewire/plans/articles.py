"""The article view over the test tables, for Spark and for DuckDB.

An article is a document joined with the event of its number (time, kind,
value) and its labels. Array columns stand for places, actors and topics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.tables import table

LEVELS = {"error": "CRITICAL", "purchase": "HIGH", "signup": "MODERATE", "click": "LOW"}


def articles(spark: SparkSession, root: str) -> DataFrame:
    d, e, n = table(spark, root, "documents"), table(spark, root, "events"), table(spark, root, "labels")
    joined = d.join(e, d.doc_id == e.event_id).join(n.withColumnRenamed("doc_id", "label_id"), F.col("doc_id") == F.col("label_id"), "left")
    level = F.lit("UNCLEAR")
    for kind, name in LEVELS.items():
        level = F.when(F.col("event_type") == kind, name).otherwise(level)
    number = F.col("doc_id")
    return joined.select(
        number.alias("article_id"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("article_text"),
        "source",
        "lang",
        F.substring(F.col("ts").cast("string"), 1, 19).alias("published_at"),
        level.alias("threat_level"),
        F.when(F.col("value") >= 100, "YES").otherwise("NO").alias("army_monitoring_needed"),
        F.when(F.col("value") >= 50, "YES").otherwise("NO").alias("potential_threat"),
        F.coalesce("toxic", F.lit(0)).cast("int").alias("requires_human_review"),
        (F.col("user_id") % 2).cast("int").alias("emerging_situation"),
        F.when(F.col("user_id") % 4 == 0, "HIGH").when(F.col("user_id") % 4 == 1, "MEDIUM").when(F.col("user_id") % 4 == 2, "LOW").otherwise("UNCLEAR").alias("importance"),
        F.when(number % 11 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("article_type"),
        F.array("source", F.concat(F.lit("state"), (number % 7).cast("string"))).alias("states"),
        F.array(F.concat(F.lit("city"), (number % 13).cast("string")), "source").alias("cities"),
        F.array(F.col("lang")).alias("countries"),
        F.when(number % 5 == 0, F.expr("array()").cast("array<string>")).otherwise(F.array("event_type", F.concat(F.lit("topic"), (number % 3).cast("string")))).alias("categories"),
        F.array(F.concat(F.lit("org"), (number % 9).cast("string")), F.when(number % 4 == 0, "").otherwise("hq")).alias("organizations"),
        (F.col("value") / 200).alias("confidence"),
        "quality",
        F.when(number % 5 == 0, "HIGH").otherwise("LOW").alias("military_relevance"),
        F.when(number % 7 == 0, "HIGH").otherwise("MEDIUM").alias("national_security_relevance"),
        F.when(number % 3 != 0, F.concat(F.substring(F.col("ts").cast("string"), 1, 10), F.lit("T23:59:00Z"))).alias("fetched_at"),
        (number % 2).cast("int").alias("nlp_processed"),
        F.when(number % 4 != 0, F.concat(F.lit("http://news/"), number.cast("string"))).alias("url"),
        F.when(number % 6 != 0, F.substring("text", 1, 400)).alias("summary"),
        F.when(number % 4 == 1, 0).when(number % 4 == 2, 1).cast("int").alias("is_cluster_representative"),
    )


#: The same view for DuckDB, as the start of a WITH clause.
ARTICLES_SQL = """WITH articles AS (
  SELECT d.doc_id AS article_id, substring(d.text, 1, 80) AS title, d.text AS article_text, d.source, d.lang,
         substring(CAST(e.ts AS VARCHAR), 1, 19) AS published_at,
         CASE e.event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MODERATE'
              WHEN 'click' THEN 'LOW' ELSE 'UNCLEAR' END AS threat_level,
         CASE WHEN e.value >= 100 THEN 'YES' ELSE 'NO' END AS army_monitoring_needed,
         CASE WHEN e.value >= 50 THEN 'YES' ELSE 'NO' END AS potential_threat,
         CAST(coalesce(l.toxic, 0) AS INTEGER) AS requires_human_review,
         CAST(e.user_id % 2 AS INTEGER) AS emerging_situation,
         CASE e.user_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'UNCLEAR' END AS importance,
         CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE e.event_type END AS article_type,
         [d.source, 'state' || CAST(d.doc_id % 7 AS VARCHAR)] AS states,
         ['city' || CAST(d.doc_id % 13 AS VARCHAR), d.source] AS cities,
         [d.lang] AS countries,
         CASE WHEN d.doc_id % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE [e.event_type, 'topic' || CAST(d.doc_id % 3 AS VARCHAR)] END AS categories,
         ['org' || CAST(d.doc_id % 9 AS VARCHAR), CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE 'hq' END] AS organizations,
         e.value / 200 AS confidence, l.quality,
         CASE WHEN d.doc_id % 5 = 0 THEN 'HIGH' ELSE 'LOW' END AS military_relevance, CASE WHEN d.doc_id % 7 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS national_security_relevance,
         CASE WHEN d.doc_id % 3 <> 0 THEN substring(CAST(e.ts AS VARCHAR), 1, 10) || 'T23:59:00Z' END AS fetched_at, CAST(d.doc_id % 2 AS INTEGER) AS nlp_processed,
         CASE WHEN d.doc_id % 4 <> 0 THEN 'http://news/' || d.doc_id END AS url, CASE WHEN d.doc_id % 6 <> 0 THEN substring(d.text, 1, 400) END AS summary,
         CAST(CASE d.doc_id % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS INTEGER) AS is_cluster_representative
  FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""
