"""Counts, distributions, folds and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kpis(df: DataFrame) -> DataFrame:
    """The eight dashboard counts, in one scan."""
    n = lambda test: F.count_if(F.coalesce(F.expr(test), F.lit(False)))
    return df.agg(
        F.count("*").alias("total"),
        n("threat_level IN ('HIGH', 'CRITICAL')").alias("high_threat"),
        n("threat_level = 'CRITICAL'").alias("critical"),
        n("army_monitoring_needed = 'YES'").alias("monitoring"),
        n("requires_human_review = 1").alias("review"),
        n("emerging_situation = 1").alias("emerging"),
        n("potential_threat = 'YES'").alias("potential"),
        n("military_relevance = 'HIGH' OR national_security_relevance = 'HIGH'").alias("important"),
    )


def routine(kpi: DataFrame) -> DataFrame:
    """What is neither critical nor monitored, never below zero."""
    return kpi.select(F.greatest(F.lit(0), F.col("total") - F.col("critical") - F.col("monitoring")).alias("routine"))


def distribution(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts of a label without nulls; the largest ones if ``top`` is given."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(top) if top else counts


def source_stats(df: DataFrame) -> DataFrame:
    """Articles of each named source, its last publication and last fetch."""
    named = df.where("source IS NOT NULL AND source <> ''")
    return named.groupBy("source").agg(F.count("*").alias("n"), F.max("published_at").alias("last_published"), F.max("fetched_at").alias("last_fetched"))


def place_counts(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """Total, severe and monitored articles of each place; a place that an
    article names twice counts twice."""
    level = F.coalesce("threat_level", F.lit("UNCLEAR"))
    each = df.select(F.explode(column).alias("place"), level.alias("level"), "army_monitoring_needed")
    counts = each.groupBy("place").agg(F.count("*").alias("total"), F.count_if(F.col("level").isin("HIGH", "CRITICAL")).alias("high_threat"), F.count_if(F.col("army_monitoring_needed") == "YES").alias("monitoring"))
    return counts.orderBy(F.desc("total"), "place").limit(top)


def entity_counts(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    each = df.select(F.explode(column).alias("entity")).where("entity <> ''")
    return each.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(top)


def category_trend(df: DataFrame, top: int = 15) -> DataFrame:
    """Counts of categories; an article without any counts for its type."""
    found = F.when(F.size("categories") == 0, F.array("article_type")).otherwise(F.col("categories"))
    return df.select(F.explode(found).alias("category")).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(top)


def daily_trend(df: DataFrame) -> DataFrame:
    return df.where("published_at IS NOT NULL").groupBy(F.substring("published_at", 1, 10).alias("day")).agg(F.count("*").alias("n"))


def map_fold(df: DataFrame) -> DataFrame:
    """Each state's articles, severe ones, highest level and risk."""
    rank = F.when(F.col("threat_level") == "CRITICAL", 3).when(F.col("threat_level") == "HIGH", 2).when(F.col("threat_level") == "MODERATE", 1).otherwise(0)
    each = df.select(F.explode(F.array_distinct("states")).alias("state"), rank.alias("r"), "source")
    folded = each.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("r") >= 2).alias("priority"), F.max("r").alias("r"), F.slice(F.sort_array(F.collect_set("source")), 1, 6).alias("sources"))
    risk = F.when(F.col("r") == 3, 92).when(F.col("r") == 2, 78).when(F.col("r") == 1, 50).otherwise(20)
    level = F.when(F.col("r") == 3, "CRITICAL").when(F.col("r") == 2, "HIGH").when(F.col("r") == 1, "MODERATE").otherwise("LOW")
    return folded.select("state", "n", "priority", level.alias("max_level"), risk.alias("risk"), "sources")


def fixed_domain_counts(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """A count for each label, zero if it does not occur."""
    domain = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], "position int, label string")
    counts = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(counts, "label", "left").select("position", "label", F.coalesce("n", F.lit(0)).alias("n"))


def with_unlabelled(df: DataFrame, column: str, labels: list[str], name: str = "Unclassified") -> DataFrame:
    """As ``fixed_domain_counts``, and at the end the rows without a label."""
    none = df.agg(F.count_if(F.col(column).isNull() | (F.col(column) == "")).alias("n"))
    return fixed_domain_counts(df, column, labels).unionByName(none.select(F.lit(len(labels)).alias("position"), F.lit(name).alias("label"), "n"))


def type_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value and a total row (null value)."""
    return df.rollup(column).agg(F.count("*").alias("n"))


def cluster_stats(df: DataFrame, cluster: str) -> DataFrame:
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.sum("n").alias("articles"), F.sum(F.col("n") - 1).alias("duplicates"), F.max("n").alias("largest"))


def confusion(df: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    counts = df.where(F.col(gold).isin(labels) & F.col(predicted).isin(labels)).groupBy(F.col(gold).alias("gold")).pivot(predicted, labels).count()
    return counts.na.fill(0)


def class_metrics(df: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each label (0 for an empty denominator)."""
    rows = df.where(F.col(gold).isin(labels) & F.col(predicted).isin(labels)).groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    domain = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    both = rows.select(F.explode(F.array_distinct(F.array("g", "p"))).alias("label"), "g", "p", "n")
    sums = F.broadcast(domain).join(both, "label", "left").groupBy("label").agg(
        F.coalesce(F.sum(F.when((F.col("g") == F.col("label")) & (F.col("p") == F.col("label")), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("p") == F.col("label"), F.col("n"))), F.lit(0)).alias("said"),
        F.coalesce(F.sum(F.when(F.col("g") == F.col("label"), F.col("n"))), F.lit(0)).alias("support"),
    )
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = part(F.col("tp"), F.col("said")), part(F.col("tp"), F.col("support"))
    return sums.select("label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"), "support")


def metric_totals(df: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """One row: sample size, accuracy, macro precision, recall and F1 over all
    labels, and F1 weighted by support; rows outside the labels do not count."""
    kept = df.where(F.col(gold).isin(labels) & F.col(predicted).isin(labels))
    counts = kept.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    both = counts.select(F.explode(F.array_distinct(F.array("g", "p"))).alias("label"), "g", "p", "n")
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    g, p = F.col("g") == F.col("label"), F.col("p") == F.col("label")
    per = both.groupBy("label").agg(total(g & p).alias("tp"), total(p).alias("said"), total(g).alias("support"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = part(F.col("tp"), F.col("said")), part(F.col("tp"), F.col("support"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    # Labels that do not occur count as zero in the means.
    mean = lambda c, name: F.round(F.sum(c) / len(labels), 4).alias(name)
    size = F.sum("support")
    return per.agg(size.alias("sample_size"), F.round(F.sum("tp") / size, 4).alias("accuracy"), mean(precision, "macro_precision"), mean(recall, "macro_recall"), mean(f1, "macro_f1"), F.round(F.sum(f1 * F.col("support")) / size, 4).alias("weighted_f1"))


def evaluation(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: whether there is anything to evaluate, samples, how many are
    right, and the percentage."""
    same = F.count_if(F.col(gold).eqNullSafe(F.col(predicted)))
    return df.agg((F.count("*") > 0).alias("available"), F.count("*").alias("samples"), same.alias("correct"), F.bround(F.coalesce(same / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)) * 100, 1).alias("accuracy"))


def accuracy(df: DataFrame, gold: str, predicted: str) -> Column:
    return df.agg(F.round(F.avg((F.col(gold) == F.col(predicted)).cast("double")) * 100, 1).alias("accuracy"))


def totals(df: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """A row for each key and a total row (null key)."""
    return df.rollup(key).agg(*[F.sum(c).alias(c) for c in sums])
