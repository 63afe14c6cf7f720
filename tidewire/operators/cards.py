"""Projections of articles and sources for readers: rows, cards, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.lexicon import contains_word
from tidewire.functions.rules import first_rule
from tidewire.functions.text import first_filled

# What stands in for missing fields, and the kinds of sources by
# the words of their names.
UNTITLED, NO_SOURCE, NO_CATEGORY = "Untitled article", "Unknown source", "Unclassified"
OFFICIAL = ["PIB", "Press Information", "Govt"]
SOURCE_WORDS = [
    ("Dedicated Defence", ["defence", "military", "army", "navy", "air force", "review", "idr"]),
    ("Strategic Research", ["idsa", "orf", "sipri", "vif", "diplomat", "rocks", "think"]),
    ("News Wire", ["ani", "wire", "pti"]),
]
PRESS = "National Media"
ACTIVE, RELIABILITY, RECENTLY, STAMP = "Active", "99.4%", "Recently", 16
SUPPORTING, CONTEXT, ENTRY = 300, 80_000, 1200
PLACELESS = "National / Strategic"


def confidence_percent(c: Column) -> Column:
    """A share as a percentage of one digit; what is above 1 is one already, and
    what is no number is null."""
    number = c.try_cast("double")
    return F.bround(F.when(number <= 1, number * 100).otherwise(number), 1)


def source_category(name: Column) -> Column:
    """The kind of a source by the words of its name, in order."""
    rules = [(contains_word(name, OFFICIAL), "Official Government")]
    return first_rule(rules + [(contains_word(F.lower(name), words), kind) for kind, words in SOURCE_WORDS], PRESS)


def source_rows(stats: DataFrame) -> DataFrame:
    """Rows of ``source_stats`` as they are shown, most articles first."""
    last = F.substring(first_filled(F.col("last_published"), F.col("last_fetched"), F.lit(RECENTLY)), 1, STAMP)
    return stats.orderBy(F.desc("n"), "source").select(F.col("source").alias("name"), source_category(F.col("source")).alias("category"), F.lit(ACTIVE).alias("status"), F.lit(RELIABILITY).alias("reliability"), last.alias("last_ingestion"), F.col("n").alias("articles"))


def _any(df: DataFrame, *names: str) -> Column:
    """The first filled of those columns that the table has; null if it has none."""
    there = [F.col(n).cast("string") for n in names if n in df.columns]
    return first_filled(*there) if there else F.lit(None).cast("string")


def legacy(df: DataFrame, position: str) -> DataFrame:
    """Articles of any age of the schema in one shape; ``position`` is a column
    with their place (from 0), which stands in for missing ids."""
    number = (F.col(position) + 1).cast("string")
    text = F.substring(F.coalesce(F.col("text") if "text" in df.columns else F.lit(None).cast("string"), F.lit("")), 1, 500)
    empty = F.expr("array()").cast("array<string>")
    return df.select(
        F.coalesce(_any(df, "id"), number).alias("id"),
        F.coalesce(_any(df, "article_id"), number).alias("article_id"),
        F.coalesce(_any(df, "title", "headline"), F.lit(UNTITLED)).alias("title"),
        F.coalesce(_any(df, "source", "source_name"), F.lit(NO_SOURCE)).alias("source"),
        F.coalesce(_any(df, "url", "link"), F.lit("")).alias("url"),
        F.coalesce(_any(df, "article_type", "category", "predicted_category"), F.lit(NO_CATEGORY)).alias("category"),
        confidence_percent(_any(df, "confidence", "score", "category_confidence")).alias("confidence"),
        _any(df, "published_at", "published", "pub_date").alias("published_at"),
        _any(df, "fetched_at", "fetch_time").alias("fetched_at"),
        F.coalesce(_any(df, "ai_summary", "summary", "description"), text).alias("summary"),
        _any(df, "story_cluster_id", "cluster_id").alias("story_cluster_id"),
        _any(df, "threat_level").alias("threat_level"),
        (F.coalesce(F.col("primary_categories"), empty) if "primary_categories" in df.columns else empty).alias("primary_categories"),
    )


def short_form(df: DataFrame, *more: Column) -> DataFrame:
    """The six fields of an article in a list of results, and what is added."""
    text = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    return df.select(F.col("article_id").cast("string").alias("article_id"), text("title", "Untitled").alias("title"), text("source", "Unknown").alias("source"), F.substring(text("published_at", ""), 1, 10).alias("published_at"), text("url", "").alias("url"), text("threat_level", "UNCLEAR").alias("threat_level"), *more)


def supporting(df: DataFrame) -> DataFrame:
    """Articles as evidence of an answer: the short form and a summary."""
    summary = F.substring(F.coalesce(_any(df, "ai_summary", "summary"), F.lit("")), 1, SUPPORTING)
    return short_form(df, summary.alias("summary"))


def threat_cards(df: DataFrame, *order: Column) -> DataFrame:
    """One page of threats as numbered cards; a page is bounded, so one window
    numbers it. The place is cities and states, else countries, else a default."""
    empty = F.expr("array()").cast("array<string>")
    join = lambda *c: F.array_join(F.concat(*[F.coalesce(F.col(x), empty) for x in c]), ", ")
    spot = first_filled(join("cities", "states"), join("countries"), F.lit(PLACELESS))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return df.select(F.lpad(rank.cast("string"), 2, "0").alias("rank"), "article_id", "title", F.upper(first_filled(F.col("threat_level"), F.lit("HIGH"))).alias("threat_level"), spot.alias("location"))


def context_entries(df: DataFrame, *order: Column, budget: int = CONTEXT) -> DataFrame:
    """What a text model is told of each article: numbered entries, in order, as
    long as their sum stays within the budget. For one bounded selection."""
    window = Window.partitionBy(F.lit(0)).orderBy(*order)
    empty = F.expr("array()").cast("array<string>")
    or_na = lambda c: first_filled(c, F.lit("N/A"))
    places = F.array_join(F.concat(F.coalesce("states", empty), F.coalesce("cities", empty)), ", ")
    text = F.substring(F.coalesce(F.col("article_text") if "article_text" in df.columns else F.lit(None).cast("string"), F.lit("")), 1, 300)
    summary = F.substring(F.coalesce(_any(df, "ai_summary", "summary"), text), 1, ENTRY)
    entry = F.concat(
        F.lit("["), F.row_number().over(window).cast("string"), F.lit("] "), first_filled(F.col("title"), F.lit("Untitled")),
        F.lit("\nSource: "), first_filled(F.col("source"), F.lit("Unknown")), F.lit(" | Date: "), or_na(F.substring("published_at", 1, 10)),
        F.lit("\nThreat Level (AI Flag): "), F.coalesce("threat_level", F.lit("")), F.lit("\nLocations: "), or_na(places), F.lit("\nSummary: "), summary, F.lit("\n"),
    )
    numbered = df.select("*", entry.alias("entry"))
    used = F.sum(F.length("entry")).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn("used", used).where(F.col("used") <= budget).select("article_id", "entry", "used")


def context(entries: DataFrame) -> DataFrame:
    """The entries as one text, in order of the running sum."""
    rows = F.array_sort(F.collect_list(F.struct("used", "entry")))
    return entries.agg(F.array_join(F.transform(rows, lambda r: r["entry"]), "\n---\n").alias("context"))
