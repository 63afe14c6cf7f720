"""The map: articles folded by the sectors (states with coordinates) they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import vocabulary as V
from tidewire.functions.geography import state_of
from tidewire.functions.lexicon import contains_word

# Levels with their risk, trend and what is said of them; title
# words of strategic interest (substrings, so "lac" is also in "place").
LEVELS = {"CRITICAL": (3, 92, "increasing", "High Priority Threat"), "HIGH": (2, 78, "increasing", "Elevated Alert"), "MODERATE": (1, 50, "stable", "Surveillance Active")}
BASE = ("LOW", 20, "stable", "Baseline Observation")
STRATEGIC_WORDS = [
    "army", "navy", "air force", "iaf", "drdo", "bsf", "crpf", "assam rifles", "border", "loc", "lac", "security", "encounter", "insurgent", "busted",
    "operation", "missile", "patrol", "drone", "defence", "defense", "military",
]
QUIET = "Sector stable. Baseline observation active in %s sector."
NEWEST, SOURCES, TITLES = 500, 6, 3
FEED = "Intelligence Feed"


def sectors_of(states: Column, cities: Column) -> Column:
    """The known sectors among the states; if there is none, those of the cities."""
    known = lambda c: F.array_distinct(F.filter(c, lambda s: s.isin(list(V.SECTORS))))
    none = F.expr("array()").cast("array<string>")
    own = known(F.coalesce(states, none))
    return F.when(F.size(own) > 0, own).otherwise(known(F.transform(F.coalesce(cities, none), state_of)))


def is_strategic(level: Column, title: Column) -> Column:
    """A level above the base, or a title with a strategic word."""
    return F.coalesce(level.isin(list(LEVELS)), F.lit(False)) | contains_word(F.lower(F.coalesce(title, F.lit(""))), STRATEGIC_WORDS)


def coordinates(df: DataFrame) -> DataFrame:
    """The coordinates of the sectors, a row each."""
    return df.sparkSession.createDataFrame([(n, *v) for n, v in V.SECTORS.items()], "state string, x double, y double, coordinates string")


def map_sectors(articles: DataFrame, newest: int = NEWEST) -> DataFrame:
    """A row for each sector of the newest articles: counts, level, risk, trend,
    sources (the first by name), the newest distinct strategic titles and the
    coordinates; highest risk first.

    Articles that name no known sector are left out. Ties of time go by id.
    """
    recent = articles.orderBy(F.desc_nulls_last("published_at"), "article_id").limit(newest)
    rank = F.lit(0)
    for level, (r, *_) in LEVELS.items():
        rank = F.when(F.upper("threat_level") == level, r).otherwise(rank)
    named = recent.select("article_id", "published_at", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.nullif("source", F.lit("")), F.lit(FEED)).alias("source"), rank.alias("r"),
                          is_strategic(F.upper("threat_level"), F.col("title")).alias("strategic"), F.explode(sectors_of(F.col("states"), F.col("cities"))).alias("state"))
    folded = named.groupBy("state").agg(F.count("*").alias("articles"), F.count_if(F.col("r") >= 2).alias("priority"), F.max("r").alias("r"), F.slice(F.sort_array(F.collect_set("source")), 1, SOURCES).alias("sources"))
    # The newest row of each title, then the first titles of each sector.
    order = [F.desc_nulls_last("published_at"), F.asc("article_id")]
    told = named.where("strategic AND title <> ''").withColumn("n", F.row_number().over(Window.partitionBy("state", "title").orderBy(*order))).where("n = 1")
    told = told.withColumn("n", F.row_number().over(Window.partitionBy("state").orderBy(*order))).where(F.col("n") <= TITLES)
    told = told.groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda t: t["title"]).alias("developments"))
    level, risk, trend, said = (F.lit(x) for x in BASE)
    for name, (r, score, way, words) in reversed(LEVELS.items()):
        test = F.col("r") == r
        level, risk, trend, said = (F.when(test, a).otherwise(b) for a, b in ((name, level), (score, risk), (way, trend), (words, said)))
    out = folded.join(told, "state", "left").join(F.broadcast(coordinates(articles)), "state")
    return out.select(
        F.concat(F.lit("map-"), F.lower(F.replace("state", F.lit(" "), F.lit("-")))).alias("id"), F.concat("state", F.lit(" Sector")).alias("name"), "state", "x", "y", "coordinates", "articles", "priority",
        level.alias("max_level"), risk.alias("risk"), trend.alias("trend"), said.alias("trend_text"), "sources", F.coalesce("developments", F.array(F.format_string(QUIET, "state"))).alias("developments"),
    ).orderBy(F.desc("risk"), "state")
