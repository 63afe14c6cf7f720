"""One object for all named queries of the serving layer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import aggregates, briefs, cards, chat, facets, intent, merge, sectors
from tidewire.operators.index import TextIndex
from tidewire.storage import stored

# Bounds (least, most) of each query's parameters.
BOUNDS = {"articles": (1, 500), "threats": (1, 200), "monitoring": (1, 500), "review": (1, 500), "entities": (1, 100), "trends": (1, 365), "legacy": (1, 1000), "dead_letters": (1, 500), "question": (1, 500)}
SERVICE = "News Intelligence API"
ENTITY_FIELDS = ["organizations", "people", "equipment", "countries"]


class OutOfBounds(ValueError):
    """A parameter is outside its bounds."""


def _bounded(name: str, value: int) -> int:
    least, most = BOUNDS[name]
    if not least <= value <= most:
        raise OutOfBounds(f"{name}: {value} is not within {least} and {most}")
    return value


class Desk:
    """Queries over an article table, and, where given, the record store and
    the dead letters. Methods return lazy DataFrames; ``digest`` writes its
    positions to the shared folder at once. ``today`` is an ISO date, so results
    can be repeated.
    """

    def __init__(self, articles: DataFrame, today: str, records: DataFrame | None = None, dead: DataFrame | None = None, places: list[str] | None = None, actors: list[str] | None = None):
        self.all, self.today, self.records, self.dead = articles, today, records, dead
        self.places, self.actors = places or ["cities", "states", "countries"], actors or ["organizations"]
        self.newest = [F.desc_nulls_last("published_at"), F.asc("article_id")]

    def _since(self, days: int) -> DataFrame:
        return self.all.where(F.col("published_at") >= F.date_format(F.date_sub(F.lit(self.today).cast("date"), days), "yyyy-MM-dd"))

    def _brief(self, df: DataFrame) -> DataFrame:
        return briefs.synthesize(df, [], self.newest, ["title"], self.places, self.actors)

    def health(self) -> DataFrame:
        return self.all.agg(F.lit("ok").alias("status"), F.count("*").alias("articles"))

    def legacy_health(self) -> DataFrame:
        return self.all.agg(F.lit("online").alias("status"), F.lit(SERVICE).alias("service"), (F.count("*") > 0).alias("data_exists"))

    def kpis(self) -> dict[str, DataFrame]:
        return {"kpis": aggregates.kpis(self.all), "levels": aggregates.distribution(self.all, "threat_level"), "types": aggregates.distribution(self.all, "article_type", 10)}

    def articles(self, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
        return facets.page(facets.facet_filter(self.all, **filters), _bounded("articles", limit), offset)

    def threats(self, level: str | None = None, limit: int = 50) -> dict[str, DataFrame]:
        return {"articles": facets.page(facets.facet_filter(self.all, level=level), _bounded("threats", limit)), "levels": aggregates.distribution(self.all, "threat_level")}

    def priority(self, limit: int = 50) -> DataFrame:
        """Critical articles, then severe ones, each once."""
        return merge.distinct_union([self.threats("CRITICAL", limit)["articles"], self.threats("HIGH", limit)["articles"]], "article_id")

    def monitoring(self, limit: int = 100) -> DataFrame:
        return facets.monitoring_queue(self.all, _bounded("monitoring", limit))

    def review(self, limit: int = 100) -> DataFrame:
        return facets.review_queue(self.all, _bounded("review", limit))

    def locations(self) -> dict[str, DataFrame]:
        rows = facets.located_rows(self.all)
        return {c: aggregates.place_counts(rows, c) for c in ("states", "cities", "countries")}

    def entities(self, field: str = "organizations", limit: int = 20) -> DataFrame:
        """Unknown fields mean the default one."""
        chosen = field if field in ENTITY_FIELDS and field in self.all.columns else "organizations"
        return aggregates.entity_counts(self.all, chosen, _bounded("entities", limit))

    def sources(self) -> DataFrame:
        return cards.source_rows(aggregates.source_stats(self.all))

    def map(self) -> DataFrame:
        return sectors.map_sectors(self.all)

    def trends(self, days: int = 30) -> dict[str, DataFrame]:
        recent = self._since(_bounded("trends", days))
        return {"categories": aggregates.category_trend(recent), "days": aggregates.daily_trend(recent).orderBy("day")}

    def daily_brief(self) -> DataFrame:
        return self._brief(briefs.or_unfiltered(self._since(2), self.all, self.newest, 50, 30))

    def situation_brief(self, topic: str, civilian: list[str], limit: int = 20) -> DataFrame:
        """Articles whose title or places name the topic, without civilian ones."""
        name = topic.replace(" Sector", "").replace(" sector", "").strip()
        found = facets.term_in_arrays(self.all, name, self.places, ["title"]).orderBy(*self.newest).limit(limit)
        return self._brief(facets.exclude_titles(found, civilian) if civilian else found)

    def country_brief(self, pair: str, limit: int = 25) -> DataFrame:
        """``A-B`` or ``A vs B``: articles of each country, each once."""
        names = [n.strip() for n in pair.replace(" vs ", "-").split("-") if n.strip()]
        parts = [facets.facet_filter(self.all, country=n).orderBy(*self.newest).limit(limit) for n in names]
        return self._brief(merge.distinct_union(parts, "article_id") if parts else self.all.limit(0))

    def trend_brief(self, limit: int = 40) -> DataFrame:
        return self._brief(self.all.orderBy(*self.newest).limit(limit))

    def regional_brief(self, region: str, limit: int = 20) -> DataFrame:
        """Articles of which a place names the region."""
        return self._brief(facets.term_in_arrays(self.all, region, self.places).orderBy(*self.newest).limit(limit))

    def article(self, article_id) -> DataFrame:
        return self.all.where(F.col("article_id") == F.lit(article_id))

    def at(self, position: int) -> DataFrame:
        return facets.at_position(self.all, position, *self.newest)

    def categories(self) -> DataFrame:
        return self.all.groupBy(F.coalesce("article_type", F.lit("Unclassified")).alias("category")).agg(F.count("*").alias("n"))

    def legacy(self, category: str = "all", limit: int = 100) -> DataFrame:
        """Newest articles of a category in the legacy shape; ids are there, so
        positions stand in for none."""
        rows = self.all if category.lower() == "all" else self.all.where(F.lower("article_type") == category.lower())
        return cards.legacy(rows.orderBy(*self.newest).limit(_bounded("legacy", limit)).withColumn("_at", F.lit(0)), "_at")

    def digest(self) -> DataFrame:
        """Every article with its category and its place there, newest first."""
        return facets.bucketed(self.all, "article_type", self.newest)

    def stories(self, known: list[str]) -> DataFrame:
        """The first stories of each category for a digest."""
        return briefs.stories(self.all, "article_type", self.newest, known)

    def evaluation(self, gold: str, predicted: str) -> DataFrame:
        return aggregates.evaluation(self.all, gold, predicted)

    def ask_all(self, questions: DataFrame, key: str, text: str, index: TextIndex, vocabulary: tuple[list[str], dict[str, str], list[str]], vectors: DataFrame | None = None, embed=None) -> DataFrame:
        """The answers to a table of questions, in one plan: ``vocabulary`` holds the
        places, their aliases and the stop words; ``index`` the articles' texts.
        Empty questions, and those over the bound, have no row."""
        length = F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))
        asked = chat.parsed(questions.where(length.between(*BOUNDS["question"])), key, text, self.today, *vocabulary)
        return self._answered(asked, index, vectors, embed)

    def ask(self, question: str, parse: Callable[[str], dict] | None = None, search: Callable[[dict], DataFrame] | None = None, *, index: TextIndex | None = None, vocabulary: tuple[list[str], dict[str, str], list[str]] = ([], {}, []), vectors: DataFrame | None = None) -> DataFrame:
        """The answer to one question, by the stored index and the rules of intent.

        A language model's ``parse`` may give parts of the intent (a dict); without
        it, or if it fails, the rules do. With a ``search`` of the caller's own, the
        brief of what it gives for the intent.
        """
        _bounded("question", len(question.strip()))
        if search is not None:
            found = parse(question)
            rows = search(found)
            kinds = {"trend_analysis": lambda: self._brief(rows.orderBy(*self.newest).limit(40)), "general_search": lambda: self._brief(rows)}
            return intent.route(found.get("kind", "general_search"), kinds)
        one = self.all.sparkSession.createDataFrame([(0, question)], "qid long, question string")
        asked = chat.parsed(one, "qid", "question", self.today, *vocabulary)
        given = intent.with_parser(question, parse, lambda q: {})
        for column in {"kind", "locations", "search_terms", "level", "mood", "since"} & set(given):
            asked = asked.withColumn(column, F.lit(given[column]).cast(asked.schema[column].dataType))
        if {"locations", "search_terms"} & set(given):
            asked = intent.search_query(asked.withColumn("_own", F.split("question", " ")), "locations", "search_terms", "_own").drop("_own")
        return self._answered(asked, index, vectors)

    def _answered(self, asked: DataFrame, index: TextIndex, vectors: DataFrame | None, embed=None) -> DataFrame:
        asked = stored(asked, "questions")
        hits = stored(chat.retrieved(asked, self.all, index, vectors, embed), "answers")
        return chat.answered(asked, hits, self.all, self.newest, self.places, self.actors)

    def ingestion_sources(self, configured: DataFrame) -> DataFrame:
        """Configured sources with their records, and sources that are not configured."""
        counts = self.records.groupBy("source_name").agg(F.count("*").alias("n"))
        return merge.coverage(configured, counts, "source_name", "n")

    def dead_letters(self, limit: int = 50, source_type: str | None = None) -> DataFrame:
        return facets.newest_dead_letters(self.dead, _bounded("dead_letters", limit), source_type)

    def record_counts(self) -> DataFrame:
        """Records of each source type, and all of them (null)."""
        return aggregates.type_counts(self.records, "source_type")
