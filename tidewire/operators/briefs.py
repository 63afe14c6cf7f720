"""Briefs and digests: bounded selections, folded and rendered in the plan."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.text import blank_to_null, escape_html, extractive_summary, percent

# Severity order, limits and phrases of a brief.
LEVELS = ["LOW", "MODERATE", "HIGH", "CRITICAL"]
TOP, DEVELOPMENTS, PLACES, ACTORS, ASSESSMENT, PER_CATEGORY = 6, 5, 6, 6, 800, 10
NOTHING = "No recent intelligence articles found in the database for '%s'."
RELEVANCE = {
    "CRITICAL": "Critical security event requiring immediate operational tracking across %d verified report(s).",
    "HIGH": "High-priority security development under continuous military monitoring across %d verified report(s).",
}
PLAIN_RELEVANCE = "Assessed at %s threat level across %d monitored intelligence reports."
MARKDOWN_STORY = "### %s\n\n**Source:** %s  \n**Classification confidence:** %s  \n\n%s\n\n[Read original article](%s)\n"


def _items(rows: Column, fields: list[str], most: int) -> Column:
    """Distinct filled items of array fields, by row, then field, then place."""
    nested = F.transform(rows, lambda r: F.flatten(F.array(*[F.coalesce(r[f], F.expr("array()").cast("array<string>")) for f in fields])))
    kept = F.filter(F.flatten(nested), lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.array_distinct(kept), 1, most)


def synthesize(articles: DataFrame, group: list[str], order: list[Column], lead: list[str], places: list[str], actors: list[str]) -> DataFrame:
    """One brief for each value of ``group`` (the empty list: one brief).

    The six first articles by ``order`` give developments, places, actors and
    severity; the count covers all. ``lead`` are the columns that may open the
    assessment, the first filled one of the first article. No articles, no row.
    """
    keys = group or ["_all"]
    a = articles if group else articles.withColumn("_all", F.lit(1))
    ranked = a.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= TOP)
    opening = F.trim(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in lead], F.lit("")))
    row = F.struct("_rank", F.trim(F.coalesce("title", F.lit(""))).alias("title"), opening.alias("lead"), F.upper("threat_level").alias("level"), *sorted({*places, *actors}))
    tops = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    counts = a.groupBy(*keys).agg(F.count("*").alias("reports"))
    both = counts.join(tops, [F.equal_null(counts[k], tops[k]) for k in keys]).select(*[counts[k] for k in keys], "reports", "rows")
    level = F.array_max(F.transform("rows", lambda r: F.greatest(F.lit(1), F.array_position(F.array(*map(F.lit, LEVELS)), r["level"]))))
    out = both.withColumn("severity", F.element_at(F.array(*map(F.lit, LEVELS)), level.cast("int")))
    first = F.col("rows")[0]["lead"]
    relevance = F.format_string(PLAIN_RELEVANCE, "severity", "reports")
    for name, phrase in RELEVANCE.items():
        relevance = F.when(F.col("severity") == name, F.format_string(phrase, "reports")).otherwise(relevance)
    titles = F.array_distinct(F.filter(F.transform("rows", lambda r: r["title"]), lambda t: t != ""))
    return out.select(
        *group,
        "reports",
        "severity",
        F.when(F.col("severity").isin("HIGH", "CRITICAL"), "Escalating").otherwise("Stable").alias("trend"),
        F.substring(F.when(F.col("reports") > 1, F.concat(first, F.format_string(" Monitored intelligence includes %d correlated reports.", "reports"))).otherwise(first), 1, ASSESSMENT).alias("assessment"),
        relevance.alias("relevance"),
        F.slice(titles, 1, DEVELOPMENTS).alias("developments"),
        _items(F.col("rows"), places, PLACES).alias("places"),
        _items(F.col("rows"), actors, ACTORS).alias("actors"),
    )


def or_else(chosen: DataFrame, other: DataFrame) -> DataFrame:
    """``chosen``, or ``other`` if it has no row; which of them is known from one
    row, inside the plan."""
    none = F.broadcast(chosen.limit(1).agg(F.count("*").alias("_n")).where("_n = 0"))
    return chosen.unionByName(other.join(none, how="left_semi"))


def or_unfiltered(recent: DataFrame, every: DataFrame, order: list[Column], most: int, most_of_all: int) -> DataFrame:
    """The first ``most`` recent rows, or, if there are none, the first of all."""
    return or_else(recent.orderBy(*order).limit(most), every.orderBy(*order).limit(most_of_all))


def stories(articles: DataFrame, category: str, order: list[Column], known: list[str], most: int = PER_CATEGORY) -> DataFrame:
    """The first ``most`` articles of each category; ``position`` puts known
    categories first, in their order, the others after them by name."""
    ranked = articles.where(F.coalesce(F.col(category), F.lit("")) != "").withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("rank") <= most)
    at = F.array_position(F.array(*map(F.lit, known)), F.col(category)) if known else F.lit(0)
    return ranked.withColumn("position", F.when(at > 0, at - 1).otherwise(999).cast("int"))


def story_markdown(title: Column, source: Column, confidence: Column, text: Column, url: Column) -> Column:
    return F.format_string(MARKDOWN_STORY, F.coalesce(title, F.lit("Untitled")), F.coalesce(source, F.lit("Unknown source")), percent(F.coalesce(confidence, F.lit(0.0)) * 100), extractive_summary(text), F.coalesce(url, F.lit("")))


def story_html(title: Column, source: Column, confidence: Column, text: Column, url: Column) -> Column:
    cell = lambda c, default: escape_html(F.coalesce(blank_to_null(c), F.lit(default)))
    return F.concat(
        F.lit('<article class="story"><h3>'), cell(title, "Untitled"), F.lit('</h3><div class="metadata">Source: '), cell(source, "Unknown source"),
        F.lit(" Classification confidence: "), percent(F.coalesce(confidence, F.lit(0.0)) * 100), F.lit("</div><p>"), escape_html(extractive_summary(text)),
        F.lit('</p><a href="'), cell(url, "#"), F.lit('" rel="noopener noreferrer">Read original article</a></article>'),
    )


def sections(chosen: DataFrame, category: str, story: Column, as_html: bool = False) -> DataFrame:
    """One rendered section a category, from the rows of ``stories``."""
    s = chosen.groupBy("position", category).agg(F.array_sort(F.collect_list(F.struct("rank", story.alias("text")))).alias("s"))
    if as_html:
        section = F.concat(F.lit('<section class="category"><h2>'), escape_html(F.col(category)), F.lit("</h2>"), F.array_join(F.transform("s", lambda x: x["text"]), ""), F.lit("</section>"))
    else:
        body = F.array_join(F.transform("s", lambda x: F.concat(x["text"], F.lit("\n---\n"))), "\n")
        section = F.concat(F.lit("## "), F.col(category), F.lit("\n\n"), body)
    return s.select("position", F.col(category).alias("category"), F.size("s").alias("stories"), section.alias("section"))


def digest_page(parts: DataFrame, heading: str, generated: str) -> str:
    """The whole digest as one HTML page, from sections of HTML."""
    rows = parts.orderBy("position", "category").collect()
    head = html.escape(heading)
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{head}</title></head><body><h1>{head}</h1><p>Generated: {html.escape(generated)}</p><p>Stories: {sum(r.stories for r in rows)}</p>{"".join(r.section for r in rows)}</body></html>'


def digest_text(parts: DataFrame, heading: str, generated: str) -> str:
    """The whole digest. The rows of ``sections`` are bounded by the number of
    categories, each of at most ten stories, so they fit the driver."""
    rows = parts.orderBy("position", "category").collect()
    return "\n".join([f"# {heading}", "", f"**Generated:** {generated}", "", f"**Stories:** {sum(r.stories for r in rows)}", "", "---", "", *[r.section for r in rows]])


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file below ``path``, on any file system Spark can write."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
