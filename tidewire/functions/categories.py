"""Labels of articles from scores; the scorer itself is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import vocabulary as V
from tidewire.functions.lexicon import trie_pattern
from tidewire.functions.rules import labels_of

# What an article is without any score.
FALLBACK, FALLBACK_SCORE = "National Security", 0.5
TOP_SCORES, TOP_SUB, WORD = 5, 4, 3
LABEL_TEXT, NO_LABEL_TEXT = 400, "defence news"
CONTENT, NO_CONTENT = 4000, "No article text available."


def label_text(title: Column, text: Column, summary: Column) -> Column:
    """What a multi-label scorer reads: the title and the start of the body."""
    body = F.substring(F.coalesce(F.nullif(text, F.lit("")), F.nullif(summary, F.lit("")), F.lit("")), 1, LABEL_TEXT)
    title = F.coalesce(title, F.lit(""))
    whole = F.when(body != "", F.trim(F.concat_ws("\n", title, body))).otherwise(title)
    return F.when(whole == "", NO_LABEL_TEXT).otherwise(whole)


def zero_shot_text(title: Column, summary: Column, content: Column) -> Column:
    """What a single-label scorer reads: the filled parts, a line each."""
    part = lambda name, c: F.concat(F.lit(name + ": "), F.nullif(c, F.lit("")))
    parts = [part("Title", F.trim(title)), part("Summary", F.trim(summary)), part("Content", F.substring(F.trim(content), 1, CONTENT))]
    return F.coalesce(F.nullif(F.trim(F.concat_ws("\n", *parts)), F.lit("")), F.lit(NO_CONTENT))


def ranked(scores: Column) -> Column:
    """The entries of a score map, best first; ties by label."""
    return F.array_sort(F.map_entries(scores), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))


def top_scores(scores: Column, most: int = 3, digits: int | None = None) -> Column:
    """The best entries of a score map as a map, in order."""
    return best_scores(ranked(scores), most, digits)


def best_scores(entries: Column, most: int, digits: int | None = None) -> Column:
    """The first of the entries of ``ranked`` as a map."""
    best = F.slice(entries, 1, most)
    return F.map_from_entries(F.transform(best, lambda e: F.struct(e["key"].alias("key"), F.round(e["value"], digits).alias("value"))) if digits is not None else best)


def overlap_scores(text: Column, labels: list[str]) -> Column:
    """A score without a model: the share of a label's words that a text has."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = lambda label: sum(low.contains(w).cast("double") for w in label.lower().split()) / len(label.split())
    return F.create_map(*[x for label in labels for x in (F.lit(label), score(label))])


def sub_categories(text: Column, labels: Column) -> Column:
    """Sub-categories of the labels of which the text has a word of more than
    three letters (as a substring); the first four by name."""
    low, found = F.lower(F.coalesce(text, F.lit(""))), []
    for label, subs in V.SUB_CATEGORIES.items():
        for sub in subs:
            words = [w for w in sub.lower().split() if len(w) > WORD]
            if words:
                found.append(F.when(F.array_contains(labels, label) & low.rlike(trie_pattern(words)), F.lit(sub)))
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))), 1, TOP_SUB)


def classify(df: DataFrame, scores: str, text: str) -> DataFrame:
    """``df`` with ``primary_categories, sub_categories, article_type, category,
    category_confidence, category_scores`` from a score map; rows without one get
    the fallback."""
    known = F.coalesce(F.size(scores) > 0, F.lit(False))
    # The entries are sorted once, for all columns that follow from them.
    ordered = df.withColumn("_ranked", ranked(F.col(scores)))
    best = F.element_at("_ranked", 1)
    none = F.expr("array()").cast("array<string>")
    out = ordered.withColumn("primary_categories", F.when(known, labels_of(F.col("_ranked"))).otherwise(F.array(F.lit(FALLBACK))))
    return out.withColumns({
        "sub_categories": F.when(known, sub_categories(F.col(text), F.col("primary_categories"))).otherwise(none),
        "article_type": F.when(known, best["key"]).otherwise(FALLBACK),
        "category": F.when(known, best["key"]).otherwise(FALLBACK),
        "category_confidence": F.when(known, F.round(best["value"], 3)).otherwise(FALLBACK_SCORE),
        "category_scores": F.when(known, best_scores(F.col("_ranked"), TOP_SCORES, 3)).otherwise(F.create_map(F.lit(FALLBACK), F.lit(FALLBACK_SCORE))),
    }).drop("_ranked")


def best_label(scores: Column) -> Column:
    """The single best label of a score map; ties by label."""
    return F.element_at(ranked(scores), 1)["key"]
