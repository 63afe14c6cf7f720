"""Named entities, keywords, topics and events of an article by the lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import vocabulary as V
from tidewire.functions.geography import located, place_words
from tidewire.functions.lexicon import any_term, grouped_terms, in_order, is_set, may_have, of_group, terms_in_text, union_of
from tidewire.functions.rules import topics_of

#: Shorter texts have no entities.
LEAST = 50
MOST_KEYWORDS, MOST_PHRASES, MOST_PARTS = 20, 3, 3
EVENT = "struct<event_type: string, matched_phrases: array<string>, locations: array<string>, actors: array<string>, equipment: array<string>>"
ALL_EQUIPMENT = union_of(V.EQUIPMENT)


def named(text: Column) -> Column:
    """Known organisations, equipment of all groups and countries, for ``of_group``;
    short names of the first two in their own case."""
    return grouped_terms(text, {"organization": V.ORGANIZATIONS, "equipment": ALL_EQUIPMENT, "country": V.COUNTRIES}, keep_short=("organization", "equipment"))


def listed_words(both: Column) -> Column:
    """Whether a text may have a name that ``named`` seeks, and a keyword."""
    names = "|".join([any_term([*V.ORGANIZATIONS, *ALL_EQUIPMENT], keep_short=True), any_term(V.COUNTRIES)])
    return may_have(both, names, any_term(V.KEYWORDS, keep_short=True))


def keywords(text: Column) -> Column:
    """The first keywords in list order; short ones in their own case."""
    return in_order(terms_in_text(text, V.KEYWORDS, keep_short=True), V.KEYWORDS, MOST_KEYWORDS)


def cleaned(names: Column) -> Column:
    """Sorted distinct names of two letters or more that are no numbers."""
    good = F.filter(F.transform(names, F.trim), lambda n: (F.length(n) >= 2) & ~n.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(good))


def people(names: Column) -> Column:
    """What a statistical recogniser found, only names of two words or more."""
    return cleaned(F.filter(names, lambda n: F.size(F.split(F.trim(n), r"\s+")) >= 2))


def entities(df: DataFrame, title: str, text: str, recognised: str | None = None) -> DataFrame:
    """``df`` with ``people, organizations, countries, equipment, keywords,
    topics``.

    Entities are sought in title and text, if these have ``LEAST`` characters;
    ``recognised`` may name a column ``struct<people, organizations>`` of lists
    that a statistical recogniser found, which are added. Keywords are sought in
    any text, and topics follow from the other columns. Only texts that may have
    a name or a keyword are searched (``_listed``, if it is there, tells which).
    """
    empty = F.expr("array()").cast("array<string>")
    both = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    found = df.withColumn("_both", both)
    if "_listed" not in df.columns:
        found = found.withColumn("_listed", listed_words(F.col("_both")))
    found = found.withColumn("_named", F.when((F.length(F.trim("_both")) >= LEAST) & is_set("_listed", 0), named(F.col("_both"))).otherwise(empty))
    enough = F.length(F.trim("_both")) >= LEAST
    more = {n: F.coalesce(F.col(f"{recognised}.{n}"), empty) if recognised else empty for n in ("people", "organizations")}
    found = found.withColumns({
        "people": F.when(enough, people(more["people"])).otherwise(empty),
        "organizations": F.when(enough, cleaned(F.concat(of_group(F.col("_named"), "organization"), more["organizations"]))).otherwise(empty),
        "countries": F.when(enough, of_group(F.col("_named"), "country")).otherwise(empty),
        "equipment": F.when(enough, of_group(F.col("_named"), "equipment")).otherwise(empty),
        "keywords": F.when(is_set("_listed", 1), keywords(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))).otherwise(empty),
    }).drop("_both", "_named", "_listed")
    return found.withColumn("topics", topics_of(F.col("equipment"), F.col("keywords"), F.col("countries"), V.TOPICS))


def recognise(df: DataFrame, title: str, text: str) -> DataFrame:
    """Entities and then places of each article, whose countries replace the
    entities' ones; marks the rows as processed."""
    both = df.withColumn("_both", F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    # What both need to know of a text in one pass.
    both = both.withColumns({"_listed": listed_words(F.col("_both")), "_spots": place_words(F.col("_both"))}).drop("_both")
    return located(entities(both, title, text), title, text).withColumn("nlp_processed", F.lit(1))


def any_event() -> str:
    """A pattern that fits where any pattern of an event does. Most begin with a
    word's edge, which is then looked for once at each place."""
    patterns = [p for of_kind in V.EVENTS.values() for p in of_kind]
    edged = [p[2:] for p in patterns if p.startswith(r"\b")]
    return "(?i)" + "|".join([r"\b(?:" + "|".join(f"(?:{p})" for p in edged) + ")", *[f"(?:{p})" for p in patterns if not p.startswith(r"\b")]])


def events(title: Column, text: Column, locations: Column, cities: Column, states: Column, actors: Column, persons: Column, tools: Column) -> Column:
    """``event_type, matched_phrases, locations, actors, equipment`` of each kind
    with a phrase in title or text, in any case.

    One pass tells whether a text has any phrase at all; only if so each pattern
    looks for its own. Phrases come by pattern and then place. Places are the given locations, else
    cities and states; actors the organisations, else people; of each the first
    three. Null lists count as empty.
    """
    none = F.expr("array()").cast("array<string>")
    full = lambda c: F.coalesce(c, none)
    first = lambda c: F.slice(c, 1, MOST_PARTS)
    spots = F.when(F.size(full(locations)) > 0, locations).otherwise(F.concat(full(cities), full(states)))
    who = F.when(F.size(full(actors)) > 0, actors).otherwise(full(persons))
    both = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    found = []
    for kind, patterns in V.EVENTS.items():
        phrases = F.array_distinct(F.concat(*[F.regexp_extract_all(both, F.lit(f"(?i){p}"), F.lit(0)) for p in patterns]))
        one = F.struct(F.lit(kind).alias("event_type"), F.slice(phrases, 1, MOST_PHRASES).alias("matched_phrases"), first(spots).alias("locations"), first(who).alias("actors"), first(full(tools)).alias("equipment"))
        found.append(F.when(F.size(phrases) > 0, one))
    every = F.array_compact(F.array(*found))
    return F.when(both.rlike(any_event()), every).otherwise(F.array().cast(f"array<{EVENT}>"))
