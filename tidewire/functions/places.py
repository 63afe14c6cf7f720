"""Places of a text, their type and confidence; targets and stances.

Vocabularies are parameters: ``gazetteer`` rows are (term, place, kind, state,
country, type) with kind one of strategic, country, state, city, region.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.lexicon import contains_word, runs_in_text, spaced
from tidewire.functions.rules import first_rule, match_gazetteer

# Sentiment labels, what they are called, and the stance each implies.
SENTIMENTS = {
    "positive development": "Positive",
    "negative development": "Negative",
    "neutral factual reporting": "Neutral",
    "concern or warning": "Concern",
    "critical of a policy or decision": "Critical",
    "escalation of tensions or conflict": "Escalatory",
    "de-escalation or diplomatic progress": "De-escalatory",
}
STANCES = {
    "Positive": "Reassuring",
    "Negative": "Critical",
    "Neutral": "Neutral",
    "Concern": "Alarming",
    "Critical": "Critical",
    "Escalatory": "Alarming",
    "De-escalatory": "Supportive",
    "Unclear": "Neutral",
}
KINDS = ["strategic", "country", "state", "city"]


def contains_any(c: Column, words: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [c.contains(w) for w in words]), F.lit(False)) if words else F.lit(False)


def classify_place(kinds: Column) -> Column:
    """The first of strategic, country, state, city among the kinds of a name."""
    return first_rule([(F.array_contains(kinds, k), k) for k in KINDS], "unknown")


LISTS = ["countries", "states", "cities", "localities", "regions"]


def _implied(kind: Column, place: Column, state: Column, country: Column, home: str) -> dict[str, Column]:
    """What a hit adds to each list, as an array."""
    is_home = kind.isin("state", "city")
    cases = {
        "countries": [(kind == "country", place), (is_home, F.lit(home)), (kind == "strategic", country)],
        "states": [(kind == "state", place), (kind.isin("city", "strategic"), state)],
        "cities": [(kind == "city", place)],
        "localities": [(kind == "strategic", place)],
        "regions": [(kind == "region", place)],
    }
    return {name: F.array_compact(F.array(*[F.when(t, v) for t, v in own])) for name, own in cases.items()}


def locate(df: DataFrame, key: str, text: str, gazetteer: list[tuple] | DataFrame, home: str, longest: int = 4) -> DataFrame:
    """The places of each text: sorted ``countries``, ``states``, ``cities``,
    ``localities``, ``regions`` and ``strategic_type``. A state or city implies
    the ``home`` country, a city its state, a strategic place its state and
    country. Every row of ``df`` comes back, also those without a place.

    A gazetteer that is a list of rows (up to some thousands) is matched inside
    the row; one that is a table, of any size, by a join on the words, for which
    a key must be in one row.
    """
    empty = F.expr("array()").cast("array<string>")
    if isinstance(gazetteer, DataFrame):
        hit = match_gazetteer(df, key, text, gazetteer, longest)
        implied = _implied(*[F.col(c) for c in ("kind", "place", "state", "country")], home)
        sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(n) for n, c in implied.items()]
        found = hit.groupBy(key).agg(*sets, F.min(F.when(F.col("kind") == "strategic", F.struct("place", "type"))).alias("_first"))
        return df.join(found, key, "left").select(*df.columns, *[F.coalesce(F.col(c), empty).alias(c) for c in LISTS], F.col("_first.type").alias("strategic_type"))
    rows = sorted(gazetteer, key=lambda r: (r[1] or "", r[5] or ""))
    entry = "struct<place: string, kind: string, state: string, country: string, type: string>"
    table = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("place", "kind", "state", "country", "type"), r[1:], strict=True)]) for r in rows]).cast(f"array<{entry}>")
    forms: dict[str, str] = {}
    for i, r in enumerate(rows):
        # Two rows of one term are two forms that mean different rows.
        forms[r[0] + "." * sum(x[0] == r[0] for x in rows[:i])] = f"{i + 1:06d}"
    hits = F.transform(runs_in_text(spaced(F.col(text)), forms), lambda i: F.element_at(table, i.cast("int")))
    out = df.withColumn("_hits", hits)

    def pick(name: str) -> Column:
        nested = F.transform("_hits", lambda h: _implied(h["kind"], h["place"], h["state"], h["country"], home)[name])
        return F.array_sort(F.array_distinct(F.flatten(nested)))

    first = F.filter("_hits", lambda h: h["kind"] == "strategic")
    return out.withColumns({**{n: pick(n) for n in LISTS}, "strategic_type": F.try_element_at(first, F.lit(1))["type"]}).drop("_hits")


def location_type(text: Column, strategic_type: Column, keywords: dict[str, list[str]], border: list[str], lowered: bool = False) -> Column:
    """The type of a strategic place, else the first keyword group, else by the
    border states, cities and states found (columns of ``locate``). ``lowered``:
    the text is in lower case already."""
    low = text if lowered else F.lower(text)
    rules = [(contains_word(low, words), label) for label, words in keywords.items()]
    rules.append((F.arrays_overlap("states", F.array(*map(F.lit, border))) if border else F.lit(False), "border_area"))
    rules += [(F.size("cities") > 0, "city"), (F.size("states") > 0, "state")]
    return F.coalesce(F.nullif(strategic_type, F.lit("")), first_rule(rules, "unknown"))


def sentiment(label: Column) -> Column:
    """The name of a scorer's label; unknown or missing ones are Neutral."""
    return first_rule([(label == k, v) for k, v in SENTIMENTS.items()], "Neutral")


def stance(name: Column) -> Column:
    return first_rule([(name == k, v) for k, v in STANCES.items()], "Neutral")


def sentiment_target(title: Column, text: Column, words: dict[str, list[str]], organizations: Column, equipment: Column, countries: Column) -> Column:
    """What an article is about: Military, Government, Country, Policy, Event,
    Organization or Government, the first whose words (or lists) it has. Looks
    at the title and the first 500 characters; null lists count as empty."""
    both = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 500)))
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    has = lambda name: contains_any(both, words.get(name, []))
    return first_rule([
        (filled(equipment) | has("Military"), "Military"),
        (has("Government"), "Government"),
        (filled(countries) | has("Country"), "Country"),
        (has("Policy"), "Policy"),
        (has("Event"), "Event"),
        (filled(organizations), "Organization"),
    ], "Government")
