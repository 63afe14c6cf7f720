"""Gazetteers, ordered rules and events as column expressions.

Vocabularies are parameters; small ones become literals of the plan, large ones
are joined by the words of the text (``match_gazetteer``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a gazetteer's terms that are broadcast at most (with some room a
#: row); a larger one is shuffled.
BROADCAST_BYTES = 32 << 20


def word_rule(term: str, ignore_case: bool = True) -> str:
    """A whole-word pattern; short names keep their case."""
    return f"{'(?i)' if ignore_case else ''}\\b{re.escape(term)}\\b"


def has_term(c: Column, term: str) -> Column:
    """Names of at most four letters are matched in their own case."""
    return F.coalesce(c.rlike(word_rule(term, len(term) > 4)), F.lit(False))


def has_plain_term(c: Column, term: str) -> Column:
    """``has_term`` of a text whose characters other than A-Z, a-z and 0-9 count as
    spaces. The text is searched as it is: a copy of it without those characters
    would cost more than the search, and be made anew for every term. What stands
    before a match is looked at last, as a search for letters is fast."""
    letter = "[A-Za-z0-9]"
    words = term.replace(" ", "[^A-Za-z0-9]")
    case = "(?i)" if len(term) > 4 else ""
    return F.coalesce(c.rlike(f"{case}{words}(?<!{letter}{words})(?!{letter})"), F.lit(False))


def plain_terms_in(c: Column, terms: list[str], most: int | None = None) -> Column:
    """The terms, of letters, digits and spaces, that a text has by ``has_plain_term``,
    in list order."""
    found = F.array_compact(F.array(*[F.when(has_plain_term(c, t), F.lit(t)) for t in terms]))
    return F.slice(found, 1, most) if most else found


def terms_in(c: Column, terms: list[str], most: int | None = None) -> Column:
    """The terms that a text has, in list order."""
    found = F.array_compact(F.array(*[F.when(has_term(c, t), F.lit(t)) for t in terms]))
    return F.slice(found, 1, most) if most else found


def ngrams(c: Column, longest: int) -> Column:
    """Distinct runs of 1 to ``longest`` alphanumeric words, lower case."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    runs = [words]
    for n in range(2, longest + 1):
        joined = F.zip_with(runs[-1], F.slice(words, n, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        runs.append(F.filter(joined, lambda x: x.isNotNull()))
    return F.array_distinct(F.flatten(F.array(*runs)))


def match_gazetteer(df: DataFrame, key: str, text: str, gazetteer: DataFrame, longest: int) -> DataFrame:
    """``key`` and the columns of ``gazetteer (term, ...)`` for each term that a
    text has: an equi join on the words, never a comparison of all pairs."""
    words = df.select(key, F.explode(ngrams(F.col(text), longest)).alias("term"))
    room = [F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in gazetteer.columns]
    size = gazetteer.agg(F.coalesce(F.sum(sum(room, F.lit(64))), F.lit(0))).first()[0]
    small = size <= BROADCAST_BYTES
    return words.join(F.broadcast(gazetteer) if small else gazetteer, "term")


def first_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(default)
    for test, label in reversed(rules):
        out = F.when(test, label).otherwise(out)
    return out


def any_of(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def cascade(title: Column, body: Column, steps: list[dict]) -> Column:
    """The outcome of the first step that matches.

    A step has ``patterns`` and an ``outcome`` (label, score). It looks at the
    title; unless ``title_only`` it also looks at the body, where it needs a
    ``context`` word anywhere or no ``blocked`` word in the title. ``unless``
    words in the title switch a step off.
    """
    none = F.struct(F.lit("LOW").alias("level"), F.lit(0.10).alias("score"), F.lit("default").alias("rule"))
    out, both = none, F.concat_ws(" ", title, body)
    for step in reversed(steps):
        test = any_of(title, step["patterns"])
        if not step.get("title_only"):
            inside = any_of(F.substring(body, 1, 1200), step["patterns"])
            if step.get("context"):
                inside = inside & any_of(both, step["context"])
            if step.get("blocked"):
                inside = inside & ~any_of(title, step["blocked"])
            test = test | inside
        if step.get("unless"):
            test = test & ~any_of(title, step["unless"])
        level, score = step["outcome"]
        out = F.when(test, F.struct(F.lit(level).alias("level"), F.lit(score).alias("score"), F.lit(step["name"]).alias("rule"))).otherwise(out)
    return out


def events_in(c: Column, kinds: dict[str, list[str]], most: int = 3) -> Column:
    """``(event_type, phrases)`` of each kind with a phrase in the text."""
    each = []
    for kind, patterns in kinds.items():
        found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.lower(c), F.lit(p), F.lit(0)) for p in patterns])))
        each.append(F.when(F.size(found) > 0, F.struct(F.lit(kind).alias("event_type"), F.slice(found, 1, most).alias("phrases"))))
    return F.array_compact(F.array(*each))


def confidence(countries: Column, states: Column, cities: Column, places: Column) -> Column:
    """0.3 + 0.3 + 0.2 + 0.2 for what was found, at most 1."""
    part = lambda c, w: F.when(F.size(c) > 0, w).otherwise(0.0)
    return F.least(F.lit(1.0), part(countries, 0.3) + part(states, 0.3) + part(cities, 0.2) + part(places, 0.2))


def top_labels(scores: Column, least: float = 0.25, most: int = 5) -> Column:
    """Labels of a score map from ``least`` on, best first; else the best one."""
    entries = F.array_sort(F.map_entries(scores), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    return labels_of(entries, least, most)


def labels_of(entries: Column, least: float = 0.25, most: int = 5) -> Column:
    """As ``top_labels``, of a score map's entries, best first."""
    good = F.filter(entries, lambda e: e["value"] >= least)
    chosen = F.when(F.size(good) > 0, F.slice(good, 1, most)).otherwise(F.slice(entries, 1, 1))
    return F.transform(chosen, lambda e: e["key"])


def topics_of(equipment: Column, keywords: Column, countries: Column, rules: dict[str, dict[str, list[str]]]) -> Column:
    """Sorted topics: a rule holds if a substring is in the equipment names, or
    a word is among the keywords or countries. Null lists count as empty."""
    names = F.lower(F.array_join(F.coalesce(equipment, F.array()), " "))
    have = {"keywords": keywords, "countries": countries}
    found = []
    for topic, needs in rules.items():
        tests = [names.contains(w) for w in needs.get("equipment", [])]
        tests += [F.array_contains(have[k], w) for k in have for w in needs.get(k, [])]
        found.append(F.when(F.greatest(*[F.coalesce(t, F.lit(False)).cast("int") for t in [*tests, F.lit(False)]]) == 1, F.lit(topic)))
    return F.array_sort(F.array_compact(F.array(*found)))
