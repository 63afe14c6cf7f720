"""Questions in plain language as filters and search terms, a column each."""

from __future__ import annotations

import json
import logging
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.places import contains_any
from tidewire.functions.lexicon import apart, in_order, runs_in_text, spaced
from tidewire.functions.rules import first_rule

# Words that name a severity, sentiment, kind of question or span of days.
SEVERE = ["high threat", "high-threat", "critical"]
KIND_WORDS = [("trend_analysis", ["trend", "over the last", "during the last"]), ("situation_brief", ["what is happening", "current status", "situation"])]
SPANS = [(7, ["week"]), (30, ["month", "30 day"]), (1, ["today"])]
QUERY_CHARS = 200


def parse(questions: DataFrame, text: str, places: list[str], aliases: dict[str, str], stopwords: list[str]) -> DataFrame:
    """Adds ``locations, search_terms, threat_level, sentiment, days, kind`` and
    ``search_query`` to each question.

    ``places`` come in order (states, then cities), after those that a token
    names by alias. A term is a token of two characters or more that is no stop
    word, no location and no alias of one. Null text counts as empty.
    """
    empty = F.expr("array()").cast("array<string>")
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    # Step by step, so that each list is computed once.
    q = questions.withColumns({"_low": F.lower(F.coalesce(F.col(text), F.lit(""))), "_words": spaced(F.col(text))})
    q = q.withColumn("_tokens", F.filter(F.split("_words", " "), lambda t: t != ""))
    low, tokens = F.col("_low"), F.col("_tokens")
    by_alias = F.array_compact(F.transform(tokens, lambda t: F.try_element_at(table, t))) if aliases else empty
    named = in_order(runs_in_text(F.col("_words"), {p: p for p in places}), places) if places else empty
    q = q.withColumn("locations", F.array_distinct(F.concat(by_alias, named)))
    taken = F.transform("locations", F.lower)
    if aliases:
        known: dict[str, list[str]] = {}
        for alias, place in aliases.items():
            known.setdefault(place, []).append(alias)
        names = F.create_map(*[x for place, own in known.items() for x in (F.lit(place), F.array(*map(F.lit, own)))])
        taken = F.concat(taken, F.flatten(F.transform("locations", lambda p: F.coalesce(F.try_element_at(names, p), empty))))
    q = q.withColumn("_taken", taken)
    keep = lambda t: (F.length(t) >= 2) & ~t.isin(stopwords) if stopwords else F.length(t) >= 2
    terms = apart("_taken", lambda taken: F.filter(tokens, lambda t: keep(t) & ~F.array_contains(taken, t)))
    days = F.lit(None).cast("int")
    for n, words in reversed(SPANS):
        days = F.when(contains_any(low, words), n).otherwise(days)
    kind = first_rule([(contains_any(low, w), k) for k, w in KIND_WORDS] + [(F.size("locations") > 0, "location_search")], "general_search")
    out = q.withColumns({
        "search_terms": terms,
        "threat_level": F.when(contains_any(low, SEVERE), "HIGH"),
        "sentiment": F.when(low.contains("negative"), "Negative").when(low.contains("escalat"), "Escalatory"),
        "days": days,
        "kind": kind,
    })
    out = search_query(out, "locations", "search_terms", "_tokens")
    return out.drop("_low", "_words", "_tokens", "_taken")


def search_query(df: DataFrame, locations: str, terms: str, fallback: str) -> DataFrame:
    """``df`` with ``search_query``: locations and terms, each once whatever its
    case, at most 200 characters; the fallback tokens if there are none."""
    both = F.concat(locations, terms)
    q = df.withColumn("_parts", F.when(F.size(both) > 0, both).otherwise(F.col(fallback)))
    q = q.withColumn("_lower", F.transform("_parts", F.lower))
    once = apart("_lower", lambda low: F.filter("_parts", lambda p, i: F.array_position(low, F.lower(p)) == i + 1))
    return q.withColumn("search_query", F.substring(F.array_join(once, " "), 1, QUERY_CHARS)).drop("_parts", "_lower")


def filters_of(intent: dict, today: str) -> dict:
    """One parsed question (a row as a dict) as arguments of the facet filter;
    ``today`` is an ISO date."""
    from datetime import date, timedelta

    out = {}
    if intent.get("threat_level"):
        out["level"] = intent["threat_level"]
    if intent.get("sentiment"):
        out["sentiment"] = intent["sentiment"]
    if intent.get("days"):
        out["since"] = str(date.fromisoformat(today) - timedelta(days=intent["days"]))
    return out


def with_parser(question: str, parser, fallback) -> dict:
    """The intent that a language model's ``parser`` gives, a dict; that of the
    rules (``fallback``) if there is no parser, it fails, or gives none."""
    if parser is not None:
        try:
            found = parser(question)
            if isinstance(found, dict) and found:
                return found
        except Exception as e:  # noqa: BLE001 - any failure of a client means the rules
            logging.getLogger(__name__).warning("the parser failed: %s", e)
    return fallback(question)


def parse_answer(text: str | None) -> dict | None:
    """The JSON object in a language model's answer, with or without a code fence
    around it; None if there is none."""
    found = re.search(r"\{.*\}", text or "", re.DOTALL)
    try:
        answer = json.loads(found[0]) if found else None
    except ValueError:
        return None
    return answer if isinstance(answer, dict) else None


def route(kind: str, handlers: dict, *args):
    """Calls the handler of a kind of question, else that of ``general_search``."""
    return handlers.get(kind, handlers["general_search"])(*args)
