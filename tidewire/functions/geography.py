"""Places of a text by the production lists, their hierarchy and type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import vocabulary as V
from tidewire.functions.lexicon import any_part, any_term, grouped_terms, is_set, look_up, may_have, of_group, union_of
from tidewire.functions.places import location_type
from tidewire.functions.rules import confidence, first_rule

HOME = "India"
STATE_OF_CITY = {city: state for state, cities in V.CITIES.items() for city in cities}
REGION_OF_STATE = {state: region for region, states in V.REGIONS.items() for state in states}
PLACE_COUNTRIES = V.COUNTRIES + V.MORE_COUNTRIES
#: Strategic places that are common words need more than their name.
SPECIAL = {
    "Uri": (r"\bUri\b", r"\buri\s+(?:sector|attack|base|encounter|infiltration|loc)\b"),
    "Hot Springs": (None, r"\bhot\s+springs?\s+(?:sector|friction|lac|ladakh|patrol)\b"),
}


def normalised(name: Column) -> Column:
    """The name in use for another name of a place; else the name itself."""
    return look_up(V.ALIASES, F.lower(name), name)


def state_of(city: Column) -> Column:
    return look_up(STATE_OF_CITY, city)


def region_of(state: Column) -> Column:
    return look_up(REGION_OF_STATE, state)


def is_state(name: Column) -> Column:
    return F.coalesce(name.isin(V.STATES), F.lit(False))


def strategic(name: Column, field: int) -> Column:
    """Type (0), state (1) or country (2) of a strategic place."""
    return look_up({n: v[field] for n, v in V.STRATEGIC.items() if v[field]}, name)


def classified(name: Column) -> Column:
    """``kind, place, state, country`` of one named place, by the first list that
    has its name in use: strategic, country, state, city; null if none has it or
    the name is shorter than two letters."""
    place = normalised(F.trim(name))
    kinds = [(place.isin(list(V.STRATEGIC)), "strategic"), (place.isin(PLACE_COUNTRIES), "country"), (is_state(place), "state"), (place.isin(list(STATE_OF_CITY)), "city")]
    kind = first_rule([(F.coalesce(t, F.lit(False)), k) for t, k in kinds], "")
    state = F.when(kind == "strategic", strategic(place, 1)).when(kind == "state", place).when(kind == "city", state_of(place))
    country = F.when(kind == "strategic", strategic(place, 2)).when(kind == "country", place).when(kind.isin("state", "city"), HOME)
    found = F.struct(kind.alias("kind"), place.alias("place"), state.alias("state"), country.alias("country"))
    return F.when((kind != "") & (F.length(place) >= 2), found)


def _joined(*parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*parts))))


def _if(test: Column, *values: str) -> Column:
    return F.when(test, F.array(*map(F.lit, values))).otherwise(F.expr("array()").cast("array<string>"))


def place_words(both: Column) -> Column:
    """Whether a text may have a place that ``places_of`` seeks, and a word that
    tells the type of a place."""
    regions = [p for patterns in V.REGION_PATTERNS.values() for p in patterns]
    edged = [p.replace(r"\b", "") for p in regions if p.startswith(r"\b")]
    region = "|".join([any_term(edged), any_part([p for p in regions if not p.startswith(r"\b")])])
    places = any_term([*PLACE_COUNTRIES, *V.STATES, *STATE_OF_CITY, *V.STRATEGIC, *(name.split()[0] for name in SPECIAL)])
    # Words in capitals are sought in lower-case text, and never found.
    return may_have(both, places, region, any_part([w for w in union_of(V.LOCATION_TYPES) if w.islower()]))


def places_of(both: Column, low: Column) -> dict[str, Column]:
    """What a text (and it in lower case) names: places of the lists, places that
    are common words, and regions. Only texts that may have any of them are searched
    (``_spots``, by ``place_words``)."""
    none = F.expr("array()").cast("array<string>")
    special = []
    for name, (own, pattern) in SPECIAL.items():
        hit = low.rlike(pattern)
        special.append(_if(hit | both.rlike(own) if own else hit, name))
    plain = [n for n in V.STRATEGIC if n not in SPECIAL]
    regions = [_if(low.rlike("|".join(patterns)), region) for region, patterns in V.REGION_PATTERNS.items()]
    # One pass tells whether any region is named at all.
    some = low.rlike("|".join(p for patterns in V.REGION_PATTERNS.values() for p in patterns))
    named = grouped_terms(both, {"country": PLACE_COUNTRIES, "state": V.STATES, "city": list(STATE_OF_CITY), "place": plain}, lowered=low)
    return {
        "_named": F.when(is_set("_spots", 0), named).otherwise(none),
        "_special": F.when(is_set("_spots", 0), F.concat(*special)).otherwise(none),
        "_regions": F.when(is_set("_spots", 1) & some, F.concat(*regions)).otherwise(none),
    }


def by_group() -> dict[str, Column]:
    """The lists of ``places_of`` by kind."""
    return {"_countries": of_group(F.col("_named"), "country"), "_states": of_group(F.col("_named"), "state"), "cities": of_group(F.col("_named"), "city"), "localities": _joined(of_group(F.col("_named"), "place"), F.col("_special"))}


def implied() -> dict[str, Column]:
    """The lists that follow from those of ``places_of``: a state or city implies
    the home country, a city its state, a strategic place its state (and home) or
    country, a state its region."""
    local_states = F.transform("localities", lambda p: strategic(p, 1))
    states = _joined(F.col("_states"), F.transform("cities", state_of), local_states)
    home = (F.size("_states") > 0) | (F.size("cities") > 0) | F.exists(local_states, lambda s: s.isNotNull())
    return {
        "states": states,
        "countries": _joined(F.col("_countries"), F.transform("localities", lambda p: strategic(p, 2)), _if(home, HOME)),
        "regions": _joined(F.col("_regions"), F.transform(states, region_of)),
    }


def located(df, title: str, text: str):
    """``df`` with ``countries, states, cities, localities, regions,
    location_type, location_confidence``; earlier columns of these names go.
    Null titles and texts count as empty."""
    both = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    kept = df.withColumn("_both", both)
    if "_spots" not in df.columns:
        kept = kept.withColumn("_spots", place_words(F.col("_both")))
    kept = kept.withColumn("_low", F.lower("_both"))
    kept = kept.withColumns(places_of(F.col("_both"), F.col("_low"))).withColumns(by_group()).withColumns(implied())
    # Of several strategic places the first by name gives the type.
    kind = F.element_at(F.concat(F.filter(F.transform("localities", lambda p: strategic(p, 0)), lambda t: t.isNotNull()), F.array(F.lit(None).cast("string"))), 1)
    kept = kept.withColumns({
        "location_type": location_type(F.when(is_set("_spots", 2), F.col("_low")), kind, V.LOCATION_TYPES, V.BORDER_STATES, lowered=True),
        "location_confidence": F.round(confidence(F.col("countries"), F.col("states"), F.col("cities"), F.col("localities")), 6),
    })
    return kept.drop("_both", "_spots", "_low", "_named", "_special", "_countries", "_states", "_regions")
