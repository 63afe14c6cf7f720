"""The language rules with the production lists, over the documents.

The documents are invented prose, so a line of names, and a headline, are put
before each text, chosen from the lists by the document's number; the rules then
read the whole of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import categories, entities, geography, severity
from tidewire.functions import vocabulary as V
from tidewire.tables import table

QUERIES, ORACLES = {}, {}
HEADLINES = [
    "DAC approves purchase", "Stock market and cricket today", "Ransom case in town", "Terror ransom plot", "Talks on Ukraine in Kyiv", "Indian Army and Ukraine",
    "Election rally begins", "Cross-border firing at LAC", "Terrorists killed in Kashmir", "Encounter in Kupwara", "Hostile drone intercepted", "Malabar exercise opens",
    "Quiet day", "BRO tunnel opens", "Arms cache recovered", "Soldier martyred", "Joint military exercise", "HAL and Safran seal deal",
]
BODIES = [
    "nothing to see", "ceasefire violation reported in Kashmir", "bomb blast heard far away", "arms cache recovered by DRDO", "DAC approves Javelin missiles", "troop buildup at LAC",
    "a staff reporter writes of a ceasefire violation at the LOC", "a joint exercise and Exercise Malabar and a military drill", "troops deployed and the contract signed", "ied blast in Manipur", "Uri sector and hot springs patrol",
]
NAMES = [(V.ORGANIZATIONS, 1), (entities.ALL_EQUIPMENT, 3), (V.COUNTRIES, 5), (list(geography.STATE_OF_CITY), 7), (V.STATES, 11), (list(V.STRATEGIC), 13), ([*V.ALIASES, "northeast india", "ladakh region", "Indo-Pacific", "IOR"], 17), (V.KEYWORDS, 19)]


def _story(spark: SparkSession, root: str) -> DataFrame:
    """``doc_id, title, body``."""
    pick = lambda items, by: F.element_at(F.array(*map(F.lit, items)), (F.col("doc_id") * by % len(items) + 1).cast("int"))
    # Some documents have none of a list, so that every rule fails somewhere.
    names = [F.when(F.col("doc_id") % (i + 2) != 0, pick(items, by)).otherwise("") for i, (items, by) in enumerate(NAMES)]
    body = F.concat_ws(" ", pick(BODIES, 1), *names, F.regexp_replace("text", "[^A-Za-z0-9 ]", " "))
    return table(spark, root, "documents").select("doc_id", pick(HEADLINES, 1).alias("title"), body.alias("body"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_quoted, items)) + "]"


def _pick(items, by) -> str:
    return f"{_list(items)}[doc_id * {by} % {len(items)} + 1]"


_NAMES = ", ".join(f"CASE WHEN doc_id % {i + 2} <> 0 THEN {_pick(items, by)} ELSE '' END" for i, (items, by) in enumerate(NAMES))
STORY_SQL = f"""WITH story AS (SELECT doc_id, {_pick(HEADLINES, 1)} AS title,
 concat_ws(' ', {_pick(BODIES, 1)}, {_NAMES}, regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g')) AS body FROM documents),
s AS (SELECT *, title || chr(10) || body AS b, lower(title || chr(10) || body) AS l FROM story)"""


def _escaped(term: str) -> str:
    import re

    return re.escape(term).replace("'", "''")


def _named(pairs, short: bool) -> str:
    """SQL: the values of forms that stand as whole words in ``b`` or ``l``."""
    cases = []
    for form, value in pairs:
        text, form = ("b", form) if short and len(form) <= 4 else ("l", form.lower())
        cases.append(f"CASE WHEN regexp_matches({text}, '\\b{_escaped(form)}\\b') THEN {_quoted(value)} END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


_sorted = lambda inner: f"list_sort(list_distinct({inner}))"
_same = lambda items: [(x, x) for x in items]


def query(sql: str):
    def register(run):
        QUERIES[run.__name__] = run
        ORACLES[run.__name__] = sql
        return run

    return register


@query(f"{STORY_SQL} SELECT doc_id, {_sorted(_named(_same(V.ORGANIZATIONS), True))} AS organizations, {_sorted(_named(_same(entities.ALL_EQUIPMENT), True))} AS equipment, {_sorted(_named(_same(V.COUNTRIES), False))} AS countries FROM s")
def named_entities(spark, root):
    """Organisations, equipment and countries of each story."""
    s = entities.entities(_story(spark, root), "title", "body")
    return s.select("doc_id", "organizations", "equipment", "countries")


def _topic_sql() -> str:
    tests = []
    for topic, needs in V.TOPICS.items():
        parts = [f"contains(g, {_quoted(w)})" for w in needs.get("equipment", [])]
        parts += [f"list_contains(keywords, {_quoted(w)})" for w in needs.get("keywords", [])]
        parts += [f"list_contains(countries, {_quoted(w)})" for w in needs.get("countries", [])]
        tests.append(f"CASE WHEN {' OR '.join(parts)} THEN {_quoted(topic)} END")
    return f"list_sort(list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL))"


@query(
    f"{STORY_SQL}, k AS (SELECT doc_id, {_named(_same(V.KEYWORDS), True)}[1:20] AS keywords, lower(array_to_string({_sorted(_named(_same(entities.ALL_EQUIPMENT), True))}, ' ')) AS g, {_named(_same(V.COUNTRIES), False)} AS countries FROM s) SELECT doc_id, keywords, {_topic_sql()} AS topics FROM k"
)
def story_topics(spark, root):
    """Production keywords in list order, and the topics that follow."""
    return entities.entities(_story(spark, root), "title", "body").select("doc_id", "keywords", "topics")


@query("SELECT doc_id, CAST([] AS VARCHAR[]) AS people, CASE WHEN doc_id % 2 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['Indian Army'] END AS organizations FROM documents")
def short_texts(spark, root):
    """Texts under fifty characters have no entities; recognised names are cleaned."""
    d = table(spark, root, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "Indian Army").otherwise("Indian Army " + "x" * 60).alias("t"))
    found = F.struct(F.array(F.lit("Mono"), F.lit("7")).alias("people"), F.array(F.lit("9"), F.lit("x")).alias("organizations"))
    return entities.entities(d.withColumn("r", found), "t", "t", "r").select("doc_id", "people", "organizations")


def _places_sql() -> str:
    plain = _same(n for n in V.STRATEGIC if n not in geography.SPECIAL)
    special = "list_filter([CASE WHEN regexp_matches(b, '\\bUri\\b') OR regexp_matches(l, '\\buri\\s+(?:sector|attack|base|encounter|infiltration|loc)\\b') THEN 'Uri' END, CASE WHEN regexp_matches(l, '\\bhot\\s+springs?\\s+(?:sector|friction|lac|ladakh|patrol)\\b') THEN 'Hot Springs' END], lambda x: x IS NOT NULL)"
    spots = lambda at: "[" + ", ".join(f"{{'n': {_quoted(n)}, 'v': {_quoted(v[at])}}}" for n, v in V.STRATEGIC.items() if v[at]) + "]"
    of_city = "[" + ", ".join(f"{{'n': {_quoted(c)}, 'v': {_quoted(s)}}}" for c, s in geography.STATE_OF_CITY.items()) + "]"
    of_state = "[" + ", ".join(f"{{'n': {_quoted(s)}, 'v': {_quoted(r)}}}" for s, r in geography.REGION_OF_STATE.items()) + "]"
    at = lambda table, names: f"list_transform(list_filter({table}, lambda e: list_contains({names}, e.n)), lambda e: e.v)"
    # Words in capitals are never found in the lower-case text.
    words = {kind: [w for w in found if w.islower()] for kind, found in V.LOCATION_TYPES.items()}
    terms = " ".join(f"WHEN regexp_matches(l, '{'|'.join(found)}') THEN {_quoted(kind)}" for kind, found in words.items())
    of_spot = " ".join(f"WHEN localities[1] = {_quoted(n)} THEN {_quoted(v[0])}" for n, v in V.STRATEGIC.items())
    regions = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(l, '{'|'.join(p)}') THEN {_quoted(r)} END" for r, p in V.REGION_PATTERNS.items()) + "], lambda x: x IS NOT NULL)"
    return f"""{STORY_SQL},
f AS (SELECT *, {_named(_same(geography.PLACE_COUNTRIES), False)} AS c0, {_named(_same(V.STATES), False)} AS s0, {_sorted(_named(_same(geography.STATE_OF_CITY), False))} AS cities,
 {_sorted(f"list_concat({_named(plain, False)}, {special})")} AS localities, {regions} AS r0 FROM s),
g AS (SELECT *, {_sorted(f"list_concat(s0, {at(of_city, 'cities')}, {at(spots(1), 'localities')})")} AS states FROM f),
h AS (SELECT *, {_sorted(f"list_concat(c0, {at(spots(2), 'localities')}, CASE WHEN len(states) > 0 THEN ['India'] ELSE CAST([] AS VARCHAR[]) END)")} AS countries,
 {_sorted(f"list_concat(r0, {at(of_state, 'states')})")} AS regions FROM g)
SELECT doc_id, countries, states, cities, localities, regions,
 CASE {of_spot} {terms} WHEN list_has_any(states, {_list(V.BORDER_STATES)}) THEN 'border_area' WHEN len(cities) > 0 THEN 'city' WHEN len(states) > 0 THEN 'state' ELSE 'unknown' END AS location_type,
 CAST(round(CASE WHEN len(countries) > 0 THEN 0.3 ELSE 0 END + CASE WHEN len(states) > 0 THEN 0.3 ELSE 0 END + CASE WHEN len(cities) > 0 THEN 0.2 ELSE 0 END + CASE WHEN len(localities) > 0 THEN 0.2 ELSE 0 END, 6) AS DOUBLE) AS location_confidence FROM h"""


@query(_places_sql())
def story_places(spark, root):
    """Countries, states, cities, strategic places and regions of each story, what
    they imply, the kind of place and the confidence."""
    s = geography.located(_story(spark, root), "title", "body")
    return s.select("doc_id", "countries", "states", "cities", "localities", "regions", "location_type", "location_confidence")


PLACE_NAMES = [*V.ALIASES, *V.STRATEGIC, *V.STATES, *geography.STATE_OF_CITY, *geography.PLACE_COUNTRIES, "Atlantis", "x"]


def _classified_sql() -> str:
    pairs = lambda items: ", ".join(f"({_quoted(a)}, {', '.join('NULL' if x is None else _quoted(x) for x in b)})" for a, b in items)
    return f"""WITH names AS (SELECT doc_id, {_list(PLACE_NAMES)}[doc_id % {len(PLACE_NAMES)} + 1] AS n FROM documents),
alias(a, p) AS (VALUES {pairs([(k, [v]) for k, v in V.ALIASES.items()])}),
spot(p, kind, state, country) AS (VALUES {pairs(V.STRATEGIC.items())}), town(p, state) AS (VALUES {pairs([(c, [s]) for c, s in geography.STATE_OF_CITY.items()])}),
region(s, r) AS (VALUES {pairs([(s, [r]) for s, r in geography.REGION_OF_STATE.items()])}),
x AS (SELECT doc_id, coalesce(alias.p, n) AS place FROM names LEFT JOIN alias ON alias.a = lower(n)),
y AS (SELECT x.*, CASE WHEN spot.p IS NOT NULL THEN 'strategic' WHEN place IN {tuple(geography.PLACE_COUNTRIES)} THEN 'country' WHEN place IN {tuple(V.STATES)} THEN 'state' WHEN town.p IS NOT NULL THEN 'city' END AS kind, spot.state AS ss, spot.country AS sc, town.state AS ts
 FROM x LEFT JOIN spot ON spot.p = place LEFT JOIN town ON town.p = place),
z AS (SELECT *, CASE kind WHEN 'strategic' THEN ss WHEN 'state' THEN place WHEN 'city' THEN ts END AS state FROM y)
SELECT doc_id, place, kind, state, CASE kind WHEN 'strategic' THEN sc WHEN 'country' THEN place WHEN 'state' THEN 'India' WHEN 'city' THEN 'India' END AS country, r AS region, place IN {tuple(V.STATES)} AS is_state FROM z LEFT JOIN region ON s = state"""


@query(_classified_sql())
def place_lookups(spark, root):
    """Names of places in use, their kind, state, country and region."""
    name = F.element_at(F.array(*map(F.lit, PLACE_NAMES)), (F.col("doc_id") % len(PLACE_NAMES) + 1).cast("int"))
    d = table(spark, root, "documents").select("doc_id", name.alias("n")).withColumn("c", geography.classified(F.col("n")))
    place = geography.normalised(F.col("n"))
    return d.select("doc_id", place.alias("place"), "c.kind", "c.state", "c.country", geography.region_of(F.col("c.state")).alias("region"), geography.is_state(place).alias("is_state"))


def severity_sql(story: str = STORY_SQL) -> str:
    has = lambda text, words: f"regexp_matches({text}, '{'|'.join(_escaped(w) for w in words)}')"
    pattern = lambda p: p.replace("'", "''")

    def says(patterns, inside):
        return "CASE " + " ".join(f"WHEN regexp_matches(t, '{pattern(p)}') OR ({inside} AND regexp_matches(h, '{pattern(p)}')) THEN {_quoted(w)}" for p, w in patterns.items()) + " END"

    outcomes = ", ".join("(" + ", ".join([_quoted(k), *(repr(x) if isinstance(x, float) else str(x).upper() if isinstance(x, bool) else _quoted(x) for x in v)]) + ")" for k, v in severity.OUTCOMES.items())
    reason = " ".join(f"WHEN {_quoted(k)} THEN {' || '.join(part for part in [_quoted(p.partition('%s')[0]), k + '_says' if '%s' in p else '', _quoted(p.partition('%s')[2])] if part)}" for k, p in severity.REASONS.items())
    fields = ", ".join(f"CASE WHEN rule = 'critical' AND {has('w', severity.DIPLOMATIC)} THEN 'HIGH' ELSE o.{n} END AS {n}" if n == "diplomatic_significance" else f"CAST(o.{n} AS DOUBLE) AS {n}" if n in ("threat_score", "ai_confidence") else f"o.{n}" for n in severity.FIELDS)
    return f"""{story},
a AS (SELECT doc_id, lower(title) AS t, lower(substring(regexp_replace(body, '{severity.BIO_TAIL}', '', 'g'), 1, 1200)) AS h FROM story),
w AS (SELECT *, t || ' ' || h AS w FROM a),
p AS (SELECT *, {says(V.PROCUREMENT, "NOT " + has("t", severity.NOT_PROCUREMENT))} AS procurement_says, {says(V.CRITICAL, has("w", severity.CRITICAL_CONTEXT))} AS critical_says,
 {says(V.HIGH, has("w", severity.HIGH_CONTEXT))} AS high_says, {says(V.MODERATE, "FALSE")} AS moderate_says FROM w),
r AS (SELECT *, CASE WHEN procurement_says IS NOT NULL THEN 'procurement' WHEN {has("t", V.CIVIC)} THEN 'civic' WHEN {has("t", V.CRIME)} AND NOT {has("t", severity.NOT_CRIME)} THEN 'crime'
 WHEN {has("t", V.FOREIGN)} AND NOT {has("t", severity.NOT_FOREIGN)} THEN 'foreign' WHEN {has("t", V.POLITICS)} THEN 'politics' WHEN critical_says IS NOT NULL THEN 'critical'
 WHEN high_says IS NOT NULL THEN 'high' WHEN moderate_says IS NOT NULL THEN 'moderate' ELSE 'baseline' END AS rule FROM p),
o(k, {", ".join(severity.FIELDS)}) AS (VALUES {outcomes})
SELECT doc_id, rule AS severity_rule, CASE rule {reason} END AS threat_reason, {fields} FROM r JOIN o ON k = rule"""


@query(severity_sql())
def story_severity(spark, root):
    """The production severity cascade with all its fields."""
    return severity.severity(_story(spark, root), "title", "body").drop("title", "body")


@query(f"WITH n AS ({severity_sql()}) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'KEPT' ELSE threat_level END AS threat_level, CAST(CASE WHEN doc_id % 3 = 0 THEN 0.77 ELSE threat_score END AS DOUBLE) AS threat_score FROM n")
def severity_of_new(spark, root):
    """Rows that were judged before keep what they have."""
    s = _story(spark, root).withColumns({"threat_level": F.when(F.col("doc_id") % 3 == 0, "KEPT").when(F.col("doc_id") % 3 == 1, ""), "threat_score": F.when(F.col("doc_id") % 3 == 0, 0.77)})
    return severity.severity_of_new(s, "title", "body").select("doc_id", "threat_level", "threat_score")


def _events_sql() -> str:
    each = []
    for kind, patterns in V.EVENTS.items():
        phrases = "list_concat(" + ", ".join(f"regexp_extract_all(b, '(?i){p}')" for p in patterns) + ")"
        each.append(f"SELECT doc_id, {_quoted(kind)} AS event_type, {phrases} AS p, b, l FROM s")
    first = f"{_sorted(_named(_same(V.ORGANIZATIONS), True))}[1:3]"
    return f"{STORY_SQL}, e AS ({' UNION ALL '.join(each)}) SELECT doc_id, event_type, list_filter(p, lambda x, i: list_position(p, x) = i)[1:3] AS matched_phrases, {first} AS actors, CASE WHEN doc_id % 2 = 0 THEN ['c', 's'] ELSE ['l'] END AS locations FROM e WHERE len(p) > 0"


@query(_events_sql())
def story_events(spark, root):
    """Events of each story with their phrases, places and actors."""
    s = entities.entities(_story(spark, root), "title", "body")
    none = F.lit(None).cast("array<string>")
    spots = F.when(F.col("doc_id") % 2 == 1, F.array(F.lit("l")))
    found = entities.events(F.col("title"), F.col("body"), spots, F.array(F.lit("c")), F.array(F.lit("s")), F.col("organizations"), none, F.col("equipment"))
    return s.select("doc_id", F.explode(found).alias("e")).select("doc_id", "e.event_type", "e.matched_phrases", "e.actors", "e.locations")


def scores_sql() -> str:
    score = lambda label: "(" + " + ".join(f"CAST(contains(l, {_quoted(w)}) AS DOUBLE)" for w in label.lower().split()) + f") / {len(label.split())}"
    return "[" + ", ".join(f"{{'s': -({score(label)}), 'n': {_quoted(label)}}}" for label in V.CATEGORIES) + "]"


def _category_sql() -> str:
    subs = []
    for label, names in V.SUB_CATEGORIES.items():
        for sub in names:
            words = [w for w in sub.lower().split() if len(w) > 3]
            subs.append(f"CASE WHEN list_contains(primary_categories, {_quoted(label)}) AND ({' OR '.join(f'contains(l, {_quoted(w)})' for w in words)}) THEN {_quoted(sub)} END")
    return f"""{STORY_SQL}, q AS (SELECT doc_id, lower(b) AS l, doc_id % 4 <> 0 AS known, list_sort({scores_sql()}) AS r FROM s),
c AS (SELECT *, CASE WHEN NOT known THEN ['National Security'] WHEN r[1].s > -0.25 THEN [r[1].n] ELSE [x.n for x in list_filter(r, lambda x: x.s <= -0.25)[1:5]] END AS primary_categories FROM q)
SELECT doc_id, primary_categories, CASE WHEN known THEN list_sort(list_distinct(list_filter([{", ".join(subs)}], lambda x: x IS NOT NULL)))[1:4] ELSE CAST([] AS VARCHAR[]) END AS sub_categories,
 CASE WHEN known THEN r[1].n ELSE 'National Security' END AS category, CASE WHEN known THEN round(-r[1].s, 3) ELSE 0.5 END AS category_confidence,
 CASE WHEN known THEN r[1].n END AS best, CASE WHEN known THEN [x.n for x in r[1:3]] END AS top FROM c"""


@query(_category_sql())
def story_categories(spark, root):
    """Labels by the offline scorer, their sub-categories, and what is given to
    rows without a score."""
    s = _story(spark, root)
    both = F.concat_ws("\n", "title", "body")
    s = s.withColumns({"b": both, "scores": F.when(F.col("doc_id") % 4 != 0, categories.overlap_scores(both, V.CATEGORIES))})
    c = categories.classify(s, "scores", "b")
    top = F.map_keys(categories.top_scores(F.col("scores")))
    return c.select("doc_id", "primary_categories", "sub_categories", "category", "category_confidence", categories.best_label(F.col("scores")).alias("best"), top.alias("top"))


@query("SELECT doc_id, coalesce(nullif(trim(concat_ws(chr(10), 'Title: ' || nullif(trim(source), ''), 'Summary: ' || nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END), ''), 'Content: ' || nullif(substring(trim(text, ' '), 1, 4000), ''))), ''), 'No article text available.') AS t, CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || trim(substring(text, 1, 400), ' ') ELSE 'defence news' END AS u FROM documents WHERE text <> ''")
def scorer_texts(spark, root):
    """What scorers read."""
    d = table(spark, root, "documents").where("text <> ''")
    summary = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang"))
    even = F.col("doc_id") % 2 == 0
    u = categories.label_text(F.when(even, F.col("source")), F.when(even, F.col("text")), F.lit(None).cast("string"))
    return d.select("doc_id", categories.zero_shot_text(F.col("source"), summary, F.col("text")).alias("t"), u.alias("u"))


@query(f"{STORY_SQL} SELECT doc_id, regexp_replace(body, '{severity.BIO_TAIL}', '', 'g') AS t FROM story")
def without_bio(spark, root):
    """Texts without the tails that speak of their authors."""
    return _story(spark, root).select("doc_id", severity.without_bio(F.col("body")).alias("t"))
