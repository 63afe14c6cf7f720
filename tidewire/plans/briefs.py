"""Briefs, digests, places, sentiment and questions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import places
from tidewire.operators import briefs, intent
from tidewire.plans.articles import ARTICLES_SQL, articles
from tidewire.plans.scalars import extractive_sql
from tidewire.tables import table

QUERIES, ORACLES = {}, {}
KNOWN = ["error", "purchase", "absent"]
# A gazetteer of words that the test texts have: (term, place, kind, state, country, type).
GAZETTEER = [
    ("that", "Thatland", "country", None, None, None),
    ("con", "Conland", "country", None, None, None),
    ("this", "Thisshire", "state", None, None, None),
    ("which", "Whichton", "city", "Thisshire", None, None),
    ("of the", "Ofthe Pass", "strategic", "Mitshire", "Farland", "border_area"),
    ("mit", "North", "region", None, None, None),
]
HOME = "Homeland"
TYPE_WORDS = {"road_area": ["road", "way"], "conflict_zone": ["thought"]}
TARGET_WORDS = {"Military": ["army"], "Government": ["which"], "Country": ["that"], "Policy": ["from"], "Event": ["con"]}
PLACES, ALIASES, STOP = ["That", "Of The", "Which"], {"you": "Youville", "der": "That"}, ["the", "of", "and", "to", "in"]


def _order():
    return [F.desc_nulls_last("published_at"), F.asc("article_id")]




def briefs_by_source(spark, root):
    """A brief for each source."""
    return briefs.synthesize(articles(spark, root), ["source"], _order(), ["title"], ["cities", "states", "countries"], ["organizations"])


def brief_of_all(spark, root):
    """One brief of the severe articles."""
    return briefs.synthesize(articles(spark, root).where(F.col("threat_level") == "HIGH"), [], _order(), ["title"], ["countries"], ["organizations"])


def digest_stories(spark, root):
    return briefs.stories(articles(spark, root), "article_type", _order(), KNOWN).select("position", "article_type", "rank", "article_id")


def digest_sections(spark, root):
    """Markdown of each category's first ten stories."""
    a = articles(spark, root)
    story = briefs.story_markdown(F.col("title"), F.col("source"), F.col("confidence"), F.col("article_text"), F.col("article_id").cast("string"))
    return briefs.sections(briefs.stories(a, "article_type", _order(), KNOWN), "article_type", story)


def digest_pages(spark, root):
    """HTML of each category's first ten stories."""
    a = articles(spark, root)
    story = briefs.story_html(F.col("title"), F.col("source"), F.col("confidence"), F.col("article_text"), F.col("article_id").cast("string"))
    return briefs.sections(briefs.stories(a, "article_type", _order(), KNOWN), "article_type", story, True)


def _located(spark, root):
    return places.locate(table(spark, root, "documents"), "doc_id", "text", GAZETTEER, HOME)


def located(spark, root):
    """Places of each document, with those they imply, and the confidence."""
    d = _located(spark, root)
    return d.select("doc_id", "countries", "states", "cities", "localities", "regions", F.round(places_confidence(), 2).alias("confidence"))


def located_by_join(spark, root):
    """The same places by a join with a gazetteer table."""
    g = spark.createDataFrame(GAZETTEER, "term string, place string, kind string, state string, country string, type string")
    d = places.locate(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text", g, HOME, 2)
    return d.select("doc_id", "countries", "states", "cities", "localities", "regions", F.round(places_confidence(), 2).alias("confidence"))


def places_confidence():
    from tidewire.functions.rules import confidence

    return confidence(F.col("countries"), F.col("states"), F.col("cities"), F.col("localities"))


def location_types(spark, root):
    d = _located(spark, root)
    return d.select("doc_id", places.location_type(F.col("text"), F.col("strategic_type"), TYPE_WORDS, ["Thisshire"]).alias("location_type"))


def sentiment_targets(spark, root):
    a = articles(spark, root)
    lists = [F.when(F.col("article_id") % 3 == 0, F.col("organizations")), F.when(F.col("article_id") % 7 == 0, F.array("source")), F.when(F.col("article_id") % 5 == 0, F.col("countries"))]
    return a.select("article_id", places.sentiment_target(F.col("title"), F.col("article_text"), TARGET_WORDS, *lists).alias("target"))


def sentiments(spark, root):
    """Names and stances of scorer labels."""
    labels = F.array(*map(F.lit, [*places.SENTIMENTS, "other"]))
    name = places.sentiment(F.element_at(labels, (F.col("event_id") % 8 + 1).cast("int")))
    return table(spark, root, "events").select("event_id", name.alias("sentiment"), places.stance(name).alias("stance"))


def questions(spark, root):
    """The conversation turns read as questions."""
    q = table(spark, root, "conversations").select("conv_id", "turn", "text")
    return intent.parse(q, "text", PLACES, ALIASES, STOP).drop("text")


def production_questions(spark, root):
    """The turns read with the production places, aliases and stop words."""
    from tidewire.functions import vocabulary as V
    from tidewire.functions.geography import STATE_OF_CITY

    places_ = [*V.STATES, *STATE_OF_CITY]
    pick = F.element_at(F.array(*map(F.lit, [*places_, *V.ALIASES])), (F.col("conv_id") * 7 % (len(places_) + len(V.ALIASES)) + 1).cast("int"))
    q = table(spark, root, "conversations").select("conv_id", "turn", F.concat(F.lit("what is the situation in "), pick, F.lit(" and in "), F.lower(pick)).alias("text"))
    return intent.parse(q, "text", places_, V.ALIASES, V.STOPWORDS).select("conv_id", "turn", "locations", "search_terms", "kind")


_run = [production_questions, briefs_by_source, brief_of_all, digest_stories, digest_sections, digest_pages, located, located_by_join, location_types, sentiment_targets, sentiments, questions]
QUERIES |= {f.__name__: f for f in _run}


def _brief_sql(key: str, where: str, spots: str) -> str:
    group = key or "1"
    part = f"PARTITION BY {key} " if key else ""
    pick = f"{key}, " if key else ""
    once = lambda c, n: f"list_filter({c}, lambda x, i: x <> '' AND list_position({c}, x) = i)[1:{n}]"
    return (
        ARTICLES_SQL
        + f""", a AS (SELECT * FROM articles WHERE {where}),
r AS (SELECT *, row_number() OVER ({part}ORDER BY published_at DESC NULLS LAST, article_id) AS k, count(*) OVER ({part.strip()}) AS reports FROM a),
t AS (SELECT {pick}any_value(reports) AS reports, list(coalesce(trim(title, ' '), '') ORDER BY k) AS titles, arg_min(coalesce(trim(title, ' '), ''), k) AS lead,
 max(CASE threat_level WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MODERATE' THEN 2 ELSE 1 END) AS s,
 flatten(list({spots} ORDER BY k)) AS p, flatten(list(organizations ORDER BY k)) AS o FROM r WHERE k <= 6 GROUP BY {group if key else "()"}),
v AS (SELECT *, ['LOW', 'MODERATE', 'HIGH', 'CRITICAL'][s] AS severity FROM t)
SELECT {pick}reports, severity, CASE WHEN s >= 3 THEN 'Escalating' ELSE 'Stable' END AS trend,
 substring(lead || CASE WHEN reports > 1 THEN ' Monitored intelligence includes ' || reports || ' correlated reports.' ELSE '' END, 1, 800) AS assessment,
 CASE s WHEN 4 THEN 'Critical security event requiring immediate operational tracking across ' || reports || ' verified report(s).' WHEN 3 THEN 'High-priority security development under continuous military monitoring across ' || reports || ' verified report(s).' ELSE 'Assessed at ' || severity || ' threat level across ' || reports || ' monitored intelligence reports.' END AS relevance,
 {once("titles", 5)} AS developments, {once("p", 6)} AS places, {once("o", 6)} AS actors FROM v"""
    )


_WORDS = "w AS (SELECT doc_id, text, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents), m AS (SELECT doc_id, text, contains(t, ' that ') AS a, contains(t, ' con ') AS b, contains(t, ' this ') AS c, contains(t, ' which ') AS d, contains(t, ' of the ') AS e, contains(t, ' mit ') AS f FROM w)"
_LIST = lambda *cases: "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{v}' END" for t, v in cases) + "], lambda x: x IS NOT NULL)))"
ORACLES["briefs_by_source"] = _brief_sql("source", "TRUE", "list_concat(cities, states, countries)")
ORACLES["brief_of_all"] = _brief_sql("", "threat_level = 'HIGH'", "countries")
ORACLES["digest_stories"] = ARTICLES_SQL + "SELECT CAST(CASE article_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 999 END AS INTEGER) AS position, article_type, CAST(rank AS INTEGER) AS rank, article_id FROM (SELECT *, row_number() OVER (PARTITION BY article_type ORDER BY published_at DESC NULLS LAST, article_id) AS rank FROM articles WHERE coalesce(article_type, '') <> '') WHERE rank <= 10"
ORACLES["located"] = (
    f"WITH {_WORDS} SELECT doc_id, "
    + _LIST(("a", "Thatland"), ("b", "Conland"), ("c OR d", HOME), ("e", "Farland")) + " AS countries, "
    + _LIST(("c OR d", "Thisshire"), ("e", "Mitshire")) + " AS states, " + _LIST(("d", "Whichton")) + " AS cities, "
    + _LIST(("e", "Ofthe Pass")) + " AS localities, " + _LIST(("f", "North")) + " AS regions, "
    + "round(CASE WHEN a OR b OR c OR d OR e THEN 0.3 ELSE 0 END + CASE WHEN c OR d OR e THEN 0.3 ELSE 0 END + CASE WHEN d THEN 0.2 ELSE 0 END + CASE WHEN e THEN 0.2 ELSE 0 END, 2)::DOUBLE AS confidence FROM m"
)
ORACLES["located_by_join"] = ORACLES["located"]
ORACLES["location_types"] = f"WITH {_WORDS} SELECT doc_id, CASE WHEN e THEN 'border_area' WHEN contains(lower(text), 'road') OR contains(lower(text), 'way') THEN 'road_area' WHEN contains(lower(text), 'thought') THEN 'conflict_zone' WHEN c OR d THEN 'border_area' ELSE 'unknown' END AS location_type FROM m"
ORACLES["sentiment_targets"] = ARTICLES_SQL + ", x AS (SELECT *, lower(coalesce(title, '') || ' ' || substring(coalesce(article_text, ''), 1, 500)) AS b FROM articles) SELECT article_id, CASE WHEN article_id % 7 = 0 OR contains(b, 'army') THEN 'Military' WHEN contains(b, 'which') THEN 'Government' WHEN article_id % 5 = 0 OR contains(b, 'that') THEN 'Country' WHEN contains(b, 'from') THEN 'Policy' WHEN contains(b, 'con') THEN 'Event' WHEN article_id % 3 = 0 THEN 'Organization' ELSE 'Government' END AS target FROM x"
ORACLES["sentiments"] = "SELECT event_id, ['Positive', 'Negative', 'Neutral', 'Concern', 'Critical', 'Escalatory', 'De-escalatory', 'Neutral'][event_id % 8 + 1] AS sentiment, ['Reassuring', 'Critical', 'Neutral', 'Alarming', 'Critical', 'Alarming', 'Supportive', 'Neutral'][event_id % 8 + 1] AS stance FROM events"
ORACLES["questions"] = """WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS b, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS k FROM conversations),
p AS (SELECT *, ' ' || array_to_string(k, ' ') || ' ' AS t FROM q),
l AS (SELECT *, list_concat(list_filter([CASE x WHEN 'you' THEN 'Youville' WHEN 'der' THEN 'That' END for x in k], lambda y: y IS NOT NULL), list_filter([CASE WHEN contains(t, ' that ') THEN 'That' END, CASE WHEN contains(t, ' of the ') THEN 'Of The' END, CASE WHEN contains(t, ' which ') THEN 'Which' END], lambda y: y IS NOT NULL)) AS raw FROM p),
n AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS locations FROM l),
s AS (SELECT *, list_filter(k, lambda x: length(x) >= 2 AND x NOT IN ('the', 'of', 'and', 'to', 'in') AND NOT list_contains([lower(y) for y in locations], x) AND NOT (x = 'you' AND list_contains(locations, 'Youville')) AND NOT (x = 'der' AND list_contains(locations, 'That'))) AS search_terms FROM n),
o AS (SELECT *, CASE WHEN len(locations) + len(search_terms) > 0 THEN list_concat(locations, search_terms) ELSE k END AS parts FROM s),
z AS (SELECT *, [lower(y) for y in parts] AS low FROM o)
SELECT conv_id, turn, locations, search_terms, CASE WHEN contains(b, 'high threat') OR contains(b, 'high-threat') OR contains(b, 'critical') THEN 'HIGH' END AS threat_level,
 CASE WHEN contains(b, 'negative') THEN 'Negative' WHEN contains(b, 'escalat') THEN 'Escalatory' END AS sentiment,
 CAST(CASE WHEN contains(b, 'week') THEN 7 WHEN contains(b, 'month') OR contains(b, '30 day') THEN 30 WHEN contains(b, 'today') THEN 1 END AS INTEGER) AS days,
 CASE WHEN contains(b, 'trend') OR contains(b, 'over the last') OR contains(b, 'during the last') THEN 'trend_analysis' WHEN contains(b, 'what is happening') OR contains(b, 'current status') OR contains(b, 'situation') THEN 'situation_brief' WHEN len(locations) > 0 THEN 'location_search' ELSE 'general_search' END AS kind,
 substring(array_to_string(list_filter(parts, lambda x, i: list_position(low, lower(x)) = i), ' '), 1, 200) AS search_query FROM z"""


_STORIES = ARTICLES_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY article_type ORDER BY published_at DESC NULLS LAST, article_id) AS rank FROM articles WHERE coalesce(article_type, '') <> ''), t AS (SELECT *, " + extractive_sql("article_text") + " AS told, printf('%.1f%%', round(coalesce(confidence, 0.0) * 100, 1)) AS sure FROM r WHERE rank <= 10)"
_SECTION = " SELECT CAST(CASE article_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 999 END AS INTEGER) AS position, article_type AS category, CAST(count(*) AS INTEGER) AS stories, "
_escape = lambda c: f"""replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""
ORACLES["digest_sections"] = _STORIES + _SECTION + "'## ' || article_type || chr(10) || chr(10) || string_agg('### ' || title || chr(10) || chr(10) || '**Source:** ' || source || '  ' || chr(10) || '**Classification confidence:** ' || sure || '  ' || chr(10) || chr(10) || told || chr(10) || chr(10) || '[Read original article](' || article_id || ')' || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY rank) AS section FROM t GROUP BY article_type"
ORACLES["digest_pages"] = _STORIES + _SECTION + f"""'<section class="category"><h2>' || {_escape("article_type")} || '</h2>' || string_agg('<article class="story"><h3>' || {_escape("coalesce(nullif(trim(title, ' '), ''), 'Untitled')")} || '</h3><div class="metadata">Source: ' || {_escape("source")} || ' Classification confidence: ' || sure || '</div><p>' || {_escape("told")} || '</p><a href="' || article_id || '" rel="noopener noreferrer">Read original article</a></article>', '' ORDER BY rank) || '</section>' AS section FROM t GROUP BY article_type"""


def _production_questions_sql() -> str:
    import re

    from tidewire.functions import vocabulary as V
    from tidewire.functions.geography import STATE_OF_CITY

    places_ = [*V.STATES, *STATE_OF_CITY]
    words = lambda t: " ".join(re.findall("[a-z0-9]+", t.lower()))
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    names = "[" + ", ".join(map(quote, [*places_, *V.ALIASES])) + "]"
    alias = "CASE x " + " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in V.ALIASES.items()) + " END"
    known = ", ".join(f"CASE WHEN contains(t, ' {words(p)} ') THEN {quote(p)} END" for p in places_)
    taken = ", ".join(f"CASE WHEN list_contains(locations, {quote(b)}) THEN {quote(a)} END" for a, b in V.ALIASES.items())
    stop = "(" + ", ".join(map(quote, V.STOPWORDS)) + ")"
    return f"""WITH q AS (SELECT conv_id, turn, 'what is the situation in ' || {names}[conv_id * 7 % {len(places_) + len(V.ALIASES)} + 1] AS b FROM conversations),
r AS (SELECT conv_id, turn, lower(b || ' and in ' || substring(b, 26)) AS b FROM q),
k AS (SELECT *, regexp_extract_all(b, '[a-z0-9]+') AS k FROM r), p AS (SELECT *, ' ' || array_to_string(k, ' ') || ' ' AS t FROM k),
l AS (SELECT *, list_concat(list_filter([{alias} for x in k], lambda y: y IS NOT NULL), list_filter([{known}], lambda y: y IS NOT NULL)) AS raw FROM p),
n AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS locations FROM l),
a AS (SELECT *, list_concat([lower(y) for y in locations], list_filter([{taken}], lambda y: y IS NOT NULL)) AS taken FROM n)
SELECT conv_id, turn, locations, list_filter(k, lambda x: length(x) >= 2 AND x NOT IN {stop} AND NOT list_contains(taken, x)) AS search_terms, 'situation_brief' AS kind FROM a"""


ORACLES["production_questions"] = _production_questions_sql()
