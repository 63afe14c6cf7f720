"""Gazetteer, keyword, cascade and event queries over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import rules
from tidewire.tables import table

QUERIES, ORACLES = {}, {}
# A gazetteer of words that the test texts have: (term, kind).
PLACES = [("of the", "region"), ("that", "country"), ("this", "state"), ("which", "city"), ("con", "country"), ("mit", "state")]
KEYWORDS = ["Whre", "that", "ingand", "nowhere", "Eaux"]
STEPS = [
    {"name": "civic", "patterns": ["\\bthis\\b"], "title_only": True, "outcome": ("LOW", 0.05)},
    {"name": "critical", "patterns": ["\\bwhich\\b", "\\bthst\\b"], "context": ["\\bwith\\b"], "outcome": ("CRITICAL", 0.95)},
    {"name": "high", "patterns": ["\\bthe\\b"], "blocked": ["\\bof\\b"], "outcome": ("HIGH", 0.82)},
    {"name": "moderate", "patterns": ["\\bque\\b"], "title_only": True, "unless": ["\\ble\\b"], "outcome": ("MODERATE", 0.50)},
]


def gazetteer_matches(spark, root):
    """Gazetteer terms of each document."""
    g = spark.createDataFrame(PLACES, "term string, kind string")
    return rules.match_gazetteer(table(spark, root, "documents"), "doc_id", "text", g, 2)


def keyword_matches(spark, root):
    """Keywords in list order; short ones in their own case."""
    return table(spark, root, "documents").select("doc_id", rules.plain_terms_in(F.col("text"), KEYWORDS, 20).alias("keywords"))


def threat_cascade(spark, root):
    """First matching step of an ordered rule list."""
    ascii_only = F.regexp_replace("text", "[^A-Za-z0-9 ]", " ")
    d = table(spark, root, "documents").select("doc_id", F.substring(ascii_only, 1, 80).alias("title"), ascii_only.alias("body"))
    return d.select("doc_id", rules.cascade(F.col("title"), F.col("body"), STEPS).alias("r")).select("doc_id", "r.level", "r.score", "r.rule")


def event_phrases(spark, root):
    """Events with their first phrases."""
    found = rules.events_in(F.col("text"), {"meeting": ["with th[a-z]+"], "move": ["of th[a-z]+", "to th[a-z]+"]})
    return table(spark, root, "documents").select("doc_id", F.explode(found).alias("e")).select("doc_id", "e.event_type", "e.phrases")


def top_labels(spark, root):
    """Labels from a score map: those above the threshold, else the best."""
    scores = F.create_map(F.lit("a"), (F.col("event_id") % 7) / 10, F.lit("b"), (F.col("event_id") % 5) / 10, F.lit("c"), (F.col("event_id") % 3) / 10)
    return table(spark, root, "events").select("event_id", rules.top_labels(scores).alias("labels"))


QUERIES |= {f.__name__: f for f in (gazetteer_matches, keyword_matches, threat_cascade, event_phrases, top_labels)}
ORACLES["gazetteer_matches"] = "WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents), g(term, kind) AS (VALUES ('of the', 'region'), ('that', 'country'), ('this', 'state'), ('which', 'city'), ('con', 'country'), ('mit', 'state')) SELECT doc_id, term, kind FROM w JOIN g ON contains(t, ' ' || term || ' ')"
ORACLES["keyword_matches"] = r"WITH d AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9]', ' ', 'g') AS t FROM documents) SELECT doc_id, list_filter([CASE WHEN regexp_matches(t, '\bWhre\b') THEN 'Whre' END, CASE WHEN regexp_matches(t, '\bthat\b') THEN 'that' END, CASE WHEN regexp_matches(t, '(?i)\bingand\b') THEN 'ingand' END, CASE WHEN regexp_matches(t, '(?i)\bnowhere\b') THEN 'nowhere' END, CASE WHEN regexp_matches(t, '\bEaux\b') THEN 'Eaux' END], lambda x: x IS NOT NULL) AS keywords FROM d"
ORACLES["threat_cascade"] = r"WITH a AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g') AS b FROM documents), d AS (SELECT doc_id, substring(b, 1, 80) AS t, substring(b, 1, 1200) AS s, substring(b, 1, 80) || ' ' || b AS w FROM a), r AS (SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)\bthis\b') THEN 'civic' WHEN regexp_matches(t, '(?i)\bwhich\b|\bthst\b') OR (regexp_matches(s, '(?i)\bwhich\b|\bthst\b') AND regexp_matches(w, '(?i)\bwith\b')) THEN 'critical' WHEN regexp_matches(t, '(?i)\bthe\b') OR (regexp_matches(s, '(?i)\bthe\b') AND NOT regexp_matches(t, '(?i)\bof\b')) THEN 'high' WHEN regexp_matches(t, '(?i)\bque\b') AND NOT regexp_matches(t, '(?i)\ble\b') THEN 'moderate' ELSE 'default' END AS rule FROM d) SELECT doc_id, CASE rule WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' WHEN 'moderate' THEN 'MODERATE' ELSE 'LOW' END AS level, CAST(CASE rule WHEN 'civic' THEN 0.05 WHEN 'critical' THEN 0.95 WHEN 'high' THEN 0.82 WHEN 'moderate' THEN 0.50 ELSE 0.10 END AS DOUBLE) AS score, rule FROM r"


def _phrases(kind: str, *patterns: str) -> str:
    found = [f"regexp_extract_all(lower(text), '{p}')" for p in patterns]
    return f"SELECT doc_id, '{kind}' AS event_type, {found[0] if len(found) == 1 else f'list_concat({", ".join(found)})'} AS p FROM documents"


ORACLES["event_phrases"] = f"WITH e AS ({_phrases('meeting', 'with th[a-z]+')} UNION ALL {_phrases('move', 'of th[a-z]+', 'to th[a-z]+')}) SELECT doc_id, event_type, list_filter(p, lambda x, i: list_position(p, x) = i)[1:3] AS phrases FROM e WHERE len(p) > 0"
ORACLES["top_labels"] = "WITH s AS (SELECT event_id, list_sort([{'s': -((event_id % 7) / 10), 'n': 'a'}, {'s': -((event_id % 5) / 10), 'n': 'b'}, {'s': -((event_id % 3) / 10), 'n': 'c'}]) AS r FROM events) SELECT event_id, CASE WHEN r[1].s > -0.25 THEN [r[1].n] ELSE [x.n for x in list_filter(r, lambda x: x.s <= -0.25)] END AS labels FROM s"
