"""Every query of the serving layer (``Desk``) and the projections of readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import vocabulary as V
from tidewire.functions.geography import STATE_OF_CITY
from tidewire.operators import aggregates, briefs, cards, facets, reports, sectors
from tidewire.operators.numbering import numbered
from tidewire.plans.articles import ARTICLES_SQL, articles
from tidewire.plans.briefs import KNOWN, _brief_sql
from tidewire.plans.desk import Desk
from tidewire.plans.listing import RANK
from tidewire.tables import table

QUERIES, ORACLES = {}, {}
TODAY = "2024-03-01"


def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def _desk(spark, root) -> Desk:
    e = table(spark, root, "events")
    stamp = F.concat(F.substring(F.col("ts").cast("string"), 1, 10), F.lit("T00:00:00"))
    dead = e.where("event_id % 17 = 0").select(F.when(F.col("event_id") % 2 == 0, "CSV").otherwise("JSON").alias("source_type"), stamp.alias("timestamp"), F.concat(F.lit("error "), F.format_string("%08d", "event_id")).alias("error_message"))
    records = e.select(F.col("event_type").alias("source_name"), F.when(F.col("event_id") % 2 == 0, "CSV").otherwise("JSON").alias("source_type"))
    return Desk(articles(spark, root), TODAY, records, dead)


def desk(name, run, sql, *columns):
    """A query of one method of the desk, of some columns."""
    add(name, lambda spark, root: (lambda df: df.select(*columns) if columns else df)(run(_desk(spark, root))), ARTICLES_SQL + sql)


def brief(name, run, where):
    """A brief of the desk, of the articles that ``where`` means."""
    add(name, lambda spark, root: run(_desk(spark, root)), _brief_sql("", where, "list_concat(cities, states, countries)"))


BRIEF, BRIEF_SQL = ["article_id", "threat_level", "published_at"], "article_id, threat_level, published_at"
_COUNT = lambda c: f"SELECT place, count(*) AS total, count(*) FILTER (threat_level IN ('HIGH','CRITICAL')) AS high_threat, count(*) FILTER (army_monitoring_needed = 'YES') AS monitoring FROM (SELECT unnest({c}) AS place, threat_level, army_monitoring_needed FROM articles WHERE nlp_processed = 1 OR states IS NOT NULL) GROUP BY 1 ORDER BY total DESC, place LIMIT 20"
desk("desk_health", lambda d: d.health(), "SELECT 'ok' AS status, count(*) AS articles FROM articles")
desk("desk_legacy_health", lambda d: d.legacy_health(), "SELECT 'online' AS status, 'News Intelligence API' AS service, count(*) > 0 AS data_exists FROM articles")
desk("desk_kpis", lambda d: d.kpis()["kpis"], "SELECT count(*) AS total, count(*) FILTER (threat_level IN ('HIGH','CRITICAL')) AS high_threat, count(*) FILTER (threat_level = 'CRITICAL') AS critical, count(*) FILTER (army_monitoring_needed = 'YES') AS monitoring, count(*) FILTER (requires_human_review = 1) AS review, count(*) FILTER (emerging_situation = 1) AS emerging, count(*) FILTER (potential_threat = 'YES') AS potential, count(*) FILTER (military_relevance = 'HIGH' OR national_security_relevance = 'HIGH') AS important FROM articles")
desk("desk_articles", lambda d: d.articles(30, 10, level="high", since="2020"), f"SELECT {BRIEF_SQL} FROM articles WHERE threat_level = 'HIGH' AND published_at >= '2020' ORDER BY {RANK}, published_at DESC, article_id LIMIT 30 OFFSET 10", *BRIEF)
desk("desk_threats", lambda d: d.threats("critical", 20)["articles"], f"SELECT {BRIEF_SQL} FROM articles WHERE threat_level = 'CRITICAL' ORDER BY published_at DESC, article_id LIMIT 20", *BRIEF)
desk("desk_priority", lambda d: d.priority(25), f"SELECT * FROM (SELECT {BRIEF_SQL} FROM articles WHERE threat_level = 'CRITICAL' ORDER BY published_at DESC, article_id LIMIT 25) UNION ALL SELECT * FROM (SELECT {BRIEF_SQL} FROM articles WHERE threat_level = 'HIGH' ORDER BY published_at DESC, article_id LIMIT 25)", *BRIEF)
desk("desk_monitoring", lambda d: d.monitoring(40), f"SELECT {BRIEF_SQL} FROM articles WHERE army_monitoring_needed = 'YES' ORDER BY CASE threat_level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END, CASE importance WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, published_at DESC, article_id LIMIT 40", *BRIEF)
desk("desk_review", lambda d: d.review(40), f"SELECT {BRIEF_SQL} FROM articles WHERE requires_human_review = 1 ORDER BY {RANK}, published_at DESC, article_id LIMIT 40", *BRIEF)
for _c in ("states", "cities", "countries"):
    desk(f"desk_locations_{_c}", lambda d, c=_c: d.locations()[c], _COUNT(_c))
desk("desk_entities", lambda d: d.entities("organizations", 10), "SELECT entity, count(*) AS n FROM (SELECT unnest(organizations) AS entity FROM articles) WHERE entity <> '' GROUP BY 1 ORDER BY n DESC, entity LIMIT 10")
desk("desk_sources", lambda d: d.sources(), "SELECT source AS name, CASE WHEN regexp_matches(source, 'PIB|Press Information|Govt') THEN 'Official Government' WHEN regexp_matches(lower(source), 'defence|military|army|navy|air force|review|idr') THEN 'Dedicated Defence' WHEN regexp_matches(lower(source), 'idsa|orf|sipri|vif|diplomat|rocks|think') THEN 'Strategic Research' WHEN regexp_matches(lower(source), 'ani|wire|pti') THEN 'News Wire' ELSE 'National Media' END AS category, 'Active' AS status, '99.4%' AS reliability, substring(coalesce(max(published_at), max(fetched_at), 'Recently'), 1, 16) AS last_ingestion, count(*) AS articles FROM articles WHERE source <> '' GROUP BY source")
desk("desk_trend_categories", lambda d: d.trends(45)["categories"], f"SELECT category, count(*) AS n FROM (SELECT unnest(CASE WHEN len(categories) = 0 THEN [article_type] ELSE categories END) AS category FROM articles WHERE published_at >= strftime(DATE '{TODAY}' - 45, '%Y-%m-%d')) WHERE category IS NOT NULL GROUP BY 1 ORDER BY n DESC, category LIMIT 15")
desk("desk_trend_days", lambda d: d.trends(45)["days"], f"SELECT substring(published_at, 1, 10) AS day, count(*) AS n FROM articles WHERE published_at >= strftime(DATE '{TODAY}' - 45, '%Y-%m-%d') GROUP BY 1")
desk("desk_article", lambda d: d.article(5), f"SELECT {BRIEF_SQL} FROM articles WHERE article_id = 5", *BRIEF)
desk("desk_at", lambda d: d.at(7), f"SELECT {BRIEF_SQL} FROM articles ORDER BY published_at DESC, article_id LIMIT 1 OFFSET 6", *BRIEF)
desk("desk_categories", lambda d: d.categories(), "SELECT coalesce(article_type, 'Unclassified') AS category, count(*) AS n FROM articles GROUP BY 1")
_LEGACY = "SELECT CAST(article_id AS VARCHAR) AS article_id, title, coalesce(nullif(source, ''), 'Unknown source') AS source, coalesce(nullif(url, ''), '') AS url, coalesce(nullif(article_type, ''), 'Unclassified') AS category, round_even(CASE WHEN confidence <= 1 THEN confidence * 100 ELSE confidence END, 1) AS confidence, published_at, fetched_at, coalesce(nullif(summary, ''), '') AS summary, threat_level FROM articles"
_LEGACY_COLUMNS = ["article_id", "title", "source", "url", "category", "confidence", "published_at", "fetched_at", "summary", "threat_level"]
desk("desk_legacy_articles", lambda d: d.legacy("CLICK", 50), f"SELECT * FROM ({_LEGACY}) WHERE category = 'click' ORDER BY published_at DESC, CAST(article_id AS BIGINT) LIMIT 50", *_LEGACY_COLUMNS)
desk("desk_digest", lambda d: d.digest(), "SELECT coalesce(article_type, 'Unclassified') AS category, row_number() OVER (PARTITION BY coalesce(article_type, 'Unclassified') ORDER BY published_at DESC, article_id) - 1 AS position, article_id FROM articles", "category", "position", "article_id")
desk("desk_evaluation", lambda d: d.evaluation("military_relevance", "national_security_relevance"), "SELECT count(*) > 0 AS available, count(*) AS samples, count(*) FILTER (military_relevance = national_security_relevance) AS correct, round_even(100.0 * count(*) FILTER (military_relevance = national_security_relevance) / count(*), 1) AS accuracy FROM articles")
desk("desk_dead_letters", lambda d: d.dead_letters(25, "CSV"), "SELECT 'CSV' AS source_type, substring(CAST(ts AS VARCHAR), 1, 10) || 'T00:00:00' AS timestamp, 'error ' || printf('%08d', event_id) AS error_message FROM events WHERE event_id % 17 = 0 AND event_id % 2 = 0 ORDER BY timestamp DESC, error_message LIMIT 25")
brief("desk_daily_brief", lambda d: d.daily_brief(), "article_id IN (SELECT article_id FROM articles ORDER BY published_at DESC NULLS LAST, article_id LIMIT 30)")
brief("desk_situation_brief", lambda d: d.situation_brief("state3 Sector", ["nothing of it"]), "article_id IN (SELECT article_id FROM articles WHERE title ILIKE '%state3%' OR len(list_filter(list_concat(states, cities, countries), lambda x: x ILIKE '%state3%')) > 0 ORDER BY published_at DESC NULLS LAST, article_id LIMIT 20)")
brief("desk_country_brief", lambda d: d.country_brief("en vs de"), "article_id IN (SELECT article_id FROM (SELECT article_id FROM articles WHERE len(list_filter(countries, lambda x: x ILIKE '%en%')) > 0 ORDER BY published_at DESC NULLS LAST, article_id LIMIT 25) UNION SELECT article_id FROM (SELECT article_id FROM articles WHERE len(list_filter(countries, lambda x: x ILIKE '%de%')) > 0 ORDER BY published_at DESC NULLS LAST, article_id LIMIT 25))")
brief("desk_trend_brief", lambda d: d.trend_brief(), "article_id IN (SELECT article_id FROM articles ORDER BY published_at DESC NULLS LAST, article_id LIMIT 40)")
brief("desk_regional_brief", lambda d: d.regional_brief("state2"), "article_id IN (SELECT article_id FROM articles WHERE len(list_filter(list_concat(states, cities, countries), lambda x: x ILIKE '%state2%')) > 0 ORDER BY published_at DESC NULLS LAST, article_id LIMIT 20)")
brief("desk_ask", lambda d: d.ask("what is critical", lambda q: {"kind": "situation_brief", "locations": ["state1"]}, lambda i: d.all.where("threat_level = 'CRITICAL'")), "article_id IN (SELECT article_id FROM articles WHERE threat_level = 'CRITICAL')")
add("desk_ingestion_sources", lambda spark, root: _desk(spark, root).ingestion_sources(spark.createDataFrame([("click",), ("gone",)], "source_name string")), "SELECT coalesce(c.s, n.event_type) AS source_name, c.s IS NOT NULL AS configured, coalesce(n, 0) AS n FROM (SELECT unnest(['click', 'gone']) AS s) c FULL JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) n ON n.event_type = c.s")
add("desk_record_counts", lambda spark, root: _desk(spark, root).record_counts(), "SELECT CASE WHEN event_id % 2 = 0 THEN 'CSV' ELSE 'JSON' END AS source_type, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM events")


def _mapped(spark, root):
    """The article view with real states and cities."""
    pick = lambda items, by: F.element_at(F.array(*map(F.lit, items)), (F.col("article_id") * by % len(items) + 1).cast("int"))
    a, i = articles(spark, root), F.col("article_id")
    none = F.expr("array()").cast("array<string>")
    return a.withColumns({
        "states": F.when(i % 3 == 0, F.array(pick(V.STATES, 1), pick(V.STATES, 5), F.lit("Atlantis"))).otherwise(none),
        "cities": F.when(i % 3 == 2, F.array(pick(list(STATE_OF_CITY), 7))).otherwise(none),
        "title": F.when(i % 10 == 0, "").otherwise(F.concat("title", F.when(i % 4 == 0, " drone").otherwise(""))),
    })


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _map_sql() -> str:
    lists = lambda items: "[" + ", ".join(map(_quoted, items)) + "]"
    city, known = lists(STATE_OF_CITY), lists(V.SECTORS)
    state_of = f"list_extract({lists(STATE_OF_CITY.values())}, list_position({city}, cities[1]))"
    words = " OR ".join(f"contains(lower(t), {_quoted(w)})" for w in sectors.STRATEGIC_WORDS)
    spots = ", ".join(f"({_quoted(n)}, {x}::DOUBLE, {y}::DOUBLE, {_quoted(c)})" for n, (x, y, c) in V.SECTORS.items())
    return f"""{ARTICLES_SQL}, m AS (SELECT article_id, published_at, source, threat_level, CASE WHEN article_id % 10 = 0 THEN '' ELSE title || CASE WHEN article_id % 4 = 0 THEN ' drone' ELSE '' END END AS t,
 CASE WHEN article_id % 3 = 0 THEN [{lists(V.STATES)}[article_id % {len(V.STATES)} + 1], {lists(V.STATES)}[article_id * 5 % {len(V.STATES)} + 1]] ELSE CAST([] AS VARCHAR[]) END AS states,
 CASE WHEN article_id % 3 = 2 THEN [{city}[article_id * 7 % {len(STATE_OF_CITY)} + 1]] ELSE CAST([] AS VARCHAR[]) END AS cities FROM articles ORDER BY published_at DESC NULLS LAST, article_id LIMIT 500),
e AS (SELECT *, unnest(list_filter(CASE WHEN len(states) > 0 THEN list_distinct(states) WHEN len(cities) > 0 THEN [{state_of}] ELSE CAST([] AS VARCHAR[]) END, lambda x: list_contains({known}, x))) AS state,
 CASE threat_level WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 1 ELSE 0 END AS r, threat_level IN ('CRITICAL', 'HIGH', 'MODERATE') OR {words} AS strategic FROM m),
f AS (SELECT state, count(*) AS articles, count(*) FILTER (r >= 2) AS priority, max(r) AS r, list_sort(list_distinct(list(source)))[1:6] AS sources FROM e GROUP BY 1),
u AS (SELECT state, t, min(k) AS k FROM (SELECT *, row_number() OVER (ORDER BY published_at DESC NULLS LAST, article_id) AS k FROM e WHERE strategic AND t <> '') GROUP BY 1, 2),
d AS (SELECT state, list(t ORDER BY k)[1:3] AS developments FROM u GROUP BY 1),
c(state, x, y, coordinates) AS (VALUES {spots})
SELECT 'map-' || lower(replace(state, ' ', '-')) AS id, state || ' Sector' AS name, state, x, y, coordinates, articles, priority,
 CASE r WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MODERATE' ELSE 'LOW' END AS max_level, CAST(CASE r WHEN 3 THEN 92 WHEN 2 THEN 78 WHEN 1 THEN 50 ELSE 20 END AS INTEGER) AS risk,
 CASE WHEN r >= 2 THEN 'increasing' ELSE 'stable' END AS trend, CASE r WHEN 3 THEN 'High Priority Threat' WHEN 2 THEN 'Elevated Alert' WHEN 1 THEN 'Surveillance Active' ELSE 'Baseline Observation' END AS trend_text, sources,
 coalesce(developments, ['Sector stable. Baseline observation active in ' || state || ' sector.']) AS developments FROM f LEFT JOIN d USING (state) JOIN c USING (state)"""


add("map_sectors", lambda spark, root: sectors.map_sectors(_mapped(spark, root)), _map_sql())
add("map_pins", lambda spark, root: facets.pins(sectors.map_sectors(_mapped(spark, root)), "high").select("id", "max_level"), f"SELECT id, max_level FROM ({_map_sql()}) WHERE max_level IN ('HIGH', 'CRITICAL')")


def view(name, run, sql):
    add(name, lambda spark, root: run(articles(spark, root)), ARTICLES_SQL + sql)




def newest():
    return [F.desc_nulls_last("published_at"), F.asc("article_id")]


view("representatives", lambda a: facets.representatives(a).select("article_id"), "SELECT article_id FROM articles WHERE coalesce(is_cluster_representative, 1) <> 0")
view("located_rows", lambda a: facets.located_rows(a.withColumn("states", F.when(F.col("article_id") % 3 == 0, F.col("states")))).select("article_id"), "SELECT article_id FROM articles WHERE nlp_processed = 1 OR article_id % 3 = 0")
view("short_forms", cards.short_form, "SELECT CAST(article_id AS VARCHAR) AS article_id, coalesce(nullif(title, ''), 'Untitled') AS title, coalesce(nullif(source, ''), 'Unknown') AS source, substring(published_at, 1, 10) AS published_at, coalesce(url, '') AS url, threat_level FROM articles")
view("supporting", cards.supporting, "SELECT CAST(article_id AS VARCHAR) AS article_id, coalesce(nullif(title, ''), 'Untitled') AS title, coalesce(nullif(source, ''), 'Unknown') AS source, substring(published_at, 1, 10) AS published_at, coalesce(url, '') AS url, threat_level, substring(coalesce(summary, ''), 1, 300) AS summary FROM articles")
view("legacy_articles", lambda a: cards.legacy(numbered(a.drop("article_id").withColumn("k", F.col("url")).withColumnRenamed("summary", "description"), ["published_at", "title", "source"], "at"), "at").select("article_id", "title", "summary"), "SELECT CAST(row_number() OVER (ORDER BY published_at, title, source) AS VARCHAR) AS article_id, coalesce(nullif(title, ''), 'Untitled article') AS title, coalesce(nullif(summary, ''), '') AS summary FROM articles")
view("threat_cards", lambda a: cards.threat_cards(facets.page(facets.facet_filter(a, level="CRITICAL"), 50), *newest()), "SELECT lpad(CAST(row_number() OVER (ORDER BY published_at DESC NULLS LAST, article_id) AS VARCHAR), 2, '0') AS rank, article_id, title, threat_level, array_to_string(list_concat(cities, states), ', ') AS location FROM articles WHERE threat_level = 'CRITICAL' ORDER BY published_at DESC, article_id LIMIT 50")
_ENTRIES = ", t AS (SELECT * FROM articles ORDER BY published_at DESC NULLS LAST, article_id LIMIT 200), e AS (SELECT *, row_number() OVER (ORDER BY published_at DESC NULLS LAST, article_id) AS k FROM t), n AS (SELECT article_id, k, '[' || k || '] ' || coalesce(nullif(title, ''), 'Untitled') || chr(10) || 'Source: ' || source || ' | Date: ' || substring(published_at, 1, 10) || chr(10) || 'Threat Level (AI Flag): ' || threat_level || chr(10) || 'Locations: ' || array_to_string(list_concat(states, cities), ', ') || chr(10) || 'Summary: ' || coalesce(nullif(summary, ''), substring(article_text, 1, 300)) || chr(10) AS entry FROM e), u AS (SELECT article_id, k, entry, CAST(sum(length(entry)) OVER (ORDER BY k) AS BIGINT) AS used FROM n) "
view("context_entries", lambda a: cards.context_entries(a.orderBy(*newest()).limit(200), *newest(), budget=20_000), _ENTRIES + "SELECT article_id, entry, used FROM u WHERE used <= 20000")
view("context_text", lambda a: cards.context(cards.context_entries(a.orderBy(*newest()).limit(200), *newest(), budget=20_000)), _ENTRIES + "SELECT string_agg(entry, chr(10) || '---' || chr(10) ORDER BY k) AS context FROM u WHERE used <= 20000")
view("category_chart", lambda a: briefs.or_else(aggregates.distribution(a.where("article_type = 'never'"), "article_type"), aggregates.category_trend(a).withColumnRenamed("category", "article_type")), "SELECT category AS article_type, count(*) AS n FROM (SELECT unnest(CASE WHEN len(categories) = 0 THEN [article_type] ELSE categories END) AS category FROM articles) WHERE category IS NOT NULL GROUP BY 1 ORDER BY n DESC, category LIMIT 15")
add("confidence_percent", lambda spark, root: table(spark, root, "events").select("event_id", cards.confidence_percent(F.when(F.col("event_id") % 5 == 0, "none").otherwise(F.format_string("%.4f", F.col("value")))).alias("c")), "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN round_even(CASE WHEN CAST(printf('%.4f', value) AS DOUBLE) <= 1 THEN CAST(printf('%.4f', value) AS DOUBLE) * 100 ELSE CAST(printf('%.4f', value) AS DOUBLE) END, 1) END AS c FROM events")
_KINDS = ["PIB Delhi", "Indian Army blog", "Defence Review", "The Diplomat", "ORF", "ANI", "PTI wire", "Govt press", "Daily Mail", "Military Times"]
add("source_categories", lambda spark, root: table(spark, root, "nation").select("n_nationkey", cards.source_category(F.element_at(F.array(*map(F.lit, _KINDS)), F.col("n_nationkey") % len(_KINDS) + 1)).alias("category")), "SELECT n_nationkey, ['Official Government', 'Dedicated Defence', 'Dedicated Defence', 'Strategic Research', 'Strategic Research', 'News Wire', 'News Wire', 'Official Government', 'National Media', 'Dedicated Defence'][n_nationkey % 10 + 1] AS category FROM nation")


_RULE = "=" * 54
view("kpi_report", lambda a: reports.kpi_report(aggregates.kpis(a).select("total", "critical")), f"SELECT CAST(i - 1 AS INTEGER) AS line, t[i] AS text FROM (SELECT ['{_RULE}', 'Intelligence KPIs', '{_RULE}', printf('%-20s %8d', 'total', count(*)), printf('%-20s %8d', 'critical', count(*) FILTER (threat_level = 'CRITICAL')), '{_RULE}'] AS t FROM articles), range(1, 7) r(i)")
view("category_report", lambda a: reports.category_report(aggregates.with_unlabelled(a, "article_type", ["click", "never"])), f"SELECT CAST(i - 1 AS INTEGER) AS line, t[i] AS text FROM (SELECT ['{_RULE}', 'Category distribution', '{_RULE}', printf('%-28s %8d %6.1f%%', 'click', c, round(c * 100 / (c + u), 1)), printf('%-28s %8d %6.1f%%', 'never', 0, 0.0), printf('%-28s %8d %6.1f%%', 'Unclassified', u, round(u * 100 / (c + u), 1)), '{_RULE}'] AS t FROM (SELECT count(*) FILTER (article_type = 'click') AS c, count(*) FILTER (article_type IS NULL) AS u FROM articles)), range(1, 8) r(i)")
view("metric_report", lambda a: reports.metric_report(aggregates.metric_totals(a.select(F.lit("x").alias("g"), F.when(F.col("article_id") % 4 == 0, "y").otherwise("x").alias("p")), "g", "p", ["x", "y"]).select("sample_size", "accuracy")), f"SELECT CAST(i - 1 AS INTEGER) AS line, t[i] AS text FROM (SELECT ['{_RULE}', 'Classification metrics', '{_RULE}', printf('%-20s %8d', 'sample_size', count(*)), printf('%-20s %8.4f', 'accuracy', round(count(*) FILTER (article_id % 4 <> 0) / count(*), 4)), '{_RULE}'] AS t FROM articles), range(1, 7) r(i)")
