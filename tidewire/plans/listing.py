"""Listings, queues, counts and facets over the article view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import aggregates, facets
from tidewire.plans.articles import ARTICLES_SQL, articles

QUERIES, ORACLES = {}, {}
RANK = "CASE threat_level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 3 ELSE 4 END"
BRIEF = ["article_id", "threat_level", "published_at"]
BRIEF_SQL = "article_id, threat_level, published_at"


def add(name, run, sql=None):
    QUERIES[name] = lambda spark, root: run(articles(spark, root))
    if sql:
        ORACLES[name] = ARTICLES_SQL + sql


add("facet_articles", lambda a: facets.page(facets.facet_filter(a, level="high", category="purchase", since="2020"), 50).select("article_id", "title", "source", *BRIEF[1:], "categories"),
    f"SELECT article_id, title, source, threat_level, published_at, categories FROM articles WHERE threat_level = 'HIGH' AND (article_type ILIKE '%purchase%' OR len(list_filter(categories, lambda x: x ILIKE '%purchase%')) > 0) AND published_at >= '2020' ORDER BY {RANK}, published_at DESC, article_id LIMIT 50")
add("facet_places", lambda a: facets.facet_filter(a, source="src1", state="state3", city="city", country="e", monitoring="NO", before="2999").select(*BRIEF),
    f"SELECT {BRIEF_SQL} FROM articles WHERE source ILIKE '%src1%' AND len(list_filter(states, lambda x: x ILIKE '%state3%')) > 0 AND len(list_filter(cities, lambda x: x ILIKE '%city%')) > 0 AND len(list_filter(countries, lambda x: x ILIKE '%e%')) > 0 AND army_monitoring_needed = 'NO' AND published_at <= '2999'")
add("page_two", lambda a: facets.page(a, 20, 20).select(*BRIEF), f"SELECT {BRIEF_SQL} FROM articles ORDER BY {RANK}, published_at DESC, article_id LIMIT 20 OFFSET 20")
add("newest_of_level", lambda a: facets.newest_of_level(a, "critical").select(*BRIEF), f"SELECT {BRIEF_SQL} FROM articles WHERE threat_level = 'CRITICAL' ORDER BY published_at DESC, article_id LIMIT 50")
add("monitoring_queue", lambda a: facets.monitoring_queue(a).select(*BRIEF, "importance"),
    f"SELECT {BRIEF_SQL}, importance FROM articles WHERE army_monitoring_needed = 'YES' ORDER BY CASE threat_level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 3 WHEN 'LOW' THEN 4 ELSE 5 END, CASE importance WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, published_at DESC, article_id LIMIT 100")
add("review_queue", lambda a: facets.review_queue(a).select(*BRIEF), f"SELECT {BRIEF_SQL} FROM articles WHERE requires_human_review = 1 ORDER BY {RANK}, published_at DESC, article_id LIMIT 100")
add("unprocessed", lambda a: facets.unprocessed(a, "emerging_situation").select("article_id"), "SELECT article_id FROM articles WHERE coalesce(emerging_situation, 0) = 0 AND article_text IS NOT NULL AND article_text <> ''")
add("like_search", lambda a: facets.like_search(a, ["the", "an"], ["title", "source", "article_text"]).select("article_id"),
    "SELECT article_id FROM articles WHERE (title ILIKE '%the%' OR source ILIKE '%the%' OR article_text ILIKE '%the%') AND (title ILIKE '%an%' OR source ILIKE '%an%' OR article_text ILIKE '%an%')")
add("location_search", lambda a: facets.term_in_arrays(a, "city1", ["states", "cities", "countries"]).select("article_id"), "SELECT article_id FROM articles WHERE len(list_filter(list_concat(states, cities, countries), lambda x: x ILIKE '%city1%')) > 0")
add("entity_search", lambda a: facets.term_in_arrays(a, "org3", ["organizations", "countries"], ["title"]).select("article_id"), "SELECT article_id FROM articles WHERE len(list_filter(list_concat(organizations, countries), lambda x: x ILIKE '%org3%')) > 0 OR title ILIKE '%org3%'")
add("at_position", lambda a: facets.at_position(a, 17, F.col("published_at").desc_nulls_last(), F.col("article_id")).select("article_id"), "SELECT article_id FROM articles ORDER BY published_at DESC NULLS LAST, article_id LIMIT 1 OFFSET 16")
add("id_lookup", lambda a: a.join(a.where("article_id % 10 = 0").select("article_id"), "article_id", "left_semi").select(*BRIEF), f"SELECT {BRIEF_SQL} FROM articles WHERE article_id IN (SELECT article_id FROM articles WHERE article_id % 10 = 0)")
add("exclude_titles", lambda a: facets.exclude_titles(a, ["the", "que"]).select("article_id"), "SELECT article_id FROM articles WHERE NOT (contains(lower(title), 'the') OR contains(lower(title), 'que'))")
add("category_equal", lambda a: a.where(F.lower("article_type") == "click").select("article_id"), "SELECT article_id FROM articles WHERE lower(article_type) = 'click'")
add("top_per_category", lambda a: facets.top_of_each(a.where("article_type IS NOT NULL"), "article_type", 10, F.col("published_at").desc_nulls_last(), F.col("article_id")).select("article_type", "rank", "article_id"),
    "SELECT article_type, CAST(rank AS INTEGER) AS rank, article_id FROM (SELECT *, row_number() OVER (PARTITION BY article_type ORDER BY published_at DESC NULLS LAST, article_id) AS rank FROM articles WHERE article_type IS NOT NULL) WHERE rank <= 10")
add("context_budget", lambda a: facets.prefix_within(a, F.length("title"), 2000, F.col("article_id"), group=["source"]).select("source", "article_id", "used"),
    "SELECT source, article_id, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(length(title)) OVER (PARTITION BY source ORDER BY article_id ROWS UNBOUNDED PRECEDING) AS used FROM articles) WHERE used <= 2000")
add("kpis", aggregates.kpis,
    "SELECT count(*) AS total, count(*) FILTER (threat_level IN ('HIGH','CRITICAL')) AS high_threat, count(*) FILTER (threat_level = 'CRITICAL') AS critical, count(*) FILTER (army_monitoring_needed = 'YES') AS monitoring, count(*) FILTER (requires_human_review = 1) AS review, count(*) FILTER (emerging_situation = 1) AS emerging, count(*) FILTER (potential_threat = 'YES') AS potential, count(*) FILTER (military_relevance = 'HIGH' OR national_security_relevance = 'HIGH') AS important FROM articles")
add("routine", lambda a: aggregates.routine(aggregates.kpis(a)), "SELECT greatest(0, count(*) - count(*) FILTER (threat_level = 'CRITICAL') - count(*) FILTER (army_monitoring_needed = 'YES')) AS routine FROM articles")
add("level_distribution", lambda a: aggregates.distribution(a, "threat_level"), "SELECT threat_level, count(*) AS n FROM articles WHERE threat_level IS NOT NULL GROUP BY 1")
add("type_distribution", lambda a: aggregates.distribution(a, "article_type", 10), "SELECT article_type, count(*) AS n FROM articles WHERE article_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, article_type LIMIT 10")
add("source_stats", aggregates.source_stats, "SELECT source, count(*) AS n, max(published_at) AS last_published, max(fetched_at) AS last_fetched FROM articles WHERE source <> '' GROUP BY 1")
for _column in ("states", "cities", "countries"):
    add(f"place_counts_{_column}", lambda a, c=_column: aggregates.place_counts(a, c),
        f"SELECT place, count(*) AS total, count(*) FILTER (threat_level IN ('HIGH','CRITICAL')) AS high_threat, count(*) FILTER (army_monitoring_needed = 'YES') AS monitoring FROM (SELECT unnest({_column}) AS place, threat_level, army_monitoring_needed FROM articles) GROUP BY 1 ORDER BY total DESC, place LIMIT 20")
add("entity_counts", lambda a: aggregates.entity_counts(a, "organizations"), "SELECT entity, count(*) AS n FROM (SELECT unnest(organizations) AS entity FROM articles) WHERE entity <> '' GROUP BY 1 ORDER BY n DESC, entity LIMIT 20")
add("category_trend", aggregates.category_trend, "SELECT category, count(*) AS n FROM (SELECT unnest(CASE WHEN len(categories) = 0 THEN [article_type] ELSE categories END) AS category FROM articles) WHERE category IS NOT NULL GROUP BY 1 ORDER BY n DESC, category LIMIT 15")
add("daily_trend", aggregates.daily_trend, "SELECT substring(published_at, 1, 10) AS day, count(*) AS n FROM articles WHERE published_at IS NOT NULL GROUP BY 1")
add("map_fold", aggregates.map_fold,
    "SELECT state, count(*) AS n, count(*) FILTER (r >= 2) AS priority, CASE max(r) WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MODERATE' ELSE 'LOW' END AS max_level, CAST(CASE max(r) WHEN 3 THEN 92 WHEN 2 THEN 78 WHEN 1 THEN 50 ELSE 20 END AS INTEGER) AS risk, list_sort(list_distinct(list(source)))[1:6] AS sources FROM (SELECT unnest(list_distinct(states)) AS state, source, CASE threat_level WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 1 ELSE 0 END AS r FROM articles) GROUP BY 1")
LABELS = ["click", "error", "purchase", "signup", "view", "other"]
add("fixed_domain_counts", lambda a: aggregates.fixed_domain_counts(a, "article_type", LABELS),
    "SELECT CAST(d.i - 1 AS INTEGER) AS position, d.label, count(a.article_id) AS n FROM (SELECT unnest(['click','error','purchase','signup','view','other']) AS label, unnest([1,2,3,4,5,6]) AS i) d LEFT JOIN articles a ON a.article_type = d.label GROUP BY 1, 2")
add("category_buckets", lambda a: facets.bucketed(a, "article_type", ["article_id"]).select("category", "position", "article_id"), "SELECT coalesce(article_type, 'Unclassified') AS category, row_number() OVER (PARTITION BY coalesce(article_type, 'Unclassified') ORDER BY article_id) - 1 AS position, article_id FROM articles")
add("labels_and_unlabelled", lambda a: aggregates.with_unlabelled(a, "article_type", ["error", "never", "view"]), "SELECT CAST(d.i - 1 AS INTEGER) AS position, d.label, count(a.article_id) AS n FROM (SELECT unnest(['error','never','view']) AS label, unnest([1,2,3]) AS i) d LEFT JOIN articles a ON a.article_type = d.label GROUP BY 1, 2 UNION ALL SELECT 3, 'Unclassified', count(*) FILTER (article_type IS NULL OR article_type = '') FROM articles")
_GUESS = lambda a: a.where("quality IS NOT NULL").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("gold"), F.when(F.length("article_text") > 900, "good").otherwise("bad").alias("said"))
_GUESS_SQL = ", g AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS gold, CASE WHEN length(article_text) > 900 THEN 'good' ELSE 'bad' END AS said FROM articles WHERE quality IS NOT NULL) "
add("class_metrics", lambda a: aggregates.class_metrics(_GUESS(a), "gold", "said", ["bad", "good", "never"]),
    _GUESS_SQL + ", s AS (SELECT l.label, count(*) FILTER (gold = label AND said = label) AS tp, count(*) FILTER (said = label) AS said_n, count(*) FILTER (gold = label) AS support FROM (SELECT unnest(['bad','good','never']) AS label) l CROSS JOIN g GROUP BY 1), m AS (SELECT label, CASE WHEN said_n > 0 THEN tp / said_n ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r, support FROM s) SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1, support FROM m")
add("metric_totals", lambda a: aggregates.metric_totals(_GUESS(a), "gold", "said", ["bad", "good", "never"]),
    _GUESS_SQL + ", s AS (SELECT l.label, count(*) FILTER (gold = label AND said = label) AS tp, count(*) FILTER (said = label) AS said_n, count(*) FILTER (gold = label) AS support FROM (SELECT unnest(['bad','good','never']) AS label) l CROSS JOIN g GROUP BY 1), m AS (SELECT *, CASE WHEN said_n > 0 THEN tp / said_n ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM s), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM m) SELECT CAST(sum(support) AS BIGINT) AS sample_size, round(sum(tp) / sum(support), 4) AS accuracy, round(sum(p) / 3, 4) AS macro_precision, round(sum(r) / 3, 4) AS macro_recall, round(sum(f) / 3, 4) AS macro_f1, round(sum(f * support) / sum(support), 4) AS weighted_f1 FROM f")
add("evaluation", lambda a: aggregates.evaluation(_GUESS(a), "gold", "said"), _GUESS_SQL + "SELECT count(*) > 0 AS available, count(*) AS samples, count(*) FILTER (gold = said) AS correct, round_even(count(*) FILTER (gold = said) / count(*) * 100, 1) AS accuracy FROM g")
add("confusion", lambda a: aggregates.confusion(_GUESS(a), "gold", "said", ["bad", "good"]), _GUESS_SQL + "SELECT gold, count(*) FILTER (said = 'bad') AS bad, count(*) FILTER (said = 'good') AS good FROM g GROUP BY 1")
add("accuracy", lambda a: aggregates.accuracy(_GUESS(a), "gold", "said"), _GUESS_SQL + "SELECT round(avg(CASE WHEN gold = said THEN 1.0 ELSE 0.0 END) * 100, 1) AS accuracy FROM g")
add("source_totals", lambda a: aggregates.totals(a.select("source", F.lit(1).alias("n"), F.length("title").alias("chars")), "source", ["n", "chars"]), "SELECT source, CAST(sum(1) AS BIGINT) AS n, CAST(sum(length(title)) AS BIGINT) AS chars FROM articles GROUP BY ROLLUP (source)")
add("sample", lambda a: facets.sample(a, "article_id", 200).select("article_id"), "SELECT article_id FROM articles ORDER BY md5('42:' || article_id), article_id LIMIT 200")
add("last_ten_days", lambda a: aggregates.daily_trend(a).orderBy(F.desc("day")).limit(10), "SELECT substring(published_at, 1, 10) AS day, count(*) AS n FROM articles GROUP BY 1 ORDER BY day DESC LIMIT 10")
add("merged_places", lambda a: aggregates.place_counts(a, "states").select("place", "total").unionByName(aggregates.place_counts(a, "cities").select("place", "total")).orderBy(F.desc("total"), "place").limit(7),
    "SELECT place, total FROM ((SELECT place, count(*) AS total FROM (SELECT unnest(states) AS place FROM articles) GROUP BY 1 ORDER BY total DESC, place LIMIT 20) UNION ALL (SELECT place, count(*) AS total FROM (SELECT unnest(cities) AS place FROM articles) GROUP BY 1 ORDER BY total DESC, place LIMIT 20)) ORDER BY total DESC, place LIMIT 7")
