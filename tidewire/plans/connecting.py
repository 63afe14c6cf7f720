"""Feeds, events, indicators and streams over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.text import escape_html
from tidewire.sources import web
from tidewire.streaming import ingest as streams
from tidewire.storage import new_path
from tidewire.tables import table

QUERIES, ORACLES = {}, {}


def _feeds(spark: SparkSession, root: str) -> DataFrame:
    """Feeds of the documents: up to three hundred neighbours of a source each."""
    d = table(spark, root, "documents").withColumn("feed", F.floor(F.col("doc_id") / 300))
    title = F.when(F.col("doc_id") % 7 == 0, "").otherwise(escape_html(F.concat(F.regexp_replace("source", "[0-9]", "<"), F.lit(" & "), F.col("doc_id").cast("string"))))
    link = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("http://feed/"), F.col("doc_id").cast("string")))
    # Some links stand after an empty tag; some dates are ISO, some are missing.
    linked = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<link/>"), link, F.lit(" "))).otherwise(F.concat(F.lit("<link>"), link, F.lit("</link>")))
    dated = F.when(F.col("doc_id") % 3 == 0, "<pubDate>Thu, 26 Nov 2026 15:06:00 GMT</pubDate>").when(F.col("doc_id") % 3 == 1, "<published>2025-02-03T04:05:06Z</published>").otherwise("")
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title>"), linked, F.lit("<description><![CDATA[<b>"), "source", F.lit("</b>  now]]></description>"), dated, F.lit("</item>"))
    rows = F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item"))))
    feeds = d.groupBy(F.concat_ws("-", "source", "feed").alias("tag")).agg(F.array_join(F.transform(rows, lambda r: r["item"]), "\n").alias("items"))
    return feeds.select("tag", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("value"))


def feed_entries(spark: SparkSession, root: str) -> DataFrame:
    """The first five entries of each feed that have a title or a link."""
    return web.feed_entries(_feeds(spark, root), 5, "2026-01-01").select("source_feed", "title", "link", "summary", "published", "id")


def feed_articles(spark: SparkSession, root: str) -> DataFrame:
    """Entries with both a title and a link."""
    return web.feed_entries(_feeds(spark, root), 20, "2026-01-01", strict=True).select("source_feed", "title", "link")


def event_rows(spark: SparkSession, root: str) -> DataFrame:
    """Search results of two topics that share urls, a hundred of each at most."""
    p = table(spark, root, "pages")
    line = F.concat("url", F.lit(',,20260909T120000Z,"t, '), F.col("page_id").cast("string"), F.lit('",i,d,English,X,surplus'))
    bodies = p.select("page_id", F.explode(F.array(F.struct(F.lit("first").alias("tag"), F.when(F.col("page_id") % 2 == 0, line).alias("value")), F.struct(F.lit("second").alias("tag"), line.alias("value")))).alias("b"))
    bodies = bodies.select(F.col("page_id").alias("position"), "b.*").where("value IS NOT NULL")
    return web.event_rows(bodies, ["first", "second"], 100).select("url", "seendate", "query_topic", "sourcecountry")


def cached_events(spark: SparkSession, root: str) -> DataFrame:
    """A cache file of events with other spellings of its columns."""
    p, path = table(spark, root, "pages"), new_path(spark, "cache")
    rows = p.select(F.when(F.col("page_id") % 7 == 0, F.lit("ftp://x")).otherwise(F.col("url")).alias("URL"), F.lit("20260909T120000Z").alias("Date"), F.concat(F.lit("t, "), F.col("page_id").cast("string")).alias("title"), F.lit("X").alias("source_country"))
    rows.coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    return web.cached_events(spark, path, "topic").select("url", "language", "query_topic").distinct()


def indicator_join(spark: SparkSession, root: str) -> DataFrame:
    """Order totals with the last line amount of the same order."""
    share = table(spark, root, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("value"))
    amount = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("value"))
    last = amount.groupBy("o_orderkey", "n").agg(F.max("value").alias("value"))
    return web.join_indicators(share, last, ["o_orderkey"], "n")


def context_buckets(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation")
    return n.select("n_nationkey", web.threat_context(F.upper(F.substring("n_name", 1, 2))).alias("context"))


def _events(spark: SparkSession, root: str) -> DataFrame:
    schema = table(spark, root, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{root}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(spark: SparkSession, counts: DataFrame, name: str) -> DataFrame:
    """Runs a stream of counts over what is there, and reads what it has closed: a
    window comes out once the watermark has passed its end, and its state goes.
    A batch overwrites what an attempt before left."""
    out, state = new_path(spark, name), new_path(spark, name + "-state")
    query = counts.writeStream.outputMode("append").option("checkpointLocation", state).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)


def stream_windows(spark: SparkSession, root: str) -> DataFrame:
    """Events by hour and kind, counted from a stream: the hours that are over."""
    counts = _drain(spark, streams.window_counts(_events(spark, root), "ts", ["event_type"], "1 hour", "10 minutes"), "windows")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


def stream_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of each user, ended by a pause of half an hour: those that are over."""
    counts = _drain(spark, streams.session_counts(_events(spark, root), "ts", ["user_id"], "30 minutes", "10 minutes"), "sessions")
    return counts.select(F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "user_id", "n")


QUERIES |= {f.__name__: f for f in (feed_entries, feed_articles, cached_events, event_rows, indicator_join, context_buckets, stream_windows, stream_sessions)}
_ITEMS = "WITH i AS (SELECT doc_id, source, concat_ws('-', source, doc_id // 300) AS source_feed, CASE WHEN doc_id % 7 = 0 THEN '' ELSE regexp_replace(source, '[0-9]', '<', 'g') || ' & ' || doc_id END AS title, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'http://feed/' || doc_id END AS link, CASE doc_id % 3 WHEN 0 THEN '2026-11-26T15:06:00+00:00' WHEN 1 THEN '2025-02-03T04:05:06+00:00' ELSE '2026-01-01' END AS published, row_number() OVER (PARTITION BY source, doc_id // 300 ORDER BY doc_id) AS n FROM documents)"
ORACLES["feed_entries"] = _ITEMS + " SELECT source_feed, title, link, source || ' now' AS summary, published, CASE WHEN link <> '' THEN link ELSE md5(title || published) END AS id FROM i WHERE n <= 5 AND (title <> '' OR link <> '')"
ORACLES["feed_articles"] = _ITEMS + " SELECT source_feed, title, link FROM i WHERE n <= 20 AND title <> '' AND link <> ''"
ORACLES["cached_events"] = "SELECT DISTINCT trim(url, ' ') AS url, 'English' AS language, 'topic' AS query_topic FROM pages WHERE page_id % 7 <> 0 AND starts_with(url, 'http')"
ORACLES["event_rows"] = "WITH a AS (SELECT url, 1 AS k, page_id FROM (SELECT * FROM pages WHERE page_id % 2 = 0 AND url <> '' ORDER BY page_id LIMIT 100) UNION ALL SELECT url, 2, page_id FROM (SELECT * FROM pages WHERE url <> '' ORDER BY page_id LIMIT 100)) SELECT url, '2026-09-09T12:00:00Z' AS seendate, CASE min(k) WHEN 1 THEN 'first' ELSE 'second' END AS query_topic, 'X' AS sourcecountry FROM a GROUP BY url"
ORACLES["indicator_join"] = "WITH a AS (SELECT l_orderkey, l_linenumber AS n, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, arg_max(v, n) AS v FROM a GROUP BY 1) SELECT o_orderkey, round_even(o_totalprice, 4) AS value, round_even(nullif(v, 0), 2) AS amount FROM orders LEFT JOIN b ON o_orderkey = l_orderkey WHERE o_orderkey % 5 <> 0 AND o_totalprice IS NOT NULL"
ORACLES["context_buckets"] = "SELECT n_nationkey, CASE WHEN upper(n_name[1:2]) IN ('CN', 'PK') THEN 'HIGH' WHEN upper(n_name[1:2]) IN ('AF', 'MM') THEN 'MODERATE' WHEN upper(n_name[1:2]) IN ('NP', 'BD', 'LK') THEN 'MONITOR' WHEN upper(n_name[1:2]) = 'IN' THEN 'SELF' ELSE 'REFERENCE' END AS context FROM nation"
_MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"
ORACLES["stream_windows"] = f"SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS h, event_type FROM events WHERE ts IS NOT NULL) WHERE h + INTERVAL 1 HOUR <= {_MARK} GROUP BY h, event_type"
ORACLES["stream_sessions"] = f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_MARK}"
