"""Paged web sources as Python data sources, and the shaping of what they read.

The readers yield one JSON text a record; ``payload_of`` and the functions
below give it columns, so all shaping stays in the plan.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewire.functions.text import first_filled, squeeze, stamp_to_iso, strip_tags
from tidewire.operators.merge import first_rows
from tidewire.storage import importable, stored

# Attempts and waits of a retry, codes that no retry mends, limits.
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 5, 2.0, 60.0
FATAL_CODES = {400, 401, 403, 404, 410}
EVENT_ROWS, INDICATOR_PAGE = 250, 500
# Failures in a row after which a service counts as down, and the wait
# between two topics in seconds.
FAILURES, EVENT_WAIT = 2, 1.0
#: A record of a CSV text, whose quoted values may hold line breaks and commas; a
#: lone quote is a character.
CSV_RECORD, CSV_QUOTED = r'(?:[^"\r\n]++|"(?:[^"]++|"")*+"|")++', r'"(?:[^"]++|"")*+"'
EVENT_COLUMNS = ["url", "url_mobile", "seendate", "title", "socialimage", "domain", "language", "sourcecountry"]
THREAT_CONTEXT = {"HIGH": ["CN", "PK"], "MODERATE": ["AF", "MM"], "MONITOR": ["NP", "BD", "LK"], "SELF": ["IN"]}


class Transient(Exception):
    """May pass if tried again."""


class Structural(Exception):
    """The answer has not the expected form."""


class Fatal(Exception):
    """Not worth another attempt."""


def with_retry(call: Callable[[], str], first_wait: float = FIRST_WAIT, attempts: int = ATTEMPTS) -> str:
    """Calls again after ``Transient``, waiting twice as long each time; after
    the last attempt the error is ``Fatal``."""
    for n in range(attempts):
        try:
            return call()
        except Transient as e:
            if n + 1 == attempts:
                raise Fatal(f"{attempts} attempts failed: {e}") from e
            time.sleep(min(LONGEST_WAIT, first_wait * 2**n))
    raise Fatal("no attempt was made")


def fetch(url: str, headers: dict[str, str], timeout: float) -> str:
    """The body of one GET."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.read().decode("utf-8-sig", "replace")
    except urllib.error.HTTPError as e:
        kind = Transient if e.code == 429 or e.code >= 500 else Fatal
        raise kind(f"status {e.code} of {url}") from e
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise Transient(f"{url}: {e}") from e


def with_params(url: str, params: dict) -> str:
    return url + (("&" if "?" in url else "?") + urllib.parse.urlencode(params) if params else "")


class _Part(InputPartition):
    def __init__(self, url: str, tag: str = ""):
        super().__init__(url)
        self.url, self.tag = url, tag


class _Reader(DataSourceReader):
    """Options: ``headers`` and ``params`` (JSON), ``timeout``, ``first_wait``, ``attempts``."""

    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.headers = json.loads(self.options.get("headers", "{}"))
        self.params = json.loads(self.options.get("params", "{}"))

    def get(self, url: str) -> str:
        wait, timeout = float(self.options.get("first_wait", FIRST_WAIT)), float(self.options.get("timeout", 30))
        return with_retry(lambda: fetch(url, self.headers, timeout), wait, int(self.options.get("attempts", ATTEMPTS)))

    def parsed(self, url: str):
        try:
            return json.loads(self.get(url))
        except ValueError as e:
            raise Structural(f"{url} is not JSON: {e}") from e


class RestReader(_Reader):
    """Follows the links from page to page: one partition a start url."""

    def partitions(self):
        return [_Part(with_params(u, self.params)) for u in self.options["url"].split()]

    def read(self, partition) -> Iterator[tuple]:
        url, key, link = partition.url, self.options.get("data_key"), self.options.get("next_page_key")
        seen = set()
        while url and url not in seen:
            seen.add(url)
            page = self.parsed(url)
            if key and not (isinstance(page, dict) and key in page):
                raise Structural(f"{url} has no {key}")
            rows = page[key] if key else page
            if not isinstance(rows, list):
                raise Structural(f"{url} holds no list")
            for row in rows:
                yield partition.url, json.dumps(row), None
            url = page.get(link) if link and isinstance(page, dict) else None


class IndicatorReader(_Reader):
    """Pages of ``[header, rows]``; the header tells their number, so that each
    page is a partition of its own."""

    def _page(self, n: int) -> str:
        return with_params(self.options["url"], {"format": "json", "per_page": INDICATOR_PAGE, **self.params, "page": n})

    def _split(self, url: str):
        page = self.parsed(url)
        if not isinstance(page, list) or len(page) < 2:
            raise Structural(f"{url} is no pair of header and rows")
        return page[0], page[1] if isinstance(page[1], list) else []

    def partitions(self):
        header, _ = self._split(self._page(1))
        return [_Part(self._page(n), str(n)) for n in range(1, int(header.get("pages", 1)) + 1)]

    def read(self, partition) -> Iterator[tuple]:
        for row in self._split(partition.url)[1]:
            yield partition.tag, json.dumps(row), None


class BodyReader(_Reader):
    """Whole bodies, one partition a url; a failure is a row with an error, so
    that one source that is down does not stop the others. ``urls`` is a JSON
    object of tags and urls."""

    def partitions(self):
        return [_Part(with_params(u, self.params), tag) for tag, u in json.loads(self.options["urls"]).items()]

    def read(self, partition) -> Iterator[tuple]:
        try:
            yield partition.tag, self.get(partition.url), None
        except (Fatal, Structural) as e:
            yield partition.tag, None, str(e)


class TopicReader(BodyReader):
    """Bodies of several topics of one service, asked in order, with a wait between
    them, in one partition: a service that does not answer is not asked on. After
    ``FAILURES`` topics in a row that failed, with no row read before, the others
    are left out. An error that no retry mends (a refused key, a wrong address)
    ends the scan."""

    def partitions(self):
        return [_Part(self.options["urls"])]

    def read(self, partition) -> Iterator[tuple]:
        failures, rows, asked = 0, 0, json.loads(partition.url)
        wait = float(self.options.get("between", EVENT_WAIT))
        for n, (tag, url) in enumerate(asked.items()):
            if n:
                time.sleep(wait)
            try:
                body = self.get(with_params(url, self.params))
                failures = 0
                rows += max(len(body.strip().splitlines()) - 1, 0)
                yield tag, body, None
            except Fatal as e:
                if not isinstance(e.__cause__, Transient):
                    raise
                failures += 1
                yield tag, None, str(e)
            except Structural as e:
                failures += 1
                yield tag, None, str(e)
            if failures >= FAILURES and not rows:
                for left in list(asked)[n + 1 :]:
                    yield left, None, f"not asked: {failures} topics in a row failed"
                return


class _Source(DataSource):
    reads: type = RestReader

    def schema(self) -> str:
        return "tag string, value string, error string"

    def reader(self, schema):
        return self.reads(dict(self.options))


class RestSource(_Source):
    @classmethod
    def name(cls) -> str:
        return "tidewire_rest"


class IndicatorSource(_Source):
    reads = IndicatorReader

    @classmethod
    def name(cls) -> str:
        return "tidewire_indicator"


class BodySource(_Source):
    reads = BodyReader

    @classmethod
    def name(cls) -> str:
        return "tidewire_bodies"


class TopicSource(_Source):
    reads = TopicReader

    @classmethod
    def name(cls) -> str:
        return "tidewire_topics"


def scan(spark: SparkSession, source: type[DataSource], **options) -> DataFrame:
    """``tag, value, error`` of a web source; dicts among the options go as JSON."""
    importable(spark)
    spark.dataSource.register(source)
    given = {k: json.dumps(v) if isinstance(v, dict) else str(v) for k, v in options.items() if v is not None}
    return spark.read.format(source.name()).options(**given).load()


def payload_of(rows: DataFrame) -> DataFrame:
    """The JSON records as maps of text."""
    return rows.select(F.from_json("value", "map<string,string>").alias("payload"), "error")


def bodies(spark: SparkSession, urls: dict[str, str], **options) -> DataFrame:
    """Bodies by tag; ``Fatal`` if none could be read. They are written once, so
    that nothing is fetched twice."""
    rows = scan(spark, BodySource, urls=urls, **options)
    rows = stored(rows, "bodies")
    if rows.where("error IS NULL").isEmpty():
        raise Fatal("no source could be read")
    return rows


# Feeds


def _item(item: Column, tag: str) -> Column:
    """The text of a tag inside an item, without CDATA marks and entities."""
    raw = F.regexp_extract(item, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    text = F.regexp_replace(raw, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def feed_entries(rows: DataFrame, most: int, now: str, strict: bool = False) -> DataFrame:
    """The first ``most`` entries of each feed (``tag, value``), RSS or Atom.

    Items are found by their tags, so that a feed that is no well-formed XML
    still gives those it holds. An entry with neither title nor link is left
    out, with ``strict`` one that lacks either; the link may follow its tag as bare text; the id is the link, else the
    MD5 of title and date; an entry without a date has ``now``.
    """
    items = F.slice(F.regexp_extract_all("value", F.lit(r"(?s)<(item|entry)(?:\s[^>]*)?>(.*?)</(?:item|entry)\s*>"), F.lit(2)), 1, most)
    each = rows.where("value IS NOT NULL").select("tag", F.posexplode(items).alias("position", "item"))
    i = F.col("item")
    link = first_filled(_item(i, "link"), F.regexp_extract(i, r"<link\b[^>]*\bhref=[\"']([^\"']*)", 1), F.trim(F.regexp_extract(i, r"<link\s*/?>\s*([^<\s]+)", 1)))
    dated = first_filled(_item(i, "pubDate"), _item(i, "published"), _item(i, "updated"))
    stamp = F.coalesce(F.try_to_timestamp(F.regexp_replace(dated, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss [Z][z]")), F.try_to_timestamp(dated))
    shaped = each.select(
        "tag",
        "position",
        F.coalesce(_item(i, "title"), F.lit("")).alias("title"),
        F.coalesce(link, F.lit("")).alias("link"),
        squeeze(strip_tags(F.substring(F.coalesce(first_filled(_item(i, "description"), _item(i, "summary")), F.lit("")), 1, 500))).alias("summary"),
        first_filled(_item(i, "author"), _item(i, "dc:creator")).alias("author"),
        F.coalesce(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), dated, F.lit(now)).alias("published"),
        F.filter(F.transform(F.regexp_extract_all("item", F.lit(r"(?s)<category(?:\s[^>]*)?>(.*?)</category>"), F.lit(1)), F.trim), lambda t: t != "").alias("tags"),
    ).where("title <> '' AND link <> ''" if strict else "title <> '' OR link <> ''")
    return shaped.withColumn("id", F.when(F.col("link") != "", F.col("link")).otherwise(F.md5(F.concat("title", "published")))).withColumnRenamed("tag", "source_feed")


# Events


def event_rows(rows: DataFrame, topics: list[str], most: int = EVENT_ROWS) -> DataFrame:
    """Rows of CSV bodies tagged by topic, each url once with the first topic; of
    a topic the first ``most`` rows, by a column ``position`` of its bodies if
    there is one, and then by line.

    Rows of fewer than four values are left out, surplus values cut, missing
    ones empty. Quoted values may hold commas and line breaks.
    """
    order = F.array_position(F.array(*map(F.lit, topics)), F.col("tag"))
    place = F.col("position") if "position" in rows.columns else F.lit(0)
    lines = rows.where("value IS NOT NULL").select(F.col("tag").alias("query_topic"), order.alias("_topic"), place.alias("_body"), F.posexplode(F.regexp_extract_all("value", F.lit(CSV_RECORD), F.lit(0))).alias("_line", "line"))
    schema = ", ".join(f"{c} string" for c in EVENT_COLUMNS)
    wide = lines.where("trim(line) <> ''").select("query_topic", "_topic", "_body", "_line", F.size(F.split(F.regexp_replace("line", CSV_QUOTED, ""), ",")).alias("_n"), F.from_csv("line", schema, {"escape": '"', "multiLine": "true"}).alias("r"))
    rows = wide.where("_n >= 4 AND lower(trim(r.url)) <> 'url' AND r.url <> ''").select("query_topic", "_topic", "_body", "_line", *[F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in EVENT_COLUMNS])
    top = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_topic").orderBy("_body", "_line"))).where(F.col("_n") <= most)
    once = first_rows(top.withColumn("_position", F.struct("_topic", "_body", "_line")), ["url"], "_position")
    return once.withColumn("seendate", stamp_to_iso(F.col("seendate"))).select(*EVENT_COLUMNS, "query_topic")


def cached_events(spark: SparkSession, path: str, default_topic: str = "") -> DataFrame:
    """Events of a cache file; other spellings of its columns are accepted."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    have = {c.strip().lstrip("﻿").lower().replace("_", ""): c for c in raw.columns}
    aliases = {"url_mobile": "mobileurl", "seendate": "date", "socialimage": "image"}

    def pick(name: str, default: str) -> Column:
        found = [F.trim(f"`{have[k]}`") for k in (name.replace("_", ""), aliases.get(name)) if k in have]
        return F.coalesce(first_filled(*found), F.lit(default)) if found else F.lit(default)

    defaults = {"language": "English", "query_topic": default_topic}
    rows = raw.select(*[pick(c, defaults.get(c, "")).alias(c) for c in [*EVENT_COLUMNS, "query_topic"]], F.monotonically_increasing_id().alias("_position"))
    return first_rows(rows.where(F.col("url").startswith("http")), ["url"], "_position").select(*EVENT_COLUMNS, "query_topic")


def search_events(spark: SparkSession, url: str, topics: list[str], language: str = "english", cache: str | None = None, **options) -> DataFrame:
    """Events of all topics, asked in order; those of the cache if no topic gives any
    (see ``TopicReader`` for when a service counts as down); ``Fatal`` if there is
    no cache or nothing in it."""
    asked = {t: with_params(url, {"query": f'"{t}" sourcelang:{language}', "mode": "ArtList", "maxrecords": EVENT_ROWS, "format": "CSV"}) for t in topics}
    found = event_rows(stored(scan(spark, TopicSource, urls=asked, **options), "bodies"), topics)
    if not found.isEmpty():
        if cache:
            found.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(cache)
        return found
    kept = cached_events(spark, cache) if cache and _there(spark, cache) else None
    if kept is None or kept.isEmpty():
        raise Fatal("no topic gave an event, and there is none in the cache")
    return kept


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


# Indicators


def threat_context(code: Column) -> Column:
    out = F.lit("REFERENCE")
    for label, codes in THREAT_CONTEXT.items():
        out = F.when(code.isin(codes), label).otherwise(out)
    return out


def join_indicators(share: DataFrame, amount: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Rows of ``share (keys, value)`` that have a value, with the last
    ``amount`` of the same keys; an amount of zero counts as missing."""
    last = amount.groupBy(*keys).agg(F.max_by("value", position).alias("amount"))
    found = share.where("value IS NOT NULL").join(last, keys, "left")
    return found.withColumn("value", F.bround(F.col("value").cast("double"), 4)).withColumn("amount", F.bround(F.nullif(F.col("amount").cast("double"), F.lit(0.0)), 2))
