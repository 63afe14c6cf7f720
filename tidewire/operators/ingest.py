"""Canonical records: validation, dead letters, bridge to articles, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import article_id, classifier_text, clean_text, first_filled, is_article, json_list, payload_checksum

# Kinds of sources and of errors.
SOURCE_TYPES = ["CSV", "JSON", "REST", "SQL"]
TRANSIENT, STRUCTURAL, VALIDATION, FATAL = "transient", "structural", "validation", "fatal"


def entity_id(payload: str, declared: str | None, aliases: list[str]) -> Column:
    """The declared field, else the first alias that has a value, else the first value."""
    fields = [F.col(payload)[k] for k in ([declared] if declared else []) + aliases]
    return first_filled(*fields, F.try_element_at(F.map_values(payload), F.lit(1)))


def to_records(rows: DataFrame, source_type: str, source_name: str, kind: str, declared: str | None, aliases: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a map column ``payload`` as canonical records, with the columns in
    ``keep``.

    The record id is a function of the content, so a repeated run gives the
    same ids.
    """
    out = rows.select(*keep, F.lit(source_type).alias("source_type"), F.trim(F.lit(source_name)).alias("source_name"), F.trim(F.lit(kind)).alias("entity_type"), F.trim(entity_id("payload", declared, aliases)).alias("entity_id"), "payload")
    out = out.withColumn("checksum", payload_checksum(F.col("payload")))
    return out.withColumn("record_id", F.md5(F.concat_ws("|", "source_type", "source_name", "entity_id", "checksum")))


def errors_of(records: DataFrame) -> Column:
    """The names of the rules a record breaks."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    rules = [F.when(blank(c), F.lit(f"{c} is missing")) for c in ("source_name", "entity_type", "entity_id")]
    rules.append(F.when(~F.coalesce(F.col("source_type").isin(SOURCE_TYPES), F.lit(False)), F.lit("source_type is unknown")))
    rules.append(F.when(F.coalesce(F.size("payload") < 1, F.lit(True)), F.lit("payload is empty")))
    return F.array_compact(F.array(*rules))


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and dead letters with the reasons."""
    marked = records.withColumn("errors", errors_of(records))
    valid = marked.where(F.size("errors") == 0).drop("errors")
    dead = marked.where(F.size("errors") > 0)
    return valid, dead.select("source_type", "source_name", F.to_json("payload").alias("raw_record"), F.lit(VALIDATION).alias("error_type"), F.array_join("errors", "; ").alias("error_message"), F.lit(1).alias("attempts"))


# Kinds of records by type of source and of entity, and the words
# that articles made of records have.
BRIDGE = [("JSON", "defence_news"), ("CSV", "geopolitical_event"), ("REST", "military_expenditure"), ("SQL", "strategic_reference")]
HINTS = {"JSON": "Defence", "CSV": "Geopolitics", "REST": "Defence Economics", "SQL": "Strategic Affairs"}
INDICATOR_URL = "https://data.worldbank.org/indicator/MS.MIL.XPND.GD.ZS?locations="
INDICATOR, SUMMARY_CHARS = "Military expenditure (% of GDP)", 400


def payload_map(c: Column, kind: str) -> Column:
    """A payload as a map of texts; one that is JSON text is parsed."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.expr("map()").cast("map<string,string>")) if kind == "string" else c


def to_articles(records: DataFrame, source_hint: str = "") -> DataFrame:
    """Records as articles, by the first kind that their source or entity type
    names; records of no kind go, and feed and event records without a link.

    Feed and event articles have a link whose text is still to be fetched;
    indicator and reference records have a text made of their fields.
    """
    kind = F.lit(None).cast("string")
    for source, entity in reversed(BRIDGE):
        kind = F.when((F.upper("source_type") == source) | (F.col("entity_type") == entity), source).otherwise(kind)
    fetched = F.col("ingested_at").cast("string") if "ingested_at" in records.columns else F.lit("")
    r = records.withColumns({"_kind": kind, "_p": payload_map(F.col("payload"), records.schema["payload"].dataType.simpleString())})
    p = lambda *keys: first_filled(*[F.try_element_at("_p", F.lit(k)) for k in keys])
    get = lambda key, default: F.coalesce(F.try_element_at("_p", F.lit(key)), default if isinstance(default, Column) else F.lit(default))
    by = lambda **cases: F.coalesce(*[F.when(F.col("_kind") == k, c) for k, c in cases.items()])
    url = F.coalesce(by(JSON=p("link", "url"), CSV=p("url", "URL"), REST=F.concat(F.lit(INDICATOR_URL), get("country_code", ""))), F.lit(""))
    event = F.coalesce(p("title", "Title"), get("domain", "GDELT Event"))
    country, year, share = get("country_name", get("country_code", "Unknown")), get("year", ""), get("military_pct_gdp", "N/A")
    amount = F.try_element_at("_p", F.lit("military_usd_current")).try_cast("double")
    dollars = F.when(F.coalesce(amount, F.lit(0.0)) != 0, F.concat(F.lit(" | $"), F.format_string("%,.0f", amount), F.lit("M current USD"))).otherwise("")
    measured = F.concat(
        F.lit("Military Expenditure Intelligence Report\n\nCountry: "), country, F.lit("\nYear: "), year, F.lit("\nMilitary Expenditure (% of GDP): "), share, F.lit("%"), dollars,
        F.lit("\nThreat Context (Indian Army): "), get("threat_context", "N/A"), F.lit("\nData Source: "), get("data_source", "World Bank"), F.lit("\nIndicator: "), get("indicator_name", INDICATOR),
    )
    name = F.coalesce(p("name", "country_name"), get("id", "Unknown"))
    fields = F.filter(F.map_entries("_p"), lambda e: e["value"].isNotNull() & (e["key"] != "id"))
    listed = F.array_join(F.transform(fields, lambda e: F.concat(F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), e["value"])), "\n")
    reference = F.concat(F.lit("Strategic Intelligence Reference: "), name, F.lit("\n\n"), listed)
    region = p("region")
    entity = F.nullif("entity_id", F.lit(""))
    body = by(REST=measured, SQL=reference)
    identity = by(JSON=url, CSV=url, REST=F.coalesce(entity, F.concat_ws("-", F.lit("worldbank"), country, year)), SQL=F.coalesce(entity, name))
    linked = F.col("_kind").isin("JSON", "CSV")
    out = r.where("_kind IS NOT NULL").select(
        article_id(identity).alias("article_id"),
        by(JSON=get("title", ""), CSV=event, REST=F.concat(F.lit("Military Expenditure: "), country, F.lit(" ("), year, F.lit(") — "), share, F.lit("% of GDP")), SQL=F.concat(F.lit("Strategic Intel Reference: "), name, F.coalesce(F.concat(F.lit(" ("), region, F.lit(")")), F.lit("")))).alias("title"),
        url.alias("url"),
        by(JSON=F.coalesce(p("source_feed"), F.lit(source_hint or "p2_rss")), CSV=F.coalesce(p("domain"), F.lit("gdelt")), REST=F.lit("World Bank / SIPRI"), SQL=F.lit("Strategic Intelligence DB")).alias("source"),
        by(**{k: F.lit(v) for k, v in HINTS.items()}).alias("source_category_hint"),
        by(JSON=F.try_element_at("_p", F.lit("published")), CSV=p("seendate", "published"), REST=F.concat(year, F.lit("-01-01"))).alias("published_at"),
        by(JSON=get("summary", ""), CSV=F.concat(F.lit("[GDELT] "), event, F.lit(". Source country: "), get("sourcecountry", "Unknown")), REST=F.substring(measured, 1, SUMMARY_CHARS), SQL=F.substring(reference, 1, SUMMARY_CHARS)).alias("summary"),
        fetched.alias("fetched_at"),
        body.alias("full_text"),
        linked.alias("needs_extraction"),
        F.when(F.col("_kind") == "SQL", F.coalesce(p("threat_level", "threat_context"), F.lit(""))).alias("threat_level"),
        F.when(F.col("_kind") == "CSV", json_list(F.try_element_at("_p", F.lit("matched_topics")))).alias("matched_topics"),
    )
    return out.where(~F.col("needs_extraction") | (F.col("url") != ""))


def clean_articles(df: DataFrame, title: str, text: str) -> DataFrame:
    """Articles with clean title and text that are long enough, with the text for
    classifiers and its length."""
    clean = df.withColumns({title: clean_text(F.col(title)), text: clean_text(F.col(text))})
    return clean.where(is_article(F.col(text))).withColumns({"classifier_text": classifier_text(F.col(title), F.col(text)), "text_length": F.length(text)})


def sanitised(fields: dict[str, tuple[Column, str]]) -> Column:
    """Values as a payload map: times as ISO text, bytes as lower-case hexadecimal
    digits, other values as text; nulls are left out. ``fields``: column, type."""
    def text(c: Column, kind: str) -> Column:
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return F.lower(F.hex(c)) if kind == "binary" else c.cast("string")

    pairs = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[text(c, k) for c, k in fields.values()]))
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def report(valid: DataFrame, dead: DataFrame, inserted: DataFrame) -> DataFrame:
    """Extracted, validated, failed, inserted and skipped records of each source,
    and a total row (null source); the status is ``failed`` if nothing was valid."""
    tag = lambda df, name: df.select("source_name", *[(F.lit(1) if n == name else F.lit(0)).alias(n) for n in ("validated", "failed", "inserted")])
    rows = tag(valid, "validated").unionByName(tag(dead, "failed")).unionByName(tag(inserted, "inserted"))
    sums = rows.rollup("source_name").agg(*[F.sum(c).alias(c) for c in ("validated", "failed", "inserted")])
    return sums.withColumn("extracted", F.col("validated") + F.col("failed")).withColumns({"skipped": F.col("validated") - F.col("inserted"), "status": F.when((F.col("validated") == 0) & (F.col("failed") > 0), "failed").otherwise("completed")})
