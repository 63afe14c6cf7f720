"""Text expressions: cleaning, sentences, summaries, tokens, identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SUMMARY = "Summary unavailable."


def blank_to_null(c: Column) -> Column:
    """Trimmed; the empty string as null."""
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"https?://\S+", ""), r"www\.\S+", "")


def squeeze(c: Column) -> Column:
    """Every run of white space (also no-break spaces) as one space, trimmed. A run
    that is one space stays as it is."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def clean_text(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    # What neither a tag nor an address is without; it is found far sooner.
    marked = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in ("<", "://", "www.")])
    return squeeze(F.when(marked, strip_urls(strip_tags(text))).otherwise(text))


def is_article(c: Column, least: int = 200) -> Column:
    return F.coalesce(F.length(F.trim(c)) >= least, F.lit(False))


def sentences(c: Column, most: int | None = None) -> Column:
    """The sentences of a text, or the first ``most`` of them."""
    parts = F.split(c, r"(?<=[.!?])\s+") if most is None else F.slice(F.split(c, r"(?<=[.!?])\s+", most + 1), 1, most)
    return F.filter(F.transform(parts, squeeze), lambda s: s != "")


def extractive_summary(c: Column, n: int = 3) -> Column:
    """The first sentences, or a notice."""
    return F.coalesce(F.nullif(F.array_join(F.slice(sentences(F.coalesce(c, F.lit(""))), 1, n), " "), F.lit("")), F.lit(NO_SUMMARY))


def concise_summary(c: Column, least: int = 30, most: int = 60, fallback: int = 250) -> Column:
    """Whole sentences until ``least`` words, none that would pass ``most``. As each
    sentence but a text's last has a word, the first ``least`` are enough."""
    words = lambda s: F.size(F.split(s, " "))
    start = F.struct(F.expr("array()").cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc: Column, s: Column) -> Column:
        stop = acc["done"] | (acc["n"] >= least) | ((acc["n"] > 0) & (acc["n"] + words(s) > most))
        return F.struct(
            F.when(stop, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(s))).alias("kept"),
            F.when(stop, acc["n"]).otherwise(acc["n"] + words(s)).alias("n"),
            stop.alias("done"),
        )

    kept = F.aggregate(sentences(F.coalesce(c, F.lit("")), least), start, step, lambda acc: F.array_join(acc["kept"], " "))
    undated = F.regexp_replace(kept, r"^[A-Z][A-Z ,.]{2,40}[:\-]\s+", "")
    # In a list, what is made of the sentences is made once; ``nullif`` names it twice.
    either = F.filter(F.array(undated, F.substring(F.coalesce(c, F.lit("")), 1, fallback)), lambda x: x != "")
    return F.coalesce(F.get(either, F.lit(0)), F.lit(""))


def article_id(c: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of a url."""
    return F.substring(F.sha2(c, 256), 1, 16)


def payload_checksum(c: Column) -> Column:
    """MD5 of a map as JSON with sorted keys: an identity of the payload."""
    return F.md5(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))))


def tokens(c: Column, stopwords: list[str], aliases: dict[str, str] | None = None) -> Column:
    """Distinct lower-case alphanumeric tokens of two characters or more."""
    found = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 2) & ~t.isin(stopwords))
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        found = F.transform(found, lambda t: F.coalesce(F.element_at(table, t), t))
    return F.array_distinct(found)


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c)


def escape_html(c: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, c)


def json_list(c: Column) -> Column:
    """A JSON list of strings; what is none becomes the empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.expr("array()").cast("array<string>"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def stamp_to_iso(c: Column) -> Column:
    """``yyyyMMddTHHmmssZ`` as ISO; other values stay."""
    parsed = F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss'Z'"), c)


def colour_of(c: Column) -> Column:
    return F.when(c.isNull(), "neutral").when(c < 60, "low").when(c < 80, "medium").otherwise("high")


def source_kind(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first label one of whose substrings the source has."""
    out, low = F.lit(default), F.lower(c)
    for label, parts in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(p) for p in parts]), label).otherwise(out)
    return out


def classifier_text(title: Column, body: Column) -> Column:
    """Title and body as one text; what is missing is left out."""
    return F.concat_ws(". ", F.nullif(title, F.lit("")), F.nullif(body, F.lit("")))


def embedding_text(title: Column, summary: Column, topics: Column) -> Column:
    """What a vector stands for: title, the start of the summary, the topics."""
    return F.substring(F.concat_ws(" ", title, F.substring(summary, 1, 500), F.array_join(topics, " ")), 1, 1000)


def summary_of(existing: Column, text: Column, more_than: int = 40) -> Column:
    """The summary that is there if it has more than so many characters, else a
    concise one."""
    return F.when(F.length(F.coalesce(existing, F.lit(""))) > more_than, existing).otherwise(concise_summary(text))


def summary_of_new(done: Column, existing: Column, text: Column) -> Column:
    """As ``summary_of``, but what an earlier run made stays."""
    return F.coalesce(F.nullif(done, F.lit("")), summary_of(existing, text))


def query_tokens(c: Column, stopwords: list[str], aliases: dict[str, str]) -> Column:
    """The terms of a query in order, each once: tokens of two characters or more
    that are no stop words, by the names in use. If there are none, the tokens
    of two characters or more; if there are none, the whole query."""
    low = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower)
    long = F.filter(low, lambda t: F.length(t) >= 2)
    table = F.create_map(*[F.lit(x) for a, b in aliases.items() for x in (a, b.lower())])
    terms = F.array_distinct(F.transform(F.filter(long, lambda t: ~t.isin(stopwords)), lambda t: F.coalesce(F.try_element_at(table, t), t)))
    whole = F.array(F.lower(F.trim(F.coalesce(c, F.lit("")))))
    return F.when(F.size(terms) > 0, terms).when(F.size(long) > 0, long).otherwise(whole)


def query_string(terms: Column, every: bool) -> Column:
    """Quoted terms joined by AND or OR; a term of several words is a phrase."""
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " AND " if every else " OR ")


_EDGES = r"^[\[\]'\"]+|[\[\]'\"]+$"


def parsed_list(c: Column) -> Column:
    """The strings of a JSON list, of lists in it (two deep), or of one bare value;
    without quotes and brackets at the edges, filled ones, each once."""
    clean = lambda x: F.trim(F.regexp_replace(F.trim(x), _EDGES, ""))
    none = F.expr("array()").cast("array<string>")

    def opened(x: Column) -> Column:
        listed = F.trim(x).startswith("[") & F.trim(x).endswith("]")
        return F.coalesce(F.when(listed, F.from_json(F.trim(x), "array<string>")), F.array(x))

    items = F.flatten(F.transform(opened(F.coalesce(c, F.lit(""))), opened))
    return F.coalesce(F.array_distinct(F.filter(F.transform(items, clean), lambda x: x != "")), none)


def dumped(c: Column, is_text: bool = False) -> Column:
    """A value as JSON; a string passes through unchanged."""
    return c if is_text else F.to_json(c)


def missing_fields(fields: dict[str, Column]) -> Column:
    """The names of the fields that are null or empty."""
    there = F.array_compact(F.array(*[F.when(F.coalesce(c.cast("string") != "", F.lit(False)), F.lit(n)) for n, c in fields.items()]))
    return F.array_except(F.array(*map(F.lit, fields)), there)
