"""Text, array, JSON and identity expressions over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text as X
from tidewire.functions import vocabulary as V
from tidewire.tables import table

QUERIES, ORACLES = {}, {}


def add(name, source, run, sql=None):
    QUERIES[name] = lambda spark, root: run(table(spark, root, source))
    if sql:
        ORACLES[name] = sql


#: White space as ``squeeze`` sees it, and the sentences of a text in SQL.
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def sentences_sql(c: str) -> str:
    marked = rf"regexp_replace({c}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return f"list_filter([trim(regexp_replace(x, '{_SPACE}', ' ', 'g'), ' ') for x in string_split({marked}, chr(1))], lambda x: x <> '')"


def extractive_sql(c: str) -> str:
    whole = f"coalesce({c}, '')"
    return f"coalesce(nullif(array_to_string(({sentences_sql(whole)})[1:3], ' '), ''), 'Summary unavailable.')"


_WHOLE = sentences_sql("coalesce(text, '')")
_CONCISE = rf"""WITH s AS (SELECT doc_id, text, ({_WHOLE})[1:40] AS s FROM documents),
w AS (SELECT *, [len(string_split(x, ' ')) for x in s] AS w FROM s),
k AS (SELECT *, coalesce(list_position([CASE WHEN i = 1 THEN FALSE ELSE list_sum(w[1:i-1]) >= 30 OR list_sum(w[1:i]) > 60 END for i in range(1, len(w) + 1)], TRUE), len(w) + 1) AS stop FROM w)
SELECT doc_id, coalesce(nullif(regexp_replace(array_to_string(s[1:stop-1], ' '), '^[A-Z][A-Z ,.]{{2,40}}[:\-]\s+', ''), ''), substring(coalesce(text, ''), 1, 250)) AS summary FROM k"""
LISTS = ['["a", "b"]', "a b", "", r'["x", "[\"y\", \"z\", \"x\"]"]', "[half open", "['p']", '["a", 5]']
_LOW = "[lower(x) for x in regexp_extract_all(text, '[a-zA-Z0-9]+')]"
_STOPPED = "(" + ", ".join(f"'{w}'" for w in V.STOPWORDS) + ")"
_NAMES = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b.lower()}'" for a, b in V.ALIASES.items()) + " ELSE x END"
_TOKENS_SQL = f"""WITH t AS (SELECT conv_id, turn, text, {_LOW} AS k FROM conversations),
m AS (SELECT *, [{_NAMES} for x in k if length(x) >= 2 AND x NOT IN {_STOPPED}] AS m, [x for x in k if length(x) >= 2] AS f FROM t),
u AS (SELECT *, CASE WHEN len(m) > 0 THEN list_filter(m, lambda x, i: list_position(m, x) = i) WHEN len(f) > 0 THEN f ELSE [lower(trim(text, ' '))] END AS tokens FROM m)
SELECT conv_id, turn, tokens, array_to_string(['"' || x || '"' for x in tokens], ' AND ') AS q FROM u"""
STOP = ["the", "of", "and", "to", "in"]
add("strip_tags", "pages", lambda d: d.select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("h")), "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS h FROM pages")
add("strip_urls", "pages", lambda d: d.select("page_id", X.strip_urls(F.concat(F.lit("see "), "url", F.lit(" now www.a.b c"))).alias("t")), r"SELECT page_id, regexp_replace(regexp_replace('see ' || url || ' now www.a.b c', 'https?://\S+', '', 'g'), 'www\.\S+', '', 'g') AS t FROM pages")
add("squeeze", "documents", lambda d: d.select("doc_id", F.md5(X.squeeze(F.col("text"))).alias("h")), r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ')) AS h FROM documents")
add("clean_page", "pages", lambda d: d.select("page_id", F.md5(X.clean_text(F.col("html"))).alias("h"), F.length(X.clean_text(F.col("html"))).alias("n")),
    r"WITH c AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), 'https?://\S+', '', 'g'), 'www\.\S+', '', 'g'), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS t FROM pages) SELECT page_id, md5(t) AS h, CAST(length(t) AS INTEGER) AS n FROM c")
add("valid_articles", "documents", lambda d: d.where(X.is_article(F.col("text"))).select("doc_id"), "SELECT doc_id FROM documents WHERE length(trim(text, ' ')) >= 200")
add("blank_to_null", "conversations", lambda d: d.select("conv_id", "turn", X.blank_to_null(F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("role"))).alias("t")), "SELECT conv_id, turn, nullif(trim(CASE WHEN turn % 3 = 0 THEN '  ' ELSE role END, ' '), '') AS t FROM conversations")
add("sentences", "documents", lambda d: d.select("doc_id", F.size(X.sentences(F.col("text"))).alias("n")), f"SELECT doc_id, CAST(len({sentences_sql('text')}) AS INTEGER) AS n FROM documents")
add("extractive_summary", "documents", lambda d: d.select("doc_id", X.extractive_summary(F.col("text")).alias("summary")), f"SELECT doc_id, {extractive_sql('text')} AS summary FROM documents")
add("concise_summary", "documents", lambda d: d.select("doc_id", X.concise_summary(F.col("text")).alias("summary")), _CONCISE)
add("article_id", "pages", lambda d: d.select("page_id", X.article_id(F.col("url")).alias("article_id")), "SELECT page_id, substring(sha256(url), 1, 16) AS article_id FROM pages")
add("tokens", "documents", lambda d: d.select("doc_id", X.tokens(F.col("text"), STOP, {"that": "which"}).alias("tokens")),
    "SELECT doc_id, (WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS i), k AS (SELECT CASE WHEN w = 'that' THEN 'which' ELSE w END AS w, min(i) AS i FROM t WHERE length(w) >= 2 AND w NOT IN ('the','of','and','to','in') GROUP BY 1) SELECT coalesce(list(w ORDER BY i), []) FROM k) AS tokens FROM documents")
add("json_list", "events", lambda d: d.select("event_id", F.size(X.json_list(F.concat(F.lit('["a","'), "event_type", F.lit('"]')))).alias("n"), F.size(X.json_list(F.col("props"))).alias("none")), "SELECT event_id, CAST(2 AS INTEGER) AS n, CAST(0 AS INTEGER) AS none FROM events")
add("json_field", "events", lambda d: d.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
add("payload_checksum", "events", lambda d: d.select("event_id", X.payload_checksum(F.create_map(F.lit("type"), "event_type", F.lit("id"), F.col("event_id").cast("string"))).alias("checksum")), """SELECT event_id, md5('{"id":"' || event_id || '","type":"' || event_type || '"}') AS checksum FROM events""")
add("percent", "events", lambda d: d.select("event_id", X.percent(F.col("event_id") / F.lit(7.0)).alias("p")), "SELECT event_id, printf('%.1f%%', event_id / 7.0) AS p FROM events")
add("escape_html", "pages", lambda d: d.select("page_id", F.md5(X.escape_html(F.col("html"))).alias("h")), "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS h FROM pages")
add("colour", "events", lambda d: d.select("event_id", X.colour_of(F.col("value")).alias("c")), "SELECT event_id, CASE WHEN value IS NULL THEN 'neutral' WHEN value < 60 THEN 'low' WHEN value < 80 THEN 'medium' ELSE 'high' END AS c FROM events")
add("stamp_to_iso", "events", lambda d: d.select("event_id", X.stamp_to_iso(F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).otherwise("soon")).alias("t")), "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE 'soon' END AS t FROM events")
add("source_kind", "documents", lambda d: d.select("doc_id", X.source_kind(F.col("source"), [("wire", ["src1"]), ("agency", ["src2", "src3"])], "press").alias("kind")), "SELECT doc_id, CASE WHEN contains(lower(source), 'src1') THEN 'wire' WHEN contains(lower(source), 'src2') OR contains(lower(source), 'src3') THEN 'agency' ELSE 'press' END AS kind FROM documents")
add("classifier_text", "documents", lambda d: d.select("doc_id", F.md5(X.classifier_text(F.col("source"), F.col("text"))).alias("h")), "SELECT doc_id, md5(concat_ws('. ', nullif(source, ''), nullif(text, ''))) AS h FROM documents")
add("embedding_text", "documents", lambda d: d.select("doc_id", F.md5(X.embedding_text(F.col("source"), F.col("text"), F.array("lang", F.lit("x")))).alias("h")), "SELECT doc_id, md5(substring(concat_ws(' ', source, substring(text, 1, 500), lang || ' x'), 1, 1000)) AS h FROM documents")
add("hex_bytes", "documents", lambda d: d.select("doc_id", F.lower(F.hex(F.col("source").cast("binary"))).alias("h")), "SELECT doc_id, lower(hex(source)) AS h FROM documents")
add("rank_label", "nation", lambda d: d.select("n_nationkey", F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("rank")), "SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS rank FROM nation")
add("kept_summary", "documents", lambda d: d.select("doc_id", X.summary_of(F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 60)), F.col("text")).alias("summary")), f"SELECT c.doc_id, CASE WHEN c.doc_id % 2 = 0 AND length(substring(d.text, 1, 60)) > 40 THEN substring(d.text, 1, 60) ELSE c.summary END AS summary FROM ({_CONCISE}) c JOIN documents d ON d.doc_id = c.doc_id")
add("new_summaries", "documents", lambda d: d.select("doc_id", X.summary_of_new(F.when(F.col("doc_id") % 3 == 0, "done"), F.lit(None).cast("string"), F.col("text")).alias("ai_summary")), f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'done' ELSE summary END AS ai_summary FROM ({_CONCISE})")
add("query_tokens", "conversations", lambda d: d.select("conv_id", "turn", X.query_tokens(F.col("text"), V.STOPWORDS, V.ALIASES).alias("tokens"), X.query_string(X.query_tokens(F.col("text"), V.STOPWORDS, V.ALIASES), True).alias("q")), _TOKENS_SQL)
add("parsed_lists", "events", lambda d: d.select("event_id", X.parsed_list(F.element_at(F.array(*map(F.lit, LISTS)), (F.col("event_id") % len(LISTS) + 1).cast("int"))).alias("items")), "SELECT event_id, CASE event_id % 7 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['a b'] WHEN 2 THEN CAST([] AS VARCHAR[]) WHEN 3 THEN ['x', 'y', 'z'] WHEN 4 THEN ['half open'] WHEN 5 THEN ['p'] ELSE ['a', '5'] END AS items FROM events")
add("dumped", "events", lambda d: d.select("event_id", X.dumped(F.col("event_type"), True).alias("text"), X.dumped(F.array("event_type", F.lit("x"))).alias("list")), """SELECT event_id, event_type AS text, '["' || event_type || '","x"]' AS list FROM events""")
add("missing_fields", "events", lambda d: d.select("event_id", X.missing_fields({"title": F.when(F.col("event_id") % 2 == 0, F.col("event_type")), "url": F.when(F.col("event_id") % 3 != 0, "").otherwise("u"), "id": F.col("event_id").cast("string")}).alias("missing")), "SELECT event_id, list_filter([CASE WHEN event_id % 2 <> 0 THEN 'title' END, CASE WHEN event_id % 3 <> 0 THEN 'url' END], lambda x: x IS NOT NULL) AS missing FROM events")
