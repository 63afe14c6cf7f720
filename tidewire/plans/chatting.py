"""A table of questions against the articles, and its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import embedding
from tidewire.operators.index import TextIndex
from tidewire.plans.articles import ARTICLES_SQL, articles
from tidewire.plans.desk import Desk
from tidewire.storage import new_path, stored

TODAY = "2024-03-01"
WORDS = ["that", "ing", "and", "les", "und", "der", "que", "attion", "of", "en"]
STOP = ["situation", "trend", "over", "the", "last", "month", "high", "threat", "week"]
NAMES = [*(f"state{i}" for i in range(7)), *(f"city{i}" for i in range(13))]
COLUMNS = ["qid", "question", "kind", "reports", "severity", "articles"]


def _asked() -> list[tuple]:
    """A hundred questions, and what each means: kind, places, terms, level, days."""
    found = []
    for i in range(100):
        word, other, place = WORDS[i % 10], WORDS[i // 10], NAMES[i * 3 % len(NAMES)]
        found.append(
            [
                (i, f"Situation {place} {word}?", "situation_brief", [place], [word], None, None),
                (i, f"trend {word} over the last month", "trend_analysis", [], [word], None, 30),
                (i, f"HIGH threat {place}, {word}", "location_search", [place], [word], "HIGH", None),
                (i, f"{word} {place} week", "location_search", [place], [word], None, 7),
                (i, f"{word} {other}", "general_search", [], [word, other], None, None),
            ][i // 10 % 5]
        )
    return found


def chat_answers(spark, root):
    """A hundred questions answered at once: parsed, found by the stored index, by
    places and by vectors of the texts, ranked, and summed up."""
    a = stored(articles(spark, root), "articles")
    index = TextIndex(spark, new_path(spark, "index"), "article_id", ["title", "article_text"]).build(a)
    questions = spark.createDataFrame([q[:2] for q in _asked()], "qid long, question string")
    double = lambda df, key, text: embedding.dense(df, key, text, kind="double")
    vectors = stored(double(a, "article_id", "article_text"), "article_vectors")
    return Desk(a, TODAY).ask_all(questions, "qid", "question", index, (NAMES, {}, STOP), vectors, lambda df: double(df, "qid", "text")).select(*COLUMNS)


def stored_index(spark, root):
    """The index alone: words of each document, and its distinct ones."""
    from tidewire.tables import table

    index = TextIndex(spark, new_path(spark, "index"), "doc_id", ["text"]).build(table(spark, root, "documents"))
    terms = index.postings().groupBy("doc").agg(F.count("*").alias("terms"), F.sum(F.size("positions")).alias("found"))
    return index.sizes().join(terms, "doc", "left").select("doc", "size", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("found", F.lit(0)).alias("found"))


def _list(items) -> str:
    return "CAST([" + ", ".join(f"'{x}'" for x in items) + "] AS VARCHAR[])"


def _row(qid, question, kind, places, terms, level, days) -> str:
    unique = list(dict.fromkeys([*places, *terms]))
    since = f"strftime(DATE '{TODAY}' - {days}, '%Y-%m-%d')" if days else "NULL"
    return f"({qid}, '{question}', '{kind}', {_list(places)}, {_list(terms)}, {_list(unique)}, {f"'{level}'" if level else 'NULL'}, {since})"


_FITS = "(q.level IS NULL OR a.threat_level = q.level) AND (q.since IS NULL OR a.published_at >= q.since)"
_VECTOR = "SELECT {key}, place, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM (SELECT {key}, CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % 384 AS place, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {table}) GROUP BY 1, 2)"
QUERIES = {"chat_answers": chat_answers, "stored_index": stored_index}
ORACLES = {
    "chat_answers": ARTICLES_SQL
    + f""", q(qid, question, kind, locations, terms, tokens, level, since) AS (VALUES {", ".join(_row(*r) for r in _asked())}),
w AS (SELECT article_id AS doc, list_concat(regexp_extract_all(lower(title), '[a-z0-9]+'), regexp_extract_all(lower(article_text), '[a-z0-9]+')) AS words FROM articles),
st AS (SELECT count(*) AS docs, avg(len(words)) AS mean_size FROM w WHERE len(words) > 0),
f AS (SELECT doc, term, count(*) AS f, any_value(size) AS size FROM (SELECT doc, len(words) AS size, unnest(words) AS term FROM w) WHERE term IN (SELECT unnest(tokens) FROM q) GROUP BY doc, term),
h AS (SELECT q.qid, len(q.tokens) AS many, q.term, f.doc, f.f, f.size FROM (SELECT *, unnest(tokens) AS term FROM q) q JOIN f USING (term) JOIN articles a ON a.article_id = f.doc WHERE {_FITS}),
n AS (SELECT qid, term, count(*) AS n FROM h GROUP BY ALL),
sc AS (SELECT qid, many, doc, count(*) AS matched, round(-sum(greatest(ln((docs - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean_size))), 9) AS score FROM h JOIN n USING (qid, term), st GROUP BY ALL),
kw AS (SELECT qid, doc FROM (SELECT *, max(matched) OVER (PARTITION BY qid) AS most FROM sc) WHERE most < many OR matched = many QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score, doc) <= 20),
pl AS (SELECT q.qid, a.article_id AS doc FROM (SELECT *, unnest(locations[1:2]) AS place FROM q) q JOIN articles a ON len(list_filter(list_concat(countries, states, cities), lambda x: contains(lower(x), q.place))) > 0 WHERE {_FITS}
 QUALIFY row_number() OVER (PARTITION BY q.qid, place ORDER BY CASE a.threat_level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 3 ELSE 4 END, a.published_at DESC, a.article_id) <= 15),
av AS ({_VECTOR.format(key="article_id", text="article_text", table="articles")}),
qv AS ({_VECTOR.format(key="qid", text="array_to_string(tokens, ' ')", table="q")}),
si AS (SELECT qid, article_id AS doc, round(sum(av.weight * qv.weight), 4) AS s FROM av JOIN qv USING (place) GROUP BY ALL HAVING s >= 0.35),
vc AS (SELECT si.qid, si.doc, si.s FROM si JOIN q USING (qid) JOIN articles a ON a.article_id = si.doc WHERE {_FITS} QUALIFY row_number() OVER (PARTITION BY si.qid ORDER BY s DESC, doc) <= 15),
c AS (SELECT qid, doc, sum(k) AS k, sum(l) AS l, max(s) AS s FROM (SELECT qid, doc, 1 AS k, 0 AS l, NULL AS s FROM kw UNION ALL SELECT qid, doc, 0, 1, NULL FROM pl UNION ALL SELECT qid, doc, 0, 0, s FROM vc) GROUP BY ALL),
x AS (SELECT c.*, a.*, q.terms, q.locations, lower(title) AS t, lower(coalesce(summary, '')) AS m, lower(article_text) AS z FROM c JOIN q USING (qid) JOIN articles a ON a.article_id = c.doc),
p AS (SELECT *, list_sum(list_concat([0.0], list_transform(terms, lambda y: CASE WHEN contains(t, y) THEN 5.0 WHEN contains(m, y) THEN 3.0 WHEN contains(z, y) THEN 0.5 ELSE 0.0 END))) AS points FROM x),
y AS (SELECT *, 3.0 * k + 2.0 * l + CASE WHEN coalesce(s, 0) >= 0.4 THEN 4 * s ELSE 0 END + points - CASE WHEN len(terms) > 0 AND points = 0 AND coalesce(s, 0) < 0.45 THEN 10 ELSE 0 END
 + CASE WHEN len(locations) = 0 THEN 0 WHEN len(list_intersect(list_concat(states, cities, countries), locations)) > 0 THEN 4 ELSE -6 END AS score FROM p),
r AS (SELECT *, round(CASE WHEN score >= 3 THEN score + CASE threat_level WHEN 'CRITICAL' THEN 1.5 WHEN 'HIGH' THEN 1.0 WHEN 'MODERATE' THEN 0.5 ELSE 0 END ELSE score END, 6) AS rerank FROM y),
b AS (SELECT * FROM r WHERE rerank >= CASE WHEN len(terms) > 0 AND len(locations) > 0 THEN 4 ELSE 3 END QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, article_id) <= 15),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY published_at DESC NULLS LAST, article_id) AS k6 FROM b),
e AS (SELECT qid, count(*) AS reports, list(article_id ORDER BY rerank DESC, article_id) AS articles, ['LOW', 'MODERATE', 'HIGH', 'CRITICAL'][max(CASE WHEN k6 > 6 THEN 1 ELSE CASE threat_level WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MODERATE' THEN 2 ELSE 1 END END)] AS severity FROM o GROUP BY qid)
SELECT CAST(q.qid AS BIGINT) AS qid, question, kind, coalesce(reports, 0) AS reports, severity, coalesce(articles, CAST([] AS BIGINT[])) AS articles FROM q LEFT JOIN e USING (qid)""",
    "stored_index": "WITH w AS (SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents) SELECT doc, CAST(len(w) AS BIGINT) AS size, CAST(len(list_distinct(w)) AS BIGINT) AS terms, CAST(len(w) AS BIGINT) AS found FROM w",
}
