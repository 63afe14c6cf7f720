"""Full text, vector and hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.text import cosine
from tidewire.operators import facets
from tidewire.storage import stored

# Fixed values of the ranking functions.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K, VECTOR_WEIGHT = 60, 1.5
SEVERITY_BOOST = {"CRITICAL": 0.5, "HIGH": 0.3, "MODERATE": 0.1}
# How many hits of each kind a question gets, of how many of its
# places, and the least similarity.
KEYWORD_HITS, PLACE_HITS, PLACES, VECTOR_HITS, ANSWERS, LEAST_SIMILAR = 20, 15, 2, 15, 15, 0.35
WORD = "[a-z0-9]+"


def phrases_of(terms: list[str]) -> list[list[str]]:
    """Terms as phrases: a term of several words stands in a row."""
    import re

    return [p for p in (re.findall(WORD, t.lower()) for t in terms) if p]


def _pattern(phrase: list[str]) -> str:
    """A phrase in lower-case text; only its first word is used up, so phrases
    may overlap."""
    rest = "".join(f"[^a-z0-9]+{w}" for w in phrase[1:])
    return f"(?<![a-z0-9]){phrase[0]}(?={rest}(?![a-z0-9]))"


def features(df: DataFrame, key: str, columns: list[str], phrases: list[list[str]]) -> DataFrame:
    """``doc, size, f`` of every row: its words and how often it has each phrase
    in one column. One scan of the texts; what it writes is a few numbers a row."""
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    total = lambda pattern: reduce(lambda a, b: a + b, [F.regexp_count(c, F.lit(pattern)) for c in low])
    each = df.select(F.col(key).alias("doc"), total(WORD).cast("long").alias("size"), F.array(*[total(_pattern(p)) for p in phrases]).alias("f"))
    return stored(each, "features")


def index_stats(sizes: DataFrame) -> DataFrame:
    """One row: documents with a word and their mean length."""
    return sizes.where("size > 0").agg(F.count("*").alias("docs"), F.avg("size").alias("mean_size"))


def bm25(hits: DataFrame, stats: DataFrame) -> DataFrame:
    """``doc, matched, score`` of rows ``doc, size, f`` that have a phrase; the
    score of the best is the most negative."""
    some = hits.where(F.exists("f", lambda x: x > 0))
    found = some.select(F.posexplode("f").alias("i", "x")).where("x > 0").groupBy("i").agg(F.count("*").alias("n"))
    found = found.agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("n"))
    one = F.broadcast(stats.crossJoin(F.broadcast(found)))

    def part(f: Column, i: Column) -> Column:
        n = F.try_element_at(F.col("n"), i)
        idf = F.greatest(F.log((F.col("docs") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))).otherwise(0.0)

    score = -F.aggregate(F.transform("f", part), F.lit(0.0), lambda a, x: a + x)
    return some.crossJoin(one).select("doc", F.size(F.filter("f", lambda x: x > 0)).cast("long").alias("matched"), score.alias("score"))


def keyword_search(scored: DataFrame, phrases: int, limit: int) -> DataFrame:
    """Of scored documents those with all phrases if there are any, else those
    with some; best first."""
    every = F.broadcast(scored.agg(F.max("matched").alias("most")))
    kept = scored.crossJoin(every).where((F.col("most") < phrases) | (F.col("matched") == phrases))
    return kept.orderBy("score", "doc").limit(limit).select("doc", "matched", "score")


def text_search(df: DataFrame, key: str, columns: list[str], terms: list[str], limit: int, index=None) -> DataFrame:
    """``doc, score`` of the rows that a keyword search finds.

    By an ``index`` (of ``tidewire.operators.index``) where one is given; an
    index that cannot be read, or terms without a word, fall back to a substring
    search of every term, whose score is null.
    """
    phrases = phrases_of(terms)
    if phrases and index is not None and not index.exists():
        phrases = []
    if not phrases:
        return facets.like_search(df, terms, columns).select(F.col(key).alias("doc"), F.lit(None).cast("double").alias("score")).orderBy("doc").limit(limit)
    if index is not None:
        hits, stats = index.hits(phrases), index_stats(index.sizes())
        scored = bm25(hits.join(df.select(F.col(key).alias("doc")), "doc", "left_semi"), stats)
    else:
        own = features(df, key, columns, phrases)
        scored = bm25(own, index_stats(own))
    return keyword_search(scored, len(phrases), limit).select("doc", "score")


def with_articles(hits: DataFrame, articles: DataFrame, key: str = "article_id") -> DataFrame:
    """Hits with the articles they stand for; the few hits are broadcast."""
    return articles.join(F.broadcast(hits), articles[key] == hits["doc"]).drop("doc")


def retrieve(articles: DataFrame, vectors: DataFrame, intent: dict, query: Column | None, filters: dict, columns: list[str], index=None) -> DataFrame:
    """``article_id, rerank``: the articles for a parsed question, best first.

    Keyword hits, hits of its first places and hits of the nearest vectors
    (``vectors``: ``article_id, embedding``), all under the same filters, merged
    and ranked by ``rerank``.
    """
    pool = facets.facet_filter(articles, **filters)
    none = F.lit(None).cast("double").alias("similarity")
    point = lambda df, keyword, place, similarity=none: df.select("doc", F.lit(keyword).alias("keyword"), F.lit(place).alias("location"), similarity)
    terms = intent.get("search_terms") or []
    found = []
    if intent.get("search_query"):
        asked = intent["search_query"].split()
        found.append(point(text_search(pool, "article_id", columns, asked, KEYWORD_HITS, index), 1, 0))
    for place in (intent.get("locations") or [])[:PLACES]:
        there = facets.term_in_arrays(pool, place, ["countries", "states", "cities"])
        found.append(point(facets.page(there, PLACE_HITS).select(F.col("article_id").alias("doc")), 0, 1))
    if query is not None:
        near = vectors.join(pool.select("article_id"), "article_id", "left_semi")
        near = vector_search(near, query, "article_id", "embedding", VECTOR_HITS, LEAST_SIMILAR)
        found.append(point(near.withColumnRenamed("article_id", "doc"), 0, 0, F.col("similarity")))
    if not found:
        return articles.limit(0).select("article_id", F.lit(0.0).alias("rerank"))
    return rerank(reduce(DataFrame.unionByName, found), articles, terms, intent.get("locations") or [], ANSWERS)


def vector_search(df: DataFrame, query: Column, key: str, vector: str, limit: int, least: float) -> DataFrame:
    """The nearest rows by cosine: of twice the limit those that reach ``least``."""
    near = df.select(F.col(key), F.round(cosine(F.col(vector), query), 4).alias("similarity")).orderBy(F.desc("similarity"), key).limit(2 * limit)
    return near.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), key).limit(limit)


def fuse(keyword: DataFrame, vector: DataFrame, levels: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion of ``keyword (doc, score)`` and ``vector (doc,
    similarity)`` with a boost by ``levels (doc, threat_level)``."""
    everything = Window.partitionBy()
    k = keyword.select("doc", (1.0 / (RRF_K + F.row_number().over(everything.orderBy("score", "doc")) - 1)).alias("part"))
    v = vector.select("doc", (VECTOR_WEIGHT * F.col("similarity") + 1.0 / (RRF_K + F.row_number().over(everything.orderBy(F.desc("similarity"), "doc")) - 1)).alias("part"))
    boost = F.lit(0.0)
    for level, value in SEVERITY_BOOST.items():
        boost = F.when(F.col("threat_level") == level, value).otherwise(boost)
    fused = k.unionByName(v).groupBy("doc").agg(F.sum("part").alias("base")).join(levels, "doc")
    return fused.select("doc", F.round(F.col("base") + boost, 6).alias("fused")).orderBy(F.desc("fused"), "doc").limit(limit)


def rerank(candidates: DataFrame, articles: DataFrame, terms: list[str], places: list[str], limit: int) -> DataFrame:
    """Composite score of ``candidates (doc, keyword, location, similarity)``.

    Retrieval points, points for each query term by where it stands, points for
    a matching place, a boost by severity, and a least score to stay.
    """
    c = candidates.groupBy("doc").agg(F.sum("keyword").alias("keyword"), F.sum("location").alias("location"), F.max("similarity").alias("similarity"))
    df = articles.join(c, articles.article_id == c.doc)
    similarity = F.coalesce("similarity", F.lit(0.0))
    score = 3.0 * F.col("keyword") + 2.0 * F.col("location") + F.when(similarity >= 0.40, 4 * similarity).otherwise(0.0)
    has = lambda column, t: F.coalesce(F.lower(F.col(column)).contains(t.lower()), F.lit(False))
    some = F.lit(False)
    for t in terms:
        score = score + F.when(has("title", t), 5.0).when(has("summary", t), 3.0).when(has("article_text", t), 0.5).otherwise(0.0)
        some = some | has("title", t) | has("summary", t) | has("article_text", t)
    if terms:
        score = score + F.when(~some & (similarity < 0.45), -10.0).otherwise(0.0)
    if places:
        there = reduce(lambda a, b: a | b, [F.array_contains(F.transform(col, F.lower), p.lower()) for p in places for col in ("states", "cities", "countries")])
        score = score + F.when(there, 4.0).otherwise(-6.0)
    boost = F.when(F.col("threat_level") == "CRITICAL", 1.5).when(F.col("threat_level") == "HIGH", 1.0).when(F.col("threat_level") == "MODERATE", 0.5).otherwise(0.0)
    ranked = df.withColumn("_s", score).withColumn("rerank", F.round(F.when(F.col("_s") >= 3, F.col("_s") + boost).otherwise(F.col("_s")), 6))
    least = 4.0 if terms and places else 3.0
    return ranked.where(F.col("rerank") >= least).orderBy(F.desc("rerank"), "article_id").limit(limit).select("article_id", "rerank")
