"""Full-text, vector and hybrid search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import embedding
from tidewire.operators import search
from tidewire.operators.index import TextIndex, vector_upsert
from tidewire.plans.articles import ARTICLES_SQL, articles
from tidewire.storage import new_path
from tidewire.tables import table

QUERIES, ORACLES = {}, {}

_POST = """WITH w AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
p AS MATERIALIZED (SELECT doc, unnest(t) AS term, generate_subscripts(t, 1) AS position FROM w),
size AS (SELECT doc, count(*) AS size FROM p GROUP BY 1),
st AS (SELECT count(*) AS docs, avg(size) AS mean_size FROM size)"""
_HITS = """, h AS (SELECT doc, 0 AS phrase, count(*) AS f FROM p WHERE term = 'that' GROUP BY 1
UNION ALL SELECT a.doc, 1, count(*) FROM p a JOIN p b ON a.doc = b.doc AND b.position = a.position + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1),
fn AS (SELECT phrase, count(*) AS n FROM h GROUP BY 1),
s AS (SELECT h.doc, count(*) AS matched, -sum(greatest(ln((docs - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean_size))) AS score FROM h JOIN fn USING (phrase) JOIN size USING (doc) CROSS JOIN st GROUP BY 1)"""
PHRASES = [["that"], ["of", "the"]]


def _scored(spark, root):
    own = search.features(table(spark, root, "documents"), "doc_id", ["text"], PHRASES)
    return search.bm25(own, search.index_stats(own))


def bm25(spark, root):
    """BM25 of a word and a phrase, in one scan."""
    return _scored(spark, root).select("doc", "matched", F.round("score", 9).alias("score"))


def keyword_search(spark, root):
    return search.keyword_search(_scored(spark, root), len(PHRASES), 20).select("doc", "matched", F.round("score", 9).alias("score"))


def indexed_search(spark, root):
    """The same hits by a stored index."""
    index = TextIndex(spark, new_path(spark, "index"), "doc_id", ["text"]).build(table(spark, root, "documents"))
    scored = search.bm25(index.hits(PHRASES), search.index_stats(index.sizes()))
    return search.keyword_search(scored, len(PHRASES), 20).select("doc", "matched", F.round("score", 9).alias("score"))


def index_upkeep(spark, root):
    """An index that is built of a part, and then learns of changes and deletions."""
    d = table(spark, root, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    index = TextIndex(spark, new_path(spark, "index"), "doc_id", ["text", "source"], 8).build(d.where("doc_id % 2 = 0"))
    changed = d.where("doc_id % 3 = 0").withColumn("text", F.concat(F.lit("of the "), "text"))
    index.update(changed, d.where("doc_id % 5 = 0").select("doc_id"))
    return index.hits(PHRASES + [["src1"]]).select("doc", "size", "f")


def like_fallback(spark, root):
    """Without a readable index every term must be a substring somewhere."""
    missing = TextIndex(spark, new_path(spark, "none"), "article_id", ["title"])
    return search.text_search(articles(spark, root), "article_id", ["title", "article_text"], ["the", "an"], 25, missing)


def hits_with_articles(spark, root):
    """Keyword hits joined with their articles."""
    return search.with_articles(keyword_search(spark, root), articles(spark, root)).select("article_id", "title", "score")


INTENT = {"search_query": "that of", "search_terms": ["that", "the"], "locations": ["state3", "city5", "unused"]}


def retrieval(spark, root):
    """The whole retrieval of one parsed question."""
    a = articles(spark, root)
    e = table(spark, root, "embeddings").withColumnRenamed("vec_id", "article_id").crossJoin(_query_vector(spark, root))
    return search.retrieve(a, e, INTENT, F.col("q"), {"before": "2999"}, ["title", "article_text"])


def index_stats(spark, root):
    """Documents with a word and their mean length."""
    return search.index_stats(search.features(table(spark, root, "documents"), "doc_id", ["text"], PHRASES)).select("docs", F.round("mean_size", 6).alias("mean_size"))


def vector_search_by_three(spark, root):
    """The nearest of those that have three values, at the production threshold."""
    e = table(spark, root, "embeddings").withColumns({"level": F.when(F.col("vec_id") % 2 == 0, "HIGH").otherwise("LOW"), "kind": F.col("vec_id") % 3})
    near = e.where("level = 'HIGH' AND kind = 0 AND label >= 0").crossJoin(_query_vector(spark, root))
    return search.vector_search(near, F.col("q"), "vec_id", "embedding", search.VECTOR_HITS, search.LEAST_SIMILAR)


def text_vectors(spark, root):
    """Vectors of texts without a model, their filled places."""
    return embedding.sparse(table(spark, root, "documents"), "doc_id", "text", 64).select("doc_id", "place", F.round("weight", 6).alias("weight"))


def vector_upserts(spark, root):
    """New vectors beside kept and beside replaced ones."""
    e = table(spark, root, "embeddings").select("vec_id", "label")
    new = e.where("vec_id % 3 = 0").withColumn("label", F.lit(-1))
    old = e.where("vec_id % 2 = 0")
    both = [vector_upsert(new, old, "vec_id", keep).withColumn("kept", F.lit(keep)) for keep in (True, False)]
    return both[0].unionByName(both[1])


def _query_vector(spark, root):
    """The vector of one row, as a broadcast column."""
    return F.broadcast(table(spark, root, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q")))


def vector_search(spark, root):
    """The vectors nearest to that of row 0."""
    e = table(spark, root, "embeddings").crossJoin(_query_vector(spark, root))
    return search.vector_search(e, F.col("q"), "vec_id", "embedding", 15, 0.1)


def vector_search_filtered(spark, root):
    """As above, among one label: the filter comes before the ranking."""
    e = table(spark, root, "embeddings").where("label = 3").crossJoin(_query_vector(spark, root))
    return search.vector_search(e, F.col("q"), "vec_id", "embedding", 15, 0.0)


def fusion(spark, root):
    """Reciprocal rank fusion of keyword and vector hits."""
    k = keyword_search(spark, root).select("doc", "score")
    v = vector_search(spark, root).select(F.col("vec_id").alias("doc"), "similarity")
    levels = articles(spark, root).select(F.col("article_id").alias("doc"), "threat_level")
    return search.fuse(k, v, levels, 15)


def rerank(spark, root):
    """Composite ranking of keyword, place and vector candidates."""
    a = articles(spark, root).withColumn("summary", F.substring("article_text", 1, 200))
    k = a.where(F.lower("title").contains("the")).select(F.col("article_id").alias("doc"), F.lit(1).alias("keyword"), F.lit(0).alias("location"), F.lit(None).cast("double").alias("similarity"))
    p = a.where(F.array_contains("states", "state3")).select(F.col("article_id").alias("doc"), F.lit(0).alias("keyword"), F.lit(1).alias("location"), F.lit(None).cast("double").alias("similarity"))
    v = vector_search(spark, root).select(F.col("vec_id").alias("doc"), F.lit(0).alias("keyword"), F.lit(0).alias("location"), "similarity")
    return search.rerank(k.unionByName(p).unionByName(v), a, ["the", "that"], ["state3"], 15)


_NEAR = "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 4) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
QUERIES |= {f.__name__: f for f in (bm25, keyword_search, indexed_search, index_upkeep, like_fallback, hits_with_articles, retrieval, index_stats, vector_search_by_three, text_vectors, vector_upserts, vector_search, vector_search_filtered, fusion, rerank)}
ORACLES["bm25"] = _POST + _HITS + " SELECT doc, matched, round(score, 9) AS score FROM s"
ORACLES["keyword_search"] = _POST + _HITS + " SELECT doc, matched, round(score, 9) AS score FROM s, (SELECT max(matched) AS most FROM s) WHERE most < 2 OR matched = 2 ORDER BY s.score, doc LIMIT 20"
ORACLES["vector_search"] = f"SELECT * FROM (SELECT * FROM ({_NEAR}) ORDER BY similarity DESC, vec_id LIMIT 30) WHERE similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 15"
ORACLES["vector_search_filtered"] = f"SELECT * FROM (SELECT * FROM ({_NEAR} WHERE e.label = 3) ORDER BY similarity DESC, vec_id LIMIT 30) WHERE similarity >= 0.0 ORDER BY similarity DESC, vec_id LIMIT 15"
ORACLES["fusion"] = (
    ARTICLES_SQL + ", " + (_POST + _HITS).removeprefix("WITH ")
    + f", k AS (SELECT doc, row_number() OVER (ORDER BY score, doc) - 1 AS r FROM ({ORACLES['keyword_search'].removeprefix(_POST + _HITS)})), v AS (SELECT vec_id AS doc, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) - 1 AS r FROM ({ORACLES['vector_search']})), u AS (SELECT doc, 1.0 / (60 + r) AS part FROM k UNION ALL SELECT doc, 1.5 * similarity + 1.0 / (60 + r) FROM v) SELECT u.doc, round(sum(part) + any_value(CASE threat_level WHEN 'CRITICAL' THEN 0.5 WHEN 'HIGH' THEN 0.3 WHEN 'MODERATE' THEN 0.1 ELSE 0.0 END), 6) AS fused FROM u JOIN articles a ON a.article_id = u.doc GROUP BY 1 ORDER BY fused DESC, doc LIMIT 15"
)
ORACLES["rerank"] = (
    ARTICLES_SQL
    + f""", c AS (SELECT doc, sum(k) AS k, sum(l) AS l, max(s) AS s FROM (SELECT article_id AS doc, 1 AS k, 0 AS l, NULL AS s FROM articles WHERE contains(lower(title), 'the') UNION ALL SELECT article_id, 0, 1, NULL FROM articles WHERE list_contains(states, 'state3') UNION ALL SELECT vec_id, 0, 0, similarity FROM ({ORACLES['vector_search']})) GROUP BY 1),
x AS (SELECT a.*, 3.0 * k + 2.0 * l AS b, coalesce(s, 0.0) AS s, lower(title) AS t, lower(substring(article_text, 1, 200)) AS m, lower(article_text) AS z FROM articles a JOIN c ON c.doc = a.article_id),
y AS (SELECT *, b + CASE WHEN s >= 0.4 THEN 4 * s ELSE 0 END + CASE WHEN contains(t, 'the') THEN 5.0 WHEN contains(m, 'the') THEN 3.0 WHEN contains(z, 'the') THEN 0.5 ELSE 0 END + CASE WHEN contains(t, 'that') THEN 5.0 WHEN contains(m, 'that') THEN 3.0 WHEN contains(z, 'that') THEN 0.5 ELSE 0 END + CASE WHEN NOT (contains(t, 'the') OR contains(z, 'the') OR contains(t, 'that') OR contains(z, 'that')) AND s < 0.45 THEN -10 ELSE 0 END + CASE WHEN list_contains(states, 'state3') OR list_contains(cities, 'state3') OR list_contains(countries, 'state3') THEN 4 ELSE -6 END AS score FROM x),
r AS (SELECT article_id, round(CASE WHEN score >= 3 THEN score + CASE threat_level WHEN 'CRITICAL' THEN 1.5 WHEN 'HIGH' THEN 1.0 WHEN 'MODERATE' THEN 0.5 ELSE 0 END ELSE score END, 6) AS rerank FROM y)
SELECT article_id, CAST(rerank AS DOUBLE) AS rerank FROM r WHERE rerank >= 4 ORDER BY rerank DESC, article_id LIMIT 15"""
)

ORACLES["indexed_search"] = ORACLES["keyword_search"]
ORACLES["index_upkeep"] = """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'of the ' ELSE '' END || coalesce(text, '') AS t, source FROM documents WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 5 <> 0),
k AS (SELECT doc_id, regexp_extract_all(lower(t), '[a-z0-9]+') AS a, regexp_extract_all(lower(coalesce(source, '')), '[a-z0-9]+') AS b FROM d),
c AS (SELECT doc_id AS doc, CAST(len(a) + len(b) AS BIGINT) AS size, CAST(len(list_filter(list_concat(a, b), lambda x: x = 'that')) AS INTEGER) AS f1, CAST(len(list_filter(a, lambda x, i: x = 'of' AND a[i + 1] = 'the')) AS INTEGER) AS f2, CAST(len(list_filter(list_concat(a, b), lambda x: x = 'src1')) AS INTEGER) AS f3 FROM k)
SELECT doc, size, [f1, f2, f3] AS f FROM c WHERE f1 + f2 + f3 > 0"""
ORACLES["like_fallback"] = ARTICLES_SQL + "SELECT article_id AS doc, CAST(NULL AS DOUBLE) AS score FROM articles WHERE (title ILIKE '%the%' OR article_text ILIKE '%the%') AND (title ILIKE '%an%' OR article_text ILIKE '%an%') ORDER BY doc LIMIT 25"
ORACLES["hits_with_articles"] = ARTICLES_SQL + ", " + (_POST + _HITS).removeprefix("WITH ") + f" SELECT article_id, title, k.score FROM articles JOIN ({ORACLES['keyword_search'].removeprefix(_POST + _HITS)}) k ON k.doc = article_id"
ORACLES["vector_upserts"] = "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label ELSE -1 END AS label, TRUE AS kept FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0 UNION ALL SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END, FALSE FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0"
_RANKED = "ORDER BY CASE threat_level WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 3 ELSE 4 END, published_at DESC, article_id LIMIT 15"
_THERE = lambda p: f"len(list_filter(list_concat(countries, states, cities), lambda x: x ILIKE '%{p}%')) > 0"
ORACLES["retrieval"] = (
    ARTICLES_SQL
    + f""", w AS (SELECT article_id AS doc, regexp_extract_all(lower(title), '[a-z0-9]+') AS a, regexp_extract_all(lower(article_text), '[a-z0-9]+') AS b FROM articles),
fe AS (SELECT doc, len(a) + len(b) AS size, len(list_filter(list_concat(a, b), lambda x: x = 'that')) AS f1, len(list_filter(list_concat(a, b), lambda x: x = 'of')) AS f2 FROM w),
st AS (SELECT count(*) AS docs, avg(size) AS mean_size, count(*) FILTER (f1 > 0) AS n1, count(*) FILTER (f2 > 0) AS n2 FROM fe WHERE size > 0),
sc AS (SELECT doc, CASE WHEN f1 > 0 THEN 1 ELSE 0 END + CASE WHEN f2 > 0 THEN 1 ELSE 0 END AS matched, -(CASE WHEN f1 > 0 THEN greatest(ln((docs - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * size / mean_size)) ELSE 0 END + CASE WHEN f2 > 0 THEN greatest(ln((docs - n2 + 0.5) / (n2 + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * size / mean_size)) ELSE 0 END) AS score FROM fe, st WHERE f1 + f2 > 0),
kw AS (SELECT doc FROM sc, (SELECT max(matched) AS most FROM sc) WHERE most < 2 OR matched = 2 ORDER BY round(score, 9), doc LIMIT 20),
nr AS (SELECT * FROM (SELECT n.* FROM ({_NEAR}) n JOIN articles ON article_id = n.vec_id ORDER BY similarity DESC, vec_id LIMIT 30) WHERE similarity >= 0.35 ORDER BY similarity DESC, vec_id LIMIT 15),
c AS (SELECT doc, sum(k) AS k, sum(l) AS l, max(s) AS s FROM (SELECT doc, 1 AS k, 0 AS l, NULL AS s FROM kw UNION ALL SELECT * FROM (SELECT article_id, 0, 1, NULL FROM articles WHERE {_THERE('state3')} {_RANKED}) UNION ALL SELECT * FROM (SELECT article_id, 0, 1, NULL FROM articles WHERE {_THERE('city5')} {_RANKED}) UNION ALL SELECT vec_id, 0, 0, similarity FROM nr) GROUP BY 1),
x AS (SELECT a.*, 3.0 * k + 2.0 * l AS b, coalesce(s, 0.0) AS s, lower(title) AS t, lower(coalesce(summary, '')) AS m, lower(article_text) AS z FROM articles a JOIN c ON c.doc = a.article_id),
y AS (SELECT *, b + CASE WHEN s >= 0.4 THEN 4 * s ELSE 0 END + CASE WHEN contains(t, 'that') THEN 5.0 WHEN contains(m, 'that') THEN 3.0 WHEN contains(z, 'that') THEN 0.5 ELSE 0 END + CASE WHEN contains(t, 'the') THEN 5.0 WHEN contains(m, 'the') THEN 3.0 WHEN contains(z, 'the') THEN 0.5 ELSE 0 END + CASE WHEN NOT (contains(z, 'the') OR contains(z, 'that')) AND s < 0.45 THEN -10 ELSE 0 END + CASE WHEN len(list_intersect(list_concat(states, cities, countries), ['state3', 'city5', 'unused'])) > 0 THEN 4 ELSE -6 END AS score FROM x),
r AS (SELECT article_id, round(CASE WHEN score >= 3 THEN score + CASE threat_level WHEN 'CRITICAL' THEN 1.5 WHEN 'HIGH' THEN 1.0 WHEN 'MODERATE' THEN 0.5 ELSE 0 END ELSE score END, 6) AS rerank FROM y)
SELECT article_id, CAST(rerank AS DOUBLE) AS rerank FROM r WHERE rerank >= 4 ORDER BY rerank DESC, article_id LIMIT 15"""
)

ORACLES["index_stats"] = "SELECT count(*) AS docs, round(avg(n), 6) AS mean_size FROM (SELECT len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM documents) WHERE n > 0"
ORACLES["vector_search_by_three"] = f"SELECT * FROM (SELECT * FROM ({_NEAR} WHERE e.vec_id % 6 = 0 AND e.label >= 0) ORDER BY similarity DESC, vec_id LIMIT 30) WHERE similarity >= 0.35 ORDER BY similarity DESC, vec_id LIMIT 15"
ORACLES["text_vectors"] = "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), p AS (SELECT doc_id, CAST(CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % 64 AS INTEGER) AS place, count(*) AS n FROM w GROUP BY 1, 2) SELECT doc_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM p"
