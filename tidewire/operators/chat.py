"""Many questions in one plan: parse, retrieve by the stored index, rank, brief.

A table of questions is answered at once. The postings of all its terms are read
in one scan, places are matched against the distinct names, and the vectors are
scanned once for each ``QUESTIONS`` of them. What the questions share (a term, a
place) is found once. Each step keeps its first hits for each question before the
next one reads them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import embedding
from tidewire.operators import briefs, facets, intent
from tidewire.operators.index import TextIndex
from tidewire.operators.search import ANSWERS, B, K1, KEYWORD_HITS, LEAST_IDF, LEAST_SIMILAR, PLACE_HITS, PLACES, VECTOR_HITS, WORD, index_stats
from tidewire.storage import stored

#: Questions whose vectors are held at once, by the driver and by each task.
QUESTIONS = 1024
#: Tokens of a question that a substring search looks for.
TOKENS = 5
PLACE_COLUMNS = ["countries", "states", "cities"]


def parsed(questions: DataFrame, key: str, text: str, today: str, places: list[str], aliases: dict[str, str], stopwords: list[str]) -> DataFrame:
    """``qid, question, kind, locations, search_terms, search_query, level, mood, since``."""
    rows = intent.parse(questions.select(F.col(key).alias("qid"), F.col(text).alias("question")), "question", places, aliases, stopwords)
    since = F.date_format(F.date_sub(F.lit(today).cast("date"), F.col("days")), "yyyy-MM-dd")
    return rows.select("qid", "question", "kind", "locations", "search_terms", "search_query", F.col("threat_level").alias("level"), F.col("sentiment").alias("mood"), since.alias("since"))


def _allowed(articles: DataFrame) -> Column:
    """Whether an article passes its question's filters."""
    mood = F.col("sentiment") == F.col("mood") if "sentiment" in articles.columns else F.lit(False)
    tests = [(F.col("level"), F.col("threat_level") == F.col("level")), (F.col("mood"), mood), (F.col("since"), F.col("published_at") >= F.col("since"))]
    out = F.lit(True)
    for given, test in tests:
        out = out & (given.isNull() | F.coalesce(test, F.lit(False)))
    return out


def _first(df: DataFrame, per: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def _facets_of(articles: DataFrame) -> DataFrame:
    some = [c for c in ("threat_level", "sentiment", "published_at") if c in articles.columns]
    return articles.select(F.col("article_id").alias("doc"), *some)


def keyword_hits(asked: DataFrame, articles: DataFrame, index: TextIndex, columns: list[str]) -> DataFrame:
    """``qid, doc`` of each question's first keyword hits: of the articles that its
    filters allow, those with all its tokens, if there are any, else those with
    some, by BM25. A question without an indexable word is a substring search."""
    tokens = F.filter(F.split("search_query", " "), lambda t: t != "")
    phrases = F.filter(F.transform(tokens, lambda t: F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0))), lambda w: F.size(w) > 0)
    own = asked.select("qid", "level", "mood", "since", tokens.alias("tokens"), phrases.alias("phrases"))
    wanted = own.select("qid", "level", "mood", "since", F.size("phrases").alias("of"), F.posexplode("phrases").alias("p", "words")).withColumn("phrase", F.array_join("words", " "))

    # Each phrase once, whoever asks for it; its words meet their postings.
    words = wanted.select("phrase", "words").distinct().select("phrase", F.size("words").alias("len"), F.posexplode("words").alias("k", "term")).withColumn("bucket", index.bucket("term"))
    met = index.postings().join(words, ["bucket", "term"])
    single = met.where("len = 1").select("phrase", "doc", F.size("positions").alias("f"))
    starts = met.where("len > 1").select("phrase", "len", "doc", "column", F.transform("positions", lambda p: p - F.col("k")).alias("starts"))
    runs = starts.groupBy("phrase", "len", "doc", "column").agg(F.collect_list("starts").alias("all")).where(F.size("all") == F.col("len"))
    runs = runs.select("phrase", "doc", F.size(F.aggregate(F.col("all"), F.col("all")[0], lambda a, s: F.array_intersect(a, s))).alias("f"))
    found = single.unionByName(runs).groupBy("phrase", "doc").agg(F.sum("f").alias("f")).where("f > 0")

    hits = found.join(_facets_of(articles), "doc").join(wanted.drop("words"), "phrase").where(_allowed(articles))
    sizes = index.sizes()
    hits = hits.join(sizes, "doc").withColumn("n", F.count("*").over(Window.partitionBy("qid", "p")))
    hits = hits.crossJoin(F.broadcast(index_stats(sizes)))
    idf = F.greatest(F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    scored = hits.groupBy("qid", "of", "doc").agg(F.count("*").alias("matched"), F.round(-F.sum(part), 9).alias("score"))
    most = F.max("matched").over(Window.partitionBy("qid"))
    scored = scored.withColumn("most", most).where((F.col("most") < F.col("of")) | (F.col("matched") == F.col("of")))
    ranked = _first(scored, ["qid"], [F.col("score"), F.col("doc")], KEYWORD_HITS).select("qid", "doc")

    wordless = own.where((F.size("phrases") == 0) & (F.size("tokens") > 0)).select("qid", "level", "mood", "since", F.slice("tokens", 1, TOKENS).alias("tokens"))
    has = lambda t: F.greatest(*[F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(t)) for c in columns])
    like = articles.join(F.broadcast(wordless), F.forall("tokens", has) & _allowed(articles)).select("qid", F.col("article_id").alias("doc"))
    return ranked.unionByName(_first(like, ["qid"], [F.col("doc")], KEYWORD_HITS))


def place_hits(asked: DataFrame, articles: DataFrame) -> DataFrame:
    """``qid, doc`` of the first articles of each question's first places."""
    wanted = asked.select("qid", "level", "mood", "since", F.explode(F.slice("locations", 1, PLACES)).alias("place"))
    names = articles.select("article_id", F.explode(F.array_distinct(F.concat(*[F.coalesce(F.col(c), F.expr("array()").cast("array<string>")) for c in PLACE_COLUMNS]))).alias("name"))
    # Names are few: a place is looked for in each distinct one.
    there = names.select("name").distinct().join(F.broadcast(wanted.select("place").distinct()), F.contains(F.lower("name"), F.lower("place")))
    held = names.join(there, "name").select("article_id", "place").distinct()
    rows = held.join(articles.drop("_n"), "article_id").join(wanted, "place").where(_allowed(articles))
    return _first(rows, ["qid", "place"], facets.by_severity(rows), PLACE_HITS).select("qid", F.col("article_id").alias("doc"))


def vector_hits(asked: DataFrame, articles: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``qid, doc, similarity`` of each question's nearest articles, of those that its
    filters allow and that are near enough. ``embed`` gives ``qid, embedding`` of
    ``qid, text``; the vectors are scanned once for each ``QUESTIONS`` questions."""
    text = F.when(F.col("search_query") != "", F.col("search_query")).otherwise(F.coalesce("question", F.lit("")))
    known = stored(embed(asked.select("qid", text.alias("text"))).join(asked.select("qid", "level", "mood", "since"), "qid"), "question_vectors")
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, doc {articles.schema['article_id'].dataType.simpleString()}, similarity double"
    rows = vectors.join(_facets_of(articles), vectors["article_id"] == F.col("doc")).select("doc", F.col("embedding").cast("array<double>").alias("embedding"), *[F.coalesce(F.col(c), F.lit("")) .alias(c) if c in articles.columns else F.lit("").alias(c) for c in ("threat_level", "sentiment", "published_at")])
    spark, found = asked.sparkSession, []
    total = known.count()
    numbered = known.withColumn("_at", F.row_number().over(Window.orderBy("qid")) - 1) if total > QUESTIONS else known.withColumn("_at", F.lit(0))
    for at in range(0, max(total, 1), QUESTIONS):
        some = numbered.where((F.col("_at") >= at) & (F.col("_at") < at + QUESTIONS)).toArrow()
        if not some.num_rows:
            return spark.createDataFrame([], schema)
        matrix = np.array(some["embedding"].to_pylist(), float)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        given = spark.sparkContext.broadcast((some["qid"].to_pylist(), matrix / np.where(norm > 0, norm, 1), *[np.array([x or "" for x in some[c].to_pylist()], object) for c in ("level", "mood", "since")]))

        def near(batches, given=given):
            qids, wanted, level, mood, since = given.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                sims = np.floor(x / np.where(norm > 0, norm, 1) @ wanted.T * 1e4 + 0.5) / 1e4
                has = [np.array(batch.column(i).to_pylist(), object)[:, None] for i in (2, 3, 4)]
                fits = ((level == "") | (has[0] == level)) & ((mood == "") | (has[1] == mood)) & ((since == "") | (has[2] >= since))
                fits &= sims >= LEAST_SIMILAR
                docs = np.array(batch.column(0).to_pylist())
                rows, at = [], []
                for q in np.flatnonzero(fits.any(axis=0)):
                    own = np.flatnonzero(fits[:, q])
                    own = own[np.lexsort((docs[own], -sims[own, q]))][:VECTOR_HITS]
                    rows.append(own)
                    at.append(np.full(len(own), q))
                if rows:
                    own, at = np.concatenate(rows), np.concatenate(at)
                    yield pa.RecordBatch.from_arrays([pa.array([qids[q] for q in at]), batch.column(0).take(pa.array(own)), pa.array(sims[own, at])], names=["qid", "doc", "similarity"])

        found.append(rows.mapInArrow(near, schema))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return _first(hits, ["qid"], [F.desc("similarity"), F.col("doc")], VECTOR_HITS)


def ranked(candidates: DataFrame, asked: DataFrame, articles: DataFrame) -> DataFrame:
    """``qid, article_id, rerank``: the first articles of each question, of
    ``candidates (qid, doc, keyword, location, similarity)``, by the composite score."""
    c = candidates.groupBy("qid", "doc").agg(F.sum("keyword").alias("keyword"), F.sum("location").alias("location"), F.max("similarity").alias("similarity"))
    low = lambda name: F.lower(F.coalesce(F.col(name), F.lit("")))
    lists = F.transform(F.filter(F.concat(*[F.coalesce(F.col(x), F.expr("array()").cast("array<string>")) for x in PLACE_COLUMNS]), lambda x: x.isNotNull()), F.lower)
    texts = articles.select("article_id", "threat_level", low("title").alias("_t"), low("summary").alias("_s"), low("article_text").alias("_x"), lists.alias("_p"))
    df = c.join(texts, F.col("doc") == F.col("article_id")).join(asked.select("qid", "search_terms", "locations"), "qid")
    similarity = F.coalesce("similarity", F.lit(0.0))

    def points(total: Column, term: Column) -> Column:
        t = F.lower(term)
        return total + F.when(F.contains(F.col("_t"), t), 5.0).when(F.contains(F.col("_s"), t), 3.0).when(F.contains(F.col("_x"), t), 0.5).otherwise(0.0)

    df = df.withColumn("_points", F.aggregate("search_terms", F.lit(0.0), points))
    base = 3.0 * F.col("keyword") + 2.0 * F.col("location") + F.when(similarity >= 0.40, 4 * similarity).otherwise(0.0) + F.col("_points")
    missing = (F.size("search_terms") > 0) & (F.col("_points") == 0) & (similarity < 0.45)
    there = F.arrays_overlap(F.col("_p"), F.transform("locations", F.lower))
    score = base - F.when(missing, 10.0).otherwise(0.0) + F.when(F.size("locations") == 0, 0.0).when(there, 4.0).otherwise(-6.0)
    boost = F.when(F.col("threat_level") == "CRITICAL", 1.5).when(F.col("threat_level") == "HIGH", 1.0).when(F.col("threat_level") == "MODERATE", 0.5).otherwise(0.0)
    df = df.withColumn("_score", score).withColumn("rerank", F.round(F.when(F.col("_score") >= 3, F.col("_score") + boost).otherwise(F.col("_score")), 6))
    least = F.when((F.size("search_terms") > 0) & (F.size("locations") > 0), 4.0).otherwise(3.0)
    return _first(df.where(F.col("rerank") >= least), ["qid"], [F.desc("rerank"), F.col("article_id")], ANSWERS).select("qid", "article_id", "rerank")


def retrieved(asked: DataFrame, articles: DataFrame, index: TextIndex, vectors: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, columns: tuple[str, ...] = ("title", "article_text")) -> DataFrame:
    """``qid, article_id, rerank``: what each parsed question finds, best first."""
    point = lambda df, keyword, place: df.withColumns({"keyword": F.lit(keyword), "location": F.lit(place)})
    none = F.lit(None).cast("double")
    found = point(keyword_hits(asked, articles, index, list(columns)), 1, 0).withColumn("similarity", none)
    found = found.unionByName(point(place_hits(asked, articles), 0, 1).withColumn("similarity", none))
    if vectors is not None:
        embed = embed or (lambda df: embedding.dense(df, "qid", "text"))
        found = found.unionByName(point(vector_hits(asked, articles, vectors, embed), 0, 0))
    return ranked(stored(found, "candidates"), asked, articles)


def answered(asked: DataFrame, hits: DataFrame, articles: DataFrame, order: list[Column], places: list[str], actors: list[str]) -> DataFrame:
    """One row a question: its kind, the brief of its articles, and their ids, best
    first. A question that finds nothing has no reports, and says so."""
    rows = articles.join(hits, "article_id")
    brief = briefs.synthesize(rows, ["qid"], order, ["title"], places, actors)
    ids = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rerank")).alias("s"), "article_id"))), lambda x: x["article_id"]).alias("articles"))
    subject = F.coalesce(F.get("locations", F.lit(0)), F.nullif(F.col("search_query"), F.lit("")), F.col("question"), F.lit(""))
    out = asked.select("qid", "question", "kind", subject.alias("subject")).join(brief, "qid", "left").join(ids, "qid", "left")
    nothing = F.replace(F.lit(briefs.NOTHING), F.lit("%s"), F.col("subject"))
    return out.withColumns({"reports": F.coalesce("reports", F.lit(0)), "assessment": F.coalesce("assessment", nothing), "articles": F.coalesce("articles", F.array().cast(rows.select(F.array("article_id")).schema[0].dataType))}).drop("subject")
