"""The language rules with the production word lists."""

from pyspark.sql import functions as F

from tidewire.functions import places, rules
from tidewire.functions import vocabulary as V


def test_keywords_and_topics(spark):
    d = spark.createDataFrame([("The LAC border drill, a nuclear DEAL", ["Rafale"], ["China"]), ("lac loc", None, None), (None, [], [])], "t string, e array<string>, c array<string>")
    got = d.select(rules.terms_in(F.col("t"), V.KEYWORDS, 20).alias("k"), "e", "c")
    rows = got.select("k", rules.topics_of(F.col("e"), F.col("k"), F.col("c"), V.TOPICS).alias("topics")).collect()
    assert rows[0].k == ["border", "LAC", "drill", "nuclear"]  # short words keep their case
    assert rows[0].topics == ["Border Security", "Fighter Aircraft", "India-China Relations", "Military Exercises", "Nuclear Affairs"]
    assert [(r.k, r.topics) for r in rows[1:]] == [([], []), ([], [])]


def test_events(spark):
    d = spark.createDataFrame([("A joint exercise and Exercise Malabar began; ceasefire violation reported",), ("",), (None,)], "t string")
    rows = [r.e for r in d.select(rules.events_in(F.col("t"), V.EVENTS).alias("e")).collect()]
    assert [(e.event_type, e.phrases) for e in rows[0]] == [("Military Exercise", ["joint exercise", "exercise malabar"]), ("Border Incident", ["ceasefire violation"])]
    assert rows[1] == [] and not rows[2]


def test_location_types_and_targets(spark):
    d = spark.createDataFrame([("near the frontier", None, [], []), ("quiet", "pass", [], []), ("quiet", None, ["Sikkim"], []), ("quiet", None, [], ["X"]), (None, None, [], [])], "t string, s string, states array<string>, cities array<string>")
    kinds = d.select(places.location_type(F.col("t"), F.col("s"), V.LOCATION_TYPES, V.BORDER_STATES)).collect()
    assert [r[0] for r in kinds] == ["border_area", "pass", "border_area", "city", "unknown"]
    none = F.lit(None).cast("array<string>")
    rows = d.select(places.sentiment_target(F.lit("Budget talks"), F.col("t"), V.TARGETS, none, none, none)).collect()
    assert {r[0] for r in rows} == {"Policy"}


def test_plain_terms_equal_those_of_a_cleaned_text(spark):
    texts = ["that", "xthat that", "éthat", "that_ that9", "THAT Nowhere", "a nowhere-b", "of-the x", "of the", "nothing", "", None, "9that that", "that\U0001f600", "to be", "ofxthe xof the"]
    terms = ["nowhere", "that", "of the", "to"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = rules.plain_terms_in(F.col("t"), terms, 3)
    got = d.select(plain.alias("a"), rules.terms_in(F.regexp_replace("t", "[^A-Za-z0-9]", " "), terms, 3).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(map(len, (r.a for r in got))) > 10


def test_keywords_are_sought_without_a_copy_of_the_text(spark):
    from tidewire.plans import language

    plan = language.keyword_matches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_one_pass_tells_whether_a_text_has_events(spark):
    from tidewire.functions import entities

    patterns = [p for of_kind in V.EVENTS.values() for p in of_kind]
    depth = lambda p: [p[:i].count("(") - p[:i].count(")") for i, c in enumerate(p) if c == "|"]
    assert all(min(depth(p), default=1) > 0 for p in patterns)  # a word's edge holds for all of a pattern
    texts = ["a WAR games day", "xwar games", "a Joint  Exercise; a joint exercise", "quiet", "", None, "border\nclash", "joint\u00e9 exercise"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    none = F.lit(None).cast("array<string>")
    df = d.select(entities.events(F.lit(None).cast("string"), F.col("t"), none, none, none, none, none, none).alias("e"), F.array(*[F.coalesce(F.col("t").rlike(f"(?i){p}"), F.lit(False)) for p in patterns]).alias("any"))
    rows = df.collect()
    assert [bool(r.e) for r in rows] == [any(r.any) for r in rows] == [True, False, True, False, False, False, True, False]
    assert rows[3].e == rows[5].e == [] and rows[2].e[0].matched_phrases == ["Joint  Exercise", "joint exercise"]
    assert df.select("e")._jdf.queryExecution().optimizedPlan().toString().startswith("Project [CASE WHEN RLIKE(")
