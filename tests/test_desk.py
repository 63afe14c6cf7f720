"""The facade over the article view, and the store helpers."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.operators import store
from tidewire.plans.articles import articles
from tidewire.plans.desk import Desk, OutOfBounds

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def desk(spark):
    records = spark.createDataFrame([("a",), ("a",), ("c",)], "source_name string")
    dead = spark.createDataFrame([("CSV", "2020", "a"), ("JSON", "2021", "b")], "source_type string, timestamp string, error_message string")
    return Desk(articles(spark, ROOT).cache(), "2030-01-01", records, dead)


def test_every_query_runs(desk):
    total = desk.all.count()
    assert desk.health().first().articles == total == desk.kpis()["kpis"].first().total
    assert desk.articles(10, 5).count() == 10 and desk.articles(level="high").where("threat_level <> 'HIGH'").count() == 0
    assert {r.threat_level for r in desk.priority().collect()} <= {"HIGH", "CRITICAL"}
    assert desk.monitoring(7).count() == 7 and desk.review().where("requires_human_review <> 1").count() == 0
    assert all(d.count() > 0 for d in desk.locations().values())
    assert desk.entities().collect() == desk.entities("nonsense").collect() != []
    assert desk.sources().agg(F.sum("articles")).first()[0] == total and desk.map().count() == 0
    assert desk.trends()["days"].count() == 0 and desk.categories().agg(F.sum("n")).first()[0] == total
    one = desk.at(3).first()
    assert desk.article(one.article_id).count() == 1 and desk.legacy("CLICK").where("category <> 'click'").count() == 0
    assert desk.stories(["click"]).where("article_type = 'click'").agg(F.min("position")).first()[0] == 0
    assert desk.digest().count() == total


def test_briefs(desk):
    assert desk.daily_brief().first().reports == 30
    assert desk.situation_brief("state3 Sector", []).first().reports == 20
    assert desk.country_brief("en vs de").first().reports == 50
    assert desk.country_brief("").count() == 0 == desk.situation_brief("nowhere at all", ["x"]).count()
    found = desk.ask("what is new", lambda q: {"level": "HIGH"}, lambda i: desk.articles(5, **i)).first()
    assert found.reports == 5 and found.trend == "Escalating"


def test_records_and_dead_letters(spark, desk):
    configured = spark.createDataFrame([("a",), ("b",)], "source_name string")
    assert {(r.source_name, r.configured, r.n) for r in desk.ingestion_sources(configured).collect()} == {("a", True, 2), ("b", True, 0), ("c", False, 1)}
    assert desk.dead_letters(source_type="CSV").count() == 1


def test_bounds(desk):
    for call in (lambda: desk.articles(0), lambda: desk.articles(501), lambda: desk.trends(366), lambda: desk.ask("", None, None)):
        with pytest.raises(OutOfBounds):
            call()


def test_store_helpers(spark, tmp_path):
    a = spark.createDataFrame([(1, None), (2, "a long summary")], "article_id int, s string")
    assert [r[0] for r in a.orderBy("article_id").select(store.keep_or("s", F.lit("new"), 5)).collect()] == ["new", "a long summary"]
    assert store.grow(a, StructType().add("s", "integer").add("x", "double")).dtypes == [("article_id", "int"), ("s", "string"), ("x", "double")]
    store.labelling_file(a, str(tmp_path / "l"), ["article_id", "s"])
    assert spark.read.option("header", True).csv(str(tmp_path / "l")).columns == ["article_id", "s", "gold_category", "annotation_notes"]
