"""Models in tasks: one load a worker, halved batches, fallbacks."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import categories, models
from tidewire.functions import vocabulary as V
from tidewire.plans import stages


def made():
    """A function that goes to the workers by value."""

    def lengths(texts):
        if any("bad" in t for t in texts):
            raise MemoryError("a batch that does not fit")
        return [{"length": float(len(t)), "batch": float(len(texts))} for t in texts]

    return lengths


def test_a_worker_loads_once_and_a_bad_text_costs_only_itself(spark):
    loads, lengths = spark.sparkContext.accumulator(0), made()
    model = models.Model("lengths", lambda: lengths, batch=8, loads=loads)
    texts = [None if i % 50 == 7 else "bad" if i % 50 == 9 else "x" * (i % 13) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rows = models.with_scores(df, "t", "s", model, lambda t: F.create_map(F.lit("length"), F.lit(-1.0))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r in rows:
        good = r["t"] is not None and "bad" not in r["t"]
        assert r["s"]["length"] == (len(r["t"]) if good else -1.0) and r["s_by"] == ("lengths" if good else "fallback")
        assert not good or r["s"]["batch"] <= 8
    assert len(rows) == 600 and 1 <= loads.value <= 8  # workers, not its 36 batches or more


def test_a_model_that_cannot_be_loaded_or_answers_wrongly(spark):
    def broken():
        raise OSError("no weights")

    df = spark.createDataFrame([("a",), ("b",)], "t string")
    loads = spark.sparkContext.accumulator(0)
    for model in (models.Model("none", broken, loads=loads), models.Model("short", lambda: lambda texts: [])):
        got = models.with_scores(df, "t", "s", model, lambda t: F.create_map(t, F.lit(1.0)))
        assert sorted(tuple(r) for r in got.select("t", F.map_keys("s")[0], "s_by").collect()) == [("a", "a", "fallback"), ("b", "b", "fallback")]
    assert 1 <= loads.value <= 4


def test_the_stage_of_labels_takes_a_model(spark):
    label, other = V.CATEGORIES[3], V.CATEGORIES[0]
    model = models.Model("labels", lambda: lambda texts: [None if "quiet" in t else {label: 0.9, other: 0.2} for t in texts])
    df = spark.createDataFrame([("loud", "text", ""), ("quiet", "text", "")], "title string, article_text string, summary string")
    got = {r["title"]: r for r in stages.classified(df, model).collect()}
    plain = {r["title"]: r for r in stages.classified(df).collect()}
    assert got["loud"]["category"] == label and got["loud"]["category_confidence"] == 0.9 and got["quiet"] == plain["quiet"]
    text = categories.label_text(F.lit("quiet"), F.lit("text"), F.lit(""))
    assert df.select(categories.overlap_scores(text, V.CATEGORIES)).first() is not None


def test_halving_ends(monkeypatch):
    monkeypatch.setattr(models, "_LOADED", {})
    calls = []

    def predict(texts):
        calls.append(len(texts))
        return made()(texts)

    got = models.Model("m", lambda: predict).predict(["a"] * 5 + ["bad"] + ["b"] * 10)
    assert [g is None for g in got] == [False] * 5 + [True] + [False] * 10 and len(calls) <= 9
    with pytest.raises(TypeError):
        models.Model()
