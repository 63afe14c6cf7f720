"""Engine, stages, index, clustering, streams and helpers beyond the queries."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_sources import server  # noqa: F401 - a fixture

import tidewire
from tidewire.functions import embedding, lexicon, severity
from tidewire.functions import vocabulary as V
from tidewire.operators import briefs, intent, leader, numbering, search
from tidewire.operators.index import TextIndex
from tidewire.plans import stages
from tidewire.sources import engine, files, reference, web
from tidewire.storage import Manifest
from tidewire.streaming import ingest as streams


def test_exports_and_intermediates(spark):
    assert all(getattr(tidewire, n) is not None for n in tidewire.__all__)
    with pytest.raises(AttributeError):
        tidewire.nothing  # noqa: B018


def test_engine_isolates_failures_and_inserts_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,title\n1,x\n2,y\n,\n3,z,surplus\n")
    (tmp_path / "b.json").write_text('[{"id": "1", "title": "x"}, {"id": "9", "title": "n"}]')
    config = {"storage": {"store": str(tmp_path / "store"), "dead": str(tmp_path / "dead")}, "sources": {"a": {"source_type": "csv", "file_path": str(tmp_path / "a.csv")}, "b": {"source_type": "json", "file_path": str(tmp_path / "b.json")}, "c": {"source_type": "sql", "path": str(tmp_path / "none")}, "off": {"source_type": "csv", "enabled": False}}}
    (tmp_path / "config.json").write_text(json.dumps(config))
    e = engine.Engine.from_config(spark, str(tmp_path / "config.json"))
    stats = {r.source_name: r for r in e.run().collect()}
    assert (stats["a"].validated, stats["a"].failed, stats["a"].inserted) == (2, 2, 2)
    # The same payload of another source is the same record.
    assert (stats["b"].inserted, stats["b"].skipped, stats["c"].status) == (1, 1, "aborted")
    assert e.totals() == {"attempted": 4, "inserted": 3, "skipped": 1, "failed": 2}
    assert e.records().count() == 3 and files.read_dead(spark, e.dead).count() == 2 == e.dead_letters().count()
    again = engine.Engine.from_config(spark, config, only="a")
    assert [s.name for s in again.sources] == ["a"] and again.run().first().inserted == 0
    assert [s.name for s in engine.sources_of(config, skip=("csv", "sql"))] == ["b"]
    assert engine.sources_of(config, {"OFF_ENABLED": "true"})[-1].name == "off"
    with pytest.raises(ValueError, match="telex"):
        e.register(engine.Source("x", "telex"))
    assert engine.REGISTRY.types() == ["csv", "events", "json", "rest", "rss", "sql"]


def _lines(tmp_path, *ids):
    path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
    path.write_text("\n".join('{"id": "%s", "v": "1"}' % i if i else "{broken" for i in ids))
    return {"source_type": "json", "file_path": str(path), "entity_type": "event"}


def test_a_run_killed_before_its_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    config = {"storage": {"store": str(tmp_path / "store"), "dead": str(tmp_path / "dead")}, "sources": {"a": _lines(tmp_path, "1", "2", "", "3")}}
    plain = Manifest.commit

    def killed(self, version, content):
        raise KeyboardInterrupt

    monkeypatch.setattr(Manifest, "commit", killed)
    e = engine.Engine.from_config(spark, config)
    with pytest.raises(KeyboardInterrupt):
        e.run()
    assert e.records() is None and e.dead_letters().count() == 0 and e.log().count() == 0
    monkeypatch.setattr(Manifest, "commit", plain)
    for inserted in (3, 0):
        assert [tuple(r)[2:8] for r in engine.Engine.from_config(spark, config).run().collect()] == [("success", 4, 3, 1, inserted, 3 - inserted)]
    assert e.records().count() == 3 and e.dead_letters().count() == 2 and e.log().count() == 2


def test_of_two_runs_at_once_each_record_is_kept_once(spark, tmp_path, monkeypatch):
    place = {"store": str(tmp_path / "store"), "dead": str(tmp_path / "dead")}
    one = engine.Engine.from_config(spark, {"storage": place, "sources": {"a": _lines(tmp_path, "1", "2")}})
    two = engine.Engine.from_config(spark, {"storage": place, "sources": {"a": _lines(tmp_path, "2", "3")}})
    plain, raced = Manifest.commit, []

    def commit(self, version, content):
        if not raced:
            raced.append(version)
            two.run()
        return plain(self, version, content)

    monkeypatch.setattr(Manifest, "commit", commit)
    assert one.run().first().inserted == 1
    assert sorted(r["entity_id"] for r in one.records().collect()) == ["1", "2", "3"]


def test_classes_of_errors(spark, server, tmp_path):
    assert [engine.error_type(e) for e in (web.Fatal("x"), web.Structural("x"), web.Transient("x"), TimeoutError(), ValueError("x"))] == ["fatal", "structural", "transient", "transient", "fatal"]
    config = {"sources": {
        "missing": {"source_type": "rest", "url": f"{server}/nowhere"},
        "broken": {"source_type": "rest", "url": f"{server}/broken"},
        "no file": {"source_type": "csv", "file_path": str(tmp_path / "none.csv")},
        "no table": {"source_type": "sql", "path": str(tmp_path / "none")},
    }}
    got = {r["source_name"]: (r["status"], r["error_type"]) for r in engine.Engine.from_config(spark, config).run().collect()}
    assert got == {"missing": ("aborted", "fatal"), "broken": ("aborted", "structural"), "no file": ("aborted", "fatal"), "no table": ("aborted", "fatal")}


def test_reference_tables_are_a_source(spark, tmp_path):
    rows = spark.createDataFrame([("A", "Aland", 1, "x"), ("B", "Bland", 0, "x"), ("A", "Zland", 1, "x"), (None, "C", 1, "x")], "id string, country_name string, nuclear_power int, other string")
    paths = reference.seed(spark, str(tmp_path), {"countries_of_interest": rows, "defence_assets": spark.createDataFrame([], "id int")})
    got = reference.reference_table(spark, str(tmp_path), "countries_of_interest")
    assert sorted((r["id"], r["country_name"], r["nuclear_power"], r["notes"]) for r in got.collect()) == [("A", "Aland", 1, None), ("B", "Bland", 0, None)]
    assert reference.reference_table(spark, str(tmp_path), "defence_assets").count() == 0
    with pytest.raises(ValueError, match="planets"):
        reference.seed(spark, str(tmp_path), {"planets": rows})
    e = engine.Engine(spark, str(tmp_path / "store"), str(tmp_path / "dead"))
    e.register(engine.Source("countries", "sql", "strategic_reference", "id", {"path": paths[0], "where": "nuclear_power = 1"}))
    assert e.run().first().inserted == e.records().count() == 1


def test_stages_resume(spark, tmp_path):
    ran = []

    def stage(name):
        def run(df):
            ran.append(name)
            return df.withColumn(name, F.lit(1))

        return name, run

    p = stages.Pipeline(spark, [stage("one"), stage("two")], str(tmp_path))
    assert p.run(spark.range(3)).columns == ["id", "one", "two"] and ran == ["one", "two"]
    p.run(spark.range(3), resume=True)
    assert ran == ["one", "two"] and set(p.seconds) == {"one", "two"}


def test_article_stages_judge(spark):
    rows = [("Cross-border firing at LAC", "Soldiers of the Indian Army were in Leh. " * 10, ""), ("Cricket", "A match was played in Mumbai today. " * 10, None), ("Short", "no", None)]
    out = stages.Pipeline(spark, stages.article_stages()).run(spark.createDataFrame(rows, "title string, article_text string, summary string"))
    got = {r.title: r for r in out.collect()}
    assert set(got) == {"Cross-border firing at LAC", "Cricket"}
    first = got["Cross-border firing at LAC"]
    assert first.threat_level == "CRITICAL" and first.states == ["Ladakh"] and "Western Himalayas" in first.regions and first.countries == ["India"]
    assert first.diplomatic_significance == "HIGH" and got["Cricket"].severity_rule == "civic" and first.organizations == ["Indian Army"]


def test_lexicon_equals_one_pattern_a_term(spark):
    import re

    terms = [*V.ORGANIZATIONS, *[t for g in V.EQUIPMENT.values() for t in g]]
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(terms + [t.lower() for t in terms] + ["xyz", "UNx", "(IB)", "Su-30MKIs"], 12)) for _ in range(150)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", lexicon.terms_in_text(F.col("t"), terms, keep_short=True).alias("f")).collect()}
    for i, t in enumerate(texts):
        want = {x for x in terms if re.search(rf"\b{re.escape(x if len(x) <= 4 else x.lower())}\b", (t or "") if len(x) <= 4 else (t or "").lower())}
        assert got[i] == sorted(want), t


def test_severity_overrides(spark):
    cases = {
        ("DAC approves guns", ""): "procurement", ("Ambush feared", "dac approves guns"): "baseline", ("Ransom paid", ""): "crime", ("Terror ransom", ""): "baseline",
        ("Ukraine war", ""): "foreign", ("Indian Army on Ukraine", ""): "baseline", ("Election rally", ""): "politics", ("Quiet", "bomb blast in manipur"): "critical",
        ("Quiet", "bomb blast somewhere"): "baseline", ("Quiet", "terror hideout busted, says DRDO"): "high", ("Malabar exercise", ""): "moderate", ("Quiet", "malabar exercise"): "baseline", (None, None): "baseline",
    }
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, title string, body string")
    got = {r.i: r.severity_rule for r in severity.severity(df, "title", "body").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


@pytest.mark.parametrize("threshold", [0.82, 0.6])
def test_hashed_clusters_equal_exact_ones(spark, threshold):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 48))
    x = centres[rng.integers(0, 60, 700)] + 0.35 * rng.standard_normal((700, 48))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    exact = {(r.a, r.b) for r in leader.similar_pairs(df, "id", "v", threshold).collect()}
    hashed = {(r.a, r.b) for r in leader.hashed_pairs(df, "id", "v", threshold).collect()}
    assert hashed <= exact and len(hashed) >= 0.999 * len(exact) and len(exact) > 1000
    one = {tuple(r) for r in leader.leader_clusters(df, "id", "v", threshold).select("id", "leader").collect()}
    two = {tuple(r) for r in leader.leader_clusters(df, "id", "v", threshold, exact=True).select("id", "leader").collect()}
    assert len(one & two) >= 0.99 * len(two) and len(two) == 700


def test_positions(spark):
    df = spark.range(1000).repartition(7).select("id", (F.col("id") % 3).alias("g"))
    assert all(r.n == r.id for r in numbering.numbered(df, ["id"], "n").collect())
    assert all(r.n == r.id // 3 for r in numbering.numbered_within(df, "g", ["id"], "n").collect())
    assert numbering.numbered(df.limit(0), ["id"], "n").count() == 0


def test_index_versions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "b"), (3, None)], "id long, t string")
    index = TextIndex(spark, str(tmp_path / "i"), "id", ["t"], 4)
    assert not index.exists()
    index.update(docs)
    hits = lambda p: sorted((r.doc, r.size, list(r.f)) for r in index.hits(p).collect())
    assert hits([["a", "b"], ["b"]]) == [(1, 4, [2, 2]), (2, 1, [0, 1])]
    index.update(spark.createDataFrame([(2, "a b"), (4, "a")], "id long, t string"), docs.where("id = 1").select("id"))
    assert hits([["a", "b"], ["a"]]) == [(2, 2, [1, 1]), (4, 1, [0, 1])] and index.sizes().count() == 3
    found = search.text_search(docs, "id", ["t"], ["a b"], 5, index)
    assert [r.doc for r in found.collect()] == [2]
    assert search.phrases_of(["Line of Control", "!!", "x"]) == [["line", "of", "control"], ["x"]]


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, k string"
    for i, rows in enumerate([[("2024-01-01 10:00:00", "a"), ("2024-01-01 12:30:00", "a")], [("2024-01-01 15:00:00", "b")], [("2024-01-01 10:01:00", "late"), ("2024-01-01 18:00:00", "end")]]):
        spark.createDataFrame(rows, "ts string, k string").select(F.to_timestamp("ts").alias("ts"), "k").coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        part = next((tmp_path / f"in{i}").glob("part-*"))
        part.rename(tmp_path / "in" / f"{i}.parquet")
        import os

        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = streams.window_counts(stream, "ts", ["k"], "1 hour", "10 minutes")
    query = counts.writeStream.outputMode("append").format("memory").queryName("late_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {(str(r.window_start), r.k): r.n for r in spark.table("late_rows").collect()}
    assert rows == {("2024-01-01 10:00:00", "a"): 1, ("2024-01-01 12:00:00", "a"): 1, ("2024-01-01 15:00:00", "b"): 1}


def test_clients_and_models_fall_back():
    def fails(question):
        raise OSError("no network")

    rules = lambda q: {"kind": "general_search", "q": q}
    assert intent.with_parser("x", None, rules) == intent.with_parser("x", fails, rules) == intent.with_parser("x", lambda q: None, rules) == rules("x")
    assert intent.with_parser("x", lambda q: {"kind": "k"}, rules) == {"kind": "k"}
    assert intent.parse_answer('```json\n{"a": [1]}\n```') == {"a": [1]} and intent.parse_answer("{broken") is None and intent.parse_answer(None) is None
    assert embedding.Lazy(lambda: 5).get() == 5 and embedding.Lazy(lambda: 1 / 0).get() is None


def test_digest_page(spark, tmp_path):
    chosen = spark.createDataFrame([("a<b", 1, "<p>x</p>", 0)], "category string, rank int, s string, position int")
    page = briefs.digest_page(briefs.sections(chosen, "category", F.col("s"), as_html=True), "News & more", "now")
    assert page.startswith("<!DOCTYPE html>") and "<h2>a&lt;b</h2><p>x</p>" in page and "News &amp; more" in page
    briefs.save_text(spark, page, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d"), wholetext=True).count() == 1


def test_dense_vectors(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, t string")
    rows = embedding.dense(docs, "id", "t", 16).collect()
    assert [r.id for r in rows] == [1] and abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-6
