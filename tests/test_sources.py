"""File, database and web sources, dead letters, and the streamed store."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidewire.operators import briefs, ingest, intent
from tidewire.sources import files, web
from tidewire.streaming import ingest as streams


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("sep", files.DELIMITERS)
def test_csv_of_each_delimiter(spark, tmp_path, sep):
    lines = [["id", "title", "note"], ["1", " a ", ""], ["2", '"b' + sep + 'c"', "x"], ["3", "d", "e", "f"], ["4"]]
    path = put(tmp_path / "a.csv", "\n".join(sep.join(x) for x in lines) + "\n", "utf-8-sig")
    rows = sorted(files.csv_rows(spark, path).collect(), key=lambda r: r.payload["id"])
    assert [r.payload for r in rows] == [{"id": "1", "title": "a"}, {"id": "2", "title": f"b{sep}c", "note": "x"}, {"id": "3", "title": "d", "note": "e"}, {"id": "4"}]
    assert [r.error is not None for r in rows] == [False, False, True, False]


def test_empty_csv_and_repeated_names(spark, tmp_path):
    assert files.csv_rows(spark, put(tmp_path / "e.csv", "")).count() == 0
    rows = files.csv_rows(spark, put(tmp_path / "h.csv", "a,a,\n1,2,\n")).collect()
    assert rows[0].payload == {"a": "1", "a_1": "2"}


def test_json_lists_and_lines(spark, tmp_path):
    items = [{"id": 1, "a": {"b": 2, "c": {"d": 3}}, "t": ["x"]}, {"id": 2, "a": None}]
    want = [{"id": "1", "a.b": "2", "a.c": '{"d":"3"}', "t": '["x"]'}, {"id": "2"}]
    for name, text in (("l.json", "\n".join(map(json.dumps, items))), ("a.json", "\n " + json.dumps(items, indent=1))):
        rows = files.json_rows(spark, put(tmp_path / name, text)).collect()
        assert sorted((r.payload for r in rows), key=lambda p: p["id"]) == want
    bad = files.json_rows(spark, put(tmp_path / "c.json", '[{"id": 1}, 5]'))
    assert bad.where("error IS NULL").count() == 1 and bad.where("error IS NOT NULL").count() == 1
    bad = files.json_rows(spark, put(tmp_path / "b.json", '{"id": 1}\nnot json\n'))
    assert bad.where("error IS NULL").count() == 1 and bad.where("error IS NOT NULL").count() == 1


def test_database_table(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(1, "a"), (2, None)], "ID int, NAME string").write.format("jdbc").option("url", url).option("dbtable", "T").save()
    assert [r.payload for r in files.jdbc_rows(spark, url, "T").orderBy(F.col("payload")["ID"]).collect()] == [{"ID": "1", "NAME": "a"}, {"ID": "2"}]
    assert files.jdbc_rows(spark, url, "T", "ID > 1").count() == 1


def test_dead_letters(spark, tmp_path):
    rows = files.csv_rows(spark, put(tmp_path / "a.csv", "id\n1,2\n3\n"))
    path = str(tmp_path / "dead")
    files.append_dead(files.dead_of(rows, "CSV", "s"), path)
    files.append_dead(files.dead_of(rows, "JSON", "s"), path)
    put(tmp_path / "dead" / "part-x.json", "broken\n")
    assert files.read_dead(spark, path).count() == 2
    assert [json.loads(r.raw_record) for r in files.read_dead(spark, path, "CSV").collect()] == [{"id": "1"}]
    files.clear_dead(spark, path)
    assert files.read_dead(spark, path).count() == 0


def test_gold_rows_and_stored_records(spark, tmp_path):
    path = put(tmp_path / "g.csv", "article_id,predicted_category,gold_category\n1, a ,b\n2,a,z\n3,,a\n")
    assert [(r.predicted_category, r.gold_category) for r in files.gold_rows(spark, path, ["a", "b"]).collect()] == [("a", "b")]
    spark.createDataFrame([("CSV", "e"), ("SQL", "e")], "source_type string, entity_type string").write.parquet(str(tmp_path / "r"))
    assert files.read_records(spark, str(tmp_path / "r"), "CSV", "e").count() == 1
    assert files.read_records(spark, str(tmp_path / "r"), limit=1).count() == 1


def test_configuration():
    config = {"a": {"rows": 1}, "b": {"enabled": False}, "c": {}}
    assert files.enabled(config, {"A_ROWS": "9"}) == {"a": {"rows": "9"}, "c": {}}
    assert files.enabled(config, {"B_ENABLED": "true", "C_ENABLED": "no"}, ["b", "c"]) == {"b": {}}


class Handler(BaseHTTPRequestHandler):
    failures: dict = {}
    answers: dict = {}  # by topic; 204: a header without rows
    asked: list = []

    def do_GET(self):
        path = self.path.split("?")[0]
        left = Handler.failures.get(path, [])
        code = left.pop(0) if left else 200
        port = self.server.server_port
        pages = {
            "/p1": {"data": [{"id": 1}, {"id": 2}], "next": f"http://127.0.0.1:{port}/p2"},
            "/p2": {"data": [{"id": 3}], "next": None},
            "/odd": {"rows": []},
            "/topics": {},
            "/ind": [{"pages": 2}, [{"n": self.path.rsplit("page=", 1)[-1]}]],
        }
        body = "<rss><item><title>T</title><link>http://x</link></item></rss>" if path == "/feed" else "{" if path == "/broken" else json.dumps(pages.get(path, []))
        if path == "/topics":
            topic = self.path.split("query=")[1].split("&")[0]
            Handler.asked.append(topic)
            code = Handler.answers.get(topic, 500)
            body = "URL,URL_mobile,Date,Title\n" + (f'http://e/{topic},,20240102T030405Z,"a, ""b""\nc"\n' if code == 200 else "")
            code = 200 if code == 204 else code
        self.send_response(code if path in pages or path in ("/feed", "/broken") else 404)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_pages_of_a_service(spark, server):
    Handler.failures["/p2"] = [429, 500]
    rows = web.scan(spark, web.RestSource, url=f"{server}/p1", data_key="data", next_page_key="next", first_wait=0.01)
    assert sorted(r.payload["id"] for r in web.payload_of(rows).collect()) == ["1", "2", "3"]


@pytest.mark.parametrize("path", ["odd", "broken", "gone"])
def test_pages_that_fail(spark, server, path):
    with pytest.raises(Exception, match="Structural|Fatal"):
        web.scan(spark, web.RestSource, url=f"{server}/{path}", data_key="data", first_wait=0.01).collect()


def test_retry_ends():
    calls = []

    def fail():
        calls.append(1)
        raise web.Transient("down")

    with pytest.raises(web.Fatal):
        web.with_retry(fail, 0)
    assert len(calls) == web.ATTEMPTS


def test_indicator_pages_are_partitions(spark, server):
    rows = web.scan(spark, web.IndicatorSource, url=f"{server}/ind", first_wait=0.01)
    assert rows.rdd.getNumPartitions() == 2
    assert sorted(json.loads(r.value)["n"] for r in rows.collect()) == ["1", "2"]


def test_feeds_of_which_one_is_down(spark, server):
    rows = web.bodies(spark, {"a": f"{server}/feed", "b": f"{server}/gone"}, first_wait=0.01)
    assert [(r.source_feed, r.title, r.link) for r in web.feed_entries(rows, 5, "now").collect()] == [("a", "T", "http://x")]
    with pytest.raises(web.Fatal):
        web.bodies(spark, {"b": f"{server}/gone"}, first_wait=0.01)


def test_odd_feeds(spark):
    atom = '<feed><entry><title>A</title><link rel="x" href="http://a"/><updated>2026-01-02T03:04:05Z</updated><category>k</category></entry><entry><summary>none</summary></entry></feed>'
    lenient = "<rss><item><title>B</title><link/>http://b <description>d<p>e</description></item><item><title>C"
    dateless = "<rss><item><title>D</title></item></rss>"
    rows = web.feed_entries(spark.createDataFrame([("a", atom), ("l", lenient), ("d", dateless), ("n", None), ("e", "")], "tag string, value string"), 10, "2026-05-05").orderBy("source_feed").collect()
    assert [(r.source_feed, r.title, r.link, r.published) for r in rows] == [("a", "A", "http://a", "2026-01-02T03:04:05+00:00"), ("d", "D", "", "2026-05-05"), ("l", "B", "http://b", "2026-05-05")]
    assert rows[0].tags == ["k"] and len(rows[1].id) == 32 and rows[2].summary == "d e"


def test_events_of_topics_and_of_the_cache(spark, tmp_path):
    bodies = spark.createDataFrame([("t2", "url,m,s,t\nhttp://a,,20260909T120000Z,x\nshort,1"), ("t1", "http://a,,soon,y\n\nhttp://b,,,z,,,,,,extra"), ("t3", None)], "tag string, value string")
    got = {r.url: (r.query_topic, r.seendate, r.title) for r in web.event_rows(bodies, ["t1", "t2", "t3"]).collect()}
    assert got == {"http://a": ("t1", "soon", "y"), "http://b": ("t1", "", "z")}
    path = put(tmp_path / "c.csv", "URL,Date,Title\nhttp://a,20260909,x\nhttp://a,1,y\nftp://c,1,z\n")
    assert [(r.url, r.seendate, r.language, r.query_topic) for r in web.cached_events(spark, path, "any").collect()] == [("http://a", "20260909", "English", "any")]


def test_streamed_store_is_idempotent(spark, tmp_path):
    src, store, dead = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "dead")
    src.mkdir()
    schema = "payload map<string,string>"

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        records = ingest.to_records(stream, "JSON", "s", "event", "id", [])
        streams.store_stream(spark, records, store, dead, str(tmp_path / checkpoint)).awaitTermination()

    put(src / "a.json", '{"payload": {"id": "1"}}\n{"payload": {"id": "1"}}\n{"payload": {}}\n')
    run("c")
    put(src / "b.json", '{"payload": {"id": "1"}}\n{"payload": {"id": "2"}}\n')
    run("c")
    ids = lambda: sorted(r.entity_id for r in spark.read.parquet(store).collect())
    assert ids() == ["1", "2"] and spark.read.json(dead).count() == 1
    run("another")  # everything again, from the start
    assert ids() == ["1", "2"]


def test_late_rows_and_duplicates_of_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put(src / "a.json", "\n".join(json.dumps({"entity_id": "a", "checksum": "x", "at": f"2026-01-01T00:0{m}:00Z"}) for m in (0, 1, 2)))
    stream = spark.readStream.schema("entity_id string, checksum string, at timestamp").json(str(src))
    out = streams.distinct_records(stream, "at", "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_digest_text_and_file(spark, tmp_path):
    rows = [("k", "t1", "s", 0.5, "One. Two.", "u", "2026-01-01"), ("k", None, None, None, None, None, "2026-01-02"), (None, "x", "s", 0.1, "z", "u", "2026-01-03")]
    a = spark.createDataFrame(rows, "c string, title string, source string, conf double, text string, url string, at string")
    chosen = briefs.stories(a, "c", [F.desc("at")], ["k"])
    parts = briefs.sections(chosen, "c", briefs.story_markdown(F.col("title"), F.col("source"), F.col("conf"), F.col("text"), F.col("url")))
    text = briefs.digest_text(parts, "News", "today")
    assert text.startswith("# News\n\n**Generated:** today\n\n**Stories:** 2\n\n---\n\n## k\n\n### Untitled\n\n**Source:** Unknown source  \n**Classification confidence:** 0.0%  \n\nSummary unavailable.\n")
    assert "### t1\n\n**Source:** s  \n**Classification confidence:** 50.0%  \n\nOne. Two.\n\n[Read original article](u)\n" in text
    briefs.save_text(spark, text, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d"), wholetext=True).first()[0].rstrip("\n") == text.rstrip("\n")


def test_brief_selection_and_empty_input(spark):
    a = spark.createDataFrame([(1, "2026-01-01"), (2, "2026-01-02")], "id int, at string")
    order = [F.desc("at")]
    assert [r.id for r in briefs.or_unfiltered(a.where("at > '2026-01-01'"), a, order, 5, 1).collect()] == [2]
    assert [r.id for r in briefs.or_unfiltered(a.where("at > '2027'"), a, order, 5, 1).collect()] == [2]


def test_filters_and_routes():
    row = {"threat_level": "HIGH", "sentiment": None, "days": 7}
    assert intent.filters_of(row, "2026-03-03") == {"level": "HIGH", "since": "2026-02-24"}
    handlers = {"general_search": lambda q: ("general", q), "trend_analysis": lambda q: ("trend", q)}
    assert intent.route("trend_analysis", handlers, "q") == ("trend", "q") and intent.route("odd", handlers, "q") == ("general", "q")


def _search(spark, server, answers, cache=None):
    Handler.answers, Handler.asked[:] = answers, []
    rows = web.search_events(spark, f"{server}/topics", ["t1", "t2", "t3", "t4"], cache=cache, first_wait=0.01, attempts=1, between=0.01).collect()
    return sorted((r["url"].rsplit("/", 1)[1], r["title"], r["query_topic"]) for r in rows), [t.split("%22")[1] if "%22" in t else t for t in Handler.asked]


def _answers(**codes):
    return {f"%22{t}%22+sourcelang%3Aenglish": c for t, c in codes.items()}


def test_events_with_one_failure_go_on(spark, server, tmp_path):
    rows, asked = _search(spark, server, _answers(t1=500, t2=200, t3=500, t4=500), str(tmp_path / "c"))
    title = 'a, "b"\nc'
    assert asked == ["t1", "t2", "t3", "t4"] and rows == [("%22t2%22+sourcelang%3Aenglish", title, "t2")]
    # What was found is the cache of the next scan.
    rows, asked = _search(spark, server, _answers(), str(tmp_path / "c"))
    assert asked == ["t1", "t2"] and [(r[1].split("\n")[0], r[2]) for r in rows] == [('a, "b"', "t2")]


def test_a_service_that_is_down_is_not_asked_on(spark, server, tmp_path):
    with pytest.raises(web.Fatal):
        _search(spark, server, _answers(t4=200))
    assert len(Handler.asked) == 2
    with pytest.raises(web.Fatal):
        _search(spark, server, _answers(t1=204, t2=204, t3=204, t4=204), str(tmp_path / "none"))
    assert len(Handler.asked) == 4  # it answered, with nothing
    with pytest.raises(web.Fatal):
        _search(spark, server, _answers(t1=204, t2=500, t3=500, t4=200))
    assert len(Handler.asked) == 3


def test_a_refused_scan_ends_at_once(spark, server):
    with pytest.raises(Exception, match="Fatal"):
        _search(spark, server, _answers(t1=403, t2=200))
    assert len(Handler.asked) == 1
