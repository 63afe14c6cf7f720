"""Every operator against a brute-force version, and on odd tables."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import ann, decontaminate, neardup, packing, pii, quality, sharding, toxicity, urlfilter, warc
from tidewire.llm.common import new_path

DOCS = "doc_id long, text string, lang string"


def odd_documents(spark, prose):
    """Nulls, empty and very long texts, repeated rows, clashing column names."""
    long = prose(1, 30_000)
    rows = [(1, None, None), (2, "", "en"), (3, "word", "en"), (3, "word", "en"), (None, "no key here", "en"), (4, long, None), (5, long, "de")]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("start", "size", "shard", "slot", "id", "key", "score", "bucket", "u", "v"):
        df = df.withColumn(name, F.lit("extra"))
    return df, rows


# 1 -----------------------------------------------------------------------------


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark, prose):
    rng = random.Random(5)
    items = [(i, prose(100 + i, 18)[:110]) for i in range(6)]
    texts = []
    for d in range(40):
        text, item = prose(200 + d, 60), items[d % 6][1]
        if d % 2:
            edited = list(item)
            for _ in range(rng.randint(0, 16)):
                edited[rng.randrange(len(edited))] = rng.choice("abcxyz")
            at = rng.randrange(len(text))
            text = text[:at] + " " + "".join(edited).upper() + "\n" + text[at:]
        texts.append((d, text))
    index = decontaminate.Index(items)
    normal = lambda t: "".join(map(chr, decontaminate.normalise([t])[0][:-1])).strip()
    want = {(d, i) for d, t in texts for i, b in items if edit_distance_inside(normal(b), normal(t)) <= int(len(normal(b)) * decontaminate.BUDGET)}
    got = decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    assert len(index.passages) == 6
    by_id = dict(texts)
    for r in got:
        assert edit_distance_inside(normal(dict(items)[r.item_id]), normal(by_id[r.doc_id][r.start : r.end])) == r.edits


def test_leaks_of_odd_tables(spark, prose):
    docs, _ = odd_documents(spark, prose)
    item = spark.createDataFrame([(1, prose(1, 30)), (2, None), (3, "tiny"), (4, " ."), (None, "x" * 50)], "item_id long, text string")
    found = decontaminate.leaks(docs, item).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(4, 1), (5, 1)]
    # Repeated documents give repeated rows, equal items are each reported.
    twice = decontaminate.leaks(docs.unionByName(docs), item.unionByName(spark.createDataFrame([(9, prose(1, 30))], item.schema))).collect()
    assert sorted((r.doc_id, r.item_id) for r in twice) == [(4, 1)] * 2 + [(4, 9)] * 2 + [(5, 1)] * 2 + [(5, 9)] * 2
    assert decontaminate.leaks(docs.limit(0), item).count() == 0
    assert decontaminate.leaks(docs, item.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, item).columns == docs.columns
    assert decontaminate.without_leaks(docs, item).count() == 5


def test_every_passage_of_a_long_item_is_found(spark, prose):
    rng = random.Random(11)
    items = [(i, prose(700 + i, 90)[:n]) for i, n in enumerate((250, 394, 130, 3000))]
    quotes = [(d, *items[d % 4]) for d in range(80)]
    texts = []
    for d, _, whole in quotes:
        at = rng.randrange(len(whole) - 119)
        quote = list(whole[at : at + 120])
        for _ in range((d % 3) * 3):
            quote[rng.randrange(len(quote))] = rng.choice("xyz")
        text = prose(800 + d, 80)
        cut = rng.randrange(len(text))
        texts.append((d, text[:cut] + "".join(quote) + text[cut:]))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d, i, _ in quotes}
    assert decontaminate.without_leaks(docs, benchmark).count() == 0


def test_passages_equal_brute_force(prose):
    rng = random.Random(12)
    item = prose(900, 60)[:170]
    index = decontaminate.Index([(1, item)])
    for d in range(40):
        quote = list(item[(at := rng.randrange(60)) : at + rng.randrange(95, 125)])
        for _ in range(rng.randint(0, 12)):
            quote[rng.randrange(len(quote))] = rng.choice(["", "x", "yz"])
        text = prose(950 + d, 8) + "".join(quote) + prose(990 + d, 8)
        normal = "".join(map(chr, decontaminate.normalise([text])[0][:-1]))
        want = any(edit_distance_inside(item[s : s + 120], normal) <= 12 for s in range(51))
        assert bool(decontaminate.find_places([text], index)[0]) == want


@pytest.mark.parametrize("n", [10, 13, 15, 20, 23, 30, 31])
def test_short_items_are_found_with_all_their_edits(n):
    item = "abcdefghijklmnopqrstuvwxyz0123456789"[:n]
    e = int(n * decontaminate.BUDGET)
    index = decontaminate.Index([(1, item)])
    for shift in range(-2, 3):
        quote = list(item)
        for j in range(1, e + 1):
            quote[j * n // (e + 1) + (shift if e == 1 else 0)] = "ßé"[j % 2]
        places = decontaminate.find_places(["one two " + "".join(quote) + " three"], index)[0]
        assert [(p[0], p[3]) for p in places] == [(1, e)]
    assert decontaminate.find_places(["nothing of it in here"], index) == [[]]


def test_items_of_every_length_equal_brute_force():
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(n, "".join(rng.choice(letters) for _ in range(n))) for n in range(1, 131)]
    index = decontaminate.Index(items)
    texts, want = [], []
    for n, item in items:
        e = int(min(n, 120) * decontaminate.BUDGET)
        for edits in {0, 1, e // 2, e, e + 1, e + 2}:
            for _ in range(3):
                quote = list(item)
                for at in rng.sample(range(n), min(n, edits)):
                    quote[at] = rng.choice(["", "9", quote[at] + "8"])
                text = "7777 " + "".join(quote) + " 6666"
                if n < decontaminate.Q:
                    near = item in text.split()
                else:
                    near = any(edit_distance_inside(item[s : s + 120], text) <= e for s in range(max(1, n - 119)))
                texts.append(text)
                want.append((n, near))
    found = decontaminate.find_places(texts, index)
    for text, (n, near), places in zip(texts, want, found, strict=True):
        assert any(p[0] == n for p in places) == near, (n, text)


# 2 -----------------------------------------------------------------------------


def test_packing_round_trip(spark, prose):
    docs, rows = odd_documents(spark, prose)
    pieces = packing.pack(docs).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for key, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        start = 0
        for n in packing.piece_lengths(len(ids)):
            want[key, start, n, np.asarray(ids[start : start + n], dtype="<u4").tobytes()] += 1
            start += n
        assert start == len(ids)
    assert collections.Counter((p.doc_id, p.start, p.length, bytes(p.ids)) for p in pieces) == want
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    assert all(p.length & (p.length - 1) == 0 and p.length <= 4096 and p.offset == 0 for p in pieces)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["it's DON'T we'LL", "a<|endoftext|>b <|startoftext|>", "ab\x1ccd", "été \u0301x a\xa0b", "０１ 12.3 ΣΑΣ ß÷×µ", "日本語 🙂🙂 a🙂", " ", "\x1f"])
def test_word_encoder_equals_the_tokenizer(text):
    encoder = packing.encoder(packing.tokenizer_path())
    assert encoder.encode(text) == np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


# 3 -----------------------------------------------------------------------------


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[700:1200] = x[0]  # one vector that a third of all rows share
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, [float("inf")] + [1.0] * 23), (None, rows[1][1])]
    df = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).withColumn("v", F.lit(0))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        hits += len({i for i, _ in got[q]} & set(best.tolist()))
        assert all(abs(s[i] - score) < 1e-12 for i, score in got[q]) and len(got[q]) == 5
    assert hits / 150 >= 0.9 and len(got) == 30
    assert [i for i, _ in got[0]] == [700, 701, 702, 703, 704]
    assert [i for i, _ in got[750]] == [0, 700, 701, 702, 703]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("clusters", [0, 60])
def test_recall_over_many_lists(spark, clusters):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((12_000, 64))
    if clusters:
        x = 0.4 * x + rng.standard_normal((clusters, 64))[rng.integers(0, clusters, len(x))]
    model = ann.fit(x[::2], len(x), 5)
    assert len(model["centroids"]) == ann.lists_for(len(x)) >= 20 and (not clusters or model["probes"] <= 12)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    assert {q: len(v) for q, v in got.items()} == {i: 5 for i in range(0, 12_000, 50)}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u[::50] @ u.T
    sims[np.arange(240), np.arange(0, 12_000, 50)] = -9
    best = np.argsort(-sims, axis=1)[:, :5]
    recall = np.mean([len(got[50 * i] & set(b.tolist())) / 5 for i, b in enumerate(best)])
    assert recall >= 0.9


def test_lists_grow_with_the_square_root():
    assert [ann.lists_for(n) for n in (1, 1000, 51_200, 10**8, 10**10)] == [1, 1, 100, 20_000, 200_000]


def test_fit_takes_bounded_memory():
    import tracemalloc

    x = np.random.default_rng(5).standard_normal((ann.SAMPLE_BYTES // (8 * 64), 64))
    tracemalloc.start()
    model = ann.fit(x, 10**6, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and len(model["centroids"]) == ann.lists_for(10**6) and len(model["seen"]) == ann.SEEN
    assert len(ann.fit(x[:3200], 10**10, 5)["centroids"]) == 3200 // ann.PER_LIST


def test_blocks_of_distances_change_nothing(monkeypatch):
    x = np.random.default_rng(6).standard_normal((700, 20))
    whole = ann.closest(x, x[:30]), ann.radii(x, x[:50], 6), ann.fit(x, 10**5, 5)
    monkeypatch.setattr(ann, "BLOCK_BYTES", 5000)
    parts = ann.closest(x, x[:30]), ann.radii(x, x[:50], 6), ann.fit(x, 10**5, 5)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])
    assert np.allclose(whole[2]["centroids"], parts[2]["centroids"]) and whole[2]["probes"] == parts[2]["probes"]


def test_calibration_counts_what_the_test_loses():
    rng = np.random.default_rng(9)
    # Nearest vectors differ in the first columns of the rotated space only.
    x = rng.standard_normal((2000, 64))
    model = ann.fit(x, 2000, 5)
    u = ann._unit(x) @ model["rotation"]
    sims = u[:200] @ u.T
    sims[np.arange(200), np.arange(200)] = -9
    best = np.argsort(-sims, axis=1)[:, :5]
    radius = np.repeat(ann.radii(u[:200], model["seen"], 6), 5)
    kept = ann.survives(np.repeat(u[:200], 5, axis=0), u[best.ravel()], radius, model["epsilon"])
    assert kept.mean() >= 0.97 and model["epsilon"] >= ann.EPSILON


def test_exact_search_finds_all(spark):
    x = np.random.default_rng(10).standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.nearest(df, df.where("vec_id % 50 = 0"), exact=True).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u[::50] @ u.T
    sims[np.arange(60), np.arange(0, 3000, 50)] = -9
    assert got == {(50 * i, r + 1): int(j) for i, row in enumerate(np.argsort(-sims, axis=1)[:, :5]) for r, j in enumerate(row)}


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [2.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    rows = ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in rows] == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]


# 4 -----------------------------------------------------------------------------


def test_packages_round_trip(spark):
    rows = [(1, "http://a/x", "<p>é</p>"), (5, "http://b/\nx", "<p>é</p>"), (5, "http://b/", "<p>é</p>"), (2, None, None), (9, "u", ""), (3, "v", "z" * 300_000), (None, "w", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("sha", F.lit(2))
    packages = warc.write_packages(pages, new_path(spark, "packages"), package_bytes=200)
    records = warc.read_packages(packages).collect()
    largest = {}
    for key, _, html in rows:
        if key is not None:
            largest[html or ""] = max(key, largest.get(html or "", key))
    want = collections.Counter()
    for key, _, html in rows:
        body = (html or "").encode()
        first = largest.get(html or "")
        same = key == first
        want[str(key if key is not None else ""), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if same else "revisit", None if same else str(first), body if same else None] += 1
    assert collections.Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in records) == want
    assert warc.read_packages(warc.write_packages(pages.limit(0), new_path(spark, "none"))).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories(tmp_path, zip64):
    import zipfile

    members = [("archive/data.warc.gz", b"abc" * 100), ("indexes/index.cdxj", b""), ("x/é", b"1")]
    path = tmp_path / "a.zip"
    path.write_bytes(warc.zip_stored(members, zip64))
    with zipfile.ZipFile(path) as z:
        assert [(n, z.read(n)) for n in z.namelist()] == members
    file = warc.RangeFile(str(path))
    found = warc.zip_members(file)
    assert [(n, file.read(found[n][0], found[n][1])) for n, _ in members] == members
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("d", b"deflated" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    assert warc.zip_members(warc.RangeFile(str(tmp_path / "b.zip")))["d"][2] == zipfile.ZIP_DEFLATED
    (tmp_path / "c.zip").write_bytes(b"no zip at all")
    with pytest.raises(ValueError):
        warc.zip_members(warc.RangeFile(str(tmp_path / "c.zip")))


# 5 and 8 -----------------------------------------------------------------------


def labelled(spark, prose, bad):
    rows = [(i, (bad(i) if i % 3 == 0 else prose(i, 40)), int(i % 3 == 0)) for i in range(360)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], DOCS)
    return docs, rows


def test_quality_learns_and_holds_out(spark, prose):
    docs, rows = labelled(spark, prose, lambda i: "!! ".join(["JUNK"] * 40) + str(i))
    labels = spark.createDataFrame([(i, 1 - y) for i, _, y in rows] + [(None, 1), (1, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, 1 - y) for i, _, y in rows if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    # Labels of the held-out part have no influence.
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(docs, other).collect()}
    assert max(abs(again[i] - got[i].score) for i in got) < 1e-9


def test_toxicity_learns_and_locates(spark, prose):
    docs, rows = labelled(spark, prose, lambda i: prose(i, 20) + ". You vilest" + "aeiou"[i % 5] + " thing! " + prose(i + 900, 20) + ".")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) > 0.95
    text = {i: t for i, t, _ in rows}
    spotted = [text[i][r.sentences[0].start : r.sentences[0].end] for i, r in got.items() if r.predicted]
    assert spotted and np.mean(["vilest" in s for s in spotted]) > 0.95


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_of_odd_tables(spark, prose, module, label):
    docs, rows = odd_documents(spark, prose)
    labels = spark.createDataFrame([(4, 1), (4, 1), (3, 0), (2, 0)], f"doc_id long, {label} int")
    for some in (labels, labels.limit(0)):
        got = module.classify(docs, some).collect()
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(k for k, _, _ in rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert module.classify(docs.limit(0), labels).count() == 0


# 6 -----------------------------------------------------------------------------


def test_urls_equal_brute_force(spark):
    rng = random.Random(2)
    hosts = ["Example.NET", "a.example.net", "example.com", "x.org", "org", "net", "xnet", "", "example.net:80"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/1?q", "/EN/", "?x", "#y", "/en/#t"]
    urls = [f"{rng.choice(['http://', 'HTTPS://', '', '://', 'x://y://'])}{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "http://"]
    rows = list(enumerate(urls))
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    listed = spark.createDataFrame([*urlfilter.RULES, (None, "block")], "rule string, verdict string")
    got = urlfilter.judge_urls(pages, "page_id", "url", listed).collect()
    want = collections.Counter()
    for i, url in [*rows, rows[0]]:
        host = path = ""
        if url and "://" in url:
            rest = url[url.index("://") + 3 :]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(r), r, v) for r, v in urlfilter.RULES if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
        want[i, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert urlfilter.judge_urls(pages.limit(0), "page_id", "url", listed).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(pages, "page_id", "url", listed.limit(0)).collect()} == {"allow"}


def test_listed_urls(spark):
    """A list of a hundred thousand urls: the filter passes all listed ones and
    some others, which the exact join removes; rules go before the list."""
    listed = spark.range(100_000).select(F.concat(F.lit("http://H"), F.col("id") % 977, F.lit(".Example.org:80/p/"), "id", F.lit("?q#f")).alias("url"))
    listed = listed.unionByName(spark.createDataFrame([(None,), ("no url",), ("https://x.net",)], "url string"))
    pages = spark.range(50_000, 150_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h"), F.col("id") % 977, F.lit(".example.org/p/"), "id").alias("url"))
    pages = pages.unionByName(spark.createDataFrame([(1, "http://x.net/?a"), (2, "http://x.net/b"), (3, None), (4, "http://h1.example.org/p/1x")], "page_id long, url string"))
    rules = spark.createDataFrame([("net/b", "allow"), ("h1.example.org/", "allow")], "rule string, verdict string")
    got = urlfilter.judge_urls(pages, "page_id", "url", rules, listed)
    counts = got.where("page_id >= 50000 AND host <> 'h1.example.org'").groupBy((F.col("page_id") < 100_000).alias("listed"), "verdict").count().collect()
    assert {(r.listed, r.verdict) for r in counts} == {(True, "block"), (False, "allow")}
    assert {(r.page_id, r.rule, r.verdict) for r in got.where("page_id < 10").collect()} == {(1, None, "block"), (2, "net/b", "allow"), (3, None, "allow"), (4, "h1.example.org/", "allow")}
    assert {r.verdict for r in got.where("host = 'h1.example.org'").collect()} == {"allow"}
    entries = urlfilter.entries_of(rules, listed)
    places = got.select("host", "path", F.concat("host", "path").alias("form")).where("host <> ''").distinct()
    possible, small = urlfilter.possible_entries(places, entries, [2, 1])
    passed, exact = possible.count(), possible.join(entries, ["kind", "entry"]).count()
    assert small and exact >= 50_000 and 0 < passed - exact < 0.1 * places.count()


def test_a_million_listed_urls_by_both_joins(spark, monkeypatch):
    listed = spark.range(1_000_000).select(F.concat(F.lit("http://h"), F.col("id") % 9973, F.lit(".example.org/p/"), "id").alias("url"))
    pages = spark.range(990_000, 1_010_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h"), F.col("id") % 9973, F.lit(".example.org/p/"), "id").alias("url"))
    rules = spark.createDataFrame(urlfilter.RULES, "rule string, verdict string")
    entries = urlfilter.entries_of(rules, listed).cache()
    places = pages.select(urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path"), urlfilter.canonical(F.col("url")).alias("form"))
    found = []
    for most in (1 << 30, 0):
        monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", most)
        possible, small = urlfilter.possible_entries(places, entries, [1, 4], 2)
        assert small == bool(most)
        found.append((possible.count(), possible.join(entries, ["kind", "entry"]).count()))
        got = urlfilter.judge_urls(pages, "page_id", "url", rules, listed).groupBy((F.col("page_id") < 1_000_000).alias("in_list"), "verdict").count().collect()
        assert {tuple(r) for r in got} == {(True, "block", 10_000), (False, "allow", 10_000)}
    assert found[0] == found[1] and found[0][1] == 10_000 < found[0][0] < 10_600  # false positives, removed
    entries.unpersist()


def test_hosts_of_thousands_of_labels_and_long_urls(spark):
    deep, long = "a." * 4000 + "example.net", "x" * 1_000_000
    rows = [(1, f"http://{deep}/en/1"), (2, f"http://{deep}/de"), (3, f"http://net/{long}"), (4, f"http://{long}.org/fr/"), (5, f"{long}"), (6, "http://" + "." * 3000)]
    rules = spark.createDataFrame(urlfilter.RULES, "rule string, verdict string")
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), "page_id", "url", rules)
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: ("net/", "block"), 4: ("org/fr/", "allow"), 5: (None, "allow"), 6: (None, "allow")}


def test_toxicity_of_repeated_keys_does_not_depend_on_the_order(spark, prose):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    rows = [(i, f"{prose(i, 12)}. {'vile scum ' * (i % 3 == 0)}{prose(i + 99, 9)}.") for i in range(60)] + [(i, f"other {prose(i + 500, 15)}.") for i in range(0, 60, 4)]
    one = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    two = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5)
    scores = [sorted((r["doc_id"], round(r["score"], 6)) for r in toxicity.classify(df, labels).collect()) for df in (one, two)]
    assert scores[0] == scores[1]


def test_bloom_filter_misses_nothing(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    bloom = urlfilter.blocked_bloom(keys, "k", 160)
    block, mask = urlfilter.bloom_address(F.col("k"), 160)
    probe = spark.range(20000).select(F.col("id"), F.col("id").cast("string").alias("k")).select("id", block.alias("block"), mask.alias("mask")).join(bloom, "block", "left")
    hit = F.forall(F.zip_with("words", "mask", lambda w, m: w.bitwiseAND(m) == m), lambda x: x)
    found = probe.select("id", F.coalesce(hit, F.lit(False)).alias("hit")).where("hit").agg(F.count_if(F.col("id") < 5000).alias("inside"), F.count_if(F.col("id") >= 5000).alias("outside")).first()
    assert found.inside == 5000 and found.outside < 300


# 7 -----------------------------------------------------------------------------


def similar(x, y):
    common, union = (x & y).total(), (x | y).total()
    return x == y or common >= 0.8 * union


def brute_classes(rows):
    """How often a key has a class, and the names of the classes, by comparing
    all pairs of texts."""
    sets = {text or "": collections.Counter(neardup.shingles(neardup.words_of(text or "")).tolist()) for _, text in rows}
    parent = {t: t for t in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    texts = sorted(sets)
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            n, m = sets[a].total(), sets[b].total()
            if min(n, m) >= 0.8 * max(n, m) and similar(sets[a], sets[b]):
                parent[find(b)] = find(a)
    least = {}
    for key, text in rows:
        root = find(text or "")
        least[root] = min((k for k in (least.get(root), key) if k is not None), default=None)
    named = collections.Counter((key, least[find(text or "")]) for key, text in rows)
    return named, collections.Counter(least.values())


def test_near_duplicates_equal_brute_force(spark, prose):
    rng = random.Random(7)
    rows = []
    for g in range(12):
        base = prose(500 + g, 120).split()
        for c in range(1 + 3 * (g % 4)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(words), "en"))
    rows += [(900, "Short one", "en"), (901, "short  ONE", "de"), (902, "", None), (903, None, None), (904, "same " * 500, None), (905, "same " * 505, None), (906, "same " * 300, None), (3, rows[3][1], "en")]
    # A key with two texts, rows without a key, a class without one.
    rows += [(3, rows[4][1], "en"), (3, "quite another text", "en"), (None, rows[9][1], "en"), (None, "nobody", "en"), (None, "nobody", "de")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit(1)).withColumn("bands", F.lit(2)).withColumn("class_id", F.lit(3))
    want, names = brute_classes([r[:2] for r in rows])
    got = neardup.near_duplicates(docs).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == want
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == names
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_every_link_of_the_test_documents_is_found(spark):
    """Recall on planted exact and near copies, against all pairs of texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet", "/root/testdata/sf0.01/documents.parquet")
    docs = docs.where("length(text) < 5000").withColumn("doc_id", F.col("doc_id") + F.length("text").cast("long") * 1_000_000).select("doc_id", "text")
    want, _ = brute_classes([tuple(r) for r in docs.collect()])
    got = collections.Counter(tuple(r) for r in neardup.near_duplicates(docs).collect())
    assert got == want and sum(n for (k, c), n in want.items() if k != c) > 80


def test_parts_and_rounds_of_large_buckets(spark, prose, monkeypatch):
    """Many copies that differ each in its own way, dealt out in small parts."""
    monkeypatch.setattr(neardup, "PART", 8)
    monkeypatch.setattr(neardup, "GROWTH", 2)
    base = prose(77, 100).split()
    rows = []
    for c in range(120):
        words = list(base)
        words[c % 90] = f"own{c}"
        words[(c * 7) % 95] = f"too{c % 40}"
        rows.append((c, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_classes(rows)[0]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(40):
        keys = rng.integers(0, 2**63, 200).astype(np.uint64)
        a = rng.integers(0, 6, 200) * rng.integers(1, 9, 200) * (100 if len(gaps) % 4 == 3 else 1)
        b = np.where(rng.random(200) < 0.6, a, rng.integers(0, 9 * (50 if len(gaps) % 4 == 3 else 1), 200))
        agree = (neardup.signature(keys[a > 0], a[a > 0], 500) == neardup.signature(keys[b > 0], b[b > 0], 500)).mean()
        gaps.append(agree - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.012


# 9 -----------------------------------------------------------------------------


def test_shards_are_contiguous_and_balanced(spark):
    sizes = [random.Random(i).randint(0, 500) for i in range(600)] + [0, 40_000]
    rows = [(i // 2 if i < 400 else 7, s) for i, s in enumerate(sizes)] + [(None, None)]  # one key holds a third
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumn("shard", F.lit("clash")).withColumn("slot", F.lit("clash"))
    got = sharding.balanced_shards(df, ["doc_id"], F.col("n"), 16).collect()
    assert len(got) == len(rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert sum(r["size"] for r in own) <= total / 16 + most
    keys = [r.doc_id if r.doc_id is not None else -1 for s in sorted(shards) for r in sorted(shards[s], key=lambda r: r.slot)]
    assert keys == sorted(keys)
    assert sharding.balanced_shards(df.limit(0), ["doc_id"], F.col("n"), 16).count() == 0
    assert {r.shard for r in sharding.balanced_shards(df, ["doc_id"], F.lit(0), 16).collect()} == {0}


# 10 ----------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a1@.+- ()94é%") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == brute_base(text), text


def test_repeated_entities_are_drawn_together(spark, prose):
    card = "4041894974608795"
    train = [f"{prose(i, 10)} card {card} and mail a.b{i}@mail.example.com at 10.0.{i % 200}.7 {prose(i, 5)} call +1 555 123 {4000 + i} id {10**8 + i} {prose(i, 4)}" for i in range(80)]
    model = pii.learn(train)
    parted = f"pay {card} now {prose(5, 30)} or {card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]} again"
    base, spans = pii.find_spans(parted, model)
    assert base == brute_base(parted) and set(base) <= set(spans)
    assert any(k == "card" and parted[s:e].startswith("4041.") for k, s, e in spans)
    assert "4041" not in pii.redact(parted, spans)
    clean = prose(9, 200) + " in 1999 or 12.5 of 100"
    assert pii.find_spans(clean, model) == ([], [])


def test_pii_of_odd_tables(spark, prose):
    docs, rows = odd_documents(spark, prose)
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.lit("mail a@b.cd é +12 345 678 90")))
    got = pii.detect(docs).collect()
    assert len(got) == len(rows) + 1
    found = [r for r in got if r.base]
    assert [(s.kind, s.start, s.end) for s in found[0].base] == brute_base("mail a@b.cd é +12 345 678 90")
    assert found[0].redacted == "mail <EMAIL> é <PHONE>"
    assert pii.detect(docs.limit(0)).count() == 0
