"""The stored index: what updates write, merges, tombstones, racing writers."""

import os
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.operators import index as stored_index
from tidewire.operators.index import TextIndex
from tidewire.storage import RacingWriters


def frame(spark, docs):
    return spark.createDataFrame([(k, t) for k, t in docs.items()], "id long, t string")


def expected(docs):
    return {k: (len(w := re.findall("[a-z0-9]+", (t or "").lower())), Counter(w)) for k, t in docs.items()}


def seen(index):
    sizes = {r["doc"]: r["size"] for r in index.sizes().collect()}
    terms = {}
    for r in index.postings().collect():
        assert r["term"] not in terms.setdefault(r["doc"], Counter())
        terms[r["doc"]][r["term"]] = len(r["positions"])
    return {k: (n, terms.get(k, Counter())) for k, n in sizes.items()}


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_updates_deletions_and_merges(spark, tmp_path):
    docs = {i: f"word{i % 7} the The w{i}" for i in range(60)} | {60: None, 61: "", 62: "é9 a-b"}
    index = TextIndex(spark, str(tmp_path / "i"), "id", ["t"], 4).build(frame(spark, docs))
    assert seen(index) == expected(docs)
    most = 1
    for step in range(9):
        changed = {step: f"new{step} the", 100 + step: "the the"}
        gone = [10 + step, 999, 99 + step]
        index.update(frame(spark, changed), spark.createDataFrame([(g,) for g in gone], "id long"))
        docs = {k: v for k, v in (docs | changed).items() if k not in gone}
        most = max(most, len(index.segments()))
    assert seen(index) == expected(docs) and most <= 5
    assert index.merge(everything=True) and len(index.segments()) == 1 and seen(index) == expected(docs)
    assert not index.merge()
    left = index.clean(older_seconds=0)
    assert left >= 10 and index.clean(older_seconds=0) == 0 and seen(index) == expected(docs)
    hits = {r["doc"]: list(r["f"]) for r in index.hits([["the", "the"], ["the"]]).collect()}
    assert hits == {k: [sum(a == b == "the" for a, b in zip(w, w[1:], strict=False)), w.count("the")] for k, t in docs.items() if "the" in (w := re.findall("[a-z0-9]+", (t or "").lower()))}


def test_bytes_written_follow_the_change(spark, tmp_path):
    docs = {i: " ".join(f"t{(i * j) % 501}" for j in range(400)) for i in range(400)}
    index = TextIndex(spark, str(tmp_path / "i"), "id", ["t"], 4).build(frame(spark, docs))
    base = written(tmp_path)
    index.update(frame(spark, {5: docs[6]}))
    one = written(tmp_path) - base
    index.update(frame(spark, {i: docs[i + 1] for i in range(40)}))
    many = written(tmp_path) - base - one
    assert one < 0.08 * base and one < many < 0.4 * base
    assert len(index.segments()) == 3


def test_of_two_writers_both_are_kept(spark, tmp_path, monkeypatch):
    index = TextIndex(spark, str(tmp_path / "i"), "id", ["t"], 2).build(frame(spark, {1: "a", 2: "b"}))
    other = TextIndex(spark, str(tmp_path / "i"), "id", ["t"], 2)
    plain, raced = TextIndex._commit, []

    def commit(self, version, segments):
        if not raced:
            raced.append(version)
            other.update(frame(spark, {3: "c"}))  # takes the number first
        return plain(self, version, segments)

    monkeypatch.setattr(TextIndex, "_commit", commit)
    index.update(frame(spark, {1: "d"}))
    assert raced == [1] and seen(index) == expected({1: "d", 2: "b", 3: "c"})
    with pytest.raises(RacingWriters):
        plain(index, raced[0], [])
    raced.clear()
    assert not index.merge(everything=True)  # the other writer came in between
    assert raced == [3] and seen(index) == expected({1: "d", 2: "b", 3: "c"})


def test_sizes_of_merges(monkeypatch):
    index = TextIndex(None, "x", "id", ["t"])
    pick = lambda *sizes: [s["documents"] for s in index._mergeable([{"documents": n} for n in sizes])]
    assert pick(1000, 1, 1, 1) == [] and pick(1000, 1, 1, 1, 1) == [1, 1, 1, 1]
    assert pick(1000, 5, 5, 5, 5) == [5, 5, 5, 5] and pick(1000, 900, 800, 1) == []
    segments, rewritten = [], 0
    for _ in range(1000):
        segments.append({"documents": 1})
        while some := index._mergeable(segments):
            total = sum(s["documents"] for s in some)
            rewritten += total
            segments = [*segments[: len(segments) - len(some)], {"documents": total}]
    assert len(segments) <= 16 and rewritten < 1000 * 10
    assert stored_index.FANOUT == 4


def test_only_folders_of_the_terms_are_read(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), "id", ["t"], 64).build(frame(spark, {i: f"w{i}" for i in range(300)}))
    index.update(frame(spark, {1: "w5"}))
    df = index.hits([["w5"]])
    assert {r["doc"] for r in df.collect()} == {1, 5}
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket", plan)) >= 2
    assert index.postings(F.col("term") == "w7").count() == 1


def test_postings_are_made_by_pieces_of_a_batch(monkeypatch):
    rows = [(i, f"a b{i} a " * (i % 5), "c a") for i in range(40)] + [(40, None, ""), (41, "", None)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(i, t or "", u or "") for i, t, u in rows], strict=True)], names=["doc", "t0", "t1"])
    whole = [b.to_pylist() for b in stored_index._posted([batch])]
    monkeypatch.setattr(stored_index, "PIECE_BYTES", 64)
    pieces = [b.to_pylist() for b in stored_index._posted([batch.slice(0, 0), batch])]
    assert len(whole) == 1 and len(pieces) > 8 and max(map(len, pieces)) < 40
    assert sum(pieces, []) == whole[0]
    assert {"doc": 3, "column": 0, "term": "a", "positions": [0, 2, 3, 5, 6, 8]} in whole[0]
