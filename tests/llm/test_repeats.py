"""Repeated passages against plain search, and the transform against sorted rotations."""

import random

import duckdb
import numpy as np
import pytest

from tidewire.llm import repeats

SCHEMA = "doc_id long, text string, n_bytes int, block int, key string"


def plain(rows, least):
    first, found = {}, []
    rows = [(k, repeats.NO_KEY if k is None else k, (t or "").encode()) for k, t in rows]
    for _, k, t in rows:
        for i in range(len(t) - least + 1):
            first[t[i : i + least]] = min(first.get(t[i : i + least], k), k)
    for key, k, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if first[t[i : i + least]] < k:
                gone[i : i + least] = b"\1" * least
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        found.append((key, len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return sorted(found, key=repr)


def documents(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(20) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            at = rng.randint(0, 40)
            parts += [passage[at : at + rng.randint(40, 120)], prose(rng.randint(0, 12))]
        rows.append((rng.choice([i, i // 2, 1000 - i]), "".join(parts)))
    rows += [(None, rows[3][1]), (None, None), (7, None), (8, ""), (9, "a" * 400), (10, "a" * 90), (3, rows[4][1]), (3, rows[4][1]), (2**62, "日本語" * 40), (5, "日本語" * 40), (6, "x" * 49)]
    return rows


@pytest.mark.parametrize("options", [{}, {"block_bytes": 600}, {"block_bytes": 2000, "hot": 1}, {"hot": 3, "sorted_bytes": 200}, {"least": 30, "seed": 9}, {"least": 50, "seed": 50, "sorted_bytes": 1}])
def test_equals_plain_search(spark, options):
    rows = documents(len(str(options)))
    df = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], SCHEMA).repartition(3)
    got = repeats.without_repeats(df, **options).collect()
    assert sorted((tuple(r[:4]) + (bytes(r[4]),) for r in got), key=repr) == plain(rows, options.get("least", 50))


def test_many_texts_with_copies_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", 0)
    rows = documents(77)
    df = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], SCHEMA).repartition(3)
    got = repeats.without_repeats(df).collect()
    assert sorted((tuple(r[:4]) + (bytes(r[4]),) for r in got), key=repr) == plain(rows, 50)


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_prefixes_of_rotations():
    rng = random.Random(1)
    for t in range(60):
        text = bytes(rng.choice(b"ab\xff" if t % 2 else b"abcdefgh\xff") for _ in range(rng.randint(2, 300)))
        least = rng.choice([1, 2, 3, 5, 8])
        order, shared = repeats.shared_prefixes(np.frombuffer(text, np.uint8), least)
        rotations = [(text * 9)[i : i + least] for i in order]
        assert rotations == sorted(rotations)
        for above, row, have in zip(rotations, rotations[1:], shared[1:], strict=False):
            assert have == next((k for k in range(least) if above[k] != row[k]), 255)


@pytest.mark.parametrize("chunk", [1, 13, 1 << 17])
def test_runs_hold_every_string_once_and_equal_strings_have_equal_keys(monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    texts = [t.encode() for _, t in documents(5, 12) if t]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    first, count, keys = repeats.runs(data, ends, 50, 16)
    held = [(i + k, key) for i, n, key in zip(first.tolist(), count.tolist(), keys.tolist(), strict=True) for k in range(n)]
    assert sorted(p for p, _ in held) == [e - len(t) + i for t, e in zip(texts, ends.tolist(), strict=True) for i in range(len(t) - 49)]
    by_string = {}
    for p, key in held:
        assert by_string.setdefault(data[p : p + 50].tobytes(), key) == key
    assert count.max() <= repeats.RUN


def test_a_phrase_in_different_passages_gives_them_no_common_key():
    rng = random.Random(11)
    noise = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(60))
    texts = [(noise() + " a phrase of many documents " + noise()).encode() for _ in range(200)]
    ends = np.cumsum([len(t) for t in texts])
    first, _, keys = repeats.runs(np.frombuffer(b"".join(texts), np.uint8), ends, 50, 16)
    found = {(key, at) for key, at in zip(keys.tolist(), np.searchsorted(ends, first, side="right").tolist(), strict=True)}
    assert len({key for key, _ in found}) == len(found)


def test_query_equals_its_sql(spark):
    root = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet'")
    got, want = repeats.op12_repeats(spark, root), con.sql(repeats.OP12_SQL)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
