"""Collocations against plain counting."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidewire.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "lang string, text string, a long, w1 long, n string"


def plain(rows, least, top, percent=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {k: v for k, v in f.items() if v >= least}
    inside = Counter()
    for (lang, w), a in often.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(inside[lang, w[i : i + m]], a)
    found = {}
    for (lang, w), a in often.items():
        if len(w) > 1 and 100 * inside[lang, w] < percent * a:
            score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, all_ in found.items() for i, (s, a, p, l, r) in enumerate(sorted(all_)[:top]))


def texts(seed, n):
    rng = np.random.default_rng(seed)
    words = ["The", "a", "b", "é", "c\x1cd", "x" * 50, "　", "no\x00ne", *(f"W{i}" for i in range(30))]
    gaps = [" ", " ", " ", "  ", "\t", ". ", "\n", "!?", "\x0b", "\x0c", "\r\n"]
    made = []
    for i in range(n):
        p = 1 / np.arange(1, len(words) + 1)
        made.append(([None, "und", "en", "de", ""][i % 5], "".join(words[j] + gaps[int(g)] for j, g in zip(rng.choice(len(words), 60, p=p / p.sum()), rng.integers(0, len(gaps), 60) * (rng.random(60) < 0.3), strict=True))))
    return [*made, (None, None), ("en", ""), ("en", "  .. \n"), *[("en", "rare but here. " + "one two three four five " * 9)] * 4]


@pytest.mark.parametrize(("block_words", "least", "top"), [(phrases.BLOCK_WORDS, 3, 2000), (50, 3, 2000), (50, 5, 7), (1, 4, 30)])
def test_equals_plain_counting(spark, block_words, least, top):
    rows = texts(block_words, 120)
    df = spark.createDataFrame([(lang, text, 1, 2, "x") for lang, text in rows], SCHEMA).repartition(3)
    got = phrases.collocations(df, least=least, top=top, block_words=block_words).collect()
    assert sorted(map(tuple, got)) == plain(rows, least, top)


def test_nothing_frequent_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(empty).count() == 0
    one = spark.createDataFrame([("en", "only these few words", 1, 2, "x")], SCHEMA)
    assert phrases.collocations(one).count() == 0


@pytest.mark.parametrize("segment", [1, 7, 64, 1 << 20])
def test_segments_do_not_change_a_block(monkeypatch, segment):
    monkeypatch.setattr(phrases, "SEGMENT", segment)
    block = phrases.Block()
    made = [text.encode() for _, text in texts(3, 20) if text]
    for text in made:
        block.add(text)
    block.encode()
    names = list(block.numbers)
    got, piece = [], []
    for i in np.concatenate(block.parts).tolist():
        if i < 0:
            got += [piece] if piece else []
            piece = []
        else:
            piece.append(names[i])
    got += [piece] if piece else []
    want = [words for text in made for p in re.split(rb"[.,;:!?\x0A-\x0D]", text.decode().translate(LOWER).encode()) if (words := re.findall(rb"[^\x20\x09]+", p))]
    assert got == want and block.words == sum(map(len, want))


def test_ranges_rise_with_the_keys():
    f = np.array([5, 70, 30, 1, 94])
    pos = np.cumsum(f) - f
    a, b = (x.ravel() for x in np.meshgrid(range(5), range(5), indexing="ij"))
    at = phrases._ranges(pos[a], f[a], pos[b], 200, 16)
    assert (np.diff(at) >= 0).all() and at.min() >= 0 and at.max() < 16 and len(set(at[a == 4])) == 3


def test_query_equals_its_sql(spark):
    root = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet'")
    got, want = phrases.op11_phrases(spark, root), con.sql(phrases.OP11_SQL)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
