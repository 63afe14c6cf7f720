"""The manifest against a tree built plainly."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, digest string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def climb(levels, at, now, fanout):
    path = ""
    for nodes in levels[:-1]:
        first = at - at % fanout
        run = nodes[first : first + fanout]
        path += "".join(run[: at - first] + run[at - first + 1 :])
        now, at = digest("".join([*run[: at - first], now, *run[at - first + 1 :]])), first // fanout
    return path, now


def plain(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]], fanout)
    top = tree([trees[g][-1][0] for g in order], fanout) if order else [[]]
    found = []
    for t, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            odd = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            path, now = climb(trees[g], i, leaf(r, int(odd)), fanout)
            more, now = climb(top, t, now, fanout)
            found.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], digest(path + more), now, now == top[-1][0]))
    return sorted(map(repr, found))


def rows_of(n):
    return [
        {"doc_id": None if i == 5 else i // 2 if i < 8 else i, "text": None if i % 11 == 3 else "" if i % 11 == 4 else f"é{i // 2 if i < 8 else i}" * (i % 7), "lang": [None, "en", "de", "", "über"][i % 5 if i % 3 else 1], "source": None if i % 4 == 0 else "s", "n_chars": None if i % 9 == 0 else 2**63 - 1 if i == 22 else i, "leaf": 1, "digest": "x"}
        for i in range(n)
    ]


@pytest.mark.parametrize(("n", "fanout", "block"), [(1, 2, 4), (2, 2, 4), (97, 2, 4), (97, 3, 9), (260, 2, 8), (60, 4, 4096)])
def test_manifest_equals_a_plain_tree(spark, n, fanout, block):
    rows = rows_of(n)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.col("n_chars").cast("decimal(20,0)") + F.when(odd, 1).otherwise(0)
    got = merkle.manifest(df, FIELDS, "doc_id", "lang", {"n_chars": changed}, fanout, block).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows, fanout)


def test_without_changes_every_leaf_is_verified(spark):
    df = spark.createDataFrame([tuple(r.values()) for r in rows_of(40)], SCHEMA)
    assert {r["verified"] for r in merkle.manifest(df, FIELDS, "doc_id", "lang").collect()} == {True}


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), FIELDS, "doc_id", "lang").count() == 0


def test_query_equals_its_sql(spark):
    root = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet'")
    got, want = merkle.op13_manifest(spark, root), con.sql(merkle.OP13_SQL)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
