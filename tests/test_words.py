"""Words by whole buffers, and the vectors and postings made of them."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tidewire.functions import embedding
from tidewire.functions.words import counts, words
from tidewire.operators.index import TextIndex

WORD = "[a-z0-9]+"


def texts(n):
    chance = random.Random(n)
    return [None if chance.random() < 0.1 else "".join(chance.choice("ab1 .éß\n") for _ in range(chance.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 5, 300])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_texts(n, kind):
    some = texts(n)
    found = [re.findall(WORD, t or "") for t in some]
    for column in (pa.array(some, kind), pa.array(["x9", *some, "q"], kind).slice(1, n)):
        row, place, each = words(column)
        assert list(zip(row.tolist(), place.tolist(), each.to_pylist(), strict=True)) == [(i, j, w) for i, own in enumerate(found) for j, w in enumerate(own)]
        assert counts(column).tolist() == list(map(len, found))


def test_vectors_are_counted_where_the_texts_lie(spark):
    rows = [(i, t) for i, t in enumerate(["The a b the", "", None, "é9 É9 x-x", *texts(40)])] + [(0, "b z"), (None, "a")]
    docs, want = spark.createDataFrame(rows, "id long, t string"), {}
    for i, t in rows:
        if i is not None and (found := re.findall(WORD, (t or "").lower())):
            want.setdefault(i, Counter()).update(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in found)
    want = {i: [c[p] / math.sqrt(sum(n * n for n in c.values())) for p in range(16)] for i, c in want.items()}
    dense, sparse = embedding.dense(docs, "id", "t", 16, "double"), embedding.sparse(docs, "id", "t", 16)
    assert {r.id: r.embedding for r in dense.collect()} == want
    assert {(r.id, r.place): r.weight for r in sparse.collect()} == {(i, p): x for i, v in want.items() for p, x in enumerate(v) if x}
    # A row a word was made and counted again after a shuffle, and every place of a
    # vector looked for in a map.
    for df in (dense, sparse):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "map_from_entries" not in plan


def test_sizes_need_no_search_by_pattern(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A b", "c"), (2, None, ""), (3, "é9", "x\ny z")], "id long, t string, u string")
    index = TextIndex(spark, str(tmp_path / "i"), "id", ["t", "u"], 4)
    assert "regexp" not in index._sizes(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in index._sizes(docs).collect()} == {(1, 3), (2, 0), (3, 4)}
