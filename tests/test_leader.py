"""Leader clustering: batches, hot groups, recall, growth of the pair work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import leader


def plain(ids, x, threshold):
    """The sequential rule: the most similar leader, or a leader itself."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    leaders, found = [], {}
    for i in np.argsort(ids):
        sims = x[leaders] @ x[i] if leaders else np.zeros(0)
        if len(sims) and sims.max() >= threshold:
            found[int(ids[i])] = int(ids[leaders[int(np.argmax(sims))]])
        else:
            leaders.append(i)
            found[int(ids[i])] = int(ids[i])
    return found


def vectors(seed, n, d=48, centres=60, spread=0.4):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((centres, d))[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, d))


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)], "id long, v array<double>").repartition(3)


@pytest.mark.parametrize(("first", "growth"), [(4096, 8), (40, 3)])
def test_batches_equal_the_sequential_rule(spark, monkeypatch, first, growth):
    monkeypatch.setattr(leader, "FIRST", first)
    monkeypatch.setattr(leader, "GROWTH", growth)
    x = vectors(1, 500)
    x[::7] = x[3] + 0.2 * np.random.default_rng(2).standard_normal(x[::7].shape)  # one large group
    x[5:200:9] = x[5]  # equal vectors
    ids = np.random.default_rng(3).permutation(500) * 11
    got = {r["id"]: r["leader"] for r in leader.leader_clusters(frame(spark, ids, x), "id", "v", 0.82, recall=0.99999).collect()}
    assert got == plain(ids, x, 0.82) and len(set(got.values())) > 20


def test_a_large_group_of_near_copies_makes_few_edges(spark, monkeypatch):
    monkeypatch.setattr(leader, "FIRST", 50)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.standard_normal(32) + 0.1 * rng.standard_normal((700, 32)), rng.standard_normal((300, 32))])
    _, edges = leader._leaders_by_batch(frame(spark, rng.permutation(1000), x), "id", "v", 0.82, 0.999)
    assert edges.count() < 3000  # all pairs of the group would be 244650


@pytest.mark.parametrize(("first", "block", "tile"), [(4096, 8192, 1024), (30, 64, 10)])
def test_exact_batches_equal_the_sequential_rule(spark, monkeypatch, first, block, tile):
    for name, value in (("FIRST", first), ("BLOCK", block), ("TILE", tile)):
        monkeypatch.setattr(leader, name, value)
    x = vectors(7, 500)
    ids = np.random.default_rng(8).permutation(500) * 7
    got = {r["id"]: r["leader"] for r in leader.leader_clusters(frame(spark, ids, x), "id", "v", 0.5, exact=True).collect()}
    assert got == plain(ids, x, 0.5) and len(set(got.values())) > 20


def test_exact_edges_are_those_of_leaders(spark, monkeypatch):
    monkeypatch.setattr(leader, "FIRST", 50)
    x, ids = vectors(9, 1000, centres=10), np.arange(1000)
    leaders, edges = leader._leaders_by_batch(frame(spark, ids, x), "id", "v", 0.5, 0.999, exact=True)
    assert edges.count() <= leaders.count() * 1000 / 4  # all similar pairs are about 50000
    assert edges.join(leaders.withColumnRenamed("id", "a"), "a", "left_anti").count() == 0


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert leader.leader_clusters(empty, "id", "v", 0.82).count() == 0
    assert leader.leader_clusters(empty, "id", "v", 0.82, exact=True).count() == 0
    assert [tuple(r) for r in leader.leader_clusters(frame(spark, [4], np.ones((1, 5))), "id", "v", 0.82).collect()] == [(4, 4, "story_00001", True)]


def test_tables_reach_the_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((400, 40))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.821 * x + np.sqrt(1 - 0.821**2) * z  # pairs just above the threshold
    df = frame(spark, np.arange(800), np.vstack([x, y]))
    got = {(r["a"], r["b"]) for r in leader.hashed_pairs(df, "id", "v", 0.82, 0.99).collect()}
    assert len(got & {(i, i + 400) for i in range(400)}) >= 392


def test_pair_work_grows_slowly():
    """Rows of the buckets and pairs that meet, of vectors without any cluster."""
    work = []
    for n in (10_000, 20_000, 40_000, 10_000_000):
        form = leader.shape(n, 0.82, 0.999)
        probes = form.probed**form.functions
        work.append(n * form.tables * (1 + probes * (1 + n / form.buckets)))
    assert np.log(work[2] / work[0]) / np.log(4) < 1.3 and np.log(work[3] / work[0]) / np.log(1000) < 1.3


def test_pairs_that_meet_are_few(spark):
    rng = np.random.default_rng(8)
    x, form = rng.standard_normal((3000, 32)), leader.shape(3000, 0.82, 0.999)
    rows = leader.hashed(frame(spark, np.arange(3000), x), "id", "v", form)
    left = rows.select("id", F.explode("near").alias("b"))
    right = rows.select(F.col("id").alias("other"), F.explode("own").alias("b"))
    met = left.join(right, "b").where("id <> other").count()
    expected = 3000 * form.tables * form.probed**form.functions * 3000 / form.buckets
    assert met < 2 * expected < 3000 * 3000 / 4


def test_a_bucket_row_is_sent_once():
    """Rows of buckets that a vector sends to a join of all with all (272 and 130 before)."""
    for n, most in ((1_846_000, 140), (308_000, 70)):
        form = leader.shape(n, 0.82, 0.999)
        probes = form.probed**form.functions
        assert form.tables * (probes + (probes > 1)) <= most


def test_few_leaders_meet_all_others_where_these_lie(spark):
    x = vectors(12, 900)
    x[:60] = x[60:120] + 0.1
    rows = leader.hashed(frame(spark, np.arange(900), x), "id", "v", leader.shape(900, 0.82, 0.999))
    met = leader.met_by_all(rows.where("id < 200"), rows, 0.82)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(unit[:200] @ unit.T >= 0.82)
    assert {(r["a"], r["b"]) for r in met.collect()} == {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j}
    assert leader.met_by_all(rows.where("id < 0"), rows, 0.82).count() == 0
