"""Greedy leader clustering in a parallel form, and duplicate statistics.

In input order an item joins its most similar leader, if that is similar
enough, and else becomes a leader. So an item is a leader exactly if no earlier
leader is similar to it: the lexicographically first maximal independent set of
the similarity graph. Items are taken in batches, each ``GROWTH`` times as large
as all before. The edges inside a batch are found; round by round, items with an
earlier leader are decided against, and items all of whose earlier neighbours are
decided against become leaders. What is similar to a new leader leaves the later
batches. So a large group of near copies never meets itself: after the first
batch only its leaders' edges are left.

Similar vectors are found by cross-polytope hashes: the vector is projected on
random directions, and the direction with the largest absolute value, with its
sign, is the hash. ``shape`` picks directions, functions a table and tables so
that a bucket keeps a few rows however many there are: the hash grows with the
logarithm of the rows, and the tables only as a small power of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.numbering import numbered
from tidewire.storage import stored

#: Vectors of a block, of which a task of the exact search compares two, and
#: vectors of one side whose products are held at once.
BLOCK, TILE = 8192, 1024
#: Rows of the first batch, and how much larger each next one is.
FIRST, GROWTH = 4096, 8
#: Leaders' numbers (rows by dimensions) that every task may hold, to compare them
#: with the vectors as they lie.
HELD = 1 << 21
#: Rows of a bucket at most (about), how many pairs of sketches cost what a row that
#: is shuffled costs, pairs by which ``shape`` measures how often similar vectors
#: meet, and directions that it tries.
BUCKET, PAIRS_A_ROW, SAMPLES, SEED = 32, 30, 4000, 5
DIRECTIONS = (2, 3, 4, 6, 8, 11, 16, 23, 32, 45, 64, 91, 128, 181, 256, 362, 512)
#: Bits of the sketch that goes to the buckets, those of another one that pairs are
#: held against before their vectors are fetched, and the probability of either that
#: it keeps a similar pair from being verified.
SKETCH, WIDE, SKETCH_LOSS = 128, 256, 1e-5
WORDS = [f"wide{i}" for i in range(WIDE // 64)]


def _similar(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, threshold: float) -> pd.DataFrame:
    """``a, b, similarity`` of similar unit vectors of both sides, by tiles."""
    found = []
    for at in range(0, len(x), TILE):
        sims = x[at : at + TILE] @ y.T
        i, j = np.nonzero(sims >= threshold)
        found.append(pd.DataFrame({"a": ids[at + i], "b": others[j], "similarity": sims[i, j]}))
    return pd.concat(found) if found else pd.DataFrame({"a": ids, "b": ids, "similarity": []})


def _units(v: pd.Series) -> np.ndarray:
    x = np.vstack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def similar_pairs(df: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """``(a, b, similarity)`` with a < b, all of them, by matrix products of blocks.

    Every block meets every block once, so the work grows with the square of the
    rows; a task holds two blocks.
    """
    total = df.count()
    blocks = max(1, -(-total // BLOCK))
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    left = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    left = left.select(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf.p.iloc[0], pdf.q.iloc[0]
        one, two = pdf[pdf.block == p], pdf[pdf.block == q]
        found = _similar(one.id.to_numpy(), _units(one.v), two.id.to_numpy(), _units(two.v), threshold)
        found = found[found.a < found.b if p == q else found.a != found.b]
        return pd.DataFrame({"a": np.minimum(found.a, found.b), "b": np.maximum(found.a, found.b), "similarity": found.similarity})

    return left.groupBy("p", "q").applyInPandas(compare, "a long, b long, similarity double")


def _compared(some: DataFrame, others: DataFrame, total: int, threshold: float) -> DataFrame:
    """``(a, b, similarity)`` with a < b of ``some`` (a) and ``others`` (b, ``total``
    rows at most), all of them: every block of the ones meets every block of the others."""
    p, q = max(1, -(-some.count() // BLOCK)), max(1, -(-total // BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = some.select("id", "v", F.lit(True).alias("first"), block(p).alias("p"), each(q).alias("q"))
    right = others.select("id", "v", F.lit(False).alias("first"), each(p).alias("p"), block(q).alias("q"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf["first"]], pdf[~pdf["first"]]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "similarity": []})
        found = _similar(one.id.to_numpy(), _units(one.v), two.id.to_numpy(), _units(two.v), threshold)
        return found[found.a < found.b]

    return left.unionByName(right).groupBy("p", "q").applyInPandas(compare, "a long, b long, similarity double")


@dataclass(frozen=True)
class Shape:
    """Tables, functions a table, directions a function, and how many of the
    best directions are probed for each."""

    tables: int
    functions: int
    directions: int
    probed: int

    @property
    def buckets(self) -> int:
        return (2 * self.directions) ** self.functions


@lru_cache(maxsize=256)
def _meeting(threshold: float, directions: int) -> np.ndarray:
    """For 1, 2, 3, 4 probed directions: how often a function's hash of one of two
    vectors at the threshold is among the other's. It depends on their angle only,
    as the projections of such a pair are normal numbers so correlated."""
    rng = np.random.default_rng([SEED, directions])
    x = rng.standard_normal((SAMPLES, directions))
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * rng.standard_normal((SAMPLES, directions))
    row, best = np.arange(SAMPLES), np.abs(y).argmax(1)
    same = np.sign(y[row, best]) == np.sign(x[row, best])
    above = (np.abs(x) > np.abs(x[row, best])[:, None]).sum(1)
    return np.array([(same & (above < k)).mean() for k in range(1, 5)])


@lru_cache(maxsize=256)
def shape(rows: int, threshold: float, recall: float) -> Shape:
    """The cheapest shape by which a pair at the threshold meets with the
    probability ``recall``, of those with about ``BUCKET`` rows a bucket at most.
    Rows of buckets are shuffled, pairs in a bucket are not, so few tables of
    fuller buckets are cheaper than many of emptier ones."""
    found = []
    for functions in range(1, 9):
        for directions in DIRECTIONS:
            buckets = (2 * directions) ** functions
            if not rows / BUCKET <= buckets <= max(rows, 4) * 4:
                continue
            for probed, meets in enumerate(_meeting(threshold, directions), 1):
                if 0 < meets < 1 and probed <= directions:
                    tables = math.ceil(math.log(1 - recall) / math.log1p(-(meets**functions)))
                    probes = probed**functions
                    # A bucket that is only its own is shuffled once for both sides.
                    sent = probes + (probes > 1)
                    cost = tables * (sent + probes * rows / buckets / PAIRS_A_ROW + functions * directions / 300)
                    found.append((cost, Shape(tables, functions, directions, probed)))
    return min(found, key=lambda x: x[0])[1]


def sketch_distance(threshold: float, bits: int = SKETCH) -> int:
    """Most differing bits of two sketches at the threshold, but for ``SKETCH_LOSS``."""
    p, kept, total = math.acos(threshold) / math.pi, 0, 0.0
    for kept in range(bits + 1):
        total += math.comb(bits, kept) * p**kept * (1 - p) ** (bits - kept)
        if total >= 1 - SKETCH_LOSS:
            break
    return kept


def _codes(x: np.ndarray, form: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's bucket in every table, and those that it probes."""
    own, near = [], []
    row = np.arange(len(x))[:, None]
    for table in range(form.tables):
        choices = []
        for function in range(form.functions):
            at = x @ np.random.default_rng([SEED, 1, table, function]).standard_normal((x.shape[1], form.directions))
            best = np.argpartition(-np.abs(at), form.probed - 1, axis=1)[:, : form.probed] if form.probed < form.directions else np.tile(np.arange(form.directions), (len(x), 1))
            best = np.take_along_axis(best, np.argsort(-np.abs(np.take_along_axis(at, best, 1)), axis=1, kind="stable"), 1)
            choices.append(2 * best + (at[row, best] > 0))
        code = lambda picks, table=table, choices=choices: sum((choices[f][:, p] * (2 * form.directions) ** f for f, p in enumerate(picks)), table * form.buckets)
        own.append(code([0] * form.functions))
        near += [code(picks) for picks in product(range(form.probed), repeat=form.functions)]
    return np.stack(own, 1), np.stack(near, 1)


def hashed(df: DataFrame, key: str, vector: str, form: Shape) -> DataFrame:
    """``id, v, low, high, *WORDS, own, near``: unit vectors, sketches, buckets."""

    def hashes(batches):
        for batch in batches:
            lists = batch.column(1)
            if not batch.num_rows:
                continue
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            bits = [x @ np.random.default_rng([SEED, k]).standard_normal((x.shape[1], n)) > 0 for k, n in ((2, SKETCH), (3, WIDE))]
            words = np.packbits(np.hstack(bits), axis=1).view("<i8")
            own, near = _codes(x, form)
            lists_of = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists_of(x), *[pa.array(w) for w in words.T], lists_of(own), lists_of(near)], names=["id", "v", "low", "high", *WORDS, "own", "near"])

    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(hashes, f"id long, v array<double>, low long, high long, {', '.join(f'{w} long' for w in WORDS)}, own array<long>, near array<long>")


def _stored_hashes(df: DataFrame, key: str, vector: str, form: Shape) -> DataFrame:
    """``hashed``, written; without ``near`` where only the own buckets are probed."""
    found = hashed(df, key, vector, form)
    return stored(found if form.probed > 1 else found.drop("near"), "hashed")


@F.pandas_udf(T.DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.einsum("ij,ij->i", np.vstack(a), np.vstack(b)) if len(a) else [], dtype=float)


def meeting(probing: DataFrame, storing: DataFrame, rows: DataFrame, threshold: float, either: bool) -> DataFrame:
    """``(a, b, similarity)`` with a < b of pairs of which one probes a bucket of
    the other; ``either`` one, or only the first. Pairs whose sketches differ too
    much never leave their bucket; each other pair is compared once by a wider sketch, and
    then by its vectors."""
    left = probing.select(F.col("id").alias("a"), "low", "high", F.explode("near" if "near" in probing.columns else "own").alias("bucket"))
    right = storing.select(F.col("id").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode("own").alias("bucket"))
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    pairs = left.join(right, "bucket").where((F.col("a") != F.col("b") if either else F.col("a") < F.col("b")) & (apart("low", "low_b") + apart("high", "high_b") <= sketch_distance(threshold)))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Most pairs of a bucket that are left go by the wider sketch: few fetch their vectors.
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("id").alias(side), *[F.col(w).alias(f"{w}_{side}") for w in WORDS]), side)
    pairs = pairs.where(reduce(lambda x, y: x + y, [apart(f"{w}_a", f"{w}_b") for w in WORDS]) <= sketch_distance(threshold, WIDE)).select("a", "b")
    both = pairs.join(rows.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(rows.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    return both.select("a", "b", _cosine("va", "vb").alias("similarity")).where(F.col("similarity") >= threshold)


def met_by_all(leading: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, similarity)`` with a < b of ``leading`` (a), at most ``HELD`` numbers,
    and ``others`` (b), all of them, which are neither shuffled nor written. Products
    in single precision tell which pairs are verified."""
    held = leading.select("id", "v").toArrow()
    vectors = np.array(held["v"].to_pylist(), float) if held.num_rows else np.zeros((0, 1))
    given = leading.sparkSession.sparkContext.broadcast((held["id"].to_numpy(), vectors))

    def compare(batches):
        ids, y = given.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            low = y.astype(np.float32)
            for at in range(0, len(x), TILE):
                some = x[at : at + TILE].astype(np.float32)
                for by in range(0, len(y), BLOCK):
                    i, j = np.nonzero(some @ low[by : by + BLOCK].T >= threshold - 1e-4)
                    i, j = i + at, j + by
                    similarity = np.einsum("ij,ij->i", y[j], x[i])
                    kept = (similarity >= threshold) & (ids[j] < own[i])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[j][kept]), pa.array(own[i][kept]), pa.array(similarity[kept])], names=["a", "b", "similarity"])

    return others.select("id", "v").mapInArrow(compare, "a long, b long, similarity double")


def hashed_pairs(df: DataFrame, key: str, vector: str, threshold: float, recall: float = 0.999) -> DataFrame:
    """``(a, b, similarity)`` with a < b of the vectors that share a bucket, verified
    by their cosine. A pair at the threshold is missed with a probability of at
    most ``1 - recall``, a more similar one more rarely. Zero vectors have no pair."""
    rows = _stored_hashes(df, key, vector, shape(df.count(), threshold, recall))
    return meeting(rows, rows, rows, threshold, True)


def independent(items: DataFrame, edges: DataFrame) -> DataFrame:
    """``id`` of the leaders among ``items``, whose edges (a < b) are all given.
    Each round settles at least the first open item, so the rounds end."""
    edges = edges.select("a", "b")
    new = stored(items.join(edges.select(F.col("b").alias("id")), "id", "left_anti"), "leaders")
    leaders, open_edges = new, edges
    while True:
        # What an earlier leader has is decided; what waits for none is a leader.
        lost = stored(open_edges.join(new.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "lost")
        waiting = open_edges.join(lost.select(F.col("id").alias("b")), "b", "left_anti")
        out = lost.select(F.col("id").alias("a"), F.lit(True).alias("out"))
        left = stored(waiting.join(out, "a", "left").select("a", "b", F.coalesce("out", F.lit(False)).alias("out")), "open")
        new = stored(left.groupBy("b").agg(F.every("out").alias("free")).where("free").select(F.col("b").alias("id")), "leaders")
        open_edges = left.where("NOT out").select("a", "b").join(new.select(F.col("id").alias("b")), "b", "left_anti")
        if new.isEmpty():
            return leaders
        leaders = leaders.unionByName(new)


def _limits(rows: DataFrame, total: int) -> list[int]:
    """Ids at which the batches end; any rising numbers would do."""
    shares, size = [], FIRST
    while size < total:
        shares.append(size / total)
        size *= GROWTH
    return sorted({int(x) for x in rows.approxQuantile("id", shares, 0.001)}) if shares else []


def _leaders_by_batch(df: DataFrame, key: str, vector: str, threshold: float, recall: float, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Leaders, and the edges from leaders to later items."""
    total = df.count()
    if exact:
        rows = stored(df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")), "vectors")
    else:
        rows = _stored_hashes(df, key, vector, shape(total, threshold, recall))
        size = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    # What is open goes on without its vectors, which are read where pairs are verified.
    left, leaders, found, before = rows if exact else rows.drop("v", *WORDS), None, None, None
    for limit in [*_limits(rows, total), None]:
        own = F.lit(True) if limit is None else F.col("id") <= limit
        batch = stored(left.where(own), "batch")
        edges = stored(similar_pairs(batch, "id", "v", threshold) if exact else meeting(batch, batch, rows, threshold, True), "edges")
        new = stored(independent(batch.select("id"), edges), "batch")
        mine = edges.join(new.select(F.col("id").alias("a")), "a", "left_semi")
        # Later items, and those that an earlier leader has, meet the new leaders.
        others = rows if before is None else rows.where(F.col("id") > before)
        if not (limit is None and before is None):
            leading = rows.join(new, "id", "left_semi")
            if not exact and new.count() * size <= HELD:
                # The batch's own edges are found again.
                mine = met_by_all(leading, others, threshold)
            else:
                others = others.where(~own) if before is None else others.join(batch.select("id"), "id", "left_anti")
                mine = mine.unionByName(_compared(leading, others, total, threshold) if exact else meeting(leading, others, rows, threshold, False))
            mine = stored(mine, "edges")
        left = left.where(~own).join(mine.select(F.col("b").alias("id")), "id", "left_anti")
        leaders = new if leaders is None else leaders.unionByName(new)
        found = mine if found is None else found.unionByName(mine)
        before = limit
    return leaders, found


def leader_clusters(df: DataFrame, key: str, vector: str, threshold: float, exact: bool = False, recall: float = 0.999) -> DataFrame:
    """``key, leader, cluster, is_leader``; input order is that of the key, a whole
    number. Similar pairs come from hashes, or, if ``exact`` is set, from comparing
    all of a batch and then its leaders with all later vectors; vectors are not null."""
    leaders, edges = _leaders_by_batch(df, key, vector, threshold, recall, exact)
    chosen = edges.join(leaders.select(F.col("id").alias("b")), "b", "left_anti")
    best = chosen.groupBy("b").agg(F.max_by("a", F.struct("similarity", (-F.col("a")).alias("tie"))).alias("leader")).withColumnRenamed("b", "id")
    all_of = best.unionByName(leaders.select("id", F.col("id").alias("leader")))
    out = all_of.join(numbered(leaders, ["id"], "n").select(F.col("id").alias("leader"), "n"), "leader")
    return out.select(F.col("id").alias(key), "leader", F.format_string("story_%05d", F.col("n") + 1).alias("cluster"), (F.col("id") == F.col("leader")).alias("is_leader"))
