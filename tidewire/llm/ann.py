"""Nearest neighbours by an adaptive dimension scan of an inverted file.

Fit (on a sample, on the driver): a random rotation, centroids by spherical
k-means, the significance of the test, and the number of lists to probe, the
smallest that reaches ``TARGET`` recall on the sample with what the test loses.
There are as many lists as keep both a list and their number near the square root
of all vectors, and the sample has ``PER_LIST`` vectors a list (``SAMPLE`` at
least), up to ``SAMPLE_BYTES`` of vectors, from where lists get longer instead of
more. Distances to all lists are computed in blocks of ``BLOCK_BYTES``, so the
driver holds a few times that and the sample, and tasks get the lists and ``SEEN``
vectors as a broadcast. Index: every distinct
vector is put into the list of its nearest centroid; a list is split into
blocks of bounded size. Search: a query goes to every block of its nearest
lists. In a block, rotated vectors are read in column blocks; after each one
the partial squared distance, scaled to all dimensions, is tested against the
query's radius, and candidates that exceed it significantly are abandoned.
The radius is the distance to the K-th nearest sample vector, an upper bound.
What survives is scored by the exact cosine of the original vectors. The
sample's nearest may lie in lists that are not probed; a query that is left with
too few hits goes to every list, without a radius. ``exact`` sends every query to
every list and abandons nothing.

Equal vectors are searched once: candidates and queries are first grouped by
the vector, keeping the smallest ids, so a vector that a third of all rows
share is one candidate and one query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, small_batches

#: About so many vectors the index is fitted on at least, and for each list (by
#: hash, at most twice as many); the recall it is calibrated to.
SAMPLE, PER_LIST, TARGET = 8192, 16, 0.97
#: Bytes of the sample's vectors at most, of a block of distances, and vectors of
#: the sample that give a query its radius at most.
SAMPLE_BYTES, BLOCK_BYTES, SEEN = 64 << 20, 16 << 20, 16_384
#: Vectors a list has, up to where the square root takes over.
IN_LIST = 512
#: Vectors of one candidate block and queries of one query block at most.
BLOCK, QUERIES = 4096, 4096
#: Rotated dimensions of a column block and the significance of the test at least.
COLUMNS, EPSILON = 16, 2.1
SEED = 7


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, not zero and wholly finite."""
    v = F.col(vector)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaling first keeps squares of very large or small components finite.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def lists_for(total: int) -> int:
    """Lists of an index of so many vectors."""
    return int(max(1, min(total // IN_LIST, 2 * total**0.5)))


def _blocks(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows whose distances to so many others fit a block."""
    step = max(1, BLOCK_BYTES // (8 * max(columns, 1)))
    for at in range(0, rows, step):
        yield slice(at, min(at + step, rows))


def closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The list of each vector."""
    found = np.empty(len(x), np.int64)
    for part in _blocks(len(x), len(centroids)):
        found[part] = (x[part] @ centroids.T).argmax(axis=1)
    return found


def radii(x: np.ndarray, seen: np.ndarray, keep: int) -> np.ndarray:
    """Squared distances to the ``keep``-th nearest of the vectors seen; 4, which
    bounds all, if there are fewer."""
    if len(seen) < keep:
        return np.full(len(x), 4.0)
    found = np.empty(len(x))
    for part in _blocks(len(x), len(seen)):
        found[part] = 2 + 2 * np.partition(-(x[part] @ seen.T), keep - 1, axis=1)[:, keep - 1]
    return found


def fit(sample: np.ndarray, total: int, k: int) -> dict:
    """Rotation, centroids, probes, significance and the vectors seen."""
    rng = np.random.default_rng(SEED)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    x = _unit(sample) @ rotation
    lists = min(lists_for(total), max(1, len(x) // PER_LIST))
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(10):
        near = closest(x, centroids)
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.zeros_like(centroids)
        sums[near[order[first]]] = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    near, seen = closest(x, centroids), x[:SEEN]
    tests = rng.choice(len(x), min(400, len(x)), replace=False)
    k = min(k, len(x) - 1)
    best, depth = np.zeros((len(tests), k), int), np.zeros((len(tests), k), int)
    for part in _blocks(len(tests), len(x) + lists):
        sims = x[tests[part]] @ x.T
        sims[np.arange(len(sims)), tests[part]] = -np.inf
        best[part] = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else best[part]
        place = np.argsort(np.argsort(-(x[tests[part]] @ centroids.T), axis=1, kind="stable"), axis=1)
        depth[part] = np.take_along_axis(place, near[best[part]], axis=1)
    # A neighbour that the test loses is found by no number of probes: the test is
    # made weaker until it loses but a third of what the target allows.
    epsilon, radius = EPSILON, np.repeat(radii(x[tests], seen, k + 1), k)
    pairs = np.repeat(x[tests], k, axis=0), x[best.ravel()]
    while (lost := ~survives(*pairs, radius, epsilon)).mean() > (1 - TARGET) / 3 if k else False:
        epsilon *= 1.25
    if k:
        depth = np.where(lost.reshape(depth.shape), lists, depth)
        probes = int(np.quantile(depth, TARGET, method="higher")) + 1
    else:
        probes = lists
    return {"rotation": rotation, "centroids": centroids, "probes": min(probes, lists), "epsilon": epsilon, "seen": seen}


def survives(queries: np.ndarray, rows: np.ndarray, radius: np.ndarray, epsilon: float) -> np.ndarray:
    """Whether the test keeps each (query, row) that is within its radius."""
    part, dim = np.cumsum((queries - rows) ** 2, axis=1), rows.shape[1]
    kept = np.ones(len(rows), bool)
    for to in range(COLUMNS, dim, COLUMNS):
        kept &= part[:, to - 1] <= radius * (1 + epsilon / np.sqrt(to)) ** 2 * to / dim + 1e-9
    return kept | (part[:, -1] > radius + 1e-9)


def adaptive_scan(queries: np.ndarray, radius: np.ndarray, rows: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) positions that no test abandoned; unit vectors, rotated.

    ``radius``: squared distances. Partial squared distances over the first d
    of D rotated dimensions, times D / d, estimate the whole; a candidate is
    abandoned once the estimate exceeds ``radius * (1 + epsilon / sqrt(d))**2``.
    After the last column block the distance is exact.
    """
    dim = rows.shape[1]
    first = min(COLUMNS, dim)
    part = ((queries[:, :first] ** 2).sum(1)[:, None] + (rows[:, :first] ** 2).sum(1)[None, :]) - 2 * (queries[:, :first] @ rows[:, :first].T)
    slack = 1e-9
    bound = radius * (1 + epsilon / np.sqrt(first)) ** 2 * first / dim if first < dim else radius
    qi, ri = np.nonzero(part <= bound[:, None] + slack)
    part = part[qi, ri]
    done = first
    while done < dim and len(qi):
        to = min(done + COLUMNS, dim)
        gap = queries[qi, done:to] - rows[ri, done:to]
        part = part + np.einsum("ij,ij->i", gap, gap)
        bound = radius * (1 + epsilon / np.sqrt(to)) ** 2 * to / dim if to < dim else radius
        stays = part <= bound[qi] + slack
        qi, ri, part, done = qi[stays], ri[stays], part[stays], to
    return qi, ri


def whole_scan(queries: np.ndarray, rows: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) positions of each query's ``keep`` nearest rows, with their
    ties; unit vectors."""
    gap = -(queries @ rows.T)
    radius = np.partition(gap, keep - 1, axis=1)[:, keep - 1] if len(rows) > keep else np.full(len(queries), np.inf)
    return np.nonzero(gap <= radius[:, None] + 1e-9)


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, exact: bool = False) -> DataFrame:
    """``query_id, rank, <key>, score``: the k nearest found for each query.

    ``vectors`` and ``queries`` have ``key`` (integers) and ``vector`` (arrays
    of one length). A query's own id is no candidate. Vectors that are null,
    zero, or hold null or non-finite components take no part, neither do rows
    with a null key; repeated rows count once; fewer candidates than k give
    fewer rows; an empty table gives none. Ties go to the smaller id. The exact
    score is the cosine in double precision of the original vectors. ``exact``
    compares every query with every vector.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    keep = k + 1  # a query may find itself
    out = f"query_id long, rank int, {key} long, score double"
    rows = usable(vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")), "v")
    asked = usable(queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")), "v")

    # Distinct vectors with their smallest ids: the rank filter is applied to
    # each map task before the shuffle, so a common vector does not gather.
    by_vector = Window.partitionBy("v").orderBy("id")
    members = rows.distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= keep)
    reps = materialize(members.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    total = reps.count()
    if not total:
        return spark.createDataFrame([], out)
    dim = reps.select(F.size("v")).first()[0]
    size = max(1, min(max(SAMPLE, PER_LIST * lists_for(total)), SAMPLE_BYTES // (16 * dim)))
    taken = reps.where(F.pmod(F.xxhash64("rep"), F.lit(max(1, total // size))) == 0).limit(2 * size).select("v").toArrow()
    model = fit(taken["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim), total, k)
    shared, lists = spark.sparkContext.broadcast(model), len(model["centroids"])

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rotation, centroids = shared.value["rotation"], shared.value["centroids"]
        for pdf in it:
            x = _unit(np.vstack(pdf.v.to_numpy())) @ rotation
            yield pdf.assign(list=closest(x, centroids).astype("int32"))

    def route(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rotation, centroids, probes, seen = (shared.value[n] for n in ("rotation", "centroids", "probes", "seen"))
        for pdf in it:
            x = _unit(np.vstack(pdf.v.to_numpy())) @ rotation
            near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes]
            radius = radii(x, seen, keep)
            yield pd.DataFrame({"qid": np.repeat(pdf.id.to_numpy(), near.shape[1]), "v": np.repeat(pdf.v.to_numpy(), near.shape[1]), "radius": np.repeat(radius, near.shape[1]), "list": near.ravel().astype("int32")})

    indexed = materialize(reps.mapInPandas(assign, "v array<double>, rep long, ids array<long>, list int"), "index")
    distinct_queries = materialize(asked.groupBy("v").agg(F.min("id").alias("id")), "asked")

    def search(cands: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "rep": pd.Series(dtype="int64"), "ids": pd.Series(dtype="object")})
        if not len(cands) or not len(asks):
            return empty
        raw = np.vstack(cands.v.to_numpy())
        asked_raw, rotation = np.vstack(asks.v.to_numpy()), shared.value["rotation"]
        x, y = _unit(raw) @ rotation, _unit(asked_raw) @ rotation
        reps_, qids, found = cands.rep.to_numpy(), asks.qid.to_numpy(), []
        for at in range(0, len(y), 256):
            radius = asks.radius.to_numpy()[at : at + 256]
            qi, ri = whole_scan(y[at : at + 256], x, keep) if np.isinf(radius).all() else adaptive_scan(y[at : at + 256], radius, x, shared.value["epsilon"])
            a, b = asked_raw[at + qi], raw[ri]
            sa, sb = np.abs(a).max(axis=1), np.abs(b).max(axis=1)
            # Only where squares would overflow or vanish; each pair by itself.
            far = (np.maximum(sa, sb) > 1e100) | (np.minimum(sa, sb) < 1e-100)
            a, b = a / np.where(far, sa, 1)[:, None], b / np.where(far, sb, 1)[:, None]
            score = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
            part = pd.DataFrame({"q": at + qi, "score": score, "row": ri, "rep": reps_[ri]}).sort_values(["q", "score", "rep"], ascending=[True, False, True])
            found.append(part.groupby("q").head(keep))
        best = pd.concat(found)
        return pd.DataFrame({"qid": qids[best.q], "score": best.score.to_numpy(), "rep": best.rep.to_numpy(), "ids": cands.ids.to_numpy()[best.row]}) if len(best) else empty

    def scan(routed: DataFrame) -> DataFrame:
        # How often a list is cut: one row a list, and lists are bounded.
        sizes = indexed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        asks = routed.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns"))
        cuts = F.broadcast(sizes.join(asks, "list"))
        left = indexed.join(cuts, "list").select("list", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "v", "rep", "ids")
        right = routed.join(cuts, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.pmod(F.xxhash64("qid"), F.col("turns")).cast("int").alias("turn"), "qid", "v", "radius")
        cell = ["list", "part", "turn"]
        hits = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(search, "qid long, score double, rep long, ids array<long>")
        top = Window.partitionBy("qid").orderBy(F.desc("score"), "rep")
        return hits.withColumn("n", F.row_number().over(top)).where(F.col("n") <= keep)

    every = F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list")
    whole = lambda asks: scan(asks.select("qid", "v", F.lit(float("inf")).alias("radius"), every))
    if exact:
        hits = whole(distinct_queries.select(F.col("id").alias("qid"), "v"))
    else:
        routed = materialize(distinct_queries.select("id", "v").mapInPandas(route, "qid long, v array<double>, radius double, list int"), "probes")
        hits = materialize(scan(routed), "hits")
        enough = hits.groupBy("qid").agg(F.sum(F.size("ids")).alias("found")).where(F.col("found") >= keep).select("qid")
        short = materialize(distinct_queries.select(F.col("id").alias("qid"), "v").join(enough, "qid", "left_anti"), "short")
        if not short.isEmpty():
            hits = hits.join(short.select("qid"), "qid", "left_anti").unionByName(whole(short))
    # The few best vectors of each distinct query, as single ids again.
    flat = hits.select("qid", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    flat = flat.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    answers = flat.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("found"))
    # Back to every query with that vector, itself left out.
    same = asked.join(distinct_queries.select("v", F.col("id").alias("qid")), "v").select("id", "qid").distinct()
    per = same.join(answers, "qid").select("id", F.slice(F.filter("found", lambda f: f.id != F.col("id")), 1, k).alias("found"))
    return per.select(F.col("id").alias("query_id"), F.posexplode("found").alias("p", "f")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.id").alias(key), F.col("f.score").alias("score"))


def op3_neighbours(spark, root: str) -> DataFrame:
    """The 5 nearest vectors of every row whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{root}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
