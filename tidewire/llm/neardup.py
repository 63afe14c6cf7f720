"""Near-duplicate classes by BagMinHash over multisets of word shingles.

A document is the multiset of its five-word shingles (lower case, words parted
by white space); the similarity of two is the weighted Jaccard index
``sum(min) / sum(max)`` of their shingle counts. A BagMinHash signature takes,
for every component, the first point of hierarchical Poisson processes that run
over (shingle, weight). The weight axis is cut into dyadic intervals (0, 1],
(1, 2], (2, 4], ..., each the root of a tree. The process of an interval draws
one point, which counts if it lies within the shingle's count, and is then split
into its halves, whose processes go on from that time; intervals of one weight
are not split further. Halves beyond the count, and whatever comes later than
the worst component, are never visited, so large counts cost little. A process
depends on its shingle and interval alone: two signatures agree in a component
with exactly the probability of the similarity.

Texts of equal words, by a 128-bit fingerprint, are one node with a number of its
own. Signatures
are cut into bands; nodes that agree in a band are in one bucket. In a bucket
some members are centres in turn: each is compared with the bucket's later
members of other classes, by the exact overlap of their multisets (of 64-bit
shingle numbers), and the links found are joined into classes. A bucket is done
when its members are in one class or every possible pair across classes has been
compared; the number of centres a round grows sixteenfold, so the rounds are
few, what a round emits is linear in the bucket for each centre, and no bucket
is cut off. Large buckets are dealt out in parts, each of which meets the
centres. Pairs that cannot be similar, by their sizes, by how many of their
elements no other text has, and by their overlap with the bucket's first centre,
are never formed: in a large group of copies that differ each in its own way
this leaves the pairs with the original.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, small_batches, text_of

WORDS, SIMILARITY = 5, 0.8
#: Bands times rows is the size of a signature; at similarity 0.8 a pair shares
#: no band with a probability of 5e-5.
BANDS, ROWS = 25, 5
#: By how much the centres of a bucket grow from round to round, and rows of a
#: bucket's part.
GROWTH, PART = 16, 256
#: Rows of a list of texts that is broadcast (about 160 bytes each); a longer one
#: is joined by a shuffle.
BROADCAST_ROWS = 300_000
SEED = np.uint64(0x51ED2701A9C3)

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the steps of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x + _A
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingles(words: list[str]) -> np.ndarray:
    """A 64-bit number for each run of ``WORDS`` words; fewer words are one run."""
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, np.uint64(min(len(h), WORDS)))
    with np.errstate(over="ignore"):
        for i in range(min(WORDS, len(h))):
            out = mix(out * _A + h[i : i + n])
    return out


def counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(numbers, return_counts=True)


def signature(keys: np.ndarray, counts: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The BagMinHash signature of a multiset, as 64-bit numbers."""
    least = np.full(size, np.inf)
    if not len(keys):
        return least.view(np.uint64)
    # A root for each key and each dyadic interval that its count reaches.
    tops = np.frexp(counts - 1.0)[1] if counts.max() > 1 else np.zeros(len(keys), dtype=int)
    key = np.repeat(keys, tops + 1)
    level = np.arange(len(key)) - np.repeat(np.cumsum(tops + 1) - tops - 1, tops + 1)
    count = np.repeat(counts, tops + 1)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    span = np.maximum(low, 1)
    at, leaves = np.zeros(len(key)), []
    while len(key):
        single = span == 1
        leaves.append((_seeds(key[single], low[single], span[single]), at[single]))
        key, count, low, span, at = (x[~single] for x in (key, count, low, span, at))
        if not len(key):
            break
        when, place, component = _points(_seeds(key, low, span), 0, 1, size)
        when = at + when[:, 0] / span
        fits = low + place[:, 0] * span < count
        np.minimum.at(least, component[fits, 0], when[fits])
        going = when < least.max()
        key, count, low, half, at = key[going], count[going], low[going], span[going] // 2, when[going]
        upper = low + half < count
        key, count, at = (np.concatenate([x, x[upper]]) for x in (key, count, at))
        low, span = np.concatenate([low, low[upper] + half[upper]]), np.concatenate([half, half[upper]])
    state, at = (np.concatenate(x) for x in zip(*leaves, strict=True))
    drawn = 0
    while len(state):
        # A few points of each process at once while there are few processes.
        n = max(1, 6 * size // len(state)) if drawn == 0 else max(1, min(64, 2 * size // len(state)))
        step, _, component = _points(state, drawn, n, size)
        step[:, 0] += at
        when = np.cumsum(step, axis=1)
        np.minimum.at(least, component.ravel(), when.ravel())
        at, drawn = when[:, -1], drawn + n
        going = at < least.max()
        state, at = state[going], at[going]
    return least.view(np.uint64)


def _seeds(key: np.ndarray, low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The state of the process of a key and an interval."""
    with np.errstate(over="ignore"):
        return mix(key ^ mix(low.astype(np.uint64) * _B + span.astype(np.uint64) + SEED))


def _points(state: np.ndarray, drawn: int, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next ``n`` points of processes of rate 1: pauses before them, places
    in their interval (0 to 1) and components."""
    with np.errstate(over="ignore"):
        draw = mix(state[:, None] + np.arange(drawn + 1, drawn + n + 1, dtype=np.uint64) * _C)
    other = mix(draw)
    pause = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
    place = (other >> np.uint64(32)).astype(np.float64) * 2.0**-32
    component = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
    return pause, place, component


def bands_of(sig: np.ndarray) -> np.ndarray:
    """A number for each band, which holds the band's own number."""
    rows = sig.reshape(BANDS, ROWS)
    out = mix(np.arange(BANDS, dtype=np.uint64))
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            out = mix(out * _A + rows[:, i])
    return out.view(np.int64)


def members_of(numbers: np.ndarray) -> np.ndarray:
    """The multiset as a set: a 64-bit number for each (shingle, occurrence)."""
    keys, counts = counted(numbers)
    key = np.repeat(keys, counts)
    turn = np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        return np.unique(mix(key + turn.astype(np.uint64) * _A)).view(np.int64)


def fingerprint(words: list[str]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table of numbers, written and reread."""
    return materialize(df, name, narrow=True)


def _keyed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``id, digest, text``: the digest names the text of a row."""
    body = text_of(text)
    return documents.select(F.col(key).cast("long").alias("id"), F.unhex(F.md5(body)).alias("digest"), body.alias("text"))


def _signed(rows: DataFrame) -> DataFrame:
    """``id, digest, print, bands``: fingerprint of the words and band numbers
    (null: no words)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            prints, bands, seen = [], [], {}
            for t in batch.column(2).to_pylist():
                words = words_of(t)
                fp = fingerprint(words)
                if fp not in seen:
                    seen[fp] = bands_of(signature(*counted(shingles(words)))).tolist() if words else None
                prints.append(fp)
                bands.append(seen[fp])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "digest", "print", "bands"])

    return rows.mapInArrow(run, "id long, digest binary, print binary, bands array<long>")


def _sets(rows: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """``node, members`` of the wanted rows (``id, digest, node``)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [members_of(shingles(words_of(t))) for t in batch.column(1).to_pylist()]
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64())
            ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["node", "members"])

    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    kept = rows.join(few, rows.id.eqNullSafe(few.id) & (rows.digest == few.digest)).select("node", "text")
    kept = kept.dropDuplicates(["node"]) if repeated else kept
    return kept.mapInArrow(run, "node long, members array<long>")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, common, similar`` of pairs ``(a, b)``: the overlap of their
    multisets and whether their similarity reaches ``SIMILARITY``."""
    left = sets.select(F.col("node").alias("b"), F.col("members").alias("mb"))
    right = sets.select(F.col("node").alias("a"), F.col("members").alias("ma"))
    both = pairs.join(left, "b").join(right, "a").withColumn("common", F.size(F.array_intersect("ma", "mb")))
    union = F.size("ma") + F.size("mb") - F.col("common")
    return both.select("a", "b", "common", (F.col("common") >= union * SIMILARITY - 1e-9).alias("similar"))


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` (root: the smallest id of its component) of the ids in
    ``edges (a, b)``, by alternating large and small stars. Each step replaces
    the edges by at most as many; it ends when all point at their roots."""
    edges = _stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = _stored(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        # Done when each id has one edge and no root has one.
        again = new.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        roots = new.select(F.col("v").alias("u")).distinct()
        open_ends = again.where("n > 1").select("u").unionByName(roots.join(new.select("u"), "u", "left_semi"))
        edges = new
        if open_ends.isEmpty():
            ids = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


#: A pair is similar only if its overlap is this share of both sizes' sum.
SHARE = SIMILARITY / (1 + SIMILARITY)


def unshared(sets: DataFrame) -> DataFrame:
    """``node, n, u``: a multiset's size and how many of its elements no other has.

    Those are in no overlap, so a multiset with more than ``(1 - s) * n`` of
    them is similar to nothing and is left out.
    """
    elements = sets.select("node", F.explode("members").alias("e"))
    alone = elements.groupBy("e").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.count("*").cast("int").alias("u"))
    sized = sets.select("node", F.size("members").alias("n")).join(alone, "node", "left").select("node", "n", F.coalesce("u", F.lit(0)).alias("u"))
    return sized.where(F.col("n") - F.col("u") >= F.col("n") * SIMILARITY - 1e-6)


def _in_parts(few: DataFrame) -> DataFrame:
    """The few rows of a bucket for each of its parts, written."""
    return _stored(few.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), "few")


ROW = ["bucket", "part", "parts", "o", "node", "n", "u"]


def links(sets: DataFrame, buckets: DataFrame) -> DataFrame:
    """``node, root``: classes of the nodes in ``buckets (bucket, node)``.

    Centres are taken in the order of how much a member shares with others, so
    that of a text and its copies the text comes first. After the first round
    each member carries its overlap with its bucket's first centre (``c``) and
    the number of its other elements that are shared at all (``x``): two
    members overlap in at most the smaller ``c`` plus the smaller ``x``.
    """
    live = _stored(buckets.join(unshared(sets), "node"), "live")
    sizes = live.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    sizes = _stored(sizes.select("bucket", "k", F.ceil(F.col("k") / PART).cast("int").alias("parts")), "sizes")
    live = _stored(live.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "sized")
    degrees = live.groupBy("node").agg(F.sum("k").alias("degree"))
    shared = F.col("n") - F.col("u")
    active = live.join(degrees, "node").withColumn("o", F.struct((-F.col("degree")).alias("d"), "node"))
    active = _stored(active.select(*ROW, shared.alias("c"), shared.alias("x")), "active")
    near = f"n >= na * {SIMILARITY} - 1e-6 AND na >= n * {SIMILARITY} - 1e-6"

    # The first round: every member meets its bucket's first, found by a minimum.
    first = active.groupBy("bucket").agg(F.min(F.struct("o", "node", "n", "parts")).alias("f"))
    first = _in_parts(first.select("bucket", F.col("f.parts").alias("parts"), F.col("f.node").alias("a"), F.col("f.n").alias("na")))
    met = _stored(active.join(first, ["bucket", "part"]).where("node <> a"), "met")
    compared = _stored(overlaps(met.where(near).select("a", F.col("node").alias("b")).distinct(), sets), "compared")
    edges = compared.where("similar").select("a", "b")
    classes = _stored(components(edges), "classes")
    rest = met.join(compared.select("a", F.col("b").alias("node"), "common"), ["a", "node"], "left")
    other = shared - F.col("common")
    rest = rest.select(*ROW, F.coalesce("common", "c").alias("c"), F.coalesce(other, "x").alias("x"))
    active = _open_buckets(rest, classes)

    centres = GROWTH
    while not active.isEmpty():
        # The first of each part, then of those the first of the bucket.
        first = active
        for group in (["bucket", "part"], ["bucket"]):
            first = first.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy("o"))).where(F.col("k") <= centres)
        first = _in_parts(first.select("bucket", "parts", F.col("o").alias("oa"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("x").alias("xa"), F.col("root").alias("ra")))
        possible = f"o > oa AND root <> ra AND {near} AND least(c, ca) + least(x, xa) >= (n + na) * {SHARE} - 1e-6"
        pairs = active.join(first, ["bucket", "part"]).where(possible).select("a", F.col("node").alias("b")).distinct()
        new = _stored(overlaps(pairs, sets).where("similar").select("a", "b"), "links")
        if not new.isEmpty():
            edges = edges.unionByName(new)
            classes = _stored(components(edges), "classes")
        last = _stored(first.groupBy("bucket", "part").agg(F.max("oa").alias("last")), "last")
        rest = active.join(last, ["bucket", "part"]).where("o > last").select(*ROW, "c", "x")
        active = _open_buckets(rest, classes)
        centres *= GROWTH
    return classes


def _open_buckets(rest: DataFrame, classes: DataFrame) -> DataFrame:
    """The members that go on: those of buckets that still hold several classes,
    while their bound allows the smallest multiset of their bucket."""
    named = rest.join(classes.select(F.col("id").alias("node"), "root"), "node", "left")
    named = _stored(named.select(*ROW, "c", "x", F.coalesce("root", "node").alias("root")), "rest")
    classes_of = F.max("parts").alias("parts"), F.min("root").alias("lo"), F.max("root").alias("hi")
    several = named.groupBy("bucket").agg(*classes_of, F.min("n").alias("least"), F.max("x").alias("most")).where("lo <> hi")
    several = _in_parts(several.select("bucket", "parts", "least", "most"))
    able = named.join(several, ["bucket", "part"]).where(f"c + least(x, most) >= (n + least) * {SHARE} - 1e-6").drop("least", "most")
    several = _in_parts(able.groupBy("bucket").agg(*classes_of).where("lo <> hi").select("bucket", "parts"))
    return _stored(able.join(several, ["bucket", "part"], "left_semi"), "active")


def classes_of_rows(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """``id, digest, root, class_id`` of every row, and whether any row is
    repeated."""
    small_batches(documents.sparkSession)
    rows = _keyed(documents, key, text)
    signed = materialize(_signed(rows), "signed")
    repeated = not signed.groupBy("id", "digest").agg(F.count("*").alias("k")).where("k > 1").isEmpty()
    # A node's row: the least key with one of its texts, null keys last. Nodes
    # are numbered as they are written, once.
    firsts = signed.groupBy("print").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "digest", "bands")).alias("r"))
    firsts = materialize(firsts.select(F.monotonically_increasing_id().alias("node"), "print", "r.id", "r.digest", "r.bands"), "firsts")
    entries = firsts.where(F.col("bands").isNotNull()).select("node", F.explode("bands").alias("bucket"))
    shared = _stored(entries.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket"), "shared")
    buckets = _stored(entries.join(shared, "bucket").select("bucket", "node").distinct(), "buckets")
    wanted = _stored(firsts.join(buckets.select("node").distinct(), "node", "left_semi").select("id", "digest", "node"), "wanted")
    classes = links(materialize(_sets(rows, wanted, repeated), "sets"), buckets).select(F.col("id").alias("node"), "root")
    ids = firsts.select("node", "id").join(classes, "node").groupBy("root").agg(F.min("id").alias("class_id"))
    named = classes.join(ids, "root")
    nodes = firsts.select("node", "print", "id").join(named, "node", "left")
    nodes = nodes.select("print", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))
    return signed.select("id", "digest", "print").join(nodes, "print").drop("print"), repeated


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, class_id``: one row for each row; the class is named by its
    smallest key.

    ``key`` holds integers; a row with a null key has a class like any other,
    named null if no row of it has a key. Null texts count as empty; texts
    without words form one class. A row's class follows from its own text, also
    where a key is repeated with other texts. An empty table gives an empty
    result, and other columns are not read.
    """
    rows, _ = classes_of_rows(documents, key, text)
    return rows.select(F.col("id").alias(key), "class_id")


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``documents`` for each class, that with the least key (null
    keys last; of several with that key, that whose text has the least digest)."""
    rows, repeated = classes_of_rows(documents, key, text)
    rows = _stored(rows.select("id", "digest", "root"), "rows")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "digest")).alias("r"))
    best = _stored(best.select("root", F.col("r.id").alias("_id"), F.col("r.digest").alias("_digest")), "best")
    other = (~F.col("id").eqNullSafe(F.col("_id"))) | (F.col("digest") != F.col("_digest"))
    copies = _stored(rows.join(best, "root").where(other).select(F.col("id").alias("_copy"), F.col("digest").alias("_print")).distinct(), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    body = F.unhex(F.md5(text_of(text)))
    kept = documents.join(copies, F.col(key).cast("long").eqNullSafe(F.col("_copy")) & (body == F.col("_print")), "left_anti")
    if not repeated:
        return kept
    return kept.withColumn("_print", body).dropDuplicates([key, "_print"]).drop("_print")


def op7_near_duplicates(spark, root: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(spark.read.parquet(f"{root}/documents.parquet"))


#: All pairs of texts that share a run of five words, by brute force. The bands
#: miss a pair at the threshold with a probability of 5e-5; the test tables hold
#: none that they miss.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
k AS (
  SELECT doc_id, w, array_to_string(w, ' ') AS k FROM w),
n AS (
  SELECT k, min(doc_id) AS id, any_value(w) AS w FROM k GROUP BY 1),
g AS (
  SELECT id, unnest([array_to_string(w[i:i+4], ' ') for i in range(1, greatest(2, len(w) - 3))]) AS g FROM n WHERE len(w) > 0),
c AS MATERIALIZED (
  SELECT id, g, count(*) AS c FROM g GROUP BY 1, 2),
z AS (
  SELECT id, sum(c) AS z FROM c GROUP BY 1),
m AS (
  SELECT a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS m FROM c a JOIN c b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM m JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE m >= (x.z + y.z - m) * 0.8 - 1e-9),
e AS MATERIALIZED (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reach) AS (
  SELECT id, id FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
o AS (
  SELECT id, min(reach) AS root FROM r GROUP BY 1)
SELECT doc_id, root AS class_id FROM k JOIN n ON n.k = k.k JOIN o ON o.id = n.id
"""
