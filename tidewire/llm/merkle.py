"""Merkle manifest of a dataset: contiguous numpy digest matrices.

Every row is a leaf: the SHA-256 of its fields, each with its length before it.
Leaves of a group (a language) stand in the order of their key; every ``fanout``
consecutive nodes become the hash of their hex digests until one remains, the
group's subroot, and the subroots become the root in the same way.

The tree is built from aligned blocks of ``fanout ** k`` nodes. In a block the hex
digests are one matrix of bytes, 64 a row; reshaped by the fanout, each of its
rows is the input of one hash of the next level. A block gives one node, and the
nodes of all blocks are the leaves of the next round, so a group of any size is
climbed in a few rounds of equal, bounded tasks. On the way down each block gets
the siblings above it, and finds those inside by index arithmetic: at level l
the siblings of leaf i are the rest of the run that holds i // fanout ** l.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import importable, materialize

HEX = 64
#: Most leaves of a block.
BLOCK = 4096


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def depth_of(fanout: int, block: int = BLOCK) -> int:
    """Levels that a block of at most ``block`` leaves climbs."""
    n = 1
    while fanout ** (n + 1) <= block:
        n += 1
    return n


def _up(n: int, fanout: int) -> int:
    return -(-n // fanout)


def _matrix(digests: list[str] | pa.ChunkedArray) -> np.ndarray:
    digests = digests if isinstance(digests, list) else digests.to_pylist()
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, HEX)


def parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The next level of a matrix of digests; a short last run becomes its hash too."""
    width, data = fanout * HEX, nodes.tobytes()
    return _matrix([hashlib.sha256(data[i : i + width]).hexdigest() for i in range(0, len(data), width)])


def climbed(leaves: np.ndarray, n: int, fanout: int, depth: int) -> list[np.ndarray]:
    """The levels of a block, leaves first, of a tree that has ``n`` nodes here."""
    found = [leaves]
    while len(found) <= depth and n > 1:
        found.append(parents(found[-1], fanout))
        n = _up(n, fanout)
    return found


def siblings(levels: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """For every leaf and level below the top: which digests are in its run
    without itself, as (leaf, level, slot) rows of the stacked levels, and a mask."""
    at = np.arange(len(levels[0]))
    base, rows, valid = 0, [], []
    for nodes in levels[:-1]:
        run = (at - at % fanout)[:, None] + np.arange(fanout)
        valid.append((run < len(nodes)) & (run != at[:, None]))
        rows.append(base + np.minimum(run, len(nodes) - 1))
        base += len(nodes)
        at = at // fanout
    if not rows:
        return np.zeros((len(levels[0]), 0, fanout), np.int64), np.zeros((len(levels[0]), 0, fanout), bool)
    return np.stack(rows, 1), np.stack(valid, 1)


def paths(levels: list[np.ndarray], fanout: int) -> list[bytes]:
    """Each leaf's siblings inside the block, level by level, left to right."""
    rows, valid = siblings(levels, fanout)
    stack = np.concatenate(levels)
    return [stack[r[v]].tobytes() for r, v in zip(rows, valid, strict=True)]


def fold(digest: bytes, path: bytes, at: int, n: int, fanout: int) -> tuple[bytes, int]:
    """The digest that a node at ``at`` of ``n`` leads to, and the bytes of path it took."""
    used = 0
    while n > 1:
        slot, run = at % fanout, min(fanout, n - (at - at % fanout))
        end = used + (run - 1) * HEX
        split = used + slot * HEX
        digest = hashlib.sha256(path[used:split] + digest + path[split:end]).hexdigest().encode()
        used, at, n = end, at // fanout, _up(n, fanout)
    return digest, used


def _climb(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """Rounds of ``tree, pos, n, digest``: the given nodes, then those of their
    blocks, until every tree has one node."""
    size = fanout**depth

    def block(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table["n"][0].as_py()
        top = climbed(_matrix(table["digest"]), n, fanout, depth)[-1]
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "n": [_up(n, size)], "digest": [top.tobytes().decode()]})

    rounds = [nodes]
    while (most := rounds[-1].agg(F.max("n")).first()[0]) and most > 1:
        dealt = rounds[-1].select("tree", "pos", "n", "digest").groupBy("tree", F.floor(F.col("pos") / size).alias("block"))
        rounds.append(materialize(dealt.applyInArrow(block, "tree long, pos long, n long, digest string"), "nodes", narrow=True))
    return rounds


def _descend(rounds: list[DataFrame], above: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``tree, pos, path`` of the first round's nodes, from the paths of the last."""
    size = fanout**depth

    def block(nodes: pa.Table, parent: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        levels = climbed(_matrix(nodes["digest"]), nodes["n"][0].as_py(), fanout, depth)
        rest = parent["path"][0].as_py()
        return pa.table({"tree": nodes["tree"], "pos": nodes["pos"], "path": [p.decode() + rest for p in paths(levels, fanout)]})

    for nodes in reversed(rounds[:-1]):
        mine = nodes.select("tree", "pos", "n", "digest").groupBy("tree", F.floor(F.col("pos") / size).alias("block"))
        above = mine.cogroup(above.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(block, "tree long, pos long, path string")
    return above


def manifest(rows: DataFrame, fields: list[str], key: str, group: str, changed: dict[str, Column] | None = None, fanout: int = 2, block: int = BLOCK) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified``, one row each.

    Leaves hash ``fields`` in their order; each ``group`` (null is one, the first)
    is a tree by ``key`` (nulls first; equal keys by their leaves, so repeated rows
    stand side by side). ``proof_sha256`` is the hash of a leaf's siblings from it
    up to the root. ``changed`` maps fields to what they are when the leaf is
    checked; ``folded_root`` is the root recomputed from that leaf and the siblings
    and ``verified`` tells if it is the root. An empty table gives an empty
    result; other columns are not read.
    """
    importable(rows.sparkSession)
    depth = depth_of(fanout, block)
    size = fanout**depth
    changed = changed or {}
    own = rows.select(
        F.col(key).alias("k"), F.col(group).alias("g"), leaf([F.col(c) for c in fields]).alias("digest"),
        (leaf([changed.get(c, F.col(c)) for c in fields]) if changed else F.lit(None).cast("string")).alias("other"),
    )
    order = [F.col("g").asc_nulls_first(), F.col("k").asc_nulls_first(), F.col("digest")]
    # Ranges are sampled anew by each evaluation, so their rows are written once.
    ranged = materialize(own.orderBy(*order).withColumn("part", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()), "leaves")

    # Rows of a group in a partition: as many as partitions and groups at most.
    counts = ranged.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("id").alias("first"))
    groups = counts.groupBy(F.col("g").alias("g_")).agg(F.sum("rows").alias("n")).orderBy(F.col("g_").asc_nulls_first())
    groups = materialize(groups.withColumn("part_", F.spark_partition_id()).withColumn("id_", F.monotonically_increasing_id()), "groups", narrow=True)
    starts = groups.groupBy("part_").agg(F.count("*").alias("rows_"), F.min("id_").alias("first_"))
    starts = starts.withColumn("above_", F.coalesce(F.sum("rows_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    groups = groups.join(F.broadcast(starts), "part_").select("g_", "n", (F.col("id_") - F.col("first_") + F.col("above_")).alias("tree"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first"))
    counts = counts.join(groups, F.col("g").eqNullSafe(F.col("g_"))).select(F.col("g").alias("g_"), F.col("part").alias("part_"), "base", "n", "tree")
    placed = ranged.join(counts, (F.col("part") == F.col("part_")) & F.col("g").eqNullSafe(F.col("g_")))
    leaves = materialize(placed.select("tree", (F.col("id") + F.col("base")).alias("pos"), "n", "digest", "k", F.coalesce("other", "digest").alias("other")), "placed")

    trees = _climb(leaves, fanout, depth)
    subroots = trees[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest")
    many = subroots.count()
    tops = _climb(subroots.withColumn("n", F.lit(many).cast("long")), fanout, depth)
    root = tops[-1].select("digest").first()
    root = root[0] if root else ""
    from_top = _descend(tops, tops[-1].select("tree", "pos", F.lit("").alias("path")), fanout, depth)
    above = trees[-1].join(from_top.select(F.col("pos").alias("tree"), "path"), "tree").select("tree", F.col("pos"), "path", F.col("digest").alias("subroot"))
    roots = above.select("tree", "subroot")
    # The first round's blocks get the paths of the second's nodes.
    above = _descend(trees[1:] or trees, above.select("tree", "pos", "path"), fanout, depth)
    above = materialize(above.join(roots, "tree"), "above", narrow=True)

    kind = rows.schema[key].dataType.simpleString()
    names = ["k", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def prove(nodes: pa.Table, parent: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        tree, n, first = (nodes[c][0].as_py() for c in ("tree", "n", "pos"))
        subroot, rest = parent["subroot"][0].as_py(), parent["path"][0].as_py().encode()
        levels = climbed(_matrix(nodes["digest"]), n, fanout, depth)
        inside = paths(levels, fanout)
        # The siblings above the block are the same for all: what a digest of its
        # top leads to is computed once.
        climbs, at, left = len(levels) - 1, first, n
        for _ in range(climbs):
            at, left = at // fanout, _up(left, fanout)
        known: dict[bytes, str] = {}

        def to_root(top: bytes) -> str:
            if top not in known:
                sub, used = fold(top, rest, at, left, fanout)
                known[top] = fold(sub, rest[used:], tree, many, fanout)[0].decode()
            return known[top]

        rows_, valid = siblings(levels, fanout)
        stack, now, at_ = np.concatenate(levels), _matrix(nodes["other"]), np.arange(len(nodes))
        for level in range(climbs):
            runs = stack[rows_[:, level]]
            runs[np.arange(len(now)), at_ % fanout] = now
            held = (valid[:, level].sum(1) + 1) * HEX
            now = _matrix([hashlib.sha256(r[:h]).hexdigest() for r, h in zip(runs.reshape(len(now), -1), held, strict=True)])
            at_ = at_ // fanout
        folded = [to_root(x.tobytes()) for x in now]
        proofs = [hashlib.sha256(p + rest).hexdigest() for p in inside]
        count = len(nodes)
        return pa.table([nodes["k"], nodes["digest"], [subroot] * count, [root] * count, proofs, folded, [f == root for f in folded]], names=names)

    mine = leaves.groupBy("tree", F.floor(F.col("pos") / size).alias("block"))
    # With one round only, a tree's single leaf is its own block's node.
    theirs = above.groupBy("tree", F.col("pos").alias("block"))
    found = mine.cogroup(theirs).applyInArrow(prove, f"k {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumnRenamed("k", key)


def op13_manifest(spark, root: str) -> DataFrame:
    """The manifest of all documents by language, checked against documents whose
    ``n_chars`` is one more where 7 divides the checksum of the id."""
    documents = spark.read.parquet(f"{root}/documents.parquet")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(odd, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    return manifest(documents, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", {"n_chars": n_chars})


OP13_SQL = """
WITH RECURSIVE
table_ AS (
  SELECT [list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for i in range(256)] AS t),
sums AS (
  SELECT doc_id, source, lang, n_chars, text, coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || x AS BIGINT) for x in regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..')]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295), 1) AS crc
  FROM documents, table_),
parts AS (
  SELECT doc_id, lang,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS was,
         CASE WHEN crc % 7 = 0 THEN coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') ELSE coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') END AS is_now,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM sums),
hashed AS (SELECT doc_id, lang, sha256(head || was || tail) AS leaf, sha256(head || is_now || tail) AS other FROM parts),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM hashed),
nodes AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, any_value(lvl) + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, pos // 2),
subroots AS (SELECT tree, h AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, tree AS pos, (SELECT count(*) FROM subroots) AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY pos // 2),
climb AS (
  SELECT doc_id, leaf, tree, 0 AS lvl, pos, n, pos AS row_, other AS cur, '' AS path FROM leaves
  UNION ALL
  SELECT c.doc_id, c.leaf, c.tree, c.lvl + 1, c.pos // 2, (c.n + 1) // 2, c.row_,
         sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.cur ELSE c.cur || coalesce(s.h, '') END), c.path || coalesce(s.h, '')
  FROM climb c LEFT JOIN nodes s ON s.tree = c.tree AND s.lvl = c.lvl AND s.pos = xor(c.pos, 1) WHERE c.n > 1),
upper_ AS (
  SELECT doc_id, leaf, tree, row_, 0 AS lvl, tree AS pos, (SELECT count(*) FROM subroots) AS n, cur, path FROM climb WHERE n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.tree, c.row_, c.lvl + 1, c.pos // 2, (c.n + 1) // 2,
         sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.cur ELSE c.cur || coalesce(s.h, '') END), c.path || coalesce(s.h, '')
  FROM upper_ c LEFT JOIN tops s ON s.lvl = c.lvl AND s.pos = xor(c.pos, 1) WHERE c.n > 1)
SELECT u.doc_id, u.leaf, s.subroot, r.h AS root, sha256(u.path) AS proof_sha256, u.cur AS folded_root, u.cur = r.h AS verified
FROM upper_ u JOIN subroots s USING (tree), (SELECT h FROM tops WHERE n = 1) r WHERE u.n = 1
"""
