"""A stored full-text index: segments of postings, tombstones, merges.

A change writes one segment: the postings and sizes of the changed documents, and
the keys of all documents that it replaces or deletes. A posting counts if no later
segment names its document. So what an update writes is in proportion to the
change. Segments of like size at the end are merged once there are ``FANOUT`` of
them, so there are about log(documents) segments, and each posting is rewritten
about that often.

Postings are one row for a term in a column of a document, with its positions, in
folders by a hash of the term, so that a query reads the folders of its terms
alone. The segments in use stand in a small file, one for each version, which is
renamed into place and never replaced: of two writers one gets the number, and the
other adds its segment to what it then finds.
"""

from __future__ import annotations

import math
import time
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.words import PIECE_BYTES, counts, pieces, words
from tidewire.storage import Manifest, RacingWriters, importable

POSTINGS = "doc long, column int, term string, positions array<int>, bucket int"
SIZES = "doc long, size long"
GONE = "doc long"
#: Segments of like size that are merged, and how often a change that meets others
#: is tried again.
FANOUT, TRIES = 4, 10


def _posted(batches):
    """Postings of texts that are in lower case already, by document, column and term.
    What a task holds as words are those of one piece of a batch."""
    for piece in (p for batch in batches for p in pieces(batch, PIECE_BYTES)):
        columns = piece.num_columns - 1
        text, place, each = words(pa.concat_arrays(piece.columns[1:]))
        by_name = pc.array_sort_indices(each.dictionary).to_numpy()
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        key = (text % piece.num_rows * columns + text // piece.num_rows) * max(len(rank), 1) + rank[each.indices.to_numpy()]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        ends = np.append(first, len(key)).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(ends), pa.array(place[order]))
        at = order[first]
        docs, column = piece.column(0).take(pa.array(text[at] % piece.num_rows)), pa.array((text[at] // piece.num_rows).astype(np.int32))
        yield pa.RecordBatch.from_arrays([docs, column, each.dictionary.take(each.indices.take(pa.array(at))), places], names=["doc", "column", "term", "positions"])


def _sized(batches):
    """How many words the texts of a row have, which are in lower case already."""
    for piece in (p for batch in batches for p in pieces(batch, PIECE_BYTES)):
        size = sum((counts(texts) for texts in piece.columns[1:]), np.zeros(piece.num_rows, np.int64))
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(size)], names=["doc", "size"])


class TextIndex:
    """An index below ``path`` over some columns of a table with an integer key."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.columns, self.buckets = spark, path.rstrip("/"), key, columns, buckets
        self.manifest = Manifest(spark, f"{self.path}/versions")
        if spark is not None:
            importable(spark)

    def bucket(self, term):
        """The folder of a term."""
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def segments(self) -> list[dict]:
        """``number, folder, documents`` of the segments in use, the oldest first."""
        return self.manifest.latest()[1] or []

    def exists(self) -> bool:
        return bool(self.manifest.versions())

    def _commit(self, version: int, segments: list[dict]) -> None:
        self.manifest.commit(version, segments)

    # Writing ---------------------------------------------------------------

    def _lowered(self, df: DataFrame) -> DataFrame:
        texts = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"t{i}") for i, c in enumerate(self.columns)]
        return df.select(F.col(self.key).cast("long").alias("doc"), *texts)

    def _postings(self, df: DataFrame) -> DataFrame:
        each = self._lowered(df).mapInArrow(_posted, "doc long, column int, term string, positions array<int>")
        return each.withColumn("bucket", self.bucket("term"))

    def _sizes(self, df: DataFrame) -> DataFrame:
        return self._lowered(df).mapInArrow(_sized, SIZES)

    def _write(self, postings: DataFrame, sizes: DataFrame, gone: DataFrame) -> dict:
        folder = f"{self.path}/segments/{uuid.uuid4().hex}"
        # A common term fills a folder; AQE splits what is too large for a task.
        dealt = postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc")
        dealt.write.partitionBy("bucket").parquet(f"{folder}/postings")
        sizes.write.parquet(f"{folder}/sizes")
        gone.distinct().write.parquet(f"{folder}/gone")
        documents = self.spark.read.schema(SIZES).parquet(f"{folder}/sizes").count()
        return {"folder": folder, "documents": documents}

    def _append(self, segment: dict) -> None:
        for _ in range(TRIES):
            version, have = self.manifest.latest()
            have = have or []
            try:
                self._commit(version + 1, [*have, segment | {"number": have[-1]["number"] + 1 if have else 0}])
                return
            except RacingWriters:
                continue
        raise RacingWriters(f"{TRIES} times at {self.path}")

    def build(self, df: DataFrame) -> TextIndex:
        """The first segment, of the whole table (a key once)."""
        self._append(self._write(self._postings(df), self._sizes(df), self.spark.createDataFrame([], GONE)))
        return self

    def update(self, changed: DataFrame, deleted: DataFrame | None = None) -> TextIndex:
        """A new segment: ``changed`` rows (new or altered, a key once) take the place
        of their old selves, and the keys in ``deleted`` are gone."""
        gone = changed.select(F.col(self.key).cast("long").alias("doc"))
        if deleted is not None:
            gone = gone.unionByName(deleted.select(F.col(self.key).cast("long").alias("doc")))
            changed = changed.join(deleted.select(self.key), self.key, "left_anti")
        self._append(self._write(self._postings(changed), self._sizes(changed), gone))
        self.merge()
        return self

    def _mergeable(self, segments: list[dict]) -> list[dict]:
        """The segments at the end that are of the size of the last few or less."""
        if len(segments) < FANOUT:
            return []
        tier = lambda s: int(math.log(max(s["documents"], 1), FANOUT))
        most, first = max(tier(s) for s in segments[-FANOUT:]), len(segments)
        # Only a run of like sizes is worth it: the last few must be of one tier.
        while first and tier(segments[first - 1]) <= min(most, tier(segments[-1]) + 1):
            first -= 1
        return segments[first:] if len(segments) - first >= FANOUT else []

    def merge(self, everything: bool = False) -> bool:
        """The last segments of like size, or all, as one. What they say of earlier
        ones is kept, and forgotten where there is none. A writer that comes in
        between wins: the merge is left for the next time."""
        version, have = self.manifest.latest()
        have = have or []
        some = have if everything else self._mergeable(have)
        if len(some) < 2:
            return False
        gone = self._gone(some) if len(some) < len(have) else self.spark.createDataFrame([], GONE)
        merged = self._write(self._live(some, "postings", POSTINGS), self._live(some, "sizes", SIZES), gone.select("doc"))
        try:
            self._commit(version + 1, [*have[: len(have) - len(some)], merged | {"number": some[-1]["number"]}])
        except RacingWriters:
            return False
        return True

    def clean(self, older_seconds: float = 86400) -> int:
        """Delete old versions and the segments that only they use, and what failed
        writers left, if it is older than any reader or writer may be; the number
        of segments deleted."""
        manifest, before = self.manifest, (time.time() - older_seconds) * 1000
        versions = manifest.versions()
        for f in manifest.listed():
            name = f.getPath().getName()
            if name != f"{versions[-1]:012d}.json" and f.getModificationTime() <= before and not name.endswith(".crc"):
                manifest.fs(manifest.folder)[0].delete(f.getPath(), False)
        used = {s["folder"].rsplit("/", 1)[-1] for v in manifest.versions() for s in manifest.read(v)}
        fs, folder = manifest.fs(f"{self.path}/segments")
        old = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName() not in used and f.getModificationTime() <= before]
        for path in old:
            fs.delete(path, True)
        return len(old)

    # Reading ---------------------------------------------------------------

    def _read(self, segments: list[dict], what: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{s['folder']}/{what}").withColumn("segment", F.lit(s["number"])) for s in segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, segment int")

    def _gone(self, segments: list[dict]) -> DataFrame:
        """``doc, last``: the last segment that replaces or deletes a document."""
        return self._read(segments, "gone", GONE).groupBy("doc").agg(F.max("segment").alias("last"))

    def _live(self, segments: list[dict], what: str, schema: str, wanted=None) -> DataFrame:
        rows = self._read(segments, what, schema)
        rows = rows if wanted is None else rows.where(wanted)
        if len(segments) > 1:
            # The first segment's own tombstones have nothing to act on.
            rows = rows.join(self._gone(segments[1:]), "doc", "left").where("last IS NULL OR last <= segment").drop("last")
        return rows.drop("segment")

    def postings(self, wanted=None) -> DataFrame:
        """Postings that count, of the ``wanted`` ones (a condition on them)."""
        return self._live(self.segments(), "postings", POSTINGS, wanted)

    def sizes(self) -> DataFrame:
        return self._live(self.segments(), "sizes", SIZES)

    def hits(self, phrases: list[list[str]]) -> DataFrame:
        """``doc, size, f`` of the documents with a phrase; reads the postings of
        the phrases' terms alone."""
        terms = sorted({w for p in phrases for w in p})
        buckets = [r.b for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self.bucket("term").alias("b")).distinct().collect()]
        read = self.postings(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        found = read.groupBy("doc", "column").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
        none = F.expr("array()").cast("array<int>")

        def back(places, by: int):
            return F.transform(places, lambda p: p - by)

        def count(phrase: list[str]):
            starts = F.coalesce(F.try_element_at("at", F.lit(phrase[0])), none)
            for i, word in enumerate(phrase[1:], 1):
                later = back(F.coalesce(F.try_element_at("at", F.lit(word)), none), i)
                starts = F.array_intersect(starts, later)
            return F.size(starts)

        each = found.select("doc", *[count(p).alias(f"f{i}") for i, p in enumerate(phrases)])
        sums = each.groupBy("doc").agg(*[F.sum(f"f{i}").cast("int").alias(f"f{i}") for i in range(len(phrases))])
        f = F.array(*[F.col(f"f{i}") for i in range(len(phrases))])
        return sums.select("doc", f.alias("f")).where(F.exists("f", lambda x: x > 0)).join(self.sizes(), "doc").select("doc", "size", "f")


def vector_upsert(new: DataFrame, stored_vectors: DataFrame, key: str, keep_existing: bool) -> DataFrame:
    """A vector table with new rows (a key once): ``keep_existing`` leaves the
    vectors that are there, else new ones take their place."""
    if keep_existing:
        return stored_vectors.unionByName(new.join(stored_vectors.select(key), key, "left_anti"), allowMissingColumns=True)
    return stored_vectors.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
