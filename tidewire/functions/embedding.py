"""Vectors of texts without a model: hashed bags of words of unit length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from tidewire.functions.words import pieces, words
from tidewire.storage import importable

DIMENSIONS = 384
#: Vectors that a task fills at once.
ROWS = 1024


def places_of(words: list[bytes], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The places of words, by the first 32 bits of their MD5."""
    digests = b"".join([hashlib.md5(w, usedforsecurity=False).digest() for w in words])
    return (np.frombuffer(digests, ">u4")[::4] % dimensions).astype(np.int64)


def _lists(parts: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    """Values as a list a row; ``parts`` are their rows, in order."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(parts, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _counted(df: DataFrame, key: str, text: str, dimensions: int) -> DataFrame:
    """``key, places, counts``: the filled places of each key, and how many words fall
    there. Words are counted where the texts lie; a row a text is shuffled, so that a
    key's texts meet, whose lists may name a place again."""

    def count(batches):
        for piece in (p for batch in batches for p in pieces(batch)):
            row, _, each = words(piece.column(1))
            at = places_of(each.dictionary.cast(pa.binary()).to_pylist(), dimensions)
            spot, many = np.unique(row * dimensions + at[each.indices.to_numpy()] if len(row) else row, return_counts=True)
            filled, parts = np.unique(spot // dimensions, return_inverse=True)
            lists = [_lists(parts, v, len(filled)) for v in ((spot % dimensions).astype(np.int32), many.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(filled)), *lists], names=[key, "places", "counts"])

    importable(df.sparkSession)
    low = df.where(F.col(key).isNotNull()).select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text"))
    each = low.mapInArrow(count, StructType([low.schema[key]]).add("places", ArrayType(IntegerType())).add("counts", ArrayType(LongType())))
    both = F.collect_list(F.struct("places", "counts"))
    return each.groupBy(key).agg(both.alias("_")).select(key, F.flatten("_.places").alias("places"), F.flatten("_.counts").alias("counts"))


def _vectors(batch: pa.RecordBatch, dimensions: int):
    """The vectors of a batch of ``key, places, counts``, some rows at a time."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        places, counts = part.column(1), part.column(2)
        spot = pc.list_parent_indices(places).to_numpy() * dimensions + places.flatten().to_numpy()
        n = np.bincount(spot, counts.flatten().to_numpy(), part.num_rows * dimensions).reshape(part.num_rows, dimensions)
        yield part.column(0), n / np.sqrt((n * n).sum(axis=1, keepdims=True))


def sparse(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``key, place, weight`` of the filled places of each vector."""

    def weigh(batches):
        for keys, vectors in (v for batch in batches for v in _vectors(batch, dimensions)):
            row, place = np.nonzero(vectors)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(vectors[row, place])], names=[key, "place", "weight"])

    return _counted(df, key, text, dimensions).mapInArrow(weigh, StructType([df.select(key).schema[0]]).add("place", IntegerType()).add("weight", DoubleType()))


def dense(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS, kind: str = "float") -> DataFrame:
    """``key, embedding``: an array of numbers of unit length; texts without a word
    have no vector."""

    def fill(batches):
        for keys, vectors in (v for batch in batches for v in _vectors(batch, dimensions)):
            ends = np.arange(0, vectors.size + 1, dimensions, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(vectors.ravel()))], names=[key, "embedding"])

    out = _counted(df, key, text, dimensions).mapInArrow(fill, StructType([df.select(key).schema[0]]).add("embedding", ArrayType(DoubleType())))
    return out.select(key, F.col("embedding").cast(f"array<{kind}>").alias("embedding"))


class Lazy:
    """A model that is loaded when it is first asked for; ``None`` for good if it
    cannot be."""

    def __init__(self, loader):
        self.loader, self.loaded, self.model = loader, False, None

    def get(self):
        if not self.loaded:
            self.loaded = True
            try:
                self.model = self.loader()
            except Exception as e:  # noqa: BLE001 - no model means the rules
                import logging

                logging.getLogger(__name__).warning("no model: %s", e)
        return self.model
