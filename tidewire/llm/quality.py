"""Quality scores: random Fourier features of document statistics, ridge
regression from partition-summed normal equations, isotonic calibration.

One scan turns each text into a short vector of statistics. The labelled part
is standardised and mapped to random Fourier features, whose inner products
approximate a Gaussian kernel; every partition adds up its own normal
equations, and their sum (a matrix of fixed size) is solved on the driver. The
raw scores of the labelled part, counted in a fixed number of bins, are made
monotone by pooling adjacent violators, which turns scores into probabilities.
All labelled rows are used; only sums of fixed size reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import fold, materialize, small_batches, text_of

FEATURES, GAMMA, RIDGE, BINS, SEED = 384, 0.12, 1.0, 512, 11
THRESHOLD, CLIP, FOLDS = 0.3, 6, 5
#: Copies of the normal equations that are added up side by side.
WAYS = 32

_WORD = re.compile(r"[^\W\d_]+")
_UPPER = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{3,}\b")
_SYMBOL_RUN = re.compile(r"([^\w\s])\1{1,}")
_ODD = re.compile(r"[^\w\s.,;:'\"()?!-]")
_DIGIT = re.compile(r"\d")
_STATS = 24


def statistics(text: str) -> list[float]:
    """Statistics of a whole text; the empty text has all zeros."""
    n = len(text)
    if not n:
        return [0.0] * _STATS
    tokens = text.split()
    m = max(1, len(tokens))
    counts = Counter(tokens)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, _WORD.findall(text)))
    raw = text.encode()
    packed = len(zlib.compress(raw, 1)) / len(raw)
    repeats = sum(a == b for a, b in pairwise(tokens))
    marks = text.count(".") + text.count("!") + text.count("?")
    top = counts.most_common(1)[0][1] if counts else 0
    upper = sum(map(len, _UPPER.findall(text)))
    return [
        np.log1p(n),
        np.log1p(m),
        letters / m / 10,
        len(counts) / m,
        top / m,
        repeats / m,
        len({*pairwise(tokens)}) / m,
        letters / n,
        upper / n,
        len(_SYMBOL_RUN.findall(text)) / m,
        len(_ODD.findall(text)) / n * 5,
        text.count("!") / m,
        text.count("|") / m,
        text.count("#") / m + text.count("*") / m + text.count("$") / m + text.count("%") / m + text.count("&") / m,
        text.count(",") / m,
        marks / m,
        np.log1p(m / max(1, marks)) / 5,
        len(set(lines)) / max(1, len(lines)),
        np.log1p(len(lines)),
        m / max(1, len(lines)) / 100,
        len(_DIGIT.findall(text)) / n * 5,
        packed,
        min(packed, 1.0) * np.log1p(n) / 10,
        sum(len(t) == 1 for t in tokens) / m,
    ]


class Model:
    """Everything that scoring needs; of fixed size."""

    def __init__(self, mean, scale):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.omega = rng.standard_normal((_STATS, FEATURES)) * np.sqrt(2 * GAMMA)
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.edges, self.values = np.asarray([0.0]), np.asarray([0.5])

    def map(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        out = np.sqrt(2 / FEATURES) * np.cos(z @ self.omega + self.phase)
        return np.hstack([out, np.ones((len(out), 1))])

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.map(stats) @ (self.weights if weights is None else weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.edges, self.values)


def isotonic(centres: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: block centres and their increasing means."""
    blocks: list[list[float]] = []
    for x, p, c in zip(centres, positives, counts, strict=True):
        if c:
            blocks.append([x * c, p, c])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.asarray([0.0]), np.asarray([0.5])
    # A weak prior keeps single labels from giving certainty.
    return np.asarray([b[0] / b[2] for b in blocks]), np.asarray([(b[1] + 0.5) / (b[2] + 1) for b in blocks])


def features(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``stats`` of every row."""
    small_batches(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"key": pdf.key, "stats": [statistics(t) for t in pdf.text]})

    out = documents.select(F.col(key).alias("key"), text_of(text).alias("text")).mapInPandas(run, f"key {kind}, stats array<double>")
    return out.withColumnRenamed("key", key)


def solve(total: np.ndarray) -> np.ndarray:
    """Ridge weights of normal equations (their last row: the right side); the
    constant is not penalised."""
    return np.linalg.lstsq(total[:-1] + RIDGE * np.diag([*np.ones(FEATURES), 0.0]), total[-1], rcond=None)[0]


def fit(labelled: DataFrame) -> Model:
    """A model of rows ``stats, label, fold`` (label 0 to 1)."""
    sums = labelled.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).collect()
    mean, scale = np.zeros(_STATS), np.ones(_STATS)
    for r in sums:
        mean[r.i], scale[r.i] = r["mean"], max(r.sd, 1e-6)
    model = Model(mean, scale)
    if not sums:
        return model
    height = FEATURES + 2

    def equations(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, height, FEATURES + 1))
        for pdf in it:
            x, y, fold_of = model.map(np.vstack(pdf.stats.to_numpy())), pdf.label.to_numpy(dtype=float), pdf.fold.to_numpy()
            for f in np.unique(fold_of):
                own = fold_of == f
                total[f, :-1] += x[own].T @ x[own]
                total[f, -1] += x[own].T @ y[own]
        for f in range(FOLDS):
            if total[f].any():
                yield pd.DataFrame({"i": np.arange(height) + f * height, "row": list(total[f])})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [int(pdf.i.iloc[0])], "row": [np.sum(np.vstack(pdf.row.to_numpy()), axis=0)]})

    # A row of the equations for each partition, added up in two steps.
    parts = labelled.select("stats", "label", "fold").mapInPandas(equations, "i int, row array<double>")
    parts = parts.groupBy("i", F.pmod(F.spark_partition_id(), F.lit(WAYS)).alias("way")).applyInPandas(add, "i int, row array<double>")
    by_fold = np.zeros((FOLDS, height, FEATURES + 1))
    for r in parts.groupBy("i").applyInPandas(add, "i int, row array<double>").collect():
        by_fold[r.i // height, r.i % height] = r.row
    total = by_fold.sum(axis=0)
    model.weights = solve(total)
    # A fold that holds all rows is scored with the weights of all.
    others = [solve(total - own) if (total - own).any() else model.weights for own in by_fold]

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            stats, fold_of = np.vstack(pdf.stats.to_numpy()), pdf.fold.to_numpy()
            raw = np.zeros(len(pdf))
            for f in np.unique(fold_of):
                raw[fold_of == f] = model.raw(stats[fold_of == f], others[f])
            bins = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1)
            yield pd.DataFrame({"bin": bins.astype("int32"), "label": pdf.label.to_numpy(dtype=float)})

    binned = labelled.select("stats", "label", "fold").mapInPandas(count, "bin int, label double").groupBy("bin").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
    p, n = np.zeros(BINS), np.zeros(BINS)
    for r in binned:
        p[r.bin], n[r.bin] = r.p, r.n
    model.edges, model.values = isotonic((np.arange(BINS) + 0.5) / BINS * 2 - 0.5, p, n)
    return model


def train(stats: DataFrame, labels: DataFrame, key: str, label: str, usable) -> Model:
    """Fit on the rows of ``stats`` that ``labels`` marks and ``usable`` admits.

    A key that is labelled repeatedly counts once, with its mean label.
    """
    marks = labels.where(usable & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(F.col(label)).alias("label"))
    fold_of = F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int").alias("fold")
    return fit(materialize(stats.join(marks, key).select("stats", "label", fold_of), "labelled"))


def with_statistics(documents: DataFrame, text: str, name: str) -> DataFrame:
    """``documents`` with the statistics of ``text`` (null: the empty text)."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    return documents.withColumn(name, stats(text_of(text)))


def score_of(stats: Column, model: Model) -> Column:
    """The score of statistics."""

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack(rows.to_numpy()))) if len(rows) else pd.Series(dtype="float64")

    return score(stats)


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 5, held: int = 0) -> DataFrame:
    """``key, held_out, score, predicted`` for every row of ``documents``.

    Labels count only where ``crc32(key) mod modulus`` is not ``held``. Null and
    empty texts get the score of the empty text, a null key is never held out,
    repeated rows are repeated, an empty table gives an empty result, and
    without any usable label every score is 0.5. Inputs of a score are the
    text's statistics alone.
    """
    stats = materialize(features(documents, key, text), "stats")
    model = train(stats, labels, key, label, fold(key, modulus) != held)
    kind = stats.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield pd.DataFrame({"key": pdf.key, "score": model.score(np.vstack(pdf.stats.to_numpy()))})

    scored = stats.select(F.col(key).alias("key"), "stats").mapInPandas(run, f"key {kind}, score double").withColumnRenamed("key", key)
    held_out = F.coalesce(fold(key, modulus) == held, F.lit(False))
    return scored.select(key, held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_quality(spark, root: str) -> DataFrame:
    """The quality score of every document."""
    return classify(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet"))
