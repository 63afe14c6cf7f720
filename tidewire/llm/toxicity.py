"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled. A sentence is
toxic with the probability that a logistic model of its words gives it, and a
document with that of at least one toxic sentence (noisy-or):
``1 - prod(1 - p)``. The word weights maximise the likelihood of the document
labels; the gradient reaches each sentence through its share in the bag, so
the offending sentences stand out although none was ever labelled.

Words count with their beginnings (of 4, 5 and 6 letters), so that other
endings of a word are known too. The model is fitted on a bounded sample of
labelled documents (``SAMPLE`` of each label, weighted back to their share), and
its parameters are bounded too: the ``VOCABULARY`` words that tell the labels
apart best among those in ``LEAST`` toxic sample documents or more. What reaches
the driver is the numbers of known words of each sample sentence that has any;
texts stay with the tasks. Scoring reads whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import fold, materialize, small_batches, text_of

#: Labelled documents of each label that the model is fitted on at most, and
#: the words and beginnings it may know at most.
SAMPLE, VOCABULARY = 8000, 20_000
#: A word must occur in so many toxic sample documents.
LEAST = 3
ROUNDS, RATE, PENALTY = 500, 0.3, 0.0003
THRESHOLD = 0.3
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def keys_of(word: str) -> list[str]:
    """A lower-cased word and its beginnings (marked by a hyphen)."""
    return [word, *(word[:n] + "-" for n in (4, 5, 6) if len(word) > n)]


class _Weights(dict):
    """The summed weight of a word and its beginnings."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = sum(self.weights.get(k, 0.0) for k in keys_of(word))
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


class Model:
    def __init__(self, weights: dict[str, float], bias: float, rest: float):
        #: ``bias``: log-odds of a sentence without known words; ``rest``: those
        #: of a document beside its sentences (labels that no sentence explains).
        self.weights, self.bias, self.rest = weights, bias, rest
        self._cache: _Weights | None = None

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "rest": self.rest, "_cache": None}

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, log-odds) of each sentence with a word."""
        self._cache = self._cache or _Weights(self.weights)
        found = []
        for m in _SENTENCE.finditer(text):
            if words := _WORD.findall(m[0].lower()):
                found.append((m.start(), m.end(), self.bias + sum(map(self._cache.__getitem__, set(words)))))
        return found

    def score(self, text: str) -> float:
        """Noisy-or over the sentences; an empty text has the rest alone."""
        self._cache = self._cache or _Weights(self.weights)
        clean, none = 0, -np.logaddexp(0, self.rest)
        get = self._cache.__getitem__
        for sentence in _SENTENCE.findall(text):
            if words := _WORD.findall(sentence.lower()):
                z = sum(map(get, set(words)))
                if z:
                    none -= np.logaddexp(0, self.bias + z)
                else:
                    clean += 1
        none -= clean * np.logaddexp(0, self.bias)
        return float(-np.expm1(none))


class Bags:
    """Bags ``(plain sentences, known sentences as lists of word numbers, label,
    weight)`` as arrays."""

    def __init__(self, bags: list[tuple[int, list[list[int]], float, float]], size: int):
        self.count, self.size = len(bags), size
        self.owner = np.asarray([i for i, b in enumerate(bags) for _ in b[1]], dtype=int)
        self.sentence = np.repeat(np.arange(len(self.owner)), [len(s) for b in bags for s in b[1]]) if len(self.owner) else np.zeros(0, int)
        self.words = np.asarray([x for b in bags for s in b[1] for x in s], dtype=int)
        self.plain = np.asarray([b[0] for b in bags], dtype=float)
        self.y = np.asarray([b[2] for b in bags])
        self.weight = np.asarray([b[3] for b in bags])

    def likelihood(self, w: np.ndarray, bias: float, rest: float) -> tuple[float, np.ndarray, float, float]:
        """The weighted log likelihood of the labels under noisy-or, and its
        gradient by word weights, bias and rest."""
        z = bias + np.bincount(self.sentence, weights=w[self.words], minlength=len(self.owner))
        p = 1 / (1 + np.exp(-z))
        p0, pr = 1 / (1 + np.exp(-bias)), 1 / (1 + np.exp(-rest))
        none = np.bincount(self.owner, weights=-np.logaddexp(0, z), minlength=self.count) - self.plain * np.logaddexp(0, bias) - np.logaddexp(0, rest)
        some = np.clip(-np.expm1(none), 1e-9, 1)
        value = float((self.weight * (self.y * np.log(some) + (1 - self.y) * none)).sum())
        # d log-likelihood / d sentence log-odds = p * (y * (1 - some) / some - (1 - y))
        pull = self.weight * (self.y * np.exp(none) / some - (1 - self.y))
        by_sentence = pull[self.owner] * p
        by_word = np.bincount(self.words, weights=by_sentence[self.sentence], minlength=self.size)
        return value, by_word, float((pull * self.plain * p0).sum() + by_sentence.sum()), float((pull * pr).sum())


def fit(bags: list[tuple[int, list[list[int]], float, float]], size: int, start: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights, bias and rest by gradient ascent on the noisy-or likelihood."""
    w, bias, rest = start.copy(), -9.0, -5.0
    if not bags:
        return w, bias, rest
    data = Bags(bags, size)
    seen, total = np.bincount(data.words, minlength=size) + 10.0, data.weight.sum()
    for _ in range(ROUNDS):
        _, by_word, by_bias, by_rest = data.likelihood(w, bias, rest)
        w = np.clip(w + RATE * 8 * (by_word - PENALTY * seen * w) / seen, -4, 14)
        bias = float(np.clip(bias + RATE * 20 * by_bias / total, -14, -4))
        rest = float(np.clip(rest + RATE * 20 * by_rest / total, -8, -1))
    return w, bias, rest


def train(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, usable, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each label, chosen by a
    hash of their key. A key that is labelled repeatedly is toxic if any label
    says so; of a key's different texts that with the least SHA-256 is learned from."""
    spark = documents.sparkSession
    small_batches(spark)
    marks = labels.where(usable & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    marks = materialize(marks, "marks")
    shares = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    kept = [marks.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample) for y in (0, 1)]
    chosen = materialize(kept[0].unionByName(kept[1]), "chosen")
    # At most 2 * sample keys: bounded, so broadcast; the texts are not shuffled.
    bags = documents.select(F.col(key).alias("k"), text_of(text).alias("t")).join(F.broadcast(chosen), "k")
    bags = materialize(bags.groupBy("k").agg(F.min_by("t", F.sha2("t", 256)).alias("t"), F.first("y").alias("y")), "bags")

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found: dict[str, list[int]] = {}
            for t, y in zip(pdf.t, pdf.y, strict=True):
                for k in {k for word in set(_WORD.findall(t.lower())) for k in keys_of(word)}:
                    found.setdefault(k, [0, 0])[y] += 1
            yield pd.DataFrame({"w": list(found), "n0": [v[0] for v in found.values()], "n1": [v[1] for v in found.values()]})

    sizes = {y: max(1, min(n, sample)) for y, n in shares.items()}
    n0, n1 = sizes.get(0, 1), sizes.get(1, 1)
    counts = bags.select("t", "y").mapInPandas(count, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    gain = odds * F.sqrt(F.col("n1"))
    words = counts.where(F.col("n1") >= LEAST).withColumn("odds", odds).where("odds > 1").orderBy(gain.desc(), "w").limit(VOCABULARY).select("w", "odds").collect()
    number = {r.w: i for i, r in enumerate(words)}
    start = np.asarray([0.5 * r.odds for r in words]) if words else np.zeros(0)

    def compact(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            plain, known = [], []
            for t in pdf.t:
                clean, flat = 0, []
                for s in _SENTENCE.findall(t):
                    if own := set(_WORD.findall(s.lower())):
                        if ids := {number[k] for word in own for k in keys_of(word) if k in number}:
                            flat += [*sorted(ids), -1]
                        else:
                            clean += 1
                plain.append(clean)
                known.append(flat)
            yield pd.DataFrame({"plain": plain, "known": known, "y": pdf.y.to_numpy()})

    rows = bags.select("t", "y").mapInPandas(compact, "plain int, known array<int>, y int").collect()
    share = {y: shares[y] / sizes[y] for y in shares}

    def lists(flat: list[int]) -> list[list[int]]:
        out, own = [], []
        for x in flat:
            if x < 0:
                out.append(own)
                own = []
            else:
                own.append(x)
        return out

    w, bias, rest = fit([(r.plain, lists(r.known), float(r.y), share[r.y]) for r in rows], len(words), start)
    return Model({r.w: float(x) for r, x in zip(words, w, strict=True) if abs(x) > 1e-3}, bias, rest)


def classify(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 4, held: int = 2) -> DataFrame:
    """``key, held_out, score, predicted, sentences`` for every row.

    ``sentences``: array of ``(start, end, score)`` (code points) of the
    sentences that are toxic with at least ``THRESHOLD``, worst first. Labels
    count only where ``crc32(key) mod modulus`` is not ``held``. Null and empty
    texts have no sentence and get the score of an empty bag, a null key is
    never held out, repeated rows are repeated, an empty table gives an empty
    result, and without usable labels no word is known and scores are low.
    """
    model = train(documents, labels, key, text, label, fold(key, modulus) != held)
    kind = documents.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            scores = [model.score(t) for t in pdf.text]
            worst = [located(model, t) if s >= THRESHOLD else [] for t, s in zip(pdf.text, scores, strict=True)]
            yield pd.DataFrame({"key": pdf.key, "score": scores, "sentences": worst})

    out = documents.select(F.col(key).alias("key"), text_of(text).alias("text")).mapInPandas(run, f"key {kind}, score double, sentences array<struct<start: int, end: int, score: double>>")
    out = out.withColumnRenamed("key", key)
    held_out = F.coalesce(fold(key, modulus) == held, F.lit(False))
    return out.select(key, held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "sentences")


def located(model: Model, text: str) -> list[dict]:
    """The offending sentences of a text, worst first."""
    found = [{"start": s, "end": e, "score": float(1 / (1 + np.exp(-z)))} for s, e, z in model.sentences(text)]
    return sorted((x for x in found if x["score"] >= THRESHOLD), key=lambda x: (-x["score"], x["start"]))


def op8_toxicity(spark, root: str) -> DataFrame:
    """The toxicity score of every document and its offending sentences (start,
    end, score), worst first."""
    return classify(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet"))
