"""Personal data by patterns and a skip-chain conditional random field.

The base finds e-mail and IP addresses, card and phone numbers by pattern, in
time linear in the text. The field then reads every text that has a candidate
(a token with ``@``, a chunk of digits, four numbers in a row): candidates are
its nodes, each with a label (none or a kind). Node potentials come from the
candidate's shape and the word before it; each candidate shares a transition
potential with the next; and distant candidates that repeat or resemble each
other (an address in other letters or with other marks, the same digits in
other punctuation, one number with and without its country code) share a skip
potential. Loopy belief propagation, with base spans held fixed, gives each
node a marginal; a free node that is surely personal data adds a span.

All potentials are learned together by pseudo-likelihood. As patterns know
nothing of what they miss, learning hides labels from them: on a bounded sample
of texts (``SAMPLE``) each base entity is mentioned once more in a form that no
pattern matches, with its label kept; every other candidate is repeated as none;
and entities of another text are mentioned in such a form as none, because a
look-alike alone is no evidence. So what the field learns is how far to trust
shape, context, sequence and repetition, and with the base held fixed it labels
the mentions that the patterns miss.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
#: About so many texts the potentials are learned from, at most twice as many.
SAMPLE = 4000
#: A free node adds a span if its marginal for one kind reaches this.
SURE = 0.9
ROUNDS, DAMPING = 12, 0.3
#: Candidates of one sampled text that are learned from at most (those whose
#: places have the least hashes), and characters before one that are kept.
PER_TEXT, AROUND = 200, 40
STEPS, RATE, PENALTY = 250, 0.15, 0.01

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can start only at the first digit of a run: if it fails there it
# fails at every later digit of that run, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EVIDENCE = re.compile(r"[@0-9]")
_NUMBER = re.compile(r"\+?[0-9(](?:[\x20().-]?[0-9()])*+")
_QUAD = re.compile(r"[0-9]{1,3}(?:[.\x20-][0-9]{1,3}){3}")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[^0-9]+")
_MARKS = re.compile(r"[\W_]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _octet(digits: str) -> bool:
    """At most 255, with any number of leading zeros."""
    rest = digits.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans by kind as listed, then start."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _EVIDENCE.search(text):
        return found
    for m in _IP.finditer(text):
        if all(_octet(p) for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


# Nodes -----------------------------------------------------------------------


def candidates(text: str, base: list[tuple[str, int, int]] = ()) -> list[tuple[int, int]]:
    """The base spans, and beside them tokens with ``@``, chunks of seven digits
    or more and four short numbers in a row; in order, without overlap."""
    found: list[tuple[int, int]] = []
    for start, end in sorted(((s, e) for _, s, e in base), key=lambda x: (x[0], -x[1])):
        if not found or start >= found[-1][1]:
            found.append((start, end))
    chunks = []
    if "@" in text:
        for m in _TOKEN.finditer(text):
            if "@" in m[0]:
                token = m[0].strip("()[]{}<>.,;:!?\"'*&$#%")
                if len(token) > 2:
                    start = m.start() + m[0].index(token)
                    chunks.append((start, start + len(token)))
    found = _beside(found, chunks)
    chunks = []
    for m in _NUMBER.finditer(text):
        start, end = m.start(), m.end()
        while end > start and text[end - 1] in " ().-":
            end -= 1
        closing = text.rfind(")", start, end)
        while start < end and (text[start] == ")" or (text[start] == "(" and closing < start)):
            start += 1
        token = text[start:end]
        if len(_DIGITS.sub("", token)) >= 7 or _QUAD.fullmatch(token):
            chunks.append((start, end))
    return _beside(found, chunks)


def _beside(taken: list[tuple[int, int]], chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``taken`` and those chunks that overlap none of it, in order."""
    found, at = list(taken), 0
    for start, end in chunks:
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or taken[at][0] >= end:
            found.append((start, end))
    return sorted(found)


def words_before(text: str, nodes: list[tuple[int, int]]) -> list[str]:
    """For each node the token before the one it stands in; ``^`` if none."""
    tokens = [m.span() for m in _TOKEN.finditer(text)] if nodes else []
    out, at = [], 0
    for start, _ in nodes:
        while at + 1 < len(tokens) and tokens[at + 1][0] <= start:
            at += 1
        word = text[slice(*tokens[at - 1])].lower().strip(":;,.()") if at else "^"
        out.append(word)
    return out


def shape(token: str, word: str) -> list[str]:
    """Names of the features of a candidate that follows a word."""
    digits = _DIGITS.sub("", token)
    parts = token.split(".")
    names = ["bias", f"digits{min(len(digits), 20)}", f"at{min(token.count('@'), 2)}", f"dots{min(len(parts) - 1, 4)}", f"before={word}"]
    if token[0] == "+":
        names.append("plus")
    if "@" in token:
        names.append(f"domain{'.' in token.rpartition('@')[2]}")
    if " " in token or "-" in token:
        names.append("parted")
    if 13 <= len(digits) <= 19:
        names.append(f"luhn{luhn(digits)}")
    if len(parts) == 4:
        names.append(f"octets{all(p.isascii() and p.isdigit() and _octet(p) for p in parts)}")
    return names


def same_as(token: str) -> list[str]:
    """Keys under which a candidate counts as a repetition of another."""
    if "@" in token:
        local, _, domain = token.casefold().partition("@")
        return ["@" + _MARKS.sub("", token.casefold()), f"{local}@{_MARKS.split(domain)[0]}"]
    if _QUAD.fullmatch(token):
        return ["." + ".".join(p.lstrip("0") or "0" for p in re.split(r"[.\x20-]", token))]
    digits = _DIGITS.sub("", token)
    return ["#" + digits] + ([f"~{digits[-9:]}"] if 9 <= len(digits) <= 15 else [])


def edges_of(tokens: list[str]) -> tuple[list, list]:
    """Neighbour edges and skip edges; each repetition is tied to the one before
    it, so there are no more edges than keys."""
    last: dict[str, int] = {}
    skip = set()
    for i, token in enumerate(tokens):
        for key in same_as(token):
            if key in last:
                skip.add((last[key], i))
            last[key] = i
    return list(pairwise(range(len(tokens)))), sorted(skip)


def base_labels(nodes: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """0 for none, else 1 + the kind of the base span that overlaps most."""
    labels, ordered, at = [], sorted((s, e, KINDS.index(k) + 1) for k, s, e in spans), 0
    for start, end in nodes:
        while at < len(ordered) and ordered[at][1] <= start and all(e <= start for _, e, _ in ordered[at : at + len(KINDS)]):
            at += 1
        best = max(((min(e, end) - max(s, start), k) for s, e, k in ordered[at : at + 2 * len(KINDS)]), default=(0, 0))
        labels.append(best[1] if best[0] > 0 else 0)
    return labels


# Learning --------------------------------------------------------------------


def disguised(kind: str, token: str, turn: int) -> str:
    """A mention of an entity that no pattern matches."""
    digits = _DIGITS.sub("", token)
    if kind == "email":
        local, _, domain = token.partition("@")
        return (f"{local}@{domain.replace('.', '_')}", f"{local}@{domain.partition('.')[0]}", token.upper().replace(".", "_"))[turn % 3]
    if kind == "ip":
        return token.replace(".", "- "[turn % 2])
    if kind == "card":
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    return (f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}", f"{last[:3]}.{last[3:6]}.{last[6:]}", digits)[turn % 4]


def masked(text: str, others: list[tuple[str, str]], turn: int) -> tuple[list[str], list[str], list[int], list[tuple[str, str]]]:
    """``(tokens, words before, labels, entities)``: the candidates of a text and
    the further mentions that learning adds; the text's own entities."""
    base = base_spans(text)
    nodes = candidates(text, base)
    labels = base_labels(nodes, base)
    tokens, words = [text[s:e] for s, e in nodes], words_before(text, nodes)
    own = [(KINDS[y - 1], t) for t, y in zip(tokens, labels, strict=True) if y]
    more = [(disguised(k, t, turn + i), KINDS.index(k) + 1) for i, (k, t) in enumerate(own)]
    more += [(t, 0) for t, y in zip(tokens, labels, strict=True) if not y]
    known = {key for t in tokens for key in same_as(t)}
    more += [(x, 0) for i, (k, t) in enumerate(others) if not known & set(same_as(x := disguised(k, t, turn + i)))]
    # In no order, each after a word that some candidate of the text follows.
    for i, (token, label) in enumerate(sorted(more, key=lambda x: zlib.crc32(x[0].encode()))):
        if not any(base_labels([(0, len(token))], base_spans(token))):
            tokens.append(token)
            words.append(words[(turn + i) % len(nodes)] if nodes else "^")
            labels.append(label)
    return tokens, words, labels, own


def learn(texts: list[str]) -> dict:
    """Potentials of the masked candidates of some texts, by gradient ascent on
    the penalised pseudo-likelihood: of each node's label, given its neighbours'."""
    names: dict[str, int] = {}
    rows, labels, near, skip, others = [], [], [], [], []
    size = len(KINDS) + 1
    for turn, text in enumerate(texts):
        tokens, words, own, entities = masked(text, others, turn)
        first = len(rows)
        rows += [[names.setdefault(n, len(names)) for n in shape(t, w)] for t, w in zip(tokens, words, strict=True)]
        labels += own
        for found, edges in zip(edges_of(tokens), (near, skip), strict=True):
            edges += [(first + i, first + j) for i, j in found]
        others = entities
    model = {"names": names, "weights": np.zeros((len(names), size)), "near": np.zeros((size, size)), "skip": np.zeros((size, size))}
    if not rows:
        return model
    graph = (rows, np.asarray(labels), np.asarray(near, dtype=int).reshape(-1, 2), np.asarray(skip, dtype=int).reshape(-1, 2))
    at = [model[k] for k in ("weights", "near", "skip")]
    speed, spread = [np.zeros_like(x) for x in at], [np.zeros_like(x) for x in at]
    for step in range(1, STEPS + 1):
        for x, g, v, r in zip(at, pseudo_gradient(model, *graph)[1], speed, spread, strict=True):
            v += 0.1 * (g - v)
            r += 0.01 * (g * g - r)
            x += RATE * (v / (1 - 0.9**step)) / (np.sqrt(r / (1 - 0.99**step)) + 1e-8)
    return model


def pseudo_gradient(model: dict, rows: list[list[int]], y: np.ndarray, near: np.ndarray, skip: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The penalised mean log pseudo-likelihood and its gradient by weights,
    neighbour and skip potentials (the last symmetric)."""
    w, a, b = model["weights"], model["near"], model["skip"]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate([np.asarray(r, dtype=int) for r in rows])
    labels = range(w.shape[1])
    z = np.stack([np.bincount(owner, w[flat, k], len(y)) for k in labels], axis=1)
    for edges, left, right in ((near, a, a), (skip, b, b)):
        if len(edges):
            i, j = edges.T
            np.add.at(z, i, left[:, y[j]].T)
            np.add.at(z, j, right[y[i]])
    z -= z.max(axis=1, keepdims=True)
    log = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    gap = -np.exp(log)
    gap[np.arange(len(y)), y] += 1
    by = [np.stack([np.bincount(flat, gap[owner, k], len(w)) for k in labels], axis=1), np.zeros_like(a), np.zeros_like(b)]
    for edges, g in ((near, by[1]), (skip, by[2])):
        if len(edges):
            i, j = edges.T
            np.add.at(g.T, y[j], gap[i])
            np.add.at(g, y[i], gap[j])
    by[2] = (by[2] + by[2].T) / 2
    n = len(y)
    value = log[np.arange(n), y].sum() / n - PENALTY / n * sum((x * x).sum() for x in (w, a, b)) / 2
    return float(value), [(g - PENALTY * x) / n for g, x in zip(by, (w, a, b), strict=True)]


def marginals(unary: np.ndarray, fixed: list[int], near: list, skip: list, model: dict) -> np.ndarray:
    """Node marginals by damped loopy belief propagation (exact where edges form
    no loop); ``fixed`` nodes with a label above 0 are held."""
    theta = unary.copy()
    for i, label in enumerate(fixed):
        if label:
            theta[i] = -50.0
            theta[i, label] = 0.0
    edges = [*near, *skip]
    if edges:
        a, b = np.asarray(edges).T
        pot = np.concatenate([np.repeat(model["near"][None], len(near), 0), np.repeat(model["skip"][None], len(skip), 0)])
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])  # [edge, source label, target label]
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        messages = np.zeros((len(src), theta.shape[1]))
        for _ in range(ROUNDS):
            belief = theta.copy()
            np.add.at(belief, dst, messages)
            out = (belief[src] - messages[back])[:, :, None] + pot
            new = np.logaddexp.reduce(out, axis=1)
            new -= new.max(axis=1, keepdims=True)
            messages = DAMPING * messages + (1 - DAMPING) * new
        np.add.at(theta, dst, messages)
    p = np.exp(theta - theta.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[str, int, int]], model: dict) -> list[tuple[str, int, int]]:
    """Spans that the field adds to the base."""
    nodes = candidates(text, base)
    fixed = base_labels(nodes, base)
    if all(fixed):
        return []
    names, weights = model["names"], model["weights"]
    tokens, words = [text[s:e] for s, e in nodes], words_before(text, nodes)
    unary = np.zeros((len(nodes), len(KINDS) + 1))
    for i, (token, word) in enumerate(zip(tokens, words, strict=True)):
        known = [names[n] for n in shape(token, word) if n in names]
        unary[i] = weights[known].sum(axis=0) if known else 0.0
    near, skip = edges_of(tokens)
    p = marginals(unary, fixed, near, skip, model)
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    found = []
    for i, (s, e) in enumerate(nodes):
        label = int(p[i].argmax())
        if fixed[i] or not label or p[i, label] < SURE:
            continue
        at = bisect_left(starts, e)
        if not any(e2 > s for _, e2 in taken[max(0, at - 2 * len(KINDS)) : at]):
            found.append((KINDS[label - 1], s, e))
    return found


def find_spans(text: str, model: dict) -> tuple[list, list]:
    """(base spans, all spans), each by kind as listed, then start."""
    if not _EVIDENCE.search(text):
        return [], []
    base = base_spans(text)
    added = added_spans(text, base, model)
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1]))


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict:
    """Learn the potentials from about ``sample`` texts that have candidates (never
    twice as many), chosen by a hash; the driver gets a bounded amount of text."""
    small_batches(documents.sparkSession)
    body = text_of(text)
    chosen = documents.where(body.rlike("@|[0-9].{0,3}[0-9].{0,3}[0-9]")).select(F.xxhash64(F.col(key), F.sha1(body)).alias("h"), body.alias("t"))
    # A share of the texts by hash, so that no task gathers them.
    parts = max(1, chosen.count() // sample)
    few = chosen.where(F.pmod("h", F.lit(parts)) == 0).limit(2 * sample)

    # The candidates with the word before each are all that learning looks at.
    def around(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = []
            for t in batch.column(0).to_pylist():
                nodes = candidates(t, base_spans(t))
                if len(nodes) > PER_TEXT:
                    nodes = sorted(sorted(nodes, key=lambda n: zlib.crc32(b"%d" % n[0]))[:PER_TEXT])
                texts.append(" \n".join(f"{w[-AROUND:]} {t[s:e]}" for w, (s, e) in zip(words_before(t, nodes), nodes, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])

    return learn(sorted(r.t for r in few.select("t").mapInArrow(around, "t string").collect() if r.t))


SPAN = "array<struct<kind: string, start: long, end: long>>"


def detect(documents: DataFrame, key: str = "doc_id", text: str = "text", model: dict | None = None) -> DataFrame:
    """``key, base, spans, redacted`` for each row: span arrays and the text with
    every span replaced by ``<KIND>``.

    Offsets are code points, the end exclusive. A null text is the empty text
    (no spans, redacted to ''), repeated rows are repeated, a null key stays
    null, an empty table gives an empty result, and other columns are not read.
    Overlapping spans are replaced together, by the kind of the first.
    """
    small_batches(documents.sparkSession)
    model = model or train(documents, key, text)
    kind = documents.schema[key].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).to_pylist()
            found = [find_spans(t, model) for t in texts]
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for pair in found for spans in pair]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows[0::2], spans_type), pa.array(rows[1::2], spans_type), pa.array([redact(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string())],
                ["key", "base", "spans", "redacted"],
            )

    out = documents.select(F.col(key).alias("key"), text_of(text).alias("text")).mapInArrow(run, f"key {kind}, base {SPAN}, spans {SPAN}, redacted string")
    return out.withColumnRenamed("key", key)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by ``<KIND>``."""
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            parts += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact_column(documents: DataFrame, text: str, model: dict) -> DataFrame:
    """``documents`` with the personal data in ``text`` replaced; nulls stay."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact(t, find_spans(t, model)[1]))

    return documents.withColumn(text, clean(F.col(text)))


def op10_pii(spark, root: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base spans, all
    spans as text and their number."""
    found = detect(spark.read.parquet(f"{root}/documents.parquet")).drop("redacted")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
