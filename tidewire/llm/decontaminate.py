"""Benchmark decontamination by the q-gram lemma.

Texts are compared in lower case, with every run of other characters than
letters and digits as one space. A passage is any ``PASSAGE`` characters in a
row of a benchmark item, wherever they begin, or the whole of a shorter item. A
place in a document that equals a passage of n characters up to e edits shares
at least ``n - q + 1 - q * e`` q-grams with it, and all of them lie on diagonals
(position in the text minus position in the item) that differ by at most e on
either side. So shared q-grams are counted in overlapping diagonal bands that
are wide enough to hold such a place wholly in one band; in a band, each passage
that holds as many as the bound is verified by banded alignment. Where q-grams
of ``Q`` characters leave a bound below 1 (short items), shorter ones are
counted; an item of fewer than ``Q`` characters, which has no edits, is one
q-gram of its own length and must stand as whole words. Nothing within the edit
budget can be missed.

The distances of two passages that begin next to each other differ by at most
1, so one alignment settles as many neighbours as its distance is away from the
budget.

The q-grams of a block of items are a bounded table that every task holds; a
larger benchmark is worked through in blocks, one scan of the documents each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import small_batches, text_of

#: q, edits a character, and the length of an item's passages.
Q, BUDGET, PASSAGE = 8, 0.1, 120
#: q for items so short that ``Q`` leaves no shared q-gram for certain.
SHORT_Q = 5
#: Characters of an item that are compared at once; a longer item is cut into
#: stretches that overlap, so that each passage lies wholly in one.
STRETCH = 1024
#: q-grams of a block of items at most (about 40 bytes each in a task).
BLOCK_GRAMS = 1_000_000
#: Characters of text that are worked on at once.
SLICE = 1_000_000
END = 0x110000  # stands between texts; no character has this number

_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x10000)], dtype=np.uint32)
_ALNUM = np.array([chr(i).isalnum() for i in range(0x10000)], dtype=bool)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts with ``END`` after each, and where each text begins."""
    raw = "\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, dtype="<u4").astype(np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    ends = np.cumsum(lengths)
    codes[ends - 1] = END
    return codes, ends - lengths


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normal form of the texts, ``END`` after each; the place of each of its
    characters in the joined texts; where each text begins there)."""
    codes, starts = _codes(texts)
    small = np.minimum(codes, 0xFFFF)
    letter = _ALNUM[small] | ((codes > 0xFFFF) & (codes != END))
    end = codes == END
    other = ~letter & ~end
    keep = letter | end
    keep[1:] |= other[1:] & letter[:-1]  # the first of a run stands for it
    at = np.flatnonzero(keep)
    out = np.where(codes[at] <= 0xFFFF, _LOWER[small[at]], codes[at])
    out[other[at]] = 32
    return out.astype(np.uint32), at, starts


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit number for the q-gram that begins at each place."""
    h, width = codes.astype(np.uint64) + np.uint64(1), 1
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while width < q:
            step = min(width, q - width)
            h = h[:-step] * factor + h[step:] if len(h) > step else h[:0]
            factor = factor * factor
            width += step
    return h


class Table:
    """The q-grams of some stretches (number, characters), for one q."""

    def __init__(self, q: int, stretches: list[tuple[int, np.ndarray]]):
        self.q = q
        keys = [grams(part, q) for _, part in stretches]
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.owner = np.concatenate([np.full(len(g), i, dtype=np.int32) for (i, _), g in zip(stretches, keys, strict=True)])[order]
        self.offset = np.concatenate([np.arange(len(g), dtype=np.int32) for g in keys])[order]
        self.key, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.bits = int(min(26, max(16, np.ceil(np.log2(16 * max(1, len(self.key)))))))
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[self._slot(self.key)] = True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, stretch, place in the stretch) of every shared q-gram."""
        key = grams(codes, self.q)
        at = np.flatnonzero(self.table[self._slot(key)])
        found = np.searchsorted(self.key, key[at])
        found[found == len(self.key)] = 0
        same = self.key[found] == key[at]
        at, found = at[same], found[same]
        n = self.count[found]
        place = np.repeat(at, n)
        entry = np.repeat(self.first[found] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return place, self.owner[entry], self.offset[entry]


class Index:
    """The stretches of a block of items (``passages``: all passages of an item
    of up to ``STRETCH`` characters) and their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.passages, self.begins = [], [], []
        for item, text in items:
            codes = normalise([text or ""])[0][:-1]
            if len(codes) and codes[-1] == 32:
                codes = codes[:-1]
            n = len(codes)
            if not n:
                continue
            for start in range(0, max(0, n - PASSAGE) + 1, STRETCH - PASSAGE + 1):
                self.items.append(item)
                self.passages.append(codes[start : start + STRETCH])
                self.begins.append(start)
        whole = np.array([len(p) for p in self.passages], dtype=np.int64)
        self.length = np.minimum(whole, PASSAGE)  # of a passage
        self.last = whole - self.length  # where the last passage begins
        self.edits = np.floor(self.length * BUDGET).astype(np.int64)
        self.q = np.where(self.length - Q + 1 - Q * self.edits >= 1, Q, np.minimum(self.length, np.where(self.length < Q, Q, SHORT_Q)))
        self.bound = self.length - self.q + 1 - self.q * self.edits
        self.width = 2 * self.edits + 1
        self.tables = [Table(q, [(i, self.passages[i]) for i in np.flatnonzero(self.q == q).tolist()]) for q in np.unique(self.q).tolist()]

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, stretch, place in the stretch) of every shared q-gram."""
        return tuple(map(np.concatenate, zip(*(t.shared(codes) for t in self.tables), strict=True)))


def align(passage: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best place of ``passage`` in ``region`` with at
    most ``most`` edits, the earliest end first; None if there is none.

    A row of the table for each character of the passage, the whole region (a
    band of diagonals) at once; places may begin and end anywhere in it.
    """
    size = passage.itemsize
    whole, at = region.tobytes(), -1
    while (at := whole.find(passage.tobytes(), at + 1)) >= 0:
        if at % size == 0:
            return at // size, at // size + len(passage), 0

    def last_row(pattern: np.ndarray, text: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(text) + 1)
        row = np.zeros(len(text) + 1, dtype=np.int64) if free else steps.copy()
        for c in pattern:
            new = row + 1
            new[1:] = np.minimum(new[1:], row[:-1] + (text != c))
            row = np.minimum.accumulate(new - steps) + steps
        return row

    ends = last_row(passage, region, True)
    end = int(ends.argmin())
    if ends[end] > most:
        return None
    back = last_row(passage[::-1], region[:end][::-1], False)
    return end - int(np.flatnonzero(back == ends[end])[0]), end, int(ends[end])


def distances(codes: np.ndarray, index: Index, owner: np.ndarray, start: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least edits with which the passage at ``start`` of each stretch can be
    placed in the band of two widths of diagonals from ``low``, in the text from
    ``begin`` to ``end``: banded alignment of many bands side by side.

    Cell (i, j) is the least number of edits for the first i characters ending
    before text character ``low + start + i + j``; it follows from (i - 1, j),
    (i - 1, j + 1) and (i, j - 1).
    """
    out = np.zeros(len(owner), dtype=np.int64)
    for n in np.unique(index.length[owner]):
        group = np.flatnonzero(index.length[owner] == n)
        wide = 2 * int(index.width[owner[group[0]]])
        steps = np.arange(wide, dtype=np.int16)[:, None]
        for at in range(0, len(group), 1000):
            some = group[at : at + 1000]
            own = np.stack([index.passages[p][s : s + n] for p, s in zip(owner[some].tolist(), start[some].tolist(), strict=True)], axis=1)
            reach = (low + start)[some] + np.arange(n + wide)[:, None]
            text = np.where((reach >= begin[some]) & (reach < end[some]), codes[np.clip(reach, 0, len(codes) - 1)], END)
            row = np.zeros((wide, len(some)), dtype=np.int16)
            for i in range(n):
                new = row + (text[i : i + wide] != own[i])
                np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
                row = np.minimum.accumulate(new - steps, axis=0) + steps
            out[some] = row.min(axis=0)
    return out


def candidates(index: Index, key: np.ndarray, offset: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last): ranges of passages, by where they begin in their
    stretch, that hold enough shared q-grams of one band. ``key``: stretch times
    ``span`` plus band, sorted, then by ``offset``; nothing twice."""
    owner = key // span
    far = np.arange(len(key)) + index.bound[owner] - 1
    at = np.flatnonzero(far < len(key))
    at = at[key[far[at]] == key[at]]
    room = (index.length - index.q)[owner]
    at = at[offset[far[at]] - offset[at] <= room[at]]
    first = np.maximum(0, offset[far[at]] - room[at])
    last = np.minimum(offset[at], index.last[owner[at]])
    key = key[at]
    # Ranges of a band that overlap or touch become one.
    new = np.ones(len(at), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (first[1:] > last[:-1] + 1)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(at))[: len(begins)] - 1
    return key[begins], first[begins], last[ends]


def _inside_word(codes: np.ndarray, at: int) -> bool:
    """Whether there is a letter or digit at this place of normalised texts."""
    return at >= 0 and codes[at] not in (32, END)


def find_places(texts: list[str], index: Index) -> list[list[tuple[int, int, int, int]]]:
    """For each text its ``(item, start, end, edits)``: places of passages, those
    of one item that touch joined, in code points of the text."""
    codes, origin, starts = normalise(texts)
    found: list[list] = [[] for _ in texts]
    if not index.tables:
        return found
    place, owner, offset = index.shared(codes)
    text_ends = np.flatnonzero(codes == END)
    text_begins = np.append(0, text_ends[:-1] + 1)
    # Texts are counted as lying so far apart that no band reaches two of them.
    gap = 2 * STRETCH
    apart = np.arange(len(texts)) * gap
    # A diagonal lies in two bands of two widths each; band numbers count from 1.
    diagonal = place + np.searchsorted(text_ends, place) * gap - offset + STRETCH
    band = diagonal // index.width[owner] + 1
    span = len(codes) + (len(texts) + 1) * gap
    # Each q-gram of a stretch counts once in a band, however often it occurs.
    each = np.concatenate([owner * np.int64(span) + band, owner * np.int64(span) + band - 1]) * STRETCH + np.concatenate([offset, offset])
    each.sort()
    each = each[np.concatenate([[True], each[1:] != each[:-1]])] if len(each) else each
    key, first, last = candidates(index, each // STRETCH, each % STRETCH, span)
    passing = []
    while len(key):
        owner, band, middle = key // span, key % span, (first + last) // 2
        low = (band - 1) * index.width[owner] - STRETCH
        text = np.searchsorted(text_ends + apart, low, side="right")
        low = low - apart[text]
        edits = distances(codes, index, owner, middle, low, text_begins[text], text_ends[text])
        most = index.edits[owner]
        good = edits <= most
        settled = np.where(good, most - edits, edits - most - 1)
        a, z = np.maximum(first, middle - settled), np.minimum(last, middle + settled)
        passing += zip(*(x[good].tolist() for x in (key, a, z, text, owner, low)), strict=True)
        key, first, last = np.append(key, key), np.append(first, z + 1), np.append(a - 1, last)
        more = first <= last
        key, first, last = key[more], first[more], last[more]
    hits: dict[tuple[int, int], list] = {}
    runs: list[list] = []
    for k, a, z, *band in sorted(passing):
        if runs and runs[-1][0] == k and a == runs[-1][2] + 1:
            runs[-1][2] = z
        else:
            runs.append([k, a, z, *band])
    for _, a, z, d, p, low in runs:
        e, n, w = int(index.edits[p]), int(index.length[p]), int(index.width[p])
        places = []
        for s in (a, z) if a < z else (a,):
            begin = max(low + s, int(text_begins[d]))
            own, region = index.passages[p][s : s + n], codes[begin : max(begin, min(low + s + 2 * w + n + e, int(text_ends[d])))]
            best = align(own, region, e)
            if best and n < Q and (_inside_word(codes, begin + best[0] - 1) or _inside_word(codes, begin + best[1])):
                best = None
            if best:
                places.append((begin + best[0], begin + best[1], index.begins[p] + s, best[2]))
        if places:
            hits.setdefault((d, index.items[p]), []).append((min(x[0] for x in places), max(x[1] for x in places), places))
    for (d, item), places in hits.items():
        joined: list[list] = []
        for s, t, ends in sorted(places):
            if joined and s <= joined[-1][1]:
                joined[-1] = [joined[-1][0], max(joined[-1][1], t), joined[-1][2] + ends]
            else:
                joined.append([s, t, ends])
        for s, t, ends in joined:
            edits = max(min((x[2], x[3]) for x in ends)[1], -max((x[2], -x[3]) for x in ends)[1])
            found[d].append((item, int(origin[s] - starts[d]), int(origin[t - 1] + 1 - starts[d]), edits))
    return found


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size (a very long text is one of its own)."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def indexes(benchmark: DataFrame, item: str, text: str) -> Iterator[Index]:
    """The benchmark in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).distinct()
    for r in rows.orderBy("i", "t").toLocalIterator():
        block.append((r.i, r.t))
        size += 2 * len(r.t)
        if size >= BLOCK_GRAMS:
            yield Index(block)
            block, size = [], 0
    if block:
        yield Index(block)


def leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``key, item, start, end, edits``: one row for each place of an item.

    Places are in code points of the whole text. Passages that touch there are
    one place; ``edits`` is what the item's first or its last passage found there
    needed, the more of the two. Null texts count as empty and have no place; null
    items and items without a letter or digit are not sought;
    repeated documents give repeated rows; equal items are each reported; an
    empty table on either side gives an empty result. Other columns are not
    read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    kind = documents.schema[key].dataType.simpleString()
    read = documents.select(F.col(key).alias("key"), text_of(text).alias("text"))
    schema = f"key {kind}, item long, start long, end long, edits int"
    out = None
    for index in indexes(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in it:
                texts, keys = pdf.text.tolist(), pdf.key.tolist()
                rows = [(keys[at + i], *place) for at, to in slices(texts) for i, places in enumerate(find_places(texts[at:to], shared.value)) for place in places]
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "item", "start", "end", "edits"])

        found = read.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.select(F.col("key").alias(key), F.col("item").alias(item), "start", "end", "edits")


def _clean(shared):
    """A column function: whether a text holds no place of the broadcast index."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        whole = texts.tolist()
        return pd.Series([not places for at, to in slices(whole) for places in find_places(whole[at:to], shared.value)], dtype=bool)

    return clean


def without_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``documents`` that hold no place of any item; null texts stay."""
    spark = documents.sparkSession
    small_batches(spark)
    for index in indexes(benchmark, item, item_text):
        documents = documents.where(_clean(spark.sparkContext.broadcast(index))(text_of(text)))
    return documents


def op1_leaks(spark, root: str) -> DataFrame:
    """Every place of a benchmark item in a document."""
    return leaks(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/benchmark.parquet"))
