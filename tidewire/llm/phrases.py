"""Phrase collocations: packed id n-grams, range partitions, run-length counts.

1. The texts are read once. Every block of about ``BLOCK_WORDS`` words of one
   language gets a dictionary of its own, and its words become numbers; piece
   ends become breaks.
2. The blocks' words are counted together. Words under the least count become
   breaks as well: a phrase that holds one cannot be frequent. Each frequent word
   has a position: the occurrences of all frequent words before it. Positions are
   unique, so they are the words' ids, and as they measure occurrences they also
   give ranges of equal load.
3. Each block packs its pairs of ids into 64 bits, sorts them and counts runs,
   and sends each range of keys to one task. There the keys of fixed width are
   sorted column by column from the last to the first (a radix sort) and counted
   by run lengths. A frequent word is cut into as many ranges as it needs, by its
   follower's position. Blocks are told which of their pairs are frequent.
4. Infrequent pairs are breaks in their turn; what is left has few phrases of
   three and four words, which are counted in the same way, with pairs in the
   place of words.
5. Scores, cuts and containment are joins over the frequent phrases.

Nothing is collected: dictionaries and replies are joined to the blocks, whose
size is a parameter. A block's counts are combined before they are sent, so a
phrase that every document repeats is one row a block.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, small_batches

#: Words of a block (a text is never divided between blocks), bytes of text that
#: are encoded at once, and words that one task of a range counts.
BLOCK_WORDS, SEGMENT, RANGE_WORDS = 1_000_000, 1 << 20, 4_000_000
LEAST, LONGEST, TOP, INSIDE_PERCENT, SCALE = 30, 4, 2000, 80, 2_000_000

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Piece ends become line feeds, tabs become spaces, A-Z lower-case.
_PLAIN = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\x0d\x09", _UPPER.lower() + b"\n" * 9 + b" ")
_GAP = re.compile(rb"[ \n]")


class _Numbers(dict):
    """A block's number of each word, in the order met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """Words of one language as numbers, with -1 before each new piece."""

    def __init__(self):
        self.numbers, self.parts, self.words, self.waiting, self.size = _Numbers(), [], 0, [], 0

    def add(self, text: bytes) -> None:
        self.waiting.append(text)
        self.size += len(text) + 1
        if self.size >= SEGMENT:
            self.encode()

    def encode(self) -> None:
        data = b"\n".join([*self.waiting, b""]).translate(_PLAIN)
        self.waiting, self.size = [], 0
        at = 0
        while at < len(data):
            end = min(at + SEGMENT, len(data))
            if end < len(data):
                cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end)) + 1
                if cut <= at:  # one word of more than a segment
                    gap = _GAP.search(data, end)
                    cut = gap.end() if gap else len(data)
                end = cut
            self._segment(data[at:end])
            at = end

    def _segment(self, data: bytes) -> None:
        raw = np.frombuffer(data, np.uint8)
        line = raw == 10
        gap = line | (raw == 32)
        starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
        words = data.split()
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        ends = np.flatnonzero(line)
        piece = np.searchsorted(ends, starts)
        breaks = np.flatnonzero(np.diff(piece, prepend=0))
        self.parts.append(np.insert(ids, breaks, -1))
        if len(ends) and (not len(starts) or ends[-1] > starts[-1]):
            self.parts.append(np.array([-1], np.int32))
        self.words += len(words)


def _blocks(block_words: int):
    """The function that makes one row of each block."""

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        open_: dict[str, Block] = {}

        def closed(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            block = open_.pop(lang)
            block.encode()
            if block.words:
                ids = np.concatenate(block.parts)
                counts = np.bincount(ids[ids >= 0], minlength=len(block.numbers))
                row = {"block": [first + made], "lang": [lang], "n": [block.words], "words": [b"\n".join(block.numbers)], "counts": [counts.astype("<i8").tobytes()], "ids": [ids.astype("<i4").tobytes()]}
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array(row["block"], pa.int64()), pa.array(row["lang"]), pa.array(row["n"], pa.int64()), *(pa.array(row[c], pa.binary()) for c in ("words", "counts", "ids"))], names=list(row))

        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = open_.setdefault(lang, Block())
                block.add(text.as_py())
                if block.words >= block_words:
                    yield from closed(lang)
            while sum(b.words for b in open_.values()) > 4 * block_words:  # many languages
                yield from closed(max(open_, key=lambda x: open_[x].words))
        for lang in list(open_):
            yield from closed(lang)

    return blocks


def _numbers(blobs: pa.ChunkedArray | list, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(b"".join(b.as_py() if isinstance(b, pa.Scalar) else b for b in blobs), kind)


def _bytes(a: np.ndarray, kind: str = "<i8") -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _cuts(at: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, first, end) of the rows whose rising range numbers are ``at``."""
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return list(zip(at[first].tolist(), first.tolist(), np.append(first[1:], len(at)).tolist(), strict=False))


def _ranges(first: np.ndarray, count: np.ndarray, second: np.ndarray, total: int, ranges: int) -> np.ndarray:
    """The range of each pair of symbols: the first one's position and, within its
    occurrences, the second one's. It never falls as pairs rise."""
    at = first.astype(float) + count.astype(float) * (second.astype(float) / total)
    return np.minimum((at * (ranges / total)).astype(np.int64), ranges - 1)


def _runs(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys in order, their summed counts, and which of them each row has."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    key = np.empty(len(order), np.int64)
    key[order] = np.cumsum(new) - 1
    return [c[first] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts[:0], key


_REPLY = "kind int, range int, block long, at binary, f binary, pos binary, total long, a binary, b binary"


def _reply(range_: int, tables: dict, table: pa.Table, sizes: list[int], key: np.ndarray, f: np.ndarray, least: int) -> pa.Table:
    """What a range found: its frequent keys (kind 0), and for each block which of
    the block's keys are frequent (kind 1), with counts and positions in the range."""
    often = f >= least
    pos = np.cumsum(np.where(often, f, 0)) - f
    rows = [(0, range_, None, None, _bytes(f[often]), _bytes(pos[often]), int(f[often].sum()), tables["a"](often), tables["b"](often))]
    at = 0
    for block, size in zip(table["block"].to_pylist(), sizes, strict=True):
        mine = key[at : at + size]
        hit = np.flatnonzero(often[mine])
        rows.append((1, range_, block, _bytes(hit, "<i4"), _bytes(f[mine[hit]]), _bytes(pos[mine[hit]]), None, None, None))
        at += size
    names = [c.split()[0] for c in _REPLY.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _with_starts(found: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Frequent keys and replies, each with the position at which its range
    starts, and the total. There is one start a range."""
    totals = found.where("kind = 0").groupBy("range").agg(F.sum("total").alias("sum"))
    start = F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = F.broadcast(totals.select("range", start.alias("start")))
    total = totals.agg(F.sum("sum")).first()[0] or 1  # 1: nothing is frequent
    return found.where("kind = 0").join(starts, "range"), found.where("kind = 1").join(starts, "range"), total


def _count_words(blocks: DataFrame, ranges: int, least: int) -> DataFrame:
    """Words of all blocks, dealt by a hash of the word."""

    def dealt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for block, lang, words, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "words", "counts")), strict=True):
                words = np.array(words.split(b"\n"), object)
                to = np.fromiter((zlib.crc32(w) % ranges for w in words), np.int64, len(words))
                order, counts = np.argsort(to, kind="stable"), np.frombuffer(counts, "<i8")
                rows = [(r, block, lang, b"\n".join(words[order[i:j]]), _bytes(counts[order[i:j]]), _bytes(order[i:j], "<i4")) for r, i, j in _cuts(to[order])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["range", "block", "lang", "words", "counts", "at"])

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        numbers: dict[tuple[str, bytes], int] = {}
        ids, sizes = [], []
        for lang, words in zip(table["lang"].to_pylist(), table["words"].to_pylist(), strict=True):
            mine = [numbers.setdefault((lang, w), len(numbers)) for w in words.split(b"\n")]
            ids.append(np.array(mine, np.int64))
            sizes.append(len(mine))
        ids = np.concatenate(ids)
        f = np.zeros(len(numbers), np.int64)
        np.add.at(f, ids, _numbers(table["counts"]))
        names = list(numbers)
        tables = {"a": lambda often: b"\n".join(names[i][1] for i in np.flatnonzero(often)), "b": lambda often: "\n".join(names[i][0] for i in np.flatnonzero(often)).encode()}
        found = _reply(key[0].as_py(), tables, table, sizes, ids, f, least)
        # Numbers of the block instead of places in the row.
        at = [None, *(_bytes(np.frombuffer(own, "<i4")[np.frombuffer(hit, "<i4")], "<i4") for own, hit in zip(table["at"].to_pylist(), found["at"].to_pylist()[1:], strict=True))]
        return found.set_column(found.column_names.index("at"), "at", pa.array(at, pa.binary()))

    rows = blocks.select("block", "lang", "words", "counts").mapInArrow(dealt, "range int, block long, lang string, words binary, counts binary, at binary")
    return materialize(rows.groupBy("range").applyInArrow(summed, _REPLY), "words")


_SENT = "kind int, range int, block long, a binary, b binary, c binary, d binary, counts binary"


def _sent(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _SENT.split(", ")])


def _symbols(replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's frequent numbers by rising position, their positions and counts."""
    at = _numbers(replies["at"], "<i4").astype(np.int64)
    held = [len(b) // 8 for b in replies["f"].to_pylist()]
    pos = _numbers(replies["pos"]) + np.repeat(np.array(replies["start"].to_pylist(), np.int64), held)
    order = np.argsort(pos)
    return at[order], pos[order], _numbers(replies["f"])[order]


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed pairs of neighbouring symbols, and where they stand."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return ids[at].astype(np.int64) << 32 | ids[at + 1], at


def _count_pairs(blocks: DataFrame, replies: DataFrame, total: int, ranges: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of frequent words (as replies), and the blocks in frequent symbols."""

    def packed(block: pa.Table, theirs: pa.Table) -> pa.Table:
        key, ids = block["block"][0].as_py(), np.frombuffer(block["ids"][0].as_py(), "<i4")
        if not len(theirs):
            return _sent([(1, None, key, b"", b"", b"", None, None)])
        at, pos, f = _symbols(theirs)
        symbol = np.full(max(int(ids.max()), int(at.max(initial=0))) + 2, -1, np.int32)  # the last is the break
        symbol[at] = np.arange(len(at))
        ids = symbol[ids]
        pairs, counts = np.unique(_pairs(ids)[0], return_counts=True)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        to = _ranges(pos[a], f[a], pos[b], total, ranges)
        rows = [(0, r, key, _bytes(pos[a[i:j]]), _bytes(pos[b[i:j]]), None, None, _bytes(counts[i:j], "<u4")) for r, i, j in _cuts(to)]
        return _sent([(1, None, key, _bytes(ids, "<i4"), _bytes(pos), _bytes(f), None, None), *rows])

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        sizes = [len(b) // 4 for b in table["counts"].to_pylist()]
        (a, b), f, mine = _runs([_numbers(table["a"]), _numbers(table["b"])], _numbers(table["counts"], "<u4").astype(np.int64))
        return _reply(key[0].as_py(), {"a": lambda often: _bytes(a[often]), "b": lambda often: _bytes(b[often])}, table, sizes, mine, f, least)

    left = blocks.select("block", "ids").groupBy("block")
    sent = materialize(left.cogroup(replies.select("block", "at", "f", "pos", "start").groupBy("block")).applyInArrow(packed, _SENT), "pairs")
    found = sent.where("kind = 0").select("range", "block", "a", "b", "counts").groupBy("range").applyInArrow(summed, _REPLY)
    return materialize(found, "frequent_pairs"), sent.where("kind = 1").select("block", "a", "b", "c")


def _count_longer(blocks: DataFrame, replies: DataFrame, total: int, ranges: int, least: int) -> DataFrame:
    """``w1, w2, w3, w4, a`` of the frequent phrases of three (w4 is -1) and four words."""

    def packed(block: pa.Table, theirs: pa.Table) -> pa.Table:
        key, ids = block["block"][0].as_py(), np.frombuffer(block["a"][0].as_py(), "<i4")
        empty = _sent([(1, None, key, None, None, None, None, None)]).slice(0, 0)
        if not len(theirs) or not len(ids):
            return empty
        word, theirs = np.frombuffer(block["b"][0].as_py(), "<i8"), theirs.sort_by("range")
        all_pairs, places = _pairs(ids)
        pairs, which = np.unique(all_pairs, return_inverse=True)
        # A reply counts from the first of the block's pairs of its range.
        to = _ranges(word[pairs >> 32], np.frombuffer(block["c"][0].as_py(), "<i8")[pairs >> 32], word[pairs & 0xFFFFFFFF], theirs["words"][0].as_py(), theirs["ranges"][0].as_py())
        first = {r: i for r, i, _ in _cuts(to)}
        at = np.concatenate([np.frombuffer(b, "<i4") + first[r] for r, b in zip(theirs["range"].to_pylist(), theirs["at"].to_pylist(), strict=True)])
        held = [len(b) // 8 for b in theirs["f"].to_pylist()]
        pos = _numbers(theirs["pos"]) + np.repeat(np.array(theirs["start"].to_pylist(), np.int64), held)
        f = _numbers(theirs["f"])
        symbol = np.full(len(pairs), -1, np.int64)
        symbol[at] = np.arange(len(at))
        chain = np.full(len(ids) + 2, -1, np.int64)
        chain[places] = symbol[which]
        w = [word[pairs[at] >> 32], word[pairs[at] & 0xFFFFFFFF]]
        rows = []
        for n in (3, 4):
            here = np.flatnonzero(reduce(np.logical_and, [chain[k : len(ids) + k] >= 0 for k in range(n - 1)]))
            grams, counts = np.unique(chain[here] << 32 | chain[here + n - 2], return_counts=True)
            a, b = grams >> 32, grams & 0xFFFFFFFF
            columns = [w[0][a], w[1][a], *((w[1][b], np.full(len(a), -1)) if n == 3 else (w[0][b], w[1][b]))]
            for r, i, j in _cuts(_ranges(pos[a], f[a], pos[b], total, ranges)):
                rows.append((0, r, key, *(_bytes(c[i:j]) for c in columns), _bytes(counts[i:j], "<u4")))
        return _sent(rows) if rows else empty

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        columns, f, _ = _runs([_numbers(table[c]) for c in "abcd"], _numbers(table["counts"], "<u4").astype(np.int64))
        return pa.table([*(c[f >= least] for c in columns), f[f >= least]], names=["w1", "w2", "w3", "w4", "a"])

    sent = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(packed, _SENT)
    return sent.select("range", "a", "b", "c", "d", "counts").groupBy("range").applyInArrow(summed, "w1 long, w2 long, w3 long, w4 long, a long")


def _unpacked_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for row in batch.to_pylist():
            if f := np.frombuffer(row["f"], "<i8").tolist():
                yield pa.RecordBatch.from_arrays([pa.array(row["b"].decode().split("\n")), pa.array(row["a"].split(b"\n")).cast(pa.string()), pa.array(np.frombuffer(row["pos"], "<i8") + row["start"]), pa.array(f, pa.int64())], names=["lang", "word", "w", "f"])


def _unpacked_pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for row in batch.to_pylist():
            a, b, f = (np.frombuffer(row[c], "<i8") for c in ("a", "b", "f"))
            rest = np.full(len(a), -1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, rest, rest, f)], names=["w1", "w2", "w3", "w4", "a"])


def _part(*words: Column) -> list[Column]:
    none = F.lit(-1).cast("long")
    return [w.alias(f"p{i + 1}") for i, w in enumerate([*words, *[none] * (LONGEST - 1 - len(words))])]


def _each(n: int, make) -> Column:
    """An array of structs made from the words of a phrase of ``n``."""
    return F.array(*make([F.col(f"w{i + 1}") for i in range(n)]))


def _by_length(make) -> Column:
    return F.when(F.col("w3") < 0, _each(2, make)).when(F.col("w4") < 0, _each(3, make)).otherwise(_each(4, make))


def _scored(grams: DataFrame, words: DataFrame) -> DataFrame:
    """The phrases with lang, a, and l, r and score of their lowest cut."""

    def cuts(w: list[Column]) -> list[Column]:
        sides = [(k, s, part) for k in range(1, len(w)) for s, part in (("l", w[:k]), ("r", w[k:]))]
        return [F.struct(F.lit(k).alias("k"), F.lit(s).alias("side"), *_part(*part)) for k, s, part in sides]

    key = ["w1", "w2", "w3", "w4"]
    parts = words.select(*_part(F.col("w")), "f", "lang").unionByName(grams.where("w4 < 0").select(F.col("w1").alias("p1"), F.col("w2").alias("p2"), F.col("w3").alias("p3"), F.col("a").alias("f"), F.lit(None).cast("string").alias("lang")))
    asked = grams.select(*key, "a", F.explode(_by_length(cuts)).alias("cut")).select(*key, "a", "cut.*")
    counted = asked.join(parts, ["p1", "p2", "p3"]).groupBy(*key, "a", "k")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    by_cut = counted.agg(side("l"), side("r"), F.max("lang").alias("lang"))
    score = F.expr(f"cast({SCALE} as decimal(20,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    return by_cut.groupBy(*key, "a").agg(lowest, F.max("lang").alias("lang")).select(*key, "a", "lang", "low.score", "low.l", "low.r")


def _not_inside(grams: DataFrame, percent: int) -> DataFrame:
    """The phrases that no longer one holds nearly as often."""

    def subs(w: list[Column]) -> list[Column]:
        return [F.struct(*_part(*w[i : i + n])) for n in range(2, len(w)) for i in range(len(w) - n + 1)]

    longer = grams.where("w3 >= 0").select("a", F.explode(F.when(F.col("w4") < 0, _each(3, subs)).otherwise(_each(4, subs))).alias("s"))
    most = longer.groupBy("s.p1", "s.p2", "s.p3").agg(F.max("a").alias("most"))
    near = F.col("most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * percent
    same = (grams["w1"] == F.col("p1")) & (grams["w2"] == F.col("p2")) & (grams["w3"] == F.col("p3")) & (grams["w4"] < 0)
    return grams.join(most, same & near, "left_anti")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, percent: int = INSIDE_PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases.

    Null texts are empty and a null language is ``und``, together with rows that
    name it so. Repeated rows count as often as they occur; equal scores and
    counts are ordered by the phrase. An empty table, or one without a frequent
    phrase, gives no row. Other columns are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    read = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    blocks = materialize(read.mapInArrow(_blocks(block_words), "block long, lang string, n long, words binary, counts binary, ids binary"), "blocks")
    sizes = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (blocks.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS)

    frequent, replies, total = _with_starts(_count_words(blocks, ranges, least))
    words = frequent.select("a", "b", "f", "pos", "start").mapInArrow(_unpacked_words, "lang string, word string, w long, f long")
    pairs, encoded = _count_pairs(blocks, replies, total, ranges, least)
    frequent_pairs, pair_replies, pair_total = _with_starts(pairs)
    told = pair_replies.select("range", "block", "at", "f", "pos", "start", F.lit(total).cast("long").alias("words"), F.lit(ranges).alias("ranges"))
    longer = _count_longer(encoded, told, pair_total, ranges, least)
    grams = frequent_pairs.select("a", "b", "f").mapInArrow(_unpacked_pairs, "w1 long, w2 long, w3 long, w4 long, a long").unionByName(longer)
    grams, words = materialize(grams, "phrases"), materialize(words, "frequent_words")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # Ties at the end stay until the phrases themselves are known.
    kept = _scored(grams, words).join(_not_inside(grams, percent).select("w1", "w2", "w3", "w4"), ["w1", "w2", "w3", "w4"], "left_semi")
    kept = kept.withColumn("place", F.rank().over(best)).where(F.col("place") <= top)
    for i in range(1, LONGEST + 1):
        kept = kept.join(words.select(F.col("w").alias(f"w{i}"), F.col("word").alias(f"t{i}")), f"w{i}", "left")
    kept = kept.withColumn("phrase", F.concat_ws(" ", *[f"t{i}" for i in range(1, LONGEST + 1)]))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return kept.join(F.broadcast(sizes), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, root: str) -> DataFrame:
    """The first 2000 phrases of each language in all documents."""
    return collocations(spark.read.parquet(f"{root}/documents.parquet"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
spans AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM spans, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM spans GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, cut, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * cuts.a // (l.a + r.a) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, k, w, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
