"""Removal of repeated passages: threshold-bounded interval expansion.

Every ``least``-byte string that also starts in a document with a smaller key
covers its bytes; covered bytes go.

A suffix array of the whole corpus would be one task, so strings that can be
equal are brought together first, by a rule that depends on the string alone.
The key of a string is a hash of the ``SEED`` bytes inside it that have the least
hash, and of as many bytes before them (or after, if the string has too few) as are
half of the rest. Neighbouring strings mostly share their key, and a run of them is
one fragment of text. (By the ``SEED`` bytes alone, frequent phrases make keys recur
in different passages, the more so the larger the corpus.)

0. A document that equals one with a smaller key is covered as a whole and takes
   no further part: any of its strings is in that document too.
1. Documents are cut into blocks, written once as a bucketed table. Each block
   counts its keys and sends each range of hashes to one task, which tells the
   blocks which keys occur more than once: all others can be left alone.
2. Each block sends its distinct fragments, with the least document of each, to
   the task of their key. Keys with more than ``HOT`` runs send every string by
   itself, under a hash of all of it, so that no key's fragments grow with the
   corpus.
3. There, fragments are joined to texts of bounded size (equal keys together),
   and their Burrows-Wheeler transform is taken. Starting from the interval of
   the empty string, all intervals of one length at a time are extended backward
   by every byte that precedes them. A new right end has its common prefix with
   the row above determined, by increasing value; at ``least`` the expansion
   stops, and rows without a value share their first ``least`` bytes or more.
   The least document of each such group is compared with the block's own.
4. Blocks get one bit for each string of their fragments: whether a smaller
   document of another block has it. Inside the block the least document of the
   fragment decides.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import materialize, new_path, small_batches

LEAST, SEED = 50, 16
#: Bytes of text of a block at least, bytes that a block sends to a range at least
#: (for which the blocks of a large corpus are larger), bytes of text of a
#: partition, and runs from which a key is cut into strings.
BLOCK_BYTES, SENT_BYTES, PARTITION_BYTES, HOT = 4 << 20, 512, 16 << 20, 8192
#: Texts with copies that are broadcast at most (about 60 bytes each).
BROADCAST_ROWS = 200_000
#: Strings of a fragment at most (bits of a mask), bytes of a text that is sorted
#: at once (fragments of one key stay together: at most HOT * (RUN + LEAST) more),
#: and bytes that are hashed at once.
RUN, SORTED_BYTES, CHUNK = 64, 1 << 18, 1 << 17
#: No byte of UTF-8.
END = 0xFF
NO_KEY = np.iinfo(np.int64).max

_MIX = 0x9E3779B97F4A7C15
#: The bits of a hash that give way to its place in a chunk.
_PLACE = np.uint64((1 << 18) - 1)


def _byte_hashes() -> np.ndarray:
    """An odd 64-bit number for each byte, by rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(_MIX)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) | np.uint64(1)


_BYTES = _byte_hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(data: np.ndarray, *widths: int) -> list[np.ndarray]:
    """A hash of each string of a width, from those of half its width."""
    parts, span, found = {1: _BYTES[data]}, 1, []
    power = lambda n: np.uint64(pow(_MIX, n, 1 << 64))
    while span * 2 <= min(max(widths), len(data)):
        h = parts[span]
        parts[span * 2] = h[:-span] * power(span) + h[span:]
        span *= 2
    for width in widths:
        if len(data) < width:
            found.append(np.zeros(0, np.uint64))
            continue
        have = 1 << (width.bit_length() - 1)
        h = parts[have]
        while have < width:
            step = 1 << ((width - have).bit_length() - 1)
            more = parts[step][have:]
            n = min(len(h), len(more))
            h, have = h[:n] * power(step) + more[:n], have + step
        found.append(_mixed(h))
    return found


def _least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


def runs(data: np.ndarray, ends: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First string, number of strings and key of every run in documents that end at ``ends``."""
    first, count, keys = [], [], []
    half = (least - seed) // 2
    at = 0
    while at + least <= len(data):
        until = min(at + CHUNK, len(data) - least + 1)  # strings [at, until)
        least_hash, wide = _hashes(data[at : until + least - 1], seed, seed + half)
        # The place of the least hash, the first of equal ones: the low bits are its place.
        low = least_hash & ~_PLACE | np.arange(len(least_hash), dtype=np.uint64)
        low = (_least_of(low, least - seed + 1) & _PLACE).astype(np.int64)
        left = low - np.arange(until - at) >= half
        key = wide[low - half * left] ^ left.astype(np.uint64)
        # The end of each string's document.
        i, j = np.searchsorted(ends, [at, until - 1], side="right")
        ending = np.repeat(ends[i : j + 1], np.diff(np.minimum(ends[i : j + 1], until), prepend=at))
        inside = np.arange(at + least, until + least) <= ending
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | ~inside[:-1]
        new &= inside
        start = np.flatnonzero(new)
        if len(start):
            stop = np.append(start[1:], len(key))
            # A run ends with its document: the strings inside are one stretch.
            held = np.add.reduceat(inside.astype(np.int64), start)
            held = np.minimum(held, stop - start)
            # Runs of more than RUN strings are cut.
            cut = -(-held // RUN)
            which = np.repeat(np.arange(len(start)), cut)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(cut) - cut, cut)
            first.append(at + start[which] + nth * RUN)
            count.append(np.minimum(held[which] - nth * RUN, RUN))
            keys.append(key[start[which]])
        at = until
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Least hashes are small numbers: mixed again, they fill all ranges alike.
    return np.concatenate(first), np.concatenate(count), _mixed(np.concatenate(keys) + np.uint64(_MIX))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a cyclic text by their first ``depth`` bytes or more: prefix
    doubling, each step one sort of (rank, rank further on, position) in 64 bits."""
    n = len(text)
    bits = max(n - 1, 1).bit_length()
    if 2 * bits + bits > 64:
        raise ValueError("the text is too long to be sorted at once")
    place = np.arange(n, dtype=np.uint64)
    known = min((64 - bits) // 8, 5)
    key = np.zeros(n, np.uint64)
    for k in range(known):
        key = key << np.uint64(8) | np.roll(text, -k).astype(np.uint64)
    while True:
        packed = np.sort(key << np.uint64(bits) | place)
        order = (packed & np.uint64((1 << bits) - 1)).astype(np.int32)
        if known >= depth:
            return order
        group = packed >> np.uint64(bits)
        new = np.empty(n, bool)
        new[0] = False
        np.not_equal(group[1:], group[:-1], out=new[1:])
        if new[1:].all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        key = rank << np.uint64(bits) | np.roll(rank, -known)
        known *= 2


def shared_prefixes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted positions of a cyclic text, and for each row the length that it
    shares with the row above, where that is under ``least`` (else 255)."""
    n = len(text)
    order = suffix_order(text, least)
    transform = text[order - 1]  # the byte before; -1 wraps around
    by_byte = np.argsort(transform, kind="stable")
    to = np.empty(n, np.int32)  # the row of the suffix one longer
    to[by_byte] = np.arange(n, dtype=np.int32)
    # The next and the last row above with the same byte.
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    same = np.flatnonzero(transform[by_byte[1:]] == transform[by_byte[:-1]])
    after[by_byte[same]] = by_byte[same + 1]
    before[by_byte[same + 1]] = by_byte[same]
    shared = np.full(n + 1, 255, np.uint8)
    shared[0] = 0
    low, high = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for length in range(least):
        size = high - low
        row = np.arange(size.sum(), dtype=np.int32) + np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size)
        last = row[after[row] >= np.repeat(high, size)]
        first = row[before[row] < np.repeat(low, size)]
        # Extended intervals lie apart, so sorted ends belong to each other.
        low, high = np.sort(to[first]), np.sort(to[last]) + 1
        new = shared[high] == 255
        low, high = low[new], high[new]
        if not len(high):
            break
        shared[high] = length
    return order, shared[:n]


def least_holders(fragments: list[bytes], holders: np.ndarray, least: int) -> list[np.ndarray]:
    """For every string of every fragment, the least holder of an equal string in
    any of them. Holders are compared as numbers."""
    sizes = np.array([len(f) for f in fragments])
    text = np.frombuffer(bytes([END]).join([*fragments, b""]), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    order, shared = shared_prefixes(text, least)
    of = np.searchsorted(starts, order, side="right") - 1
    string = order + least <= starts[of] + sizes[of]
    group = np.flatnonzero(shared != 255)
    holder = np.where(string, holders[of], NO_KEY)
    lowest = np.minimum.reduceat(holder, group)
    at = np.empty(len(text), np.int64)
    at[order] = np.repeat(lowest, np.diff(np.append(group, len(text))))
    return [at[s : s + size - least + 1] for s, size in zip(starts, sizes, strict=True)]


_COUNTED = "range int, block long, keys binary, counts binary"
_KINDS = "block long, at binary, kind binary, range int"
_FRAGMENTS = "part int, range int, block long, sizes binary, holders binary, keys binary, text binary"
_HITS = "block long, range int, bits binary"


class _Text:
    """A block's documents as one array of bytes, and their runs."""

    def __init__(self, table: pa.Table, least: int, seed: int):
        table = table.sort_by([("key", "ascending"), ("row", "ascending")])
        self.texts = [t or b"" for t in table["text"].to_pylist()]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.raw = b"".join(self.texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.keys = table["key"].to_numpy().astype(np.int64)
        self.table = table
        self.least, self.seed = least, seed

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return runs(self.data, self.ends, self.least, self.seed)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _slices(at: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, first, end) of rows whose ranges rise."""
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return list(zip(at[first].tolist(), first.tolist(), np.append(first[1:], len(at)).tolist(), strict=False))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _count_keys(blocks: DataFrame, ranges: int, least: int, seed: int, hot: int) -> DataFrame:
    """For each block and range, the places of keys that occur again (in the
    order of the block's distinct keys there) and whether they are hot."""

    def counted(key: tuple, table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        keys, counts = np.unique(_Text(table, least, seed).runs()[2], return_counts=True)
        counts = np.minimum(counts, 65535).astype("<u2")
        # In a range, half of the hash is enough: keys that are taken for equal only
        # are looked at in vain.
        return _table([(r, block, keys[i:j].astype("<u4").tobytes(), counts[i:j].tobytes()) for r, i, j in _slices(_range_of(keys, ranges))], _COUNTED)

    def again(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = _joined(table["keys"], "<u4"), _joined(table["counts"], "<u2").astype(np.int64)
        held = [len(b) // 2 for b in table["counts"].to_pylist()]
        order = np.argsort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(keys))))
        rows, at = [], 0
        for block, n in zip(table["block"].to_pylist(), held, strict=True):
            mine = total[at : at + n]
            hit = np.flatnonzero(mine > 1)
            rows.append((block, hit.astype("<u4").tobytes(), (mine[hit] > hot).astype(np.uint8).tobytes(), key[0].as_py()))
            at += n
        return _table(rows, _KINDS)

    sent = blocks.groupBy("block").applyInArrow(counted, _COUNTED)
    return sent.groupBy("range").applyInArrow(again, _KINDS)


def _send_fragments(blocks: DataFrame, told: DataFrame, ranges: int, least: int, seed: int) -> DataFrame:
    """Each block's distinct fragments by range (part 0), and where they stand
    in the block (part 1: fragment, first string and number of strings)."""

    def cut(table: pa.Table, kinds: pa.Table) -> pa.Table:
        if not len(table) or not len(kinds):
            return _table([], _FRAGMENTS)
        text, block = _Text(table, least, seed), table["block"][0].as_py()
        first, count, keys = text.runs()
        distinct = np.unique(keys)
        start = {r: i for r, i, _ in _slices(_range_of(distinct, ranges))}
        kind = np.zeros(len(distinct), np.uint8)
        for r, at, hot in zip(kinds["range"].to_pylist(), kinds["at"].to_pylist(), kinds["kind"].to_pylist(), strict=True):
            if at:
                kind[np.frombuffer(at, "<u4") + start[r]] = np.frombuffer(hot, np.uint8) + 1
        kind = kind[np.searchsorted(distinct, keys)]
        plain, hot = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        # A hot key's strings go one by one, under a hash of the whole string.
        alone = np.repeat(first[hot], count[hot]) + np.arange(count[hot].sum()) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
        begin, size = np.concatenate((first[plain], alone)), np.concatenate((count[plain], np.ones(len(alone), np.int64)))
        order = np.argsort(begin, kind="stable")
        begin, size = begin[order], size[order]
        document = text.document(begin)
        raw, number, holder, key = text.raw, {}, [], []
        names = [raw[b:e] for b, e in zip(begin.tolist(), (begin + size + least - 1).tolist(), strict=True)]
        own = np.concatenate((keys[plain], np.zeros(len(alone), np.uint64)))[order]
        # Documents stand by rising key: the first holder is the least.
        place = np.empty(len(names), np.int64)
        for i, name in enumerate(names):
            known = number.setdefault(name, len(number))
            place[i] = known
            if known == len(holder):
                holder.append(i)
        holder = np.array(holder, np.int64)
        fragments = list(number)
        key = own[holder]
        single = np.concatenate((np.zeros(len(plain), bool), np.ones(len(alone), bool)))[order][holder]
        for i in np.flatnonzero(single):
            key[i] = int.from_bytes(hashlib.blake2b(fragments[i], digest_size=8).digest(), "little")
        holders, strings = text.keys[document[holder]], size[holder]
        to = _range_of(key, ranges)
        by_range = np.lexsort((key, to))
        rows = []
        for r, i, j in _slices(to[by_range]):
            mine = by_range[i:j]
            rows.append((0, r, block, strings[mine].astype("<u1").tobytes(), holders[mine].astype("<i8").tobytes(), key[mine].astype("<u4").tobytes(), b"".join([fragments[k] for k in mine])))
        # Fragments are named by their place in what is sent, in the order of ranges.
        name = np.empty(len(fragments), np.int64)
        name[by_range] = np.arange(len(fragments))
        rows.append((1, None, block, size.astype("<u1").tobytes(), name[place].astype("<u4").tobytes(), begin.astype("<i8").tobytes(), holders[by_range].astype("<i8").tobytes()))
        return _table(rows, _FRAGMENTS)

    sent = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(cut, _FRAGMENTS)
    path = new_path(blocks.sparkSession, "fragments")
    sent.write.option("compression", "zstd").parquet(path)
    return blocks.sparkSession.read.schema(sent.schema).parquet(path)


def _find_holders(sent: DataFrame, least: int, sorted_bytes: int) -> DataFrame:
    """For each block and range, a bit for each string of the fragments it sent:
    whether a smaller document than the block's own holds it."""

    def expand(key: tuple, table: pa.Table) -> pa.Table:
        number, names, slots = {}, [], []
        for sizes, raw in zip(table["sizes"].to_pylist(), table["text"].to_pylist(), strict=True):
            at = 0
            for size in sizes:
                end = at + size + least - 1
                slots.append(number.setdefault(raw[at:end], len(number)))
                at = end
        names, slots = list(number), np.array(slots, np.int64)
        own, keys = _joined(table["holders"], "<i8"), _joined(table["keys"], "<u4")
        holders = np.full(len(names), NO_KEY, np.int64)
        np.minimum.at(holders, slots, own)
        by = np.empty(len(names), np.uint32)
        by[slots] = keys
        order = np.argsort(by, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], by[order][1:] != by[order][:-1])))
        of_key = np.diff(np.append(first, len(order)))
        # A key's only fragment meets no other: all its strings have its holder.
        strings = np.array([len(name) for name in names], np.int64) - least + 1
        flat, start = np.repeat(holders, strings), np.cumsum(strings) - strings
        order = order[np.repeat(of_key > 1, of_key)]
        of_key = of_key[of_key > 1]
        # Texts end between keys.
        ends, done, limits = np.cumsum(strings[order] + least), 0, []
        for i in np.cumsum(of_key).tolist():
            if ends[i - 1] - (ends[done - 1] if done else 0) >= sorted_bytes or i == len(order):
                limits.append((done, i))
                done = i
        for i, j in limits:
            mine = order[i:j]
            for k, found in zip(mine.tolist(), least_holders([names[k] for k in mine], holders[mine], least), strict=True):
                flat[start[k] : start[k] + strings[k]] = found
        count = strings[slots]
        base = np.cumsum(count) - count
        nth = np.arange(count.sum()) - np.repeat(base, count)
        smaller = flat[np.repeat(start[slots], count) + nth] < np.repeat(own, count)
        bits = np.add.reduceat(np.where(smaller, np.uint64(1) << nth.astype(np.uint64), np.uint64(0)), base)
        rows, at = [], 0
        for block, held in zip(table["block"].to_pylist(), table["sizes"].to_pylist(), strict=True):
            rows.append((block, key[0].as_py(), bits[at : at + len(held)].astype("<u8").tobytes()))
            at += len(held)
        return _table(rows, _HITS)

    return sent.where("part = 0").groupBy("range").applyInArrow(expand, _HITS)


def _covered(text: _Text, places: dict, hits: pa.Table, least: int) -> np.ndarray:
    """Which bytes of a block are covered."""
    covered = np.zeros(len(text.data), bool)
    if places is None:
        return covered
    hits = hits.sort_by("range")
    bits = _joined(hits["bits"], "<u8")
    name, size, begin = np.frombuffer(places["holders"], "<u4"), np.frombuffer(places["sizes"], "<u1").astype(np.int64), np.frombuffer(places["keys"], "<i8")
    holder = np.frombuffer(places["text"], "<i8")
    mask = np.where(text.keys[text.document(begin)] > holder[name], np.uint64(2**64 - 1), bits[name])
    some = np.flatnonzero(mask)
    count = size[some]
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    on = (np.repeat(mask[some], count) >> nth.astype(np.uint64)) & np.uint64(1) == 1
    start = (np.repeat(begin[some], count) + nth)[on]
    # Each string covers its bytes: sums of starts and ends.
    change = np.zeros(len(text.data) + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + least, -1)
    return np.cumsum(change[:-1]) > 0


def with_copies(documents: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """``key, text, whole``: for copies of a text with a smaller key, ``whole`` is
    the number of its bytes and the text is null. Only the digests of texts are
    grouped, and only those of texts with copies come back."""
    read = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    read = read.withColumn("size", F.octet_length("text").cast("long"))
    read = read.withColumn("digest", F.when(F.col("size") >= least, F.unhex(F.sha2("text", 256))))
    firsts = read.where("digest IS NOT NULL").groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("digest", "first")
    firsts = materialize(firsts, "copies", narrow=True)
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    copy = F.coalesce(F.col("key") > F.col("first"), F.lit(False))
    joined = read.withColumn("part", F.spark_partition_id()).join(firsts, "digest", "left")
    return joined.select("key", F.when(~copy, F.col("text")).alias("text"), F.when(copy, F.col("size")).alias("whole"), "part")


def bucketed(rows: DataFrame, in_part: int, buckets: int) -> DataFrame:
    """``block, key, row, text, whole`` as a table of the shared folder, bucketed by
    block: later steps by block read it without a shuffle. Each part of the input
    is ``in_part`` blocks, so it is written without one as well."""
    spark = rows.sparkSession
    name = f"tidewire_{uuid.uuid4().hex}"
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    block = F.col("part").cast("long") * in_part + F.pmod(F.xxhash64("row"), F.lit(in_part))
    rows = rows.select(block.alias("block"), "key", "row", "text", "whole")
    rows.write.bucketBy(buckets, "block").option("path", new_path(spark, "blocks")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def block_size(total: int, least: int, seed: int, smallest: int = BLOCK_BYTES) -> int:
    """Bytes of a block. Each block sends a row to each range, of which there are
    as many, so blocks grow with the square root of the corpus once a row would
    hold less than ``SENT_BYTES`` (about 10 bytes for every run)."""
    text_a_row = SENT_BYTES / 10 * (least - seed + 2) / 2
    return max(smallest, int((text_a_row * total) ** 0.5))


def without_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, seed: int = SEED, block_bytes: int = BLOCK_BYTES, hot: int = HOT, sorted_bytes: int = SORTED_BYTES) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept`` (the bytes left), one row a document.

    Null texts are empty, and keys are whole numbers. A null key counts as larger
    than any other; rows of equal keys, or both without one, remove nothing from
    each other; so does 2^63 - 1. Repeated rows have equal results, and texts shorter than ``least``
    stay whole. An empty table gives an empty result; other columns are not read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    parts = documents.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length(F.col(text).cast("string"))).alias("size"))
    parts, size, largest = parts.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    in_part = max(1, -(-largest // block_size(size, least, seed, block_bytes)))
    count = max(1, parts * in_part)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(count, -(-size // PARTITION_BYTES)))
    blocks = bucketed(with_copies(documents, key, text, least), in_part, buckets)
    told = _count_keys(blocks, count, least, seed, hot)
    sent = _send_fragments(blocks, told, count, least, seed)
    hits = _find_holders(sent, least, sorted_bytes)
    nothing = F.lit(None).cast("binary")
    answers = sent.where("part = 1").select("block", F.lit(-1).alias("range"), nothing.alias("bits"), "sizes", "holders", "keys", "text")
    answers = answers.unionByName(hits.select("block", "range", "bits", *[nothing.alias(c) for c in ("sizes", "holders", "keys", "text")]))

    def removed(table: pa.Table, found: pa.Table) -> pa.Table:
        text_ = _Text(table, least, seed)
        found = found.sort_by("range")
        places = found.slice(0, 1).to_pylist()[0] if len(found) else None
        covered = _covered(text_, places, found.slice(1), least)
        starts = text_.ends - text_.sizes
        gone, spans, kept = [], [], []
        for raw, i, j in zip(text_.texts, starts.tolist(), text_.ends.tolist(), strict=True):
            own = covered[i:j]
            n = int(own.sum())
            gone.append(n)
            spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if n else 0)
            kept.append(text_.data[i:j][~own].tobytes() if n else raw)
        whole = np.array([w or 0 for w in text_.table["whole"].to_pylist()], np.int64)
        keys = pa.array(text_.keys, mask=text_.keys == NO_KEY)
        return pa.table([keys, pa.array(text_.sizes + whole), pa.array(np.array(gone, np.int64) + whole), pa.array(np.array(spans, np.int64) + (whole > 0)), pa.array(kept, pa.binary())], names=["key", "n_bytes", "n_removed", "n_spans", "kept"])

    result = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(removed, "key long, n_bytes long, n_removed long, n_spans long, kept binary")
    return result.withColumnRenamed("key", key)


def op12_repeats(spark, root: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes of earlier ones."""
    found = without_repeats(spark.read.parquet(f"{root}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT row_, k, p, substr(h, 2 * p - 1, 100) AS s FROM (SELECT row_, k, h, unnest(range(1, n - 48)) AS p FROM d WHERE n >= 50)),
m AS (SELECT s, min(k) AS lowest FROM w GROUP BY s),
c AS (SELECT row_, p FROM w JOIN m USING (s) WHERE lowest < k),
g AS (SELECT row_, p, sum(fresh) OVER (PARTITION BY row_ ORDER BY p) AS span FROM (SELECT row_, p, CASE WHEN p - lag(p) OVER (PARTITION BY row_ ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM c)),
i AS (SELECT row_, span, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY row_, span),
pieces AS (
  SELECT row_, a, substr(h, 2 * f - 1, 2 * (a - f)) AS piece FROM (SELECT i.row_, a, h, lag(b, 1, 1) OVER (PARTITION BY i.row_ ORDER BY a) AS f FROM i JOIN d USING (row_))
  UNION ALL
  SELECT row_, n + 1, substr(h, 2 * coalesce(max(b), 1) - 1) FROM d LEFT JOIN i USING (row_) GROUP BY row_, n, h),
kept AS (SELECT row_, sha256(unhex(string_agg(piece, '' ORDER BY a))) AS kept_sha256 FROM pieces GROUP BY row_),
spans AS (SELECT row_, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM i GROUP BY row_)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM d JOIN kept USING (row_) LEFT JOIN spans USING (row_)
"""
