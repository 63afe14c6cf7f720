"""Packing by power-of-two decomposition.

A document of L ids (its text's ids and an end id) is cut into as many pieces
of ``longest`` ids as fit and then into one piece for each set bit of the rest,
longest first. Every piece is a sequence of its own: its length is a power of
two, so it needs no padding, and no sequence holds two documents. Sequences of
equal length form a bucket (``bucket`` = log2 of the length); a trainer draws
each batch from one bucket, with a batch size that keeps the ids of a batch
constant. One scan, no shuffle.

A piece is at most ``longest`` ids, so long documents only add pieces, and what
is held in memory is one Arrow batch and a bounded cache of word ids.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import small_batches, text_of

END_ID, LONGEST = 2, 4096
#: Words and pieces of words whose ids a worker keeps, from the second time that
#: they occur (about 300 bytes each), and bits of the table that tells so.
CACHE_WORDS, CACHE_PIECES, AGAIN_BITS = 500_000, 250_000, 22
#: Longer words are encoded but not kept.
CACHE_CHARS = 48
#: Bytes of ids in a batch that a worker hands over.
OUT_BYTES = 8 << 20

_ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
#: Printable ASCII and Latin letters that normalise to themselves.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]+")
#: The pre-tokenizer's pattern on such characters, lower-cased.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u017f]+|[0-9]|[^a-z0-9\u00c0-\u017f]+")


def tokenizer_path(path: str | None = None) -> str:
    """The vocabulary file: ``path``, or the public one of the installation."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> dict[int, str]:
    """Byte-level symbols of the two-byte characters of ``_PLAIN``, by rule.

    Printable Latin-1 bytes stand for themselves, the other bytes for the
    characters from U+0100 on, in order.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    symbol = {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}
    return {c: "".join(symbol[b] for b in chr(c).encode()) for c in range(0xC0, 0x180)}


class _Again:
    """Whether a word was met before, nearly always right: bytes by the word's
    hash, forgotten when half of them are set. Words that occur once so take no
    room in a cache."""

    def __init__(self):
        self.seen, self.left = bytearray(1 << AGAIN_BITS), 1 << (AGAIN_BITS - 1)

    def __call__(self, word: str) -> bool:
        at = hash(word) & ((1 << AGAIN_BITS) - 1)
        if self.seen[at]:
            return True
        self.seen[at] = 1
        self.left -= 1
        if not self.left:
            self.__init__()
        return False


class _Pieces(dict):
    """Ids of a lower-cased piece, as bytes: the tokenizer's model applied to it."""

    def __init__(self, model):
        self.model, self.symbols, self.again = model, byte_symbols(), _Again()

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(piece.translate(self.symbols))]).tobytes()
        if len(piece) <= CACHE_CHARS and self.again(piece):
            self[piece] = ids
        return ids


class _Words(dict):
    """Ids of a word (no white space inside), as bytes."""

    def __init__(self, tokenizer, special: list[str]):
        self.tokenizer, self.special = tokenizer, special
        self.pieces, self.again = _Pieces(tokenizer.model), _Again()

    def __missing__(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and not ("<" in word and any(s in word for s in self.special)):
            # Normalising and splitting such characters takes no tables.
            ids = b"".join(map(self.pieces.__getitem__, _SPLIT.findall(word.lower())))
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= CACHE_CHARS and self.again(word):
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of whole texts, equal to the tokenizer's own, word by word.

    This vocabulary never merges over white space, so a text's ids are those of
    its words in a row. Ids of a word are kept as little-endian 32-bit bytes in
    caches of bounded size. A new word of plain Latin letters is lower-cased,
    split into pieces and looked up in the tokenizer's model; any other word
    goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Words(self.tokenizer, self.special)

    @staticmethod
    def words(text: str) -> list[str]:
        # str.split also splits at four control characters that are no white
        # space to the tokenizer.
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [w for w in _ASCII_SPACE.split(text) if w]
        return text.split()

    def encode(self, text: str) -> bytes:
        ids = b"".join(map(self.known.__getitem__, self.words(text)))
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.known.pieces) > CACHE_PIECES:
            self.known.pieces.clear()
        return ids if sys.byteorder == "little" else swapped(ids)


def swapped(ids: bytes) -> bytes:
    """32-bit numbers in the other byte order."""
    numbers = array("I", ids)
    numbers.byteswap()
    return numbers.tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """``n`` as ``longest`` + ... + distinct falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


SCHEMA = "{id} {kind}, start long, length long, doc_tokens long, bucket int, ids binary"


def pack(documents: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: ``key, start, length, doc_tokens, bucket, ids, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit. A null or empty text has one
    piece, the end id. Repeated rows are packed as often as they occur, a null
    key stays null, an empty table gives no piece, and other columns are not
    read. ``sequence_id`` differs for every piece (it is not gapless); each
    sequence is one piece, so ``offset`` is 0.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    small_batches(documents.sparkSession)
    path = tokenizer_path(vocabulary)
    kind = documents.schema[key].dataType.simpleString()
    read = documents.select(F.col(key).alias("key"), text_of(text).alias("text"))

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        end = np.asarray([end_id], dtype="<u4").tobytes()

        def out(rows, keys):
            taken, start, length, tokens, ids = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [keys.take(pa.array(taken, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n.bit_length() - 1 for n in length], pa.int32()), pa.array(ids, pa.binary())],
                ["key", "start", "length", "doc_tokens", "bucket", "ids"],
            )

        for batch in it:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            rows, held = [], 0
            for i, text_ in enumerate(texts):
                raw = encoder(path).encode(text_) + end
                n, start = len(raw) // 4, 0
                for length in piece_lengths(n, longest):
                    rows.append((i, start, length, n, raw[4 * start : 4 * (start + length)]))
                    start += length
                held += len(raw)
                if held >= OUT_BYTES:
                    yield out(rows, keys)
                    rows, held = [], 0
            if rows:
                yield out(rows, keys)

    found = read.mapInArrow(pieces, SCHEMA.format(id="key", kind=kind))
    return found.select(F.col("key").alias(key), "start", "length", "doc_tokens", "bucket", "ids", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces as Parquet, one folder for each bucket of equal lengths."""
    pieces.write.partitionBy("bucket").parquet(path)


def op2_packing(spark, root: str) -> DataFrame:
    """All documents in power-of-two pieces, with a checksum of each piece's ids."""
    pieces = pack(spark.read.parquet(f"{root}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
