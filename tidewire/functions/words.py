"""The words of a batch of texts, by whole buffers instead of one object a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose words a task makes at once.
PIECE_BYTES = 1 << 20
_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES):
    """Runs of a batch's rows with about ``most`` bytes of text (all columns but the
    first), or one row."""
    if batch.num_rows:
        size = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy().astype(np.int64) for c in batch.columns[1:])
        first = np.flatnonzero(np.diff((np.cumsum(size) - size) // most, prepend=-1)).tolist()
        for i, j in zip(first, [*first[1:], batch.num_rows], strict=True):
            yield batch.slice(i, j - i)


def _marked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts, which of them are in a word, which begin one, and
    where each text begins and ends."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _IN_WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # A text's first word begins there, whatever the text before it ends with.
    at = ends[:-1][ends[:-1] < len(data)]
    begins[at] = inside[at]
    return data, inside, begins, ends


def counts(texts: pa.Array) -> np.ndarray:
    """How many words (``[a-z0-9]+``) each text has; a null has none."""
    if not len(texts):
        return np.zeros(0, np.int64)
    _, _, begins, ends = _marked(texts)
    return np.diff(np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])[ends])


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Of each word (``[a-z0-9]+``) of the texts its text, its place there, and the
    word, in order. The texts are a piece, as 32 bits count their bytes."""
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.string()).dictionary_encode()
    data, inside, begins, ends = _marked(texts)
    many = np.diff(np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])[ends])
    row = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    letters = data[inside]
    starts = np.append(np.flatnonzero(begins[inside]), len(letters)).astype(np.int32)
    each = pa.StringArray.from_buffers(len(row), pa.py_buffer(starts), pa.py_buffer(letters))
    return row, place.astype(np.int32), each.dictionary_encode()
