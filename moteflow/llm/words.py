"""Words of whole Arrow batches of texts, found by byte classes; all that ends a word is ASCII, so UTF-8 needs no decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD, BLANK, PIECE = range(3)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_classes(blanks: bytes = b"", pieces: bytes = b"", words: bytes | None = None) -> np.ndarray:
    """The class of each byte: named blanks and piece ends, and words for all others; or words as named, and blanks for all others."""
    out = np.full(256, WORD if words is None else BLANK, np.uint8)
    if words is not None:
        out[list(words)] = WORD
    out[list(blanks)] = BLANK
    out[list(pieces)] = PIECE
    return out


def words_of(texts: pa.Array, classes: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Every word of the texts with A-Z lower-cased, the row it stands in and the number of piece ends before it in the batch.

    Null and empty texts have no words. A word never goes on into the next text.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    if bounds[-1] == bounds[0]:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
    bounds = bounds - bounds[0]
    kind = classes[data]
    word = kind == WORD
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = bounds[:-1][bounds[:-1] < len(data)]
    first[begins] = word[begins]
    starts = np.flatnonzero(first)
    at = np.append(np.cumsum(word, dtype=np.int32)[starts] - 1, word.sum()).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data[word]))
    return found, np.searchsorted(bounds, starts, "right") - 1, np.cumsum(kind == PIECE, dtype=np.int32)[starts].astype(np.int64)
