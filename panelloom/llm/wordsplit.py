"""Words of whole Arrow columns at once, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
#: Bytes of words: anything but ASCII white space, in UTF-8 also every byte above 0x7F.
NOT_BLANK = ~np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
#: Bytes of terms: ASCII letters and digits and every byte above 0x7F.
TERM = np.isin(_BYTES, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.where(np.isin(_BYTES, range(0x41, 0x5B)), _BYTES + 32, _BYTES).astype(np.uint8)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the border of each text; null counts as empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    borders = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[borders[0] : borders[-1]] if body is not None and borders[-1] > borders[0] else np.zeros(0, np.uint8)
    return data, borders - borders[0]


def split(texts: pa.Array, word_bytes: np.ndarray = NOT_BLANK, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, one after another, and the border of each text among them."""
    data, borders = text_bytes(texts)
    inside = word_bytes[data]
    inner = borders[1:-1][(borders[1:-1] > 0) & (borders[1:-1] < len(data))]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[inner] = inside[inner]
    last[:-1] &= ~inside[1:]
    last[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = data[inside]
    if lower:
        letters = LOWER[letters]
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))
    return words, np.searchsorted(starts, borders)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``most_bytes``; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        borders = text_bytes(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(borders, borders[start] + most_bytes, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
