"""Fast, exact ids of a byte-level BPE vocabulary, and the CRC of id runs."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from panelloom.llm.wordsplit import slices, text_bytes

#: Pieces that the vocabulary's splitting pattern leaves whole: a blank and Latin letters.
_ONE_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_CACHE_WORDS = 120_000
_BATCH_BYTES = 4 << 20


def _byte_letters() -> dict[int, str]:
    """The usual byte alphabet of byte-level BPE: printing bytes stand for themselves, the
    others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return table


class _Pieces(dict):
    """Ids of pieces, each encoded by the library when first asked for.

    Bounded by two generations: when the young one is full it becomes the old one, and
    what is asked for again moves back.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.merge = tokenizer, tokenizer.model.tokenize
        self.letters, self.old = _byte_letters(), {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if _ONE_WORD.fullmatch(piece):
                found = [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.letters))]
            else:
                found = self.tokenizer.encode(piece, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}H", *found)
        self[piece] = ids
        return ids

    def age(self) -> None:
        if len(self) > _CACHE_WORDS:
            self.old = dict(self)
            self.clear()


_BYTE = np.arange(256)
_LETTER = np.isin(_BYTE, [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_MARK = (_BYTE < 0x80) & ~_LETTER & ~np.isin(_BYTE, range(0x30, 0x3A))  # ASCII, no letter, no digit
_SPACE = np.isin(_BYTE, [*range(0x09, 0x0E), 0x20])
_LEAD = np.isin(_BYTE, [0xC2, 0xE1, 0xE2, 0xE3])  # of characters among which wide spaces are


def _cuts(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where pieces begin: at texts, after an ASCII letter before an ASCII character that is
    neither letter nor digit, and at single blanks between printing characters.

    The vocabulary's pattern ends a match at all of these.  A neighbour of a blank from the
    blocks of characters that hold wide spaces counts as white space."""
    ends = np.zeros(len(data) + 1, bool)
    ends[1:-1] = _LETTER[data[:-1]] & _MARK[data[1:]]
    blank = np.flatnonzero(data == 0x20)
    inner = np.ones(len(data) + 1, bool)
    inner[borders] = False
    blank = blank[inner[blank] & inner[blank + 1]]
    before, after = data[blank - 1], data[blank + 1]
    wide = (before >= 0x80) & (_LEAD[data[np.maximum(blank - 2, 0)]] | _LEAD[data[np.maximum(blank - 3, 0)]])
    ends[blank[~(_SPACE[before] | wide | _SPACE[after] | _LEAD[after])]] = True
    ends[borders] = True
    return np.flatnonzero(ends)


class Encoder:
    """Ids of whole texts as uint16.

    Byte-level BPE never merges across the borders of its splitting pattern, so texts are cut
    at some of them (see :func:`_cuts`) and each distinct piece of a column is encoded once, by
    the library; the ids of all pieces are then gathered by position.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.pieces = _Pieces(self.tokenizer)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the border of each text among them."""
        data, borders = text_bytes(texts)
        cuts = _cuts(data, borders)
        coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        found = list(map(self.pieces.__getitem__, coded.dictionary.to_pylist()))
        self.pieces.age()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        flat, starts = np.frombuffer(b"".join(found), "<u2"), np.cumsum(sizes) - sizes
        piece = coded.indices.to_numpy(zero_copy_only=False)
        own = sizes[piece]
        ends = np.zeros(len(own) + 1, np.int64)
        np.cumsum(own, out=ends[1:])
        ids = flat[np.repeat(starts[piece] - ends[:-1], own) + np.arange(ends[-1])]
        return ids, ends[np.searchsorted(cuts, borders)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """uint16 little-endian ids of each text."""
        ids, borders = self.column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)]

    def batches(self, batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """The same rows in parts of bounded text size, each with its ids and their borders."""
        for part in slices(batches, column, _BATCH_BYTES):
            yield part, *self.column(part.column(column))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file; a worker keeps it from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def ids_crc(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
