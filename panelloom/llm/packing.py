"""Packing along a space-filling curve: neighbours on a Hilbert curve through hashed
document vectors share sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import stage
from panelloom.llm.tokens import encoder

END_ID = 1
_ROWS = 1000


def projection(dims: int, seed: int = 17) -> np.ndarray:
    """Random signs for every 16-bit id: rows of a hashed projection to ``dims`` numbers."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], "float32"), size=(1 << 16, dims))


def curve_point(vectors: np.ndarray, bits: int) -> np.ndarray:
    """Cells of mean sign vectors on a grid of 2**bits steps a side.  The means of ordinary
    texts lie within a few tenths of 0, so a sigmoid spreads them over the grid."""
    unit = 0.5 + 0.5 * np.tanh(4.0 * vectors)
    return np.minimum((unit * (1 << bits)).astype("int64"), (1 << bits) - 1)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates.

    Works from the highest bit down: each level exchanges or inverts the lower bits of the
    first coordinate as the curve turns, then the coordinates are Gray-decoded and their
    bits interleaved.
    """
    x = cells.astype("int64").copy()
    n, dims = x.shape
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            turned = (x[:, d] & bit) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] = np.where(turned, x[:, 0] ^ low, x[:, 0] ^ swap)
            if d:
                x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(n, "int64")
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, dims - 1] & (1 << level)) != 0, (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(n, "int64")
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> level) & 1)
    return key


def token_rows(docs: DataFrame, vocabulary: str, dims: int = 4, bits: int = 12) -> DataFrame:
    """``doc_id``, Hilbert ``key``, ``n`` ids and ``ids`` (uint16) of every document, end id
    included."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("key", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, signs = encoder(vocabulary), projection(dims)
        for part, ids, borders in coder.batches(batches):
            # Each text's ids and its end id, laid end to end.
            n = np.diff(borders) + 1
            ends = np.cumsum(n)
            flat = np.full(ends[-1], END_ID, "<u2")
            inner = np.ones(len(flat), bool)
            inner[ends - 1] = False
            flat[inner] = ids
            sums = np.stack([np.add.reduceat(signs[flat, d], ends - n, dtype=np.float64) for d in range(dims)], axis=1)
            key = hilbert_key(curve_point(sums / n[:, None], bits), bits)
            offsets = np.concatenate([[0], 2 * ends]).astype(np.int64)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(key), pa.array(n), raw.cast(pa.binary())], ["doc_id", "key", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class _Packer:
    """Cuts a stream of documents into full sequences, without gaps.

    Only the last, incomplete sequence of a stream is held back; :meth:`finish` cuts it at
    powers of two, which need no padding.
    """

    def __init__(self, length: int, first_id: int):
        self.length, self.next_id, self.fill = length, first_id, 0
        self.held: list[tuple] = []

    def _close(self, held: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, ids, total in held:
            out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1
        return out

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        out, start = [], 0
        while start < len(ids):
            piece = ids[start : start + self.length - self.fill]
            self.held.append((doc_id, start, piece, len(ids)))
            self.fill += len(piece)
            start += len(piece)
            if self.fill == self.length:
                out += self._close(self.held)
                self.held, self.fill = [], 0
        return out

    def finish(self) -> list[tuple]:
        out, rest, left = [], self.held[::-1], self.fill
        while left:
            room, part = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc_id, start, ids, total = rest.pop()
                if len(ids) > room:
                    rest.append((doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                part.append((doc_id, start, ids, total))
                room -= len(ids)
            out += self._close(part)
        self.held, self.fill = [], 0
        return out


def pack(docs: DataFrame, vocabulary: str, length: int = 2048) -> DataFrame:
    """Pack all documents (``doc_id``, ``text``) into sequences of ``length`` ids.

    Documents become ids and an end id, are range-sorted along the curve and laid end to
    end, so a sequence holds neighbours and no padding; the tail of each range is cut at
    powers of two.  Returns one row per piece: ``doc_id``, ``start`` (ids of the document
    before the piece), ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset`` (gapless from 0 in the sequence).

    A null or empty text is its end id alone; rows that repeat an id or a text are packed
    each; copies share a curve key and are spread by id; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + [
        T.StructField(c, T.BinaryType() if c == "ids" else T.LongType())
        for c in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    ])
    rows = stage(token_rows(docs, vocabulary), "pack-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(length, TaskContext.get().partitionId() << 32)
        as_arrow = None
        for batch in batches:
            as_arrow = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                out = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist()):
                    out += packer.add(doc_id, np.frombuffer(ids, "<u2"))
                if out:
                    yield _batch(out, as_arrow)
        if tail := packer.finish():
            yield _batch(tail, as_arrow)

    def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, *[pa.binary() if f.name == "ids" else pa.int64() for f in schema.fields[1:]]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.names)

    ordered = rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "n", F.xxhash64("ids"))
    return ordered.select("doc_id", "ids").mapInArrow(run, schema)
