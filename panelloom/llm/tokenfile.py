"""Token files: ids in independently reset, checksummed blocks under an adaptive
context-mixing range coder."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.common import bounded_batches, shared_root
from panelloom.llm.tokens import encoder, ids_crc

END_ID = 0
BLOCK_IDS = 4096
#: Blocks coded side by side; each holds about 160 kB of model state, so a coder takes about 160 MB.
LANES = 1024
MAGIC = b"CMR1"
_HEADER = struct.Struct("<4sIII")  # magic, ids, vocabulary size, crc32 of the ids as uint16

_SLOTS = 1 << 11  # contexts of each order, per block
_REFRESH = 256  # steps between refreshes of the order-0 totals
_SURE = 2048  # of 65,536: what an order's prediction leaves to the others at least
_TOP, _BOTTOM, _WORD = np.uint64(1 << 48), np.uint64(1 << 40), np.uint64(16)
_UNIT = 1 << 16
_ONE, _ZERO = np.uint64(1), np.uint64(0)


def _prior(vocabulary: int) -> np.ndarray:
    """Cumulated frequencies for ids new to a block: low ids are the frequent merges."""
    return np.concatenate([[0], np.cumsum(np.maximum(1, (1 << 14) // (np.arange(vocabulary) + 64)))])


class _Mixer:
    """Adaptive predictions of many blocks in step; block i is lane i.

    Orders 1 and 2 each predict one id from the last ids, with a confidence that grows with
    hits; order 0 counts the ids of the block so far, numbered as they appeared, and leaves a
    share for new ones.  Per confidence, the share of hits so far weighs an order's
    prediction: the mixture gives order 2 its share, order 1 its share of the rest, and
    order 0 what remains.
    """

    def __init__(self, lanes: int, vocabulary: int, longest: int):
        self.v, self.width = vocabulary, longest + 1
        self.lane = np.arange(lanes, dtype="int64")
        self.number = np.full(lanes * vocabulary, -1, "int16")  # id -> its number in the block
        self.name = np.zeros((lanes, self.width), "uint16")  # number -> id
        self.known = np.zeros(lanes, "int64")
        self.count = np.zeros((lanes, self.width), "int32")
        self.cum = np.zeros((lanes, self.width + 1), "int32")
        self.total = np.zeros(lanes, "int64")
        self.old = np.zeros(lanes, "int64")  # of 65,536: share of order 0 for known ids
        self.table = [np.zeros(lanes * _SLOTS, "int32") for _ in range(2)]  # id << 4 | confidence
        rate = (np.arange(16) * 2 + 1) * _UNIT // 40
        self.rate = [np.tile(rate.astype("int32"), lanes) for _ in range(2)]
        self.last = np.zeros((2, lanes), "int64")

    def refresh(self, ids: np.ndarray) -> None:
        """Count the latest ids ([steps, lanes still running]) into order 0."""
        k = ids.shape[1]
        at = (self.lane[:k, None] * self.v + ids.T).ravel()
        unseen = at[self.number.take(at) < 0]
        if len(unseen):
            keys, first = np.unique(unseen, return_index=True)
            keys = keys[np.argsort(first)]  # by lane, then by first appearance
            lane = keys // self.v
            new = np.bincount(lane, minlength=k)
            number = self.known[lane] + np.arange(len(keys)) - np.repeat(np.cumsum(new) - new, new)
            self.number[keys] = number
            self.name[lane, number] = keys % self.v
            self.known[:k] += new
        np.add.at(self.count.ravel(), np.repeat(self.lane[:k] * self.width, len(ids)) + self.number.take(at), 1)
        self.most = int(self.known[:k].max(initial=0))
        np.cumsum(self.count[:k, : self.most], axis=1, out=self.cum[:k, 1 : self.most + 1])
        self.total[:k] = self.cum[:k, self.most]
        self.old[:k] = (self.total[:k] << 16) // (self.total[:k] + self.known[:k] + 16)

    def predict(self, k: int):
        """For the first k lanes: predicted ids of orders 2 and 1, and the three borders that
        cut a unit interval into order 2, order 1, known ids and new ids."""
        lane = self.lane[:k]
        one, two = self.last[0, :k], self.last[1, :k]
        context = (one & (_SLOTS - 1), ((one * 40503 + two * 30011) >> 3) & (_SLOTS - 1))
        self.at = [lane * _SLOTS + c for c in context]
        self.entry = [t.take(a) for t, a in zip(self.table, self.at)]
        self.slot = [lane * 16 + (e & 15) for e in self.entry]
        self.share = [r.take(s) for r, s in zip(self.rate, self.slot)]
        b2 = self.share[1].astype("int64")
        b1 = b2 + (((_UNIT - b2) * self.share[0]) >> 16)
        b0 = b1 + (((_UNIT - b1) * self.old[:k]) >> 16)
        return self.entry[1] >> 4, self.entry[0] >> 4, b2, b1, b0

    def update(self, k: int, ids: np.ndarray) -> None:
        for order in (0, 1):
            entry = self.entry[order]
            hit = (entry >> 4) == ids
            sure = entry & 15
            kept = np.where(hit, entry + (sure < 15), entry - sure + (sure >> 1))
            self.table[order][self.at[order]] = np.where(hit | (sure > 0), kept, ids << 4)
            goal = np.where(hit, _UNIT - _SURE, 256)
            self.rate[order][self.slot[order]] = self.share[order] + ((goal - self.share[order]) >> 4)
        self.last[1, :k] = self.last[0, :k]
        self.last[0, :k] = ids

    def find(self, lane: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Per lane the number whose interval of cumulated counts holds the mark."""
        sums, base = self.cum.ravel(), lane * (self.width + 1)
        now, step = np.zeros(len(lane), "int64"), 1 << max(self.most - 1, 1).bit_length()
        while step := step >> 1:
            probe = np.minimum(now + step, self.most - 1)
            now = np.where(sums.take(base + probe) <= mark, probe, now)
        return now


def _running(lengths: np.ndarray) -> list[int]:
    """Lanes still running at each step; lengths are in descending order."""
    return (len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), side="right")).tolist()


def _narrow(low, span, start, size, total):
    part = span // total
    return low + start * part, size * part


def _settled(low: np.ndarray, span: np.ndarray):
    """Lanes whose leading 16 bits are fixed, or whose span is too small and must be cut."""
    same = (low ^ (low + span)) < _TOP
    small = span < _BOTTOM
    lanes = np.flatnonzero(same | small)
    cut = lanes[~same[lanes]]
    span[cut] = (_ZERO - low[cut]) & (_BOTTOM - _ONE)
    return lanes


def _even(order: list[int]) -> list[list[int]]:
    """Groups of at most LANES, as even as can be: a step costs much the same for any group."""
    parts = -(-len(order) // LANES)
    return [order[len(order) * i // parts : len(order) * (i + 1) // parts] for i in range(parts)]


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """One self-contained frame per block of ids."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    frames = [b""] * len(blocks)
    for group in _even(order):
        for i, code in zip(group, _encode_lanes([blocks[i] for i in group], vocabulary)):
            ids = blocks[i].astype("<u2").tobytes()
            frames[i] = _HEADER.pack(MAGIC, len(blocks[i]), vocabulary, zlib.crc32(ids)) + code
    return frames


def _encode_lanes(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    lengths = np.array([len(b) for b in blocks])
    lanes, longest = len(blocks), int(lengths[0])
    ids = np.zeros((longest, lanes), "uint16")
    for i, b in enumerate(blocks):
        ids[: len(b), i] = b
    mixer, prior, running = _Mixer(lanes, vocabulary, longest), _prior(vocabulary), _running(lengths)
    all_low, all_span = np.zeros(lanes, "uint64"), np.full(lanes, 2**64 - 1, "uint64")
    out, used = np.zeros((lanes, longest * 3 + 8), "<u2"), np.zeros(lanes, "int64")
    for t, k in enumerate(running):
        step = t % _REFRESH
        if step == 0:
            mixer.refresh(ids[max(t - _REFRESH, 0) : t, :k].astype("int64"))
            part = ids[t : t + _REFRESH, :k].astype("int64")
            number = mixer.number.take(mixer.lane[:k] * vocabulary + part).astype("int64")
            known = number >= 0
            row = mixer.lane[:k] * (mixer.width + 1) + np.maximum(number, 0)
            c0 = mixer.cum.ravel().take(row)
            start0, size0 = c0.astype("uint64"), (mixer.cum.ravel().take(row + 1) - c0).astype("uint64")
            start9, size9 = prior[part].astype("uint64"), (prior[part + 1] - prior[part]).astype("uint64")
            total9 = np.uint64(prior[-1])
        now = part[step, :k]
        second, first, b2, b1, b0 = mixer.predict(k)
        by2 = second == now
        by1 = (first == now) & ~by2
        rest = ~(by2 | by1)
        by0 = rest & known[step, :k] & (b0 > b1)
        by9 = rest & ~by0
        start = np.where(by2, 0, np.where(by1, b2, np.where(by0, b1, b0))).astype("uint64")
        end = np.where(by2, b2, np.where(by1, b1, np.where(by0, b0, _UNIT))).astype("uint64")
        low, span = _narrow(all_low[:k], all_span[:k], start, end - start, np.uint64(_UNIT))
        start = np.where(by0, start0[step, :k], np.where(by9, start9[step, :k], _ZERO))
        size = np.where(by0, size0[step, :k], np.where(by9, size9[step, :k], _ONE))
        total = np.where(by0, mixer.total[:k].astype("uint64"), np.where(by9, total9, _ONE))
        low, span = _narrow(low, span, start, size, total)
        while len(lane := _settled(low, span)):
            out[lane, used[lane]] = low[lane] >> np.uint64(48)
            used[lane] += 1
            low[lane] <<= _WORD
            span[lane] <<= _WORD
        all_low[:k], all_span[:k] = low, span
        mixer.update(k, now)
    for shift in (48, 32, 16, 0):
        out[np.arange(lanes), used] = (all_low >> np.uint64(shift)) & np.uint64(0xFFFF)
        used += 1
    return [out[i, : used[i]].tobytes() for i in range(lanes)]


def decode_blocks(frames: list[bytes]) -> list[np.ndarray]:
    """The ids of each frame; a frame that fails its checksum raises ValueError."""
    heads = [_HEADER.unpack_from(f) for f in frames]
    if any(h[0] != MAGIC for h in heads):
        raise ValueError("not a block of token ids")
    order = sorted(range(len(frames)), key=lambda i: -heads[i][1])
    found: list[np.ndarray] = [np.zeros(0, "<u2")] * len(frames)
    sizes = sorted({h[2] for h in heads})
    for group in [g for v in sizes for g in _even([i for i in order if heads[i][2] == v])]:
        ids = _decode_lanes([frames[i][_HEADER.size :] for i in group], np.array([heads[i][1] for i in group]), heads[group[0]][2])
        for i, own in zip(group, ids):
            if zlib.crc32(own.tobytes()) != heads[i][3]:
                raise ValueError("checksum of a token block does not match")
            found[i] = own
    return found


def _decode_lanes(codes: list[bytes], lengths: np.ndarray, vocabulary: int) -> list[np.ndarray]:
    lanes, longest = len(codes), int(lengths[0])
    words = np.zeros((lanes, max(map(len, codes)) // 2 + 4), "<u2")
    for i, c in enumerate(codes):
        words[i, : len(c) // 2] = np.frombuffer(c, "<u2")
    ids = np.zeros((longest, lanes), "<u2")
    mixer, prior = _Mixer(lanes, vocabulary, longest), _prior(vocabulary)
    all_low, all_span = np.zeros(lanes, "uint64"), np.full(lanes, 2**64 - 1, "uint64")
    all_code, used = np.zeros(lanes, "uint64"), np.full(lanes, 4, "int64")
    for i in range(4):
        all_code = (all_code << _WORD) | words[:, i].astype("uint64")
    unit, total9 = np.uint64(_UNIT), np.uint64(prior[-1])
    for t, k in enumerate(_running(lengths)):
        if t % _REFRESH == 0:
            mixer.refresh(ids[max(t - _REFRESH, 0) : t, :k].astype("int64"))
        second, first, b2, b1, b0 = mixer.predict(k)
        low, span, code = all_low[:k], all_span[:k], all_code[:k]
        mark = np.minimum((code - low) // (span // unit), unit - _ONE).astype("int64")
        by2 = mark < b2
        by1 = (mark < b1) & ~by2
        by9 = mark >= b0
        by0 = ~(by2 | by1 | by9)
        start = np.where(by2, 0, np.where(by1, b2, np.where(by0, b1, b0))).astype("uint64")
        end = np.where(by2, b2, np.where(by1, b1, np.where(by0, b0, _UNIT))).astype("uint64")
        low, span = _narrow(low, span, start, end - start, unit)
        total = np.where(by0, mixer.total[:k].astype("uint64"), np.where(by9, total9, _ONE))
        mark = np.minimum((code - low) // (span // total), total - _ONE).astype("int64")
        now = np.where(by2, second, first).astype("int64")
        start, size = np.zeros(k, "uint64"), np.ones(k, "uint64")
        if len(lane := np.flatnonzero(by0)):
            number = mixer.find(lane, mark[lane])
            c0 = mixer.cum[lane, number]
            start[lane], size[lane] = c0, mixer.cum[lane, number + 1] - c0
            now[lane] = mixer.name[lane, number]
        if len(lane := np.flatnonzero(by9)):
            found = np.searchsorted(prior, mark[lane], side="right") - 1
            start[lane], size[lane] = prior[found], prior[found + 1] - prior[found]
            now[lane] = found
        low, span = _narrow(low, span, start, size, total)
        while len(lane := _settled(low, span)):
            code[lane] = (code[lane] << _WORD) | words[lane, np.minimum(used[lane], words.shape[1] - 1)].astype("uint64")
            used[lane] += 1
            low[lane] <<= _WORD
            span[lane] <<= _WORD
        all_low[:k], all_span[:k] = low, span
        ids[t, :k] = now
        mixer.update(k, now)
    return [np.ascontiguousarray(ids[: lengths[i], i]) for i in range(lanes)]


def _columns(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_ids", T.LongType()),
        T.StructField("docs", T.ArrayType(T.StructType([
            T.StructField("doc_id", id_type), T.StructField("doc", T.LongType()), T.StructField("at", T.LongType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("skip", T.LongType()), T.StructField("n", T.LongType()),
        ]))), T.StructField("frame", T.BinaryType()),
    ])


def write(docs: DataFrame, vocabulary: str, path: str) -> None:
    """Write the ids of all documents (``doc_id``, ``text``) in ascending id order.

    ``path`` gets a Parquet folder: one row per block, with its part (the range of ids its
    task held), its number in the part, the documents it holds pieces of (id, number in the
    part, ids of the part before it, its ids, ids before the piece, ids of the piece) and
    the coded frame.  Spark's commit protocol makes the files whole or absent.

    A null or empty text is its end id alone; rows that repeat an id follow one another, by
    text; null ids come first; an empty table gives an empty folder.
    """
    schema = _columns(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        size = coder.tokenizer.get_vocab_size()
        end, part = np.array([END_ID], "<u2"), TaskContext.get().partitionId()
        into = pa.schema([])
        block, doc, at = 0, 0, 0
        ready: list[tuple[np.ndarray, list]] = []
        held, pieces, fill = [], [], 0

        def close():
            nonlocal held, pieces, fill
            if fill:
                ready.append((np.concatenate(held), pieces))
                held, pieces, fill = [], [], 0

        def emit(some):
            nonlocal block
            frames = encode_blocks([ids for ids, _ in some], size)
            rows = [{"part": part, "block": block + i, "n_ids": len(ids), "docs": own, "frame": f}
                    for i, ((ids, own), f) in enumerate(zip(some, frames))]
            block += len(rows)
            return pa.RecordBatch.from_pylist(rows, schema=into)

        for batch, flat, borders in coder.batches(batches):
            if not len(into):
                into = _arrow(batch.schema.field("doc_id").type)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), borders[:-1], borders[1:], strict=True):
                ids, skip = np.concatenate([flat[a:b], end]), 0
                while skip < len(ids):
                    piece = ids[skip : skip + BLOCK_IDS - fill]
                    held.append(piece)
                    pieces.append({"doc_id": doc_id, "doc": doc, "at": at, "n_tokens": len(ids), "skip": skip, "n": len(piece)})
                    fill += len(piece)
                    skip += len(piece)
                    if fill == BLOCK_IDS:
                        close()
                doc, at = doc + 1, at + len(ids)
                while len(ready) >= 2 * LANES:
                    yield emit(ready[:LANES])
                    del ready[:LANES]
        close()
        if ready:
            yield emit(ready)

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with bounded_batches(docs.sparkSession):
        ordered.mapInArrow(run, schema).write.parquet(path)


def _arrow(id_type: pa.DataType) -> pa.Schema:
    piece = pa.struct([("doc_id", id_type), *[(c, pa.int64()) for c in ("doc", "at", "n_tokens", "skip", "n")]])
    return pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("docs", pa.list_(piece)), ("frame", pa.binary())])


def read(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    """The pieces of a written folder, decoded: ``part``, ``doc``, ``doc_id``, ``at``,
    ``n_tokens``, ``skip``, ``ids`` (little-endian uint16)."""
    out = T.StructType([f for f in _columns(id_type)["docs"].dataType.elementType if f.name != "n"] + [
        T.StructField("part", T.IntegerType()), T.StructField("ids", T.BinaryType())])
    names = [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 2 * LANES):
                some = batch.slice(row, 2 * LANES)
                docs = some.column("docs")
                blocks = decode_blocks(some.column("frame").to_pylist())
                ids, parts = [], []
                for block, part, own in zip(blocks, some.column("part").to_pylist(), docs.to_pylist()):
                    at = 0
                    for piece in own:
                        ids.append(block[at : at + piece["n"]].tobytes())
                        at += piece["n"]
                    parts += [part] * len(own)
                flat = docs.flatten()
                cells = dict(zip([f.name for f in flat.type], flat.flatten())) | {"part": pa.array(parts, pa.int32()), "ids": pa.array(ids, pa.binary())}
                yield pa.RecordBatch.from_arrays([cells[c] for c in names], names)

    return spark.read.schema(_columns(id_type)).parquet(path).select("part", "docs", "frame").mapInArrow(run, out)


def _times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


_MOVES = [[0xEDB88320, *[1 << i for i in range(31)]]]  # matrices of 1, 2, 4 ... zero bits


def join_crc(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two byte runs laid end to end, from their own: the first is moved on by as
    many zero bytes as the second has.  The matrix of one zero bit is squared once for all."""
    bits, power = second_bytes * 8, 0
    while bits:
        while power >= len(_MOVES):
            _MOVES.append([_times(_MOVES[-1], m) for m in _MOVES[-1]])
        if bits & 1:
            first = _times(_MOVES[power], first)
        bits, power = bits >> 1, power + 1
    return first ^ second


def documents(pieces: DataFrame, path: str) -> DataFrame:
    """Per document of :func:`read`: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32`` (of all its ids as little-endian unsigned 32-bit)."""

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return pd.Series([ids_crc(np.frombuffer(x, "<u2")) for x in ids], dtype="int64")

    @F.pandas_udf("long")
    def joined(runs: pd.Series) -> pd.Series:
        def one(own) -> int:
            value = own[0]["crc"]
            for r in own[1:]:
                value = join_crc(value, r["crc"], 4 * r["n"])
            return value

        return pd.Series([one(sorted(own, key=lambda r: r["skip"])) for own in runs], dtype="int64")

    blocks = pieces.sparkSession.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = blocks.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    run = F.struct("skip", crc("ids").alias("crc"), (F.octet_length("ids") / 2).cast("long").alias("n"))
    docs = pieces.withColumn("run", run).groupBy("part", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("at").alias("at"), F.first("n_tokens").alias("n_tokens"), F.collect_list("run").alias("runs")
    )
    return docs.join(parts, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", joined("runs").alias("ids_crc32"))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}"
