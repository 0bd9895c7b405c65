"""Periodic runs of words, by catching squares while words are appended.

Texts of a batch form one stream of word numbers, closed by a mark of its own after each
text.  Level ``k`` keeps a catcher for every completed block of ``2**k`` words, at multiples
of ``2**k``.  A square of period ``q`` with ``2**(k+1) - 1 <= q <= 2**(k+2) - 2`` holds such a
block in its first half, so the block comes again ``q`` words later: each appended word ends
one window of ``2**k`` words, and at most two catchers lie at a distance of the level.  The
window is compared with both; a hit is a square in the making.  Hits of one period on
neighbouring blocks merge; the ends are found by halving steps, and what reaches the least
length is a run.  Work is words x levels, memory eight bytes for each.  Windows are compared
by 64-bit hashes, and each run is confirmed word by word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from panelloom.llm.wordsplit import slices, split

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _caught(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of every window that equals one of its two catchers."""
    least = (2 << level) - 1
    if len(hashes) <= least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    window = np.arange(least, len(hashes))
    block = (window - least) >> level << level
    one = np.flatnonzero(hashes[least:] == hashes[block])
    block -= 1 << level
    two = np.flatnonzero((hashes[least:] == hashes[block]) & (block >= 0))
    starts = np.concatenate([block[one] + (1 << level), block[two]])
    return starts, np.concatenate([window[one], window[two]]) - starts


def _stretches(levels: list[np.ndarray], level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, q) of all largest stretches in which words equal those q later, caught on a level."""
    starts, q = _caught(levels[level], level)
    order = np.lexsort((starts, q))
    starts, q = starts[order], q[order]
    begins = np.ones(len(starts), bool)
    begins[1:] = (q[1:] != q[:-1]) | (starts[1:] != starts[:-1] + (1 << level))
    heads = np.flatnonzero(begins)
    tails = np.append(heads[1:], len(starts))[: len(heads)] - 1
    left, right, q = starts[heads].copy(), starts[tails] + (1 << level), q[heads]
    for j in range(level - 1, -1, -1):
        hashes, step = levels[j], 1 << j
        at = np.maximum(left - step, 0)
        left -= np.where((left >= step) & (hashes[at] == hashes[at + q]), step, 0)
        fits = right + q < len(hashes)
        at = np.where(fits, right, 0)
        right += np.where(fits & (hashes[at] == hashes[np.minimum(at + q, len(hashes) - 1)]), step, 0)
    return left, right, q


def find_runs(words: np.ndarray, borders: np.ndarray, least_length: int = 6, least_power: int = 4) -> np.ndarray:
    """Rows (text, start, end, period) of all runs, ordered by text, start and period.

    A run is a stretch with smallest period ``q`` and at least ``max(least_length,
    least_power * q)`` words that no neighbouring word extends.  ``words`` are numbers that
    are equal where words are; text ``i`` spans ``borders[i]:borders[i + 1]``.
    """
    sizes = np.diff(borders)
    longest_first = np.argsort(-sizes, kind="stable")
    longest_first = longest_first[sizes[longest_first] >= least_length]
    if len(longest_first) == 0:
        return np.zeros((0, 4), np.int64)
    sizes = sizes[longest_first]
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    stream = np.full(at[-1], -1, np.int64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    stream[inside] = words[np.arange(int(sizes.sum())) + np.repeat(borders[longest_first] - (at[:-1] - np.arange(len(sizes))), sizes)]
    stream[~inside] = -1 - np.arange(len(sizes))
    for seed in count(1):
        found = _runs_of(stream, at, sizes, least_length, least_power, np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
        if found is not None:
            break
    text = np.searchsorted(at, found[:, 0], "right") - 1
    out = np.column_stack([longest_first[text], found[:, 0] - at[text], found[:, 1] - at[text], found[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _runs_of(stream, at, sizes, least_length, least_power, seed) -> np.ndarray | None:
    """(start, end, period) in the stream; None if a hash stood for unlike words."""
    levels, parts = [_mixed(stream.astype(np.uint64) + seed)], []
    for level in count():
        # Only texts that can hold a run of this level's periods; they stand first.
        texts = int(np.searchsorted(-sizes, -max(least_length, least_power * ((2 << level) - 1)), "right"))
        length = int(at[texts]) - (1 << level) + 1
        if texts == 0 or length <= 0:
            break
        if level:
            half, step = levels[-1], 1 << (level - 1)
            length = min(length, len(half) - step)
            levels.append(_mixed(half[:length] * np.uint64(0x9E3779B97F4A7C15) + (half[step : step + length] ^ (half[step : step + length] >> np.uint64(29)))))
        left, right, q = _stretches([x[: int(at[texts]) - (1 << j) + 1] for j, x in enumerate(levels)], level)
        enough = right - left + q >= np.maximum(least_length, least_power * q)
        parts.append(np.column_stack([left, right + q, q])[enough])
    found = np.concatenate(parts)
    # A stretch with a smaller period has multiples of it too; the least one is its period.
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    own = np.ones(len(found), bool)
    own[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[own]
    start, end, q = found.T
    pairs = end - q - start
    i = np.arange(int(pairs.sum())) + np.repeat(start - (np.cumsum(pairs) - pairs), pairs)
    same = (stream[i] == stream[i + np.repeat(q, pairs)]).all()
    before = np.maximum(start - 1, 0)
    ends = ((start == 0) | (stream[before] != stream[before + q])).all() and (stream[end] != stream[end - q]).all()
    return found if same and ends else None


def _repeating_tail(words: np.ndarray, borders: np.ndarray, doc_ids: list) -> np.ndarray:
    """Word numbers with the planted repetition: of one text in ten, by crc32 of its id, the
    words from a point on repeat the first of them.  A null id counts as the empty text."""
    out = words.copy()
    for i, doc_id in enumerate(doc_ids):
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        n = int(borders[i + 1] - borders[i])
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[borders[i] + a : borders[i + 1]] = words[borders[i] + a + np.arange(n - a) % p]
    return out


def _sha(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, most_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_runs``, the longest run (ties: least start, then
    period), hashes of the list of runs and of the text without repeats, and both themselves:
    ``runs`` (start, length, period) and ``collapsed``.

    A word is dropped from ``collapsed`` if any run holds it after the run's first period; the
    others are joined by one blank.  Null and empty texts have no runs and collapse to nothing;
    repeated rows and null ids are reported each; other columns are ignored; a text of any
    length is taken whole (a longer one than ``most_bytes`` is a batch of its own).  With
    ``plant`` one text in ten gets a repeating tail first.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", most_bytes):
            yield _reported(batch, plant, id_col)

    return docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).mapInArrow(each, schema)


def _reported(batch: pa.RecordBatch, plant: bool, id_col: str) -> pa.RecordBatch:
    words, borders = split(batch.column("_text"))
    coded = words.dictionary_encode()
    numbers, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.num_rows
    if plant:
        numbers = _repeating_tail(numbers, borders, batch.column("_id").to_pylist())
    runs = find_runs(numbers, borders)
    text, start, end, period = runs.T
    length = end - start
    # Words past the first period of a run are covered: +1 where that begins, -1 at the end.
    cover = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(cover, borders[text] + start + period, 1)
    np.add.at(cover, borders[text] + end, -1)
    kept = np.cumsum(cover[:-1]) == 0
    before = np.zeros(len(numbers) + 1, np.int64)
    np.cumsum(kept, out=before[1:])
    values = coded.dictionary.take(pa.array(numbers[kept]))
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(before[borders]), values), pa.scalar(" ", values.type))

    per_text = np.searchsorted(text, np.arange(n + 1))
    n_runs = np.diff(per_text)
    best = np.lexsort((period, start, -length, text))
    best = best[per_text[:-1][n_runs > 0]]
    longest = np.zeros((4, n), np.int64)
    longest[:, n_runs > 0] = start[best], length[best], period[best], 1000 * length[best] // period[best]
    none = _sha("")
    listed = [none] * n
    for i in np.flatnonzero(n_runs):
        rows = slice(per_text[i], per_text[i + 1])
        listed[i] = _sha("".join(f"{s},{m},{q}\n" for s, m, q in zip(start[rows], length[rows], period[rows], strict=True)))
    triples = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    columns = {
        id_col: batch.column("_id"),
        "n_runs": pa.array(n_runs),
        **{c: pa.array(x, mask=n_runs == 0) for c, x in zip(("start", "length", "period", "exponent_milli"), longest, strict=True)},
        "runs_sha256": pa.array(listed),
        "collapsed_sha256": pa.array([_sha(x) for x in collapsed.to_pylist()]),
        "runs": pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), triples),
        "collapsed": collapsed.cast(pa.string()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
