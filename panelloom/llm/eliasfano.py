"""Elias-Fano sequences and an n-gram trie of them, in flat levels that can be memory-mapped."""

from __future__ import annotations

from pathlib import Path

import numpy as np

_ONE, _SIX, _LOW6 = np.uint64(1), np.uint64(6), np.uint64(63)


def _packed_bits(positions: np.ndarray, length: int) -> np.ndarray:
    bits = np.zeros(-(-max(length, 1) // 64) * 64, np.uint8)
    bits[positions] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


#: Position of the r-th set bit of a byte, at 8 * byte + r.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64).ravel()
_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the set bit with ``rank`` set bits below it."""
    # Set bits up to and including each byte, then the number of bytes with at most ``rank``.
    sums = np.bitwise_count(np.ascontiguousarray(word).view(np.uint8)).view(np.uint64) * _BYTES
    rank = rank.astype(np.uint64)
    bytes_before = np.bitwise_count(((rank * _BYTES | _TOPS) - sums) & _TOPS).astype(np.uint64)
    shift = bytes_before * np.uint64(8)
    inside = rank - ((sums << np.uint64(8) >> shift) & np.uint64(255))
    return (shift + _IN_BYTE[(((word >> shift) & np.uint64(255)) << np.uint64(3) | inside).astype(np.int64)].astype(np.uint64)).astype(np.int64)


class EliasFano:
    """A sorted sequence of whole numbers: low bits packed, high parts in unary.

    About two bits and the low part for a number, besides half a bit of directory.
    """

    def __init__(self, upper: np.ndarray, ones: np.ndarray, low: np.ndarray, n: int, width: int):
        self.upper, self.ones, self.low, self.n, self.width = upper, ones, low, n, width

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        high = values.astype(np.int64) >> width
        upper = _packed_bits(high + np.arange(n), n + (top >> width) + 2)
        ones = np.zeros(len(upper) + 1, np.uint32 if n < 1 << 32 else np.uint64)
        np.cumsum(np.bitwise_count(upper), out=ones[1:])
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            part, at = values.astype(np.uint64) & np.uint64((1 << width) - 1), np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> _SIX).astype(np.int64), at & _LOW6
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(width) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return cls(upper, ones, low, n, width)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> _SIX).astype(np.int64), at & _LOW6
        value = self.low[word] >> shift
        over = shift + np.uint64(self.width) > np.uint64(64)
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return (value & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        before = self.ones.astype(np.int64)
        before = before if ones else np.arange(len(before)) * 64 - before
        word = np.searchsorted(before, rank, "right") - 1
        bits = self.upper[word]
        return word * 64 + _select_in_word(bits if ones else ~bits, rank - before[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        return (self._select(i, True) - i << self.width) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number that is at least ``x``, and whether it is ``x``."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        zeros = len(self.upper) * 64 - self.n
        high = np.minimum(x >> self.width, zeros - 1)
        wanted = np.where(x >> self.width > high, (1 << self.width) - 1, x & ((1 << self.width) - 1))
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1 - high, 0)
        stop = end = np.minimum(self._select(high, False) - high, self.n)
        begin, end = begin.copy(), end.copy()
        while (open_ := np.flatnonzero(begin < end)).size:
            middle = (begin[open_] + end[open_]) >> 1
            less = self._low(middle) < wanted[open_]
            begin[open_] = np.where(less, middle + 1, begin[open_])
            end[open_] = np.where(less, end[open_], middle)
        hit = begin < stop
        hit[hit] = self._low(begin[hit]) == wanted[hit]
        return begin, hit & (x >> self.width == high)


class Trie:
    """Counted n-grams of up to three words: level ``n`` has the last word of each n-gram.

    A node's children stand together; pointers to where they begin never fall.  Within a
    level each range of siblings is raised by the last number of the range before, so the
    level is one rising sequence, and a word is looked up by a successor search for that
    base plus the word.  Nodes of levels two and three carry a 16-bit code, 0 for a node
    that is only a beginning here.
    """

    def __init__(self, grams: np.ndarray, codes: np.ndarray):
        """``grams``: three columns of word numbers, sorted, distinct; -1 ends a shorter one."""
        one = np.flatnonzero(np.diff(grams[:, 0], prepend=-9) != 0)
        new_two = np.diff(grams[:, 1], prepend=-9) != 0
        new_two[one] = True
        two = np.flatnonzero(new_two)
        three = np.flatnonzero(grams[:, 2] >= 0)
        begin_two = np.append(np.searchsorted(two, one), len(two))
        begin_three = np.append(np.searchsorted(three, two), len(three))
        # A bigram's own row sorts first in its range (-1).
        self.codes = [np.where(grams[two, 2] < 0, codes[two], 0).astype(np.uint16), codes[three].astype(np.uint16)]
        self.first = EliasFano.build(grams[one, 0])
        self.begins = [EliasFano.build(begin_two), EliasFano.build(begin_three)]
        self.words = [EliasFano.build(_raised(grams[two, 1], begin_two)), EliasFano.build(_raised(grams[three, 2], begin_three))]

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The code of each n-gram (rows as in the builder, any order), 0 where there is none."""
        node, known = self.first.successor(grams[:, 0])
        out = np.zeros(len(grams), np.uint16)
        rows = np.flatnonzero(known)
        node = node[rows]
        for level, (begins, words, codes) in enumerate(zip(self.begins, self.words, self.codes, strict=True)):
            begin, end = begins.access(node), begins.access(node + 1)
            base = np.where(begin > 0, words.access(np.maximum(begin - 1, 0)) + 1, 0) if words.n else begin
            at, hit = words.successor(base + grams[rows, level + 1])
            hit &= at < end
            rows, node = rows[hit], at[hit]
            last = np.ones(len(rows), bool) if level else grams[rows, 2] < 0
            out[rows[last]] = codes[node[last]]
            rows, node = rows[~last], node[~last]
        return out

    def mapped(self, folder: str) -> Trie:
        """The same trie with its levels in files of ``folder``, mapped into memory."""
        count = iter(range(99))

        def moved(x: np.ndarray) -> np.ndarray:
            path = Path(folder, f"level-{next(count)}")
            x.tofile(path)
            return np.memmap(path, x.dtype, "r") if len(x) else x

        for part in (self.first, *self.begins, *self.words):
            part.upper, part.ones, part.low = moved(part.upper), moved(part.ones), moved(part.low)
        self.codes = [moved(x) for x in self.codes]
        return self


def _raised(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Words of sibling ranges as one rising sequence: each range starts above the one before.
    Ranges without words raise nothing."""
    begins = begins[:-1][np.diff(begins) > 0]
    if not len(words):
        return words
    last = words[np.append(begins[1:], len(words)) - 1]
    base = np.zeros(len(begins), np.int64)
    np.cumsum(last[:-1] + 1, out=base[1:])
    return words + np.repeat(base, np.diff(np.append(begins, len(words))))
