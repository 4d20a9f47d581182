"""Elias-Fano coded non-decreasing sequences over bytes (or a memory map of them)."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<QQQQ"
#: Words of 64 bits in a block of the directory.
BLOCK = 8


def encode(values: np.ndarray, universe: int) -> bytes:
    """Low bits packed, high bits in unary, and the count of zeros before each block."""
    n = len(values)
    v = values.astype(np.uint64)
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    if low:
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        lows = np.packbits(bits.ravel(), bitorder="little")
    else:
        lows = np.zeros(0, np.uint8)
    lows = np.concatenate([lows, np.zeros(16 + -len(lows) % 8, np.uint8)])
    high = (v >> np.uint64(low)).astype(np.int64)
    size = n + (universe >> low) + 2
    size += -size % (64 * BLOCK)
    unary = np.zeros(size, bool)
    unary[high + np.arange(n)] = True
    words = np.packbits(unary, bitorder="little").view("<u8")
    ones = np.bitwise_count(words).astype(np.int64).reshape(-1, BLOCK).sum(axis=1)
    zeros = np.concatenate([[0], np.cumsum(64 * BLOCK - ones)]).astype("<i8")
    return struct.pack(_HEAD, n, low, len(lows), len(words)) + lows.tobytes() + words.tobytes() + zeros.tobytes()


class EliasFano:
    """Reads what ``encode`` wrote, from place ``at`` of ``buffer``; ``end`` is the place after it."""

    def __init__(self, buffer, at: int = 0):
        self.n, self.low, lows, words = struct.unpack_from(_HEAD, buffer, at)
        at += struct.calcsize(_HEAD)
        # an 8-byte word at every byte: low parts start at any bit
        self.lows = np.ndarray((max(lows - 7, 0),), "<u8", buffer, at, (1,))
        at += lows
        self.words = np.frombuffer(buffer, "<u8", words, at)
        at += 8 * words
        self.zeros = np.frombuffer(buffer, "<i8", words // BLOCK + 1, at)
        self.end = at + 8 * (words // BLOCK + 1)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low
        return (self.lows[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low) - 1)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) of the unary part."""
        block = np.searchsorted(self.zeros, k, "right") - 1
        left = k - self.zeros[block]
        word = block * BLOCK
        for _ in range(BLOCK - 1):
            here = 64 - np.bitwise_count(self.words[word]).astype(np.int64)
            go = (left >= here) & (word < block * BLOCK + BLOCK - 1)
            # rows that stay add nothing more: their count stays below
            left = left - np.where(go, here, 0)
            word = word + go
            if not go.any():
                break
        bits, place = ~self.words[word], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            go = left >= here
            left = left - np.where(go, here, 0)
            bits = np.where(go, bits >> np.uint64(width), bits)
            place += np.where(go, width, 0)
        return word * 64 + place

    def values(self) -> np.ndarray:
        """All values, decoded."""
        ones = np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((ones - i).astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i`` (few): by the run of ones, found over the directory."""
        ones = np.arange(len(self.zeros)) * (64 * BLOCK) - self.zeros
        block = np.searchsorted(ones, i, "right") - 1
        out = np.empty(len(i), np.uint64)
        for k, (b, x) in enumerate(zip(block.tolist(), np.asarray(i).tolist())):
            found = np.flatnonzero(np.unpackbits(self.words[b * BLOCK : b * BLOCK + BLOCK].view(np.uint8), bitorder="little"))
            out[k] = b * 64 * BLOCK + found[x - int(ones[b])] - x
        return (out << np.uint64(self.low)) | self._low(np.asarray(i, np.int64))

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For sorted ``x``, the first place whose value is at least x (n if none)."""
        x = x.astype(np.uint64)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64)
        if len(x) * 64 >= self.n:  # many queries: one pass over the decoded level is cheaper
            return np.searchsorted(self.values(), x)
        high = (x >> np.uint64(self.low)).astype(np.int64)
        low = x & np.uint64((1 << self.low) - 1)
        zeros = int(self.zeros[-1])
        beyond = high >= zeros
        high = np.minimum(high, zeros - 1)
        first = np.where(high > 0, self._select0(np.maximum(high - 1, 0)) - (high - 1), 0)
        last = np.minimum(self._select0(high) - high, self.n)
        while (open_ := first < last).any():  # among the values with the same high bits
            mid = (first + last) >> 1
            less = open_ & (self._low(np.minimum(mid, self.n - 1)) < low)
            first = np.where(less, mid + 1, first)
            last = np.where(open_ & ~less, mid, last)
        return np.where(beyond, self.n, first)

    def find(self, x: np.ndarray) -> np.ndarray:
        """For sorted ``x``, the place of an equal value, else -1."""
        p = self.successor(x)
        if not len(p):
            return p
        near = np.minimum(p, max(self.n - 1, 0))
        if not self.n:
            return np.full(len(p), -1)
        if len(x) * 64 >= self.n:
            same = self.values()[near] == x.astype(np.uint64)
        else:
            # successor() ended within x's own high part exactly if that part's next value is x
            high = (x.astype(np.uint64) >> np.uint64(self.low)).astype(np.int64)
            bit = near + high
            bit = np.minimum(bit, len(self.words) * 64 - 1)
            here = (self.words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)
            same = (here == 1) & (self._low(near) == (x.astype(np.uint64) & np.uint64((1 << self.low) - 1)))
        return np.where((p < self.n) & same, p, -1)
