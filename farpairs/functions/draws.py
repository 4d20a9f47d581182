"""Seeded draws in numpy: the first 12 hex digits of the md5 of a text with two numbers behind it, many at a time."""

from __future__ import annotations

import math

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_AT = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_WORD = 2**32 - 1

#: Hashes made at a time: what they take stays in a core's cache.
CHUNK = 32768


def _block(state: list, words: list, shape: tuple) -> list:
    """One step of md5 in place; words are ints where all messages agree, else arrays of uint32 that broadcast."""
    a, b, c, d = (np.array(np.broadcast_to(x, shape)) for x in state)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        k = i // 16
        if k == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif k == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif k == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        w = words[_AT[k](i)]
        np.add(a, f, out=a)
        if isinstance(w, int):
            np.add(a, np.uint32((_K[i] + w) & _WORD), out=a)
        else:
            np.add(a, w, out=a)
            np.add(a, np.uint32(_K[i]), out=a)
        s = _TURNS[k][i % 4]
        np.left_shift(a, np.uint32(s), out=g)
        np.right_shift(a, np.uint32(32 - s), out=a)
        np.bitwise_or(a, g, out=a)
        np.add(a, b, out=a)
        a, d, c, b = d, c, b, a
    return [p + q for p, q in zip(state, (a, b, c, d))]


def _digits(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The decimal digits of numbers of one length as signs."""
    return [((x // 10**k) % 10 + 48).astype(np.uint32) for k in reversed(range(size))]


def numbers(head: bytes, draws: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """uint64 (draws, slots): the first 48 bits of md5(head, draw, "|", slot); the draws, and the slots, have one length each."""
    own = _digits(draws[:, None], len(str(draws[0]))), _digits(slots[None, :], len(str(slots[0])))
    signs = [*head, *own[0], ord("|"), *own[1]]
    bits = 8 * len(signs)
    signs += [0x80, *[0] * (-(len(signs) + 9) % 64), *bits.to_bytes(8, "little")]
    state: list = [np.full((1, 1), x, np.uint32) for x in _START]
    for at in range(0, len(signs), 64):
        words: list = []
        for k in range(at, at + 64, 4):
            four = signs[k : k + 4]
            known = sum(x << 8 * j for j, x in enumerate(four) if isinstance(x, int))
            moved = [x << np.uint32(8 * j) for j, x in enumerate(four) if not isinstance(x, int)]
            words.append(sum(moved[1:], moved[0]) + np.uint32(known) if moved else known)
        state = _block(state, words, (len(draws), len(slots)))
    first, second = (x.byteswap().astype(np.uint64) for x in state[:2])
    return (first << np.uint64(16)) | (second >> np.uint64(16))


def _by_length(low: int, high: int) -> list[np.ndarray]:
    """The numbers from ``low`` to before ``high``, cut where they get a digit more."""
    cuts = [low, *[10**k for k in range(1, 19) if low < 10**k < high], high]
    return [np.arange(a, b, dtype=np.int64) for a, b in zip(cuts, cuts[1:]) if a < b]


def resampled(head: bytes, flags: np.ndarray, low: int, high: int) -> np.ndarray:
    """How many flags each of the draws from ``low`` to before ``high`` picks, by as many picks as there are flags."""
    n = len(flags)
    hits = np.zeros(high - low, np.int64)
    with np.errstate(over="ignore"):
        for slots in _by_length(0, n):
            for at in range(0, len(slots), CHUNK):
                some = slots[at : at + CHUNK]
                each = max(1, CHUNK // len(some))
                for draws in _by_length(low, high):
                    for k in range(0, len(draws), each):
                        own = draws[k : k + each]
                        picked = (numbers(head, own, some) % np.uint64(n)).astype(np.int64)
                        hits[own - low] += flags[picked].sum(axis=1, dtype=np.int64)
    return hits
