"""Words, shingles and hashes of a text, in numpy; used inside Spark tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from farpairs.llm.pieces import listed

# A-Z to lower case, ASCII white space to a space
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: Most words that a task remembers hashes of.
CACHE = 200_000
_K = np.uint64(0x9E3779B97F4A7C15)


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D), A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


class Hashes(dict):
    """64-bit hash of each word; forgets all when it holds ``CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(texts: pa.Array, table: bytes, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' words in order, words in each text); ``table`` maps bytes, all separators to a space."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]].tobytes().translate(table)
    mapped = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.array(ends - ends[0]).buffers()[1], pa.py_buffer(body)])
    parts = pc.split_pattern(mapped, b" ")
    coded = parts.flatten().dictionary_encode()
    words = listed(coded.dictionary)
    codes = coded.indices.to_numpy()
    kept = codes != words.index(b"") if b"" in words else np.ones(len(codes), bool)
    total = np.concatenate([[0], np.cumsum(kept)])
    return hashes.of(words)[codes[kept]], np.diff(total[parts.offsets.to_numpy()])


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words in order; of the whole if there are fewer; empty if none."""
    if not len(hashes):
        return hashes
    size = min(n, len(hashes))
    out = np.full(len(hashes) - size + 1, np.uint64(size))
    for i in range(size):
        out = mix(out * _K + hashes[i : len(hashes) - size + 1 + i])
    return out


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(shingles(hashes, n))


# A-Z to lower case; every other ASCII character but digits and letters to a space
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits (lower case) and of all other code points, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()
