"""Texts as codes of distinct pieces, and lists of lists, in Arrow; used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def listed(strings: pa.Array) -> list:
    """As a list; much faster than ``to_pylist``."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def coded_pieces(texts: pa.Array, line_feed: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(pieces in each text, code of each piece, distinct pieces), texts cut at single spaces.

    Line feeds become ``line_feed`` before; a null is an empty text, which is one empty piece.
    """
    kind = pa.string() if texts.nbytes < 2**29 else pa.large_string()  # shorter offsets where they do
    parts = pc.split_pattern(pc.replace_substring(texts.cast(kind).fill_null(""), "\n", line_feed), " ")
    coded = parts.flatten().dictionary_encode()
    return np.diff(parts.offsets.to_numpy()).astype(np.int64), coded.indices.to_numpy(), coded.dictionary


def ragged(sizes: np.ndarray, flat: pa.Array | np.ndarray) -> pa.LargeListArray:
    """Lists of the given sizes, which follow one another in ``flat``."""
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])), pa.array(flat))


def nested(sizes: np.ndarray, items: pa.Array | np.ndarray, lists: pa.LargeListArray) -> pa.LargeListArray:
    """For each run of ``items`` (indices into ``lists``), their lists one after the other."""
    found = lists.take(pa.array(items))
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.LargeListArray.from_arrays(pa.array(found.offsets.to_numpy()[ends]), found.values)


def stepped(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``step`` bytes of text, the second column."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if size >= step:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
