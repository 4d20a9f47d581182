"""2. Benchmark decontamination.

For every length of a benchmark item, windows of that many words slide over each
document word by word. A window's five-word shingles make a 64-bit SimHash; windows
and items of equal length meet through a multi-index: five blocks of bits, items
entered under every value within 3 flips of each block. By the pigeonhole principle
all fingerprints within ``RADIUS`` (19) meet. Candidates are verified by the exact
weighted-shingle (Dice) similarity: a shingle weighs 1 + ln(items / items with it),
one that no item has weighs as much as the rarest.

Fingerprints beyond ``RADIUS`` can still reach the threshold (edited passages, items
with boilerplate), so such pairs meet by shingles. A similarity of t takes a common
weight of at least t / (2 - t) of the item's, so a window must hold one of the item's
heads: its rarest shingles, up to where the rest weighs less than that. No pair at or
above the threshold is lost.

Windows that cannot reach the threshold are skipped without loss: a bitmap of fixed
size holds every item shingle, alone and with its item's length. A document without
any item shingle has no windows to look at; a window needs so many hits for its
length that, even at the largest weight, the threshold can be met, and one hit in a
second bitmap, of the items' heads. Only shingles that some item has are looked up
for each length.

Defined results: null and empty texts, and items without words, match nothing;
items of under five words are one shingle; a document shorter than an item is one
window; repeated rows match alike; a null id gives a match with a null id (the
stage works by text, so such rows go too); empty tables give an empty result. Extra
columns pass through the stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpairs.llm.common import BROADCAST_IDS, fresh, materialize
from farpairs.llm.pieces import stepped
from farpairs.llm.words import PLAIN, Hashes, hashed_words, mix, plain_words, shingles
from farpairs.tables import table

SHINGLE, THRESHOLD = 5, 0.8
#: Blocks of the fingerprint: (shift, bits). Flips allowed in one, and radius guaranteed.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
FLIPS = 3
RADIUS = len(BLOCKS) * (FLIPS + 1) - 1
#: Bits of the bitmap that screens windows: fixed, however large the benchmark.
SCREEN = 24
#: Bytes of text that a task looks at together.
STEP = 4_000_000


def fingerprints(found: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of the shingles in each range [start, end)."""
    bits = np.unpackbits(mix(found).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    total = np.zeros((len(found) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    return np.packbits(total[ends] - total[starts] > 0, axis=1, bitorder="little").view(np.int64).ravel()


def near_keys(value: int, bits: int, flips: int = FLIPS) -> list[int]:
    """All values within ``flips`` bits of ``value``."""
    masks = [0]
    for k in range(1, flips + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(bits), k)]
    return [value ^ m for m in masks]


def _slot(found: np.ndarray, length: int) -> np.ndarray:
    """Bit of the screen of each shingle of an item of this length (0: of any item)."""
    return (mix(found ^ np.uint64(length * 0x9E3779B1)) >> np.uint64(64 - SCREEN)).astype(np.int64)


def indexed_items(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """(item_id, length, fp, shingles, slots) of each item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            out = []
            for i, x in zip(batch.column(0), batch.column(1)):
                own = hashes.of(plain_words(x.as_py()))
                if len(own):
                    found = shingles(own, SHINGLE)
                    fp = fingerprints(found, np.array([0]), np.array([len(found)]))[0]
                    out.append((i.as_py(), len(own), int(fp), found.view(np.int64).tolist(), [*_slot(found, 0).tolist(), *_slot(found, len(own)).tolist()]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())])], ["item_id", "length", "fp", "shingles", "slots"])

    narrow = items.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    return narrow.mapInArrow(run, "item_id long, length int, fp long, shingles array<long>, slots array<long>")


def with_heads(weighted: DataFrame, threshold: float) -> DataFrame:
    """(item_id, length, fp, heads, slots): shingles of which a window at the threshold holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for length, shingle, weight in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                own, first, n = np.unique(np.asarray(shingle, np.int64), return_index=True, return_counts=True)
                w = np.asarray(weight, np.float64)[first]
                order = np.lexsort((own, -w))
                before = np.concatenate([[0.0], np.cumsum((w * n)[order])])
                # the margin is for rounding; it can only lengthen the heads
                rest = before[-1] - before[:-1] >= (threshold / (2 - threshold) - 1e-9) * before[-1]
                heads = own[order][rest]
                out.append((heads.tolist(), _slot(heads.view(np.uint64), length).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, pa.list_(pa.int64())) for c in zip(*out)]], ["item_id", "length", "fp", "heads", "slots"])

    narrow = weighted.select("item_id", "length", "fp", "item_shingles", "item_weights")
    return narrow.mapInArrow(run, "item_id long, length int, fp long, heads array<long>, slots array<long>")


def bitmap(items: DataFrame) -> np.ndarray:
    """The bits ``slots`` of all items; at most 2^18 rows come back, whatever the benchmark's size."""
    bits = items.select(F.explode("slots").alias("b")).groupBy(F.shiftright("b", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("v")).collect()
    out = np.zeros(1 << (SCREEN - 6), np.int64)
    for r in bits:
        out[r["slot"]] = r["v"]
    return out.view(np.uint64)


def windows(docs: DataFrame, id_col: str, text: str, lengths: list[int], screen: np.ndarray, heads: np.ndarray, share: float) -> DataFrame:
    """(doc_id, start, length, fp, shingles, keys) of each window that may reach the threshold.

    ``keys`` are its distinct shingles that may be heads of an item of its length.
    """

    def held(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
        return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)

    def of_document(own: np.ndarray) -> Iterator[tuple[int, int, int, bytes, list[int]]]:
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in lengths:
            size = min(SHINGLE, length)
            if len(own) < size:
                continue
            if size not in by_size:
                found = shingles(own, size)
                by_size[size] = found, np.flatnonzero(held(screen, _slot(found, 0)))
            found, known = by_size[size]  # only shingles of some item can be of an item of this length
            m = min(length - size + 1, len(found))
            need = math.ceil(max(1.0, share * m - 1e-9))
            if len(known) < need:
                continue
            slot = _slot(found[known], length)
            hit = held(screen, slot) > 0
            at, slot = known[hit], slot[hit]
            if len(at) < need or (at[need - 1 :] - at[: len(at) - need + 1]).min() >= m:
                continue
            count = np.zeros(len(found) + 1, np.int64)
            count[at + 1] = 1
            total = np.cumsum(count)
            starts = np.flatnonzero(total[m:] - total[:-m] >= need)
            at = at[held(heads, slot) > 0]
            first, last = np.searchsorted(at, starts), np.searchsorted(at, starts + m)
            starts, first, last = starts[last > first], first[last > first], last[last > first]
            if len(starts):
                keys = found[at].view(np.int64)
                for s, fp, a, b in zip(starts.tolist(), fingerprints(found, starts, starts + m).tolist(), first.tolist(), last.tolist()):
                    yield s, length, fp, found[s : s + m].tobytes(), list(dict.fromkeys(keys[a:b].tolist()))

    def screened(own: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Texts that hold any item shingle, from the hashes of all words of many texts."""
        hit = np.zeros(len(ends), bool)
        for size in {min(SHINGLE, length) for length in lengths}:
            if len(own) >= size:
                at = np.flatnonzero(held(screen, _slot(shingles(own, size), 0)))
                of = np.searchsorted(ends, at, side="right")
                hit[of[at + size <= ends[of]]] = True  # no shingle over the end of a text
        return np.flatnonzero(hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in stepped(batches, STEP):
            own, counts = hashed_words(batch.column(1), PLAIN, hashes)
            ends = np.cumsum(counts)
            out = []
            for k in screened(own, ends).tolist():
                i = batch.column(0)[k].as_py()
                out += [(i, *w) for w in of_document(own[ends[k] - counts[k] : ends[k]])]
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    return narrow.mapInArrow(run, "doc_id long, start int, length int, fp long, shingles binary, keys array<long>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "start", "length", "fp", "shingles", "keys"])


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, hamming): each pair's best window."""
    spark = docs.sparkSession
    known = materialize(indexed_items(items, item_id, item_text))
    n_items = known.count()
    # shingle weights; the number of items is at least the number that hold a shingle
    held = known.select("item_id", F.explode("shingles").alias("s")).distinct().groupBy("s").agg(F.count("*").alias("df"))
    weights = known.select("item_id", "length", "fp", F.posexplode("shingles").alias("at", "s")).join(held, "s")
    weights = weights.withColumn("w", F.lit(1.0) + F.log(F.lit(float(max(n_items, 1))) / F.col("df")))
    weighted = materialize(weights.groupBy("item_id", "length", "fp").agg(F.array_sort(F.collect_list(F.struct("at", "s", "w"))).alias("x")).select("item_id", "length", "fp", F.transform("x", lambda e: e["s"]).alias("item_shingles"), F.transform("x", lambda e: e["w"]).alias("item_weights")))
    least = weighted.agg(F.min(F.array_min("item_weights"))).first()[0] or 1.0
    most = 1.0 + math.log(max(n_items, 1))
    lengths = [r["length"] for r in known.select("length").distinct().orderBy("length").collect()]
    headed = materialize(with_heads(weighted, threshold))
    met = materialize(windows(docs, id_col, text, lengths, bitmap(known), bitmap(headed), (threshold - 1e-9) * least / most))

    key = lambda fp, shift, n: F.shiftrightunsigned(fp, shift).bitwiseAND((1 << n) - 1)
    mine = met.withColumn("b", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), key(F.col("fp"), s, n).alias("key")) for k, (s, n) in enumerate(BLOCKS)])))
    def entered(k: int, shift: int, n: int):
        """The block's value of an item under every allowed flip."""
        flips = F.array(*[F.lit(m).cast("long") for m in near_keys(0, n)])
        return F.transform(flips, lambda m: F.struct(F.lit(k).alias("block"), key(F.col("item_fp"), shift, n).bitwiseXOR(m).alias("key")))

    theirs = known.select("item_id", "length", F.col("fp").alias("item_fp"))
    theirs = theirs.withColumn("b", F.explode(F.flatten(F.array(*[entered(k, s, n) for k, (s, n) in enumerate(BLOCKS)]))))
    mine = mine.select("doc_id", "start", "length", "fp", "shingles", F.col("b.block").alias("block"), F.col("b.key").alias("key"))
    theirs = theirs.select("item_id", "length", "item_fp", F.col("b.block").alias("block"), F.col("b.key").alias("key"))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair that meets in several blocks is taken in the first
    earlier = F.lit(True)
    for k, (s, n) in enumerate(BLOCKS):
        earlier &= (F.col("block") <= k) | (F.bit_count(key(differ, s, n)) > FLIPS)
    # packed for the exchange the items look small, but as a table of the driver they are not
    pairs = mine.join(theirs.hint("shuffle_hash"), ["length", "block", "key"]).where(earlier & (F.bit_count(differ) <= RADIUS))
    pairs = pairs.select("doc_id", "start", "length", "shingles", "item_id", F.bit_count(differ).alias("hamming"))
    # the pairs that the fingerprints cannot bring together; one of several common heads counts
    held_by = headed.select("item_id", "length", F.col("fp").alias("item_fp"), "heads", F.explode("heads").alias("head"))
    beyond = met.select("doc_id", "start", "length", "fp", "shingles", "keys", F.explode("keys").alias("head")).join(held_by, ["length", "head"])
    beyond = beyond.where((F.bit_count(differ) > RADIUS) & (F.col("head") == F.array_intersect("keys", "heads")[0]))
    pairs = pairs.unionByName(beyond.select("doc_id", "start", "length", "shingles", "item_id", F.bit_count(differ).alias("hamming")))

    @F.pandas_udf("double")
    def similarity(window: pd.Series, item: pd.Series, weight: pd.Series) -> pd.Series:
        out = []
        for a, b, w in zip(window, item, weight):
            a, ca = np.unique(np.frombuffer(a, np.int64), return_counts=True)
            b, first, cb = np.unique(np.asarray(b, np.int64), return_index=True, return_counts=True)
            w = np.asarray(w, np.float64)[first]
            _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            wa = np.full(len(a), most)
            wa[i] = w[j]
            out.append(2 * float((w[j] * np.minimum(ca[i], cb[j])).sum()) / float((wa * ca).sum() + (w * cb).sum()))
        return pd.Series(out, dtype="float64")

    checked = pairs.join(weighted.select("item_id", "item_shingles", "item_weights"), "item_id").select("doc_id", "item_id", "start", "length", "hamming", similarity("shingles", "item_shingles", "item_weights").alias("similarity"))
    best = checked.where(F.round("similarity", 9) >= threshold).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("at"), "length", "hamming")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.at")).cast("int").alias("start"), F.col("m.length").alias("n_words"), F.round("m.similarity", 9).alias("similarity"), F.col("m.hamming").alias("hamming"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go. Works by text, not by id."""
    key = fresh("__text", docs.columns)
    keyed = docs.select(F.xxhash64("text").alias(key), "text")
    found = materialize(leaks(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct())
    few = found.count() <= BROADCAST_IDS
    return docs.withColumn(key, F.xxhash64("text")).join(F.broadcast(found) if few else found, key, "left_anti").drop(key)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
