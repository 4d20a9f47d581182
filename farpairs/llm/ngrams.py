"""6. LM scoring with an Elias-Fano n-gram trie.

A bigram model with absolute discounting: p(w|v) = max(c(v,w) - D, 0) / c(v)
+ D * followers(v) / c(v) * p(w), where p(w) is the base probability
(c + 0.1) / (N + 0.1 * (V + 1)); after an unseen v it is p(w) itself. A text starts
after a start mark and ends with an end token.

Level 1 (words): their 63-bit hashes in order, Elias-Fano coded in files by hash
range, with counts; a word's id is its rank. Level 2 (pairs): segments by ranges of
the first word's id; a segment holds Elias-Fano pointers to each context's
followers, the followers themselves made monotone by their context's place, and for
each pair the smoothed probability as a 16-bit code. A query looks for its follower
by successor search within its context's range of values. Files are memory-mapped by
the tasks that score.

Counts cover all training rows: each task sums a block of texts, blocks are shuffled
by word or by segment, never by document. A segment's size is bounded by its share
of the contexts; a context by the vocabulary.

Defined results: a null or empty text is the end token only; a null id counts as
training; repeated rows count and are scored each; without training rows all words
are unknown (N = V = 0). Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpairs.llm.common import materialize, shared_dir
from farpairs.llm.eliasfano import EliasFano, encode
from farpairs.llm.files import opened, write_bytes
from farpairs.llm.words import Hashes, lower_words
from farpairs.tables import table

ALPHA, DISCOUNT = 0.1, 0.75
#: Steps of the 16-bit codes of -log10 probabilities.
STEP = 4096.0
#: Characters of text that a task sums or scores at a time.
BLOCK = 16_000_000
END = b""


def code(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log10(np.maximum(p, 1e-15)) * STEP), 65535).astype("<u2")


def decode(c: np.ndarray) -> np.ndarray:
    return 10.0 ** (-c.astype(np.float64) / STEP)


def mapped(uri: str):
    """The file's bytes: a memory map on a local or mounted file system, else read."""
    fs, path = opened(uri)
    if fs.type_name == "local":
        return np.memmap(path, np.uint8, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def blocks_of(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, hash arrays with the end token) of about ``size`` characters of texts at a time."""
    hashes = Hashes()
    ids, found, n = [], [], 0
    for batch in batches:
        for i, x in zip(batch.column(0), batch.column(1)):
            x = x.as_py() or ""
            own = hashes.of([*lower_words(x), END]) >> np.uint64(1)
            ids.append(i.as_py())
            found.append(own)
            n += len(x)
            if n >= size:
                yield ids, found
                ids, found, n = [], [], 0
    if ids:
        yield ids, found


class Words:
    """Level 1 over its files: ids and counts of word hashes."""

    def __init__(self, files: list[tuple[str, int, int]]):
        self.files, self.open = files, {}
        self.lows = np.array([low for _, low, _ in files], np.uint64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of sorted hashes; id -1 and count 0 if unknown."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(hashes, self.lows)
        for k, (name, _, base) in enumerate(self.files):
            a, b = cuts[k], cuts[k + 1] if k + 1 < len(cuts) else len(hashes)
            if a >= b:
                continue
            if k not in self.open:
                data = mapped(name)
                ef = EliasFano(data)
                self.open[k] = (ef, np.frombuffer(data, "<i8", ef.n, ef.end))
            ef, n = self.open[k]
            at = ef.find(hashes[a:b])
            ids[a:b] = np.where(at >= 0, at + base, -1)
            counts[a:b] = np.where(at >= 0, n[np.maximum(at, 0)], 0)
        return ids, counts


class Segment:
    """One file of level 2: contexts ``low`` up to ``high`` (ids; V is the start mark)."""

    def __init__(self, uri: str):
        data = mapped(uri)
        self.low, self.high, self.vocabulary = struct.unpack_from("<QQQ", data, 0)
        self.pointers = EliasFano(data, 24)
        self.followers = EliasFano(data, self.pointers.end)
        self.backoff = np.frombuffer(data, "<u2", self.high - self.low, self.followers.end)
        self.codes = np.frombuffer(data, "<u2", self.followers.n, self.followers.end + 2 * (self.high - self.low))

    @staticmethod
    def build(low: int, high: int, vocabulary: int, first: np.ndarray, second: np.ndarray, count: np.ndarray) -> bytes:
        """From pairs in order of (first, second)."""
        start = np.searchsorted(first, np.arange(low, high + 1))
        total = np.diff(np.concatenate([[0], np.cumsum(count)])[start])
        of = (first - low).astype(np.int64)
        kept = np.maximum(count - DISCOUNT, 1e-9) / total[of]
        rest = np.where(total > 0, DISCOUNT * np.diff(start) / np.maximum(total, 1), 1.0)
        values = of * (vocabulary + 1) + second
        return b"".join([struct.pack("<QQQ", low, high, vocabulary), encode(start, len(first)), encode(values, (high - low) * (vocabulary + 1)), np.where(total > 0, code(rest), 0).astype("<u2").tobytes(), code(kept).tobytes()])

    def look(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(discounted probability, backoff weight) of sorted pairs; second -1 is unknown."""
        own = first - self.low
        p = np.zeros(len(first))
        known = second >= 0
        at = self.followers.find(own[known] * (self.vocabulary + 1) + second[known])
        p[known] = np.where(at >= 0, decode(self.codes[np.maximum(at, 0)]) if self.followers.n else 0.0, 0.0)
        return p, decode(self.backoff[own])


def ids_of(words: Words, found: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous id, id, count) of every token; the previous of a first token is V, the start mark."""
    flat = np.concatenate(found)
    distinct, back = np.unique(flat, return_inverse=True)
    del flat
    ids, counts = words.find(distinct)
    token, n = ids[back], counts[back]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum([0, *map(len, found[:-1])])] = vocabulary
    return before, token, n


def train(docs: DataFrame, path: str) -> dict:
    """Write the trie of ``docs`` (id, text) below ``path``; returns where its levels are."""

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in blocks_of(batches):
            h, n = np.unique(np.concatenate(found), return_counts=True)
            for k in range(0, len(h), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + 50_000].astype(np.int64)), pa.array(n[k : k + 50_000].astype(np.int64))], ["h", "n"])

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)[0].as_py()) for b in batches if b.num_rows]
        if parts:
            h, n = np.concatenate([p[0] for p in parts]).astype(np.uint64), np.concatenate([p[1] for p in parts])
            name = f"{path}/{uuid.uuid4().hex}.words"
            write_bytes(name, [encode(h, 1 << 63), n.astype("<i8").tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([parts[0][2]], pa.int64()), pa.array([name]), pa.array([int(h[0])], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["part", "file", "low", "words", "tokens"])

    counted = docs.mapInArrow(count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    dealt = counted.repartitionByRange("h").sortWithinPartitions("h").withColumn("part", F.spark_partition_id().cast("long"))
    level1 = materialize(dealt.mapInArrow(write_words, "part long, file string, low long, words long, tokens long")).orderBy("part").collect()
    files, vocabulary = [], 0
    for r in level1:
        files.append((r["file"], r["low"], vocabulary))
        vocabulary += r["words"]
    tokens = sum(r["tokens"] for r in level1)
    segments = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = -(-(vocabulary + 1) // segments)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack = Words(files), zstandard.ZstdCompressor(level=1)
        for _, found in blocks_of(batches):
            before, token, _ = ids_of(words, found, vocabulary)
            pairs, n = np.unique(before * (vocabulary + 1) + token, return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(segments + 1) * width * (vocabulary + 1))
            for s in range(segments):
                a, b = cuts[s], cuts[s + 1]
                if a < b:
                    blob = pack.compress(np.diff(pairs[a:b], prepend=0).astype("<i8").tobytes() + n[a:b].astype("<i8").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([blob], pa.binary())], ["segment", "pairs"])

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def segment(s: int, blobs: list[bytes]) -> pa.RecordBatch:
            both = [np.frombuffer(unpack.decompress(b), "<i8").reshape(2, -1) for b in blobs]
            pairs, n = np.concatenate([np.cumsum(x[0]) for x in both]), np.concatenate([x[1] for x in both])
            pairs, back = np.unique(pairs, return_inverse=True)
            count = np.bincount(back, n, len(pairs))
            name = f"{path}/{uuid.uuid4().hex}.pairs"
            low, high = s * width, min((s + 1) * width, vocabulary + 1)
            write_bytes(name, [Segment.build(low, high, vocabulary, pairs // (vocabulary + 1), pairs % (vocabulary + 1), count)])
            return pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([name])], ["segment", "file"])

        last, blobs = None, []
        for batch in batches:
            for s, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if blobs and s != last:
                    yield segment(last, blobs)
                    blobs = []
                last = s
                blobs.append(b)
        if blobs:
            yield segment(last, blobs)

    routed = docs.mapInArrow(count_pairs, "segment long, pairs binary").repartition(segments, "segment").sortWithinPartitions("segment")
    level2 = materialize(routed.mapInArrow(write_pairs, "segment long, file string")).collect() if vocabulary else []
    return {"words": files, "vocabulary": vocabulary, "tokens": tokens, "width": width, "pairs": {r["segment"]: r["file"] for r in level2}}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each row of ``docs`` (id, text)."""
    vocabulary, tokens, width = model["vocabulary"], model["tokens"], model["width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, segments = Words(model["words"]), {}
        for ids, found in blocks_of(batches):
            before, token, n = ids_of(words, found, vocabulary)
            p = (n + ALPHA) / (tokens + ALPHA * (vocabulary + 1))
            kept, rest = np.zeros(len(token)), np.ones(len(token))
            seen = before >= 0
            pairs, back = np.unique(before[seen] * (vocabulary + 2) + token[seen] + 1, return_inverse=True)
            first, second = pairs // (vocabulary + 2), pairs % (vocabulary + 2) - 1
            a, b = np.zeros(len(pairs)), np.ones(len(pairs))
            which = first // width
            for s in np.unique(which).tolist():
                if s in model["pairs"]:
                    if s not in segments:
                        segments[s] = Segment(model["pairs"][s])
                    own = slice(*np.searchsorted(which, [s, s + 1]))
                    a[own], b[own] = segments[s].look(first[own], second[own])
            kept[seen], rest[seen] = a[back], b[back]
            del pairs, back, first, second, which, a, b, seen, before, token
            starts = np.cumsum([0, *map(len, found[:-1])])
            add = lambda x: np.add.reduceat(x, starts)
            lengths = np.array([len(x) for x in found], np.int64)
            cols = [pa.array(ids, pa.int64()), pa.array(lengths), pa.array(add((n > 0).astype(np.int64))), pa.array(add(np.log10(p))), pa.array(add(np.log10(kept + rest * p)))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")


def held_out(ids) -> "F.Column":
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    model = train(docs.where(~held_out(F.col("id"))), shared_dir(spark))
    out = score(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
