"""Ranked lexical search (op12): norm buckets over impact vectors, exact integer scores.

A document's impact vector holds, for each term of the items, weight times saturated
frequency. Vectors are ordered by length and taken in buckets, longest first. An item is
a vector of ones, so Cauchy-Schwarz bounds its score in a bucket by the root of its
number of terms times the bucket's largest length: a bucket below the item's tenth best
score so far is left out. Inside a bucket the item's heaviest coordinates are read, and
the rest is bounded by what length they leave over. Survivors are scored again in 64-bit
integers. The first threshold of each item comes from the longest vectors of all
documents; it only spares work.

Items are taken in blocks of at most ``TERMS`` distinct terms, so that what tasks know of
them is bounded; every block runs against all documents.

Defined results: a null or empty text has no terms and is in no count; repeated rows are
documents (or items) each; a null doc_id comes after all others at equal scores; empty
tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farpairs.llm.common import materialize
from farpairs.llm.pieces import listed, ragged, stepped
from farpairs.llm.words import PLAIN, plain_words
from farpairs.tables import table

K = 10
#: Distinct terms of a block of items; bytes of text at a time; documents of a bucket; coordinates read first.
TERMS, STEP, BUCKET, FOCUS = 4096, 4 << 20, 1024, 6
#: Longest vectors of all that give the first thresholds.
SEED = 1000
_LAST = np.iinfo(np.int64).max


def blocks(items: DataFrame, terms: int = TERMS) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, term lists) of items with a term, in blocks; the driver holds one block at a time."""
    ids, lists, known = [], [], set()
    for i, text in items.toLocalIterator():
        own = sorted(set(plain_words(text)))
        if not own:
            continue
        if ids and len(known | set(own)) > terms:
            yield ids, lists
            ids, lists, known = [], [], set()
        ids.append(i)
        lists.append(own)
        known |= set(own)
    if ids:
        yield ids, lists


def term_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tf) of each document with a term: all terms counted, those of the vocabulary listed."""
    place = {w: k for k, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stepped(batches, STEP):
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            body = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]].tobytes().translate(PLAIN)
            parts = pc.split_pattern(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.array(ends - ends[0]).buffers()[1], pa.py_buffer(body)]), b" ")
            coded = parts.flatten().dictionary_encode()
            words, codes = listed(coded.dictionary), coded.indices.to_numpy()
            of = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
            at = np.array([-2 if w == b"" else place.get(w, -1) for w in words], np.int64)[codes] if words else np.zeros(0, np.int64)
            n = np.bincount(of[at > -2], minlength=len(texts))
            held, tf = np.unique(of[at >= 0] * len(place) + at[at >= 0], return_counts=True)
            sizes = np.bincount(held // max(1, len(place)), minlength=len(texts))
            kept = np.flatnonzero(n)
            if len(kept):
                lists = lambda flat: ragged(sizes[kept], flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(n[kept]), lists((held % max(1, len(place))).astype(np.int32)).cast(pa.list_(pa.int32())), lists(tf.astype(np.int32)).cast(pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def impacts(counts: DataFrame, weights: np.ndarray, n_docs: int, n_words: int) -> DataFrame:
    """(doc_id, norm, terms, impact): impact vectors of documents that hold a term of positive weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tf = batch.column(1).to_numpy(), batch.column(2), batch.column(3).flatten().to_numpy().astype(np.int64)
            sizes = np.diff(terms.offsets.to_numpy())
            # the product may pass 64 bits on long texts of a large collection
            m = np.array([10 + 90 * x * n_docs // n_words for x in n.tolist()], np.int64)
            of = np.repeat(np.arange(len(n)), sizes)
            term = terms.flatten().to_numpy()
            value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[of]))
            kept = np.flatnonzero(value)
            own = np.bincount(of[kept], minlength=len(n))
            norm = np.sqrt(np.bincount(of[kept], value[kept].astype(np.float64) ** 2, minlength=len(n)))
            rows = np.flatnonzero(own)
            if len(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(norm[rows]), ragged(own[rows], term[kept]).cast(pa.list_(pa.int32())), ragged(own[rows], value[kept]).cast(pa.list_(pa.int64()))], ["doc_id", "norm", "terms", "impact"])

    return counts.mapInArrow(run, "doc_id long, norm double, terms array<int>, impact array<long>")


class _Search:
    """One task's best documents of each item, bucket after bucket."""

    def __init__(self, lists: list[np.ndarray], weights: np.ndarray, first: np.ndarray, k: int):
        self.k, self.size = k, len(weights)
        # heaviest coordinates first
        self.lists = [x[np.argsort(-weights[x], kind="stable")] for x in lists]
        self.least = first.copy()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in lists]

    def batch(self, batch: pa.RecordBatch) -> None:
        ids = batch.column(0).fill_null(_LAST).to_numpy()
        norm, terms, values = batch.column(1).to_numpy(), batch.column(2), batch.column(3).flatten().to_numpy()
        starts = terms.offsets.to_numpy() - terms.offsets[0].as_py()
        term = terms.flatten().to_numpy()
        order = np.argsort(-norm, kind="stable")
        step = max(64, min(BUCKET, (4 << 20) // max(1, self.size)))
        for a in range(0, len(order), step):
            rows = order[a : a + step]
            dense = np.zeros((self.size, len(rows)))
            for k, r in enumerate(rows.tolist()):
                own = slice(starts[r], starts[r + 1])
                dense[term[own], k] = values[own]
            self.bucket(ids[rows], norm[rows], dense)

    def bucket(self, ids: np.ndarray, norm: np.ndarray, dense: np.ndarray) -> None:
        """``dense``: a row for each term; a value is an integer below 2^53."""
        over = 1 + 1e-9  # for the rounding of lengths
        for q, own in enumerate(self.lists):
            if math.sqrt(len(own)) * norm[0] * over < self.least[q]:
                continue
            focus = dense[own[:FOCUS]]
            # the length left over; the small share covers the cancellation
            left = np.sqrt(np.maximum(norm**2 - (focus**2).sum(0), 0) + 1e-12 * norm**2)
            bound = (focus.sum(0) + math.sqrt(max(0, len(own) - FOCUS)) * left) * over
            kept = np.flatnonzero(bound >= self.least[q])
            if not len(kept):
                continue
            score = dense[np.ix_(own, kept)].astype(np.int64).sum(0)
            some = (score > 0) & (score >= self.least[q])
            if not some.any():
                continue
            had = self.best[q]
            every, at = np.concatenate([had[0], score[some]]), np.concatenate([had[1], ids[kept[some]]])
            first = np.lexsort((at, -every))[: self.k]
            self.best[q] = every[first], at[first]
            if len(first) == self.k:
                self.least[q] = max(self.least[q], every[first[-1]])

    def rows(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.best]
        ids = np.concatenate([i for _, i in self.best])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sizes)), sizes)), pa.array(ids, mask=ids == _LAST), pa.array(np.concatenate([s for s, _ in self.best]))], ["item", "doc_id", "score"])


def best_documents(vectors: DataFrame, lists: list[np.ndarray], weights: np.ndarray, first: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best ``k`` of each item, none that the thresholds ``first`` exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(lists, weights, first, k)
        for batch in batches:
            search.batch(batch)
        yield search.rows()

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, *, k: int = K, terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = items.select(F.col("`item_id`").cast("long"), F.col("`text`").cast("string"))
    for ids, lists in blocks(asked, terms):
        vocabulary = sorted({w for x in lists for w in x})
        place = {w: i for i, w in enumerate(vocabulary)}
        own = [np.array([place[w] for w in x], np.int64) for x in lists]
        counts = materialize(term_counts(narrow, vocabulary))
        n_docs, n_words = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        vectors = materialize(impacts(counts, weights, n_docs, max(1, n_words)))
        longest = vectors.orderBy(F.desc("norm")).limit(SEED)
        first = np.zeros(len(ids), np.int64)
        seeds = best_documents(longest, own, weights, first, k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        for r in seeds.where(F.col("n") >= k).collect():  # a row for each item of the block
            first[r["item"]] = r["least"]
        found = best_documents(vectors, own, weights, first, k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        names = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
        top = found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "item")  # a row for each item of the block
        out = out.union(top.select("item_id", "rank", "doc_id", "score"))
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""with d as (select row_number() over () as row, doc_id, {_TERMS} as w from documents), i as (select row_number() over () as it, item_id, {_TERMS} as w from benchmark),
tf as (select row, term, count(*) as tf from (select row, unnest(w) as term from d) group by all), n as (select count(*) filter (where len(w) > 0) as big_n, cast(sum(len(w)) as bigint) as l from d),
wt as (select term, cast(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) as bigint) as wt from tf, n group by term, big_n),
asked as (select distinct it, item_id, unnest(w) as term from i),
s as (select it, item_id, row, cast(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * big_n) // l)))) as bigint) as score from asked join tf using (term) join wt using (term) join d using (row), n group by all),
r as (select item_id, doc_id, score, row_number() over (partition by it order by score desc, doc_id) as rk from s join d using (row) where score > 0)
select item_id, cast(rk as int) as "rank", doc_id, score from r where rk <= 10"""
