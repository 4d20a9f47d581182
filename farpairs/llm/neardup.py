"""4. MinHash near-dedup with sequential Bayesian verification.

1. One pass over the texts gives each row its shingle-set size, a hash of the set
   and a signature of ``ROWS * BANDS`` minima. Rows with equal sets form a class;
   the least id stands for it.
2. Representatives that share a band meet in a bucket. In each bucket only one
   pivot (the least id) is compared with the others, so a bucket of g texts makes
   g - 1 pairs. Pairs whose sizes differ too much to reach the threshold go, and pairs
   whose sets' bitmaps do: two sets differ at least in as many shingles as their bitmaps
   in bits. Both bounds are exact.
3. A pair's signatures are compared batch by batch; it is dropped as soon as the
   posterior probability (uniform prior) that its similarity reaches the threshold
   falls below ``MISS``. The first batch holds two bits of each minimum and is part
   of the join's condition, so pruned pairs never become rows; then whole minima are
   compared. Survivors are verified on their full sets.
4. Verified links form components. Buckets that still hold more than one component
   are worked on in rounds. In each round more members act as pivots against the
   members of other components, until all pairs across components have been compared or the
   bucket is one component. So no link that banding offers is lost, and linked groups
   never make all their pairs.

Banding offers a pair of similarity s with probability 1-(1-s^6)^40: a pair at
exactly 0.8 is missed at 5e-6, at 0.9 below 1e-13.

Defined results: null, empty and white-space texts have an empty set and no links;
fewer words than a shingle make one shingle; repeated rows get the same component;
a row with a null id has no links, a null component and is kept; an empty table
gives an empty result. Extra columns pass through the stage and are ignored by the
query. Long texts cost time in proportion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpairs.llm.common import BROADCAST_IDS, connected_components, fresh, materialize, semi_join
from farpairs.llm.pieces import stepped
from farpairs.llm.words import LOWER, Hashes, hashed_words, lower_words, shingle_set
from farpairs.tables import table

ROWS, BANDS = 6, 40
#: Signature positions that one step of the sequential test compares.
BATCH = 60
#: Chosen probability, per step, of dropping a pair that reaches the threshold.
MISS = 1e-6
PERCENT = 80
#: Expected pivots of a bucket in the first round after the stars; doubles each round.
PIVOTS = 1024
#: Minima of which two bits lie in each of the longs that a join's condition compares. Few
#: longs, none of them nullable, keep the join's code within what the JVM compiles.
PAIRS = 30
#: Shingles that are hashed together, and bytes of text that a task looks at together.
CACHED, STEP = 16_384, 3_000_000


def _family(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(seed)
    n = ROWS * BANDS
    return (r.randint(0, 2**32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32), r.randint(0, 2**32, n, dtype=np.uint64).astype(np.uint32)


_A, _B = _family()


def minima(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of the shingles from each start to the next: minima of ``ROWS * BANDS`` hash functions, a row each."""
    out = np.empty((len(starts), len(_A)), np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    ends = np.append(starts[1:], len(short))
    k = 0
    while k < len(starts):  # as many sets at a time as stay in cache
        n = max(k + 1, int(np.searchsorted(ends, starts[k] + CACHED, side="right")))
        part, at = short[starts[k] : ends[n - 1]], starts[k:n] - starts[k]
        for j, (x, y) in enumerate(zip(_A, _B)):
            out[k:n, j] = np.minimum.reduceat(part * x + y, at)
        k = n
    return out


def least_matches(percent: int = PERCENT, miss: float = MISS) -> dict[int, int]:
    """After n compared positions: fewest matches with P(similarity >= threshold) >= miss."""
    t = percent / 100
    out = {}
    for n in range(BATCH, ROWS * BANDS + 1, BATCH):
        below, m = (1 - t) ** (n + 1), 0  # P(Bin(n+1, t) <= m), the posterior of m matches
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def sketch(sigs: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, ``PAIRS`` to a long; a row for each signature."""
    bits = ((sigs >> np.uint32(9)) & np.uint32(3)).astype(np.int64).reshape(len(sigs), len(_A) // PAIRS, PAIRS)
    return (bits << (2 * np.arange(PAIRS, dtype=np.int64))).sum(axis=2)


def least_equal(percent: int = PERCENT, miss: float = MISS) -> int:
    """As ``least_matches`` for all pairs of bits, which agree with probability s + (1 - s) / 4."""
    s = (np.arange(4000) + 0.5) / 4000
    agree, over, n = s + (1 - s) / 4, s >= percent / 100, ROWS * BANDS
    for m in range(n + 1):
        log = m * np.log(agree) + (n - m) * np.log1p(-agree)
        w = np.exp(log - log.max())
        if w[over].sum() >= miss * w.sum():
            return m
    return n


def alike(percent: int):
    """The first batch of the sequential test, as a condition on two rows' sketches."""
    unlike = F.lit(0)
    for a, b in zip(_BITS, _OTHER):
        x = F.col(a).bitwiseXOR(F.col(b))
        unlike = unlike + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(int("01" * PAIRS, 2)))
    return unlike <= ROWS * BANDS - least_equal(percent)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bit for each shingle, at a place by its hash; a row of longs for each set."""
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    out = np.zeros((len(sets), len(_MAP)), np.uint64)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    np.bitwise_or.at(out, (of, (flat >> np.uint64(6)).astype(np.int64) & (len(_MAP) - 1)), np.uint64(1) << (flat & np.uint64(63)))
    return out.view(np.int64)


def never_null(*names: str) -> list:
    return [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names]


_BITS = [f"bits{k}" for k in range(ROWS * BANDS // PAIRS)]
_OTHER = [f"other_{b}" for b in _BITS]
#: Longs of a bitmap of a set's shingles.
_MAP = [f"map{k}" for k in range(16)]
_OTHER_MAP = [f"other_{m}" for m in _MAP]


def signatures(docs: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """(id, n_shingles, set_key, sig, bits...) for each row; null from set_key on for an empty set."""
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary()), *((b, pa.int64()) for b in [*_BITS, *_MAP])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in stepped(batches, STEP):
            own, counts = hashed_words(batch.column(1), LOWER, hashes)
            ends = np.cumsum(counts)
            sets = [shingle_set(own[e - c : e], shingle) for e, c in zip(ends.tolist(), counts.tolist())]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            some = np.flatnonzero(n)
            sigs = minima(np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum(n[some]) - n[some])
            keys: list[bytes | None] = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
            place = pa.array(np.where(n > 0, np.cumsum(n > 0) - 1, 0), pa.int64(), mask=n == 0)
            width = 4 * ROWS * BANDS
            sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(some), [None, pa.py_buffer(sigs.tobytes())]).cast(pa.binary())
            bits = np.concatenate([sketch(sigs), bitmaps(sets)[some]], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(keys, pa.binary()), sig.take(place), *(pa.array(bits[:, k]).take(place) for k in range(bits.shape[1]))], schema=schema)

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, n_shingles long, set_key binary, sig binary, " + ", ".join(f"{b} long" for b in [*_BITS, *_MAP]))


def probable(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those that the sequential test does not drop."""
    least = least_matches(percent)

    @F.pandas_udf("boolean")
    def survives(x: pd.Series, y: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(x), np.uint32).reshape(len(x), -1)
        b = np.frombuffer(b"".join(y), np.uint32).reshape(len(y), -1)
        alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
        for n, m in least.items():  # each batch is compared for the pairs still alive only
            matches[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(axis=1)
            alive = alive[matches[alive] >= m]
        out = np.zeros(len(x), bool)
        out[alive] = True
        return pd.Series(out)

    ends = pairs.select("a").union(pairs.select("b")).distinct()
    near = semi_join(sigs, ends, "id")
    left = near.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    right = near.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    return pairs.join(left, "b").join(right, "a").where(survives("sig_a", "sig_b")).select("a", "b")


def linked(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, own = Hashes(), None, None
        for batch in batches:
            a, b = [], []
            for i, j, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if i != last:
                    last, own = i, shingle_set(hashes.of(lower_words(x)), shingle)
                other = shingle_set(hashes.of(lower_words(y)), shingle)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    a.append(i)
                    b.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])

    ends = pairs.select("a").union(pairs.select("b")).distinct()
    near = materialize(semi_join(texts, ends, "id").dropDuplicates(["id"]))
    left = near.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    right = near.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "src long, dst long")


def components(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``."""
    found = materialize(signatures(docs, id_col, text, shingle))
    classes = materialize(found.where("n_shingles > 0 and id is not null").groupBy("set_key").agg(F.min("id").alias("rep")))
    if not found.where("n_shingles > 0 and id is not null").select("id", "set_key").distinct().groupBy("id").count().where("count > 1").isEmpty():
        return _by_row(docs, id_col, text, shingle, percent)
    sigs = semi_join(found.where("n_shingles > 0"), classes.select("rep"), "id")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    width = 4 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * width + 1, F.lit(width))))
    banded = materialize(sigs.select("id", "n_shingles", *_BITS, *_MAP, bands.alias("bands")))
    keys = F.explode("bands").alias("key")
    buckets = banded.select("id", keys).groupBy("key").agg(F.count("*").alias("g"), F.min("id").alias("pivot")).where("g > 1")
    members = materialize(banded.select("id", keys).join(buckets, "key").where("id <> pivot").select(F.col("pivot").alias("other"), "id", "g"))

    def tested(pairs: DataFrame) -> DataFrame:
        return materialize(linked(materialize(probable(pairs, sigs, percent)), texts, shingle, percent))

    # exact bounds first: sizes, and sets differ at least in as many shingles as their bitmaps in bits
    both, differ = F.col("n_shingles") + F.col("other_n"), F.lit(0)
    for x, y in zip(_MAP, _OTHER_MAP):
        differ = differ + F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    near = (100 * F.least("n_shingles", "other_n") >= percent * F.greatest("n_shingles", "other_n")) & (100 * (both - differ) >= percent * (both + differ)) & alike(percent)

    of_member = banded.select(*never_null("id", "n_shingles", *_BITS, *_MAP))
    of_other = of_member.toDF("other", "other_n", *_OTHER, *_OTHER_MAP)
    stars = members.select("other", "id").distinct().join(of_member, "id").join(of_other, "other")
    stars = materialize(stars.where(near).select(F.col("other").alias("a"), F.col("id").alias("b")))
    seen, edges = stars, tested(stars)
    comps = connected_components(edges)

    def mixed_only(rows: DataFrame, start: int) -> DataFrame:
        """Of ``rows`` (key, id, c), the buckets of more than one component, with their sizes ``g``."""
        of_key = rows.groupBy("key").agg(F.count("*").alias("g"), F.min("c").alias("low"), F.max("c").alias("high"))
        mixed = materialize(of_key.where(f"low < high and g > {start}").select("key", "g"))
        return materialize(rows.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_IDS else mixed, "key"))

    top = members.agg(F.max("g")).first()[0] or 0
    start, wide = 0, PIVOTS
    open_ = banded.select("id", keys)
    while start < top and top > 2:  # buckets of two are fully compared by their star
        named = open_.select("key", "id").join(comps, open_["id"] == comps["node"], "left").select("key", "id", F.coalesce("component", "id").alias("c"))
        open_ = mixed_only(named, max(2, start))
        if open_.isEmpty():
            break
        full = open_.join(of_member, "id").select(*never_null("key", "id", "c", "n_shingles", *_BITS, *_MAP), "g")
        place = F.pmod(F.xxhash64("id", "key"), F.col("g"))
        full = full.withColumn("pivot", (place >= start) & (place < start + wide))
        pivots = full.where("pivot").select("key", F.col("id").alias("other"), F.col("n_shingles").alias("other_n"), F.col("c").alias("other_c"), *[F.col(b).alias(o) for b, o in zip([*_BITS, *_MAP], [*_OTHER, *_OTHER_MAP])])
        # pruned within the join: only pairs that pass the first batches become rows
        met = full.join(pivots, (full["key"] == pivots["key"]) & (F.col("c") != F.col("other_c")) & (~F.col("pivot") | (F.col("id") < F.col("other"))) & near)
        pairs = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        pairs = materialize(pairs.join(seen, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            more = tested(pairs)
            if not more.isEmpty():
                edges = edges.union(more)
                comps = connected_components(edges)
            seen = seen.union(pairs)
        start, wide = start + wide, 2 * wide

    of_set = classes.join(comps, classes.rep == comps.node, "left").select("set_key", F.coalesce("component", "rep").alias("c"))
    out = found.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("set_key")).alias("set_key")).join(of_set, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _by_row(docs: DataFrame, id_col: str, text: str, shingle: int, percent: int) -> DataFrame:
    """``components`` where one id has several texts: run on an id for each (id, text) pair."""
    own, words = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`").cast("string")
    pair = F.md5(F.concat_ws("\0", own.cast("string"), words).cast("binary"))
    keyed = materialize(docs.select(own.alias("own"), words.alias("text"), F.when(own.isNotNull(), F.conv(F.substring(pair, 1, 15), 16, 10).cast("long")).alias("id")))
    found = components(keyed.where("id is not null").dropDuplicates(["id"]), id_col="id", text="text", shingle=shingle, percent=percent)
    found = materialize(found.join(keyed.select("id", "own").distinct(), "id"))
    least = found.groupBy("component_id").agg(F.min("own").alias("low"))
    named = found.join(least, "component_id").select("id", "n_shingles", "low")
    # an id is one node: what is linked to any of its texts is one component
    both = connected_components(found.join(least, "component_id").select(F.col("own").alias("src"), F.col("low").alias("dst")))
    named = named.join(both, named.low == both.node, "left").select("id", "n_shingles", F.coalesce("component", "low").alias("c"))
    out = keyed.select("own", "id", "text").where("id is not null").join(named, "id").select(F.col("own").alias("id"), "n_shingles", F.col("c").alias("component_id"), (F.col("own") == F.col("c")).alias("kept"))
    bare = signatures(keyed.where("id is null"), "id", "text", shingle).select("id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(bare)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document with the least id stays.

    Of repeated rows with one id the first by text stays; rows without an id stay.
    """
    judged = components(docs)
    gone = judged.where("not kept").select(F.col("id").alias("__gone")).distinct()
    rest = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    n = fresh("__n", docs.columns)
    repeated = judged.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("__id"))
    if repeated.isEmpty():
        return rest
    few = rest.join(repeated, rest["doc_id"] == repeated["__id"], "left_semi").withColumn(n, F.expr("row_number() over (partition by doc_id order by text)")).where(f"`{n}` = 1").drop(n)
    return rest.join(repeated, rest["doc_id"] == repeated["__id"], "left_anti").unionByName(few)


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), shingle=4).withColumnRenamed("id", "doc_id")
