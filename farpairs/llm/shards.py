"""8. Sharding by histogram sort.

Rows are ordered by a 120-bit key: 60 bits of the text's md5, then 60 bits of the
id's. Equal texts are neighbours, so they share a shard unless a splitter falls into
their group: one that is larger than the tolerance is then cut, so that sizes stay even. To find the splitters, exact bytes are counted below equally spaced key
boundaries over all partitions; each splitter's interval is then refined (4096
boundaries a round) until the bytes below a boundary are within ``tolerance`` of
an even share, or the key's bits are used up. Only these few counts reach the
driver. Rows are then exchanged once, by the splitters found, and numbered.

Law `bytes`: shard sizes are equal up to the tolerance and one row (rows can't be
split). Defined results: a null text has no bytes, a null id is the text "null";
repeated rows are placed one by one; an empty table gives an empty result; with
ties in the whole key all tied rows stay together. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farpairs.llm.common import fresh, materialize, partitions, shared_dir
from farpairs.tables import table

SHARDS = 24
#: Bits that one round refines, bits of each half of the key.
STEP, HALF = 12, 60
#: Allowed distance of a splitter from its even place, as a share of one shard.
TOLERANCE = 0.002


def _bits(text: Column) -> Column:
    """The first 60 bits of the md5, not negative."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, k1, k2): what the sort needs of each row."""
    t = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    i = F.col(f"`{id_col}`")
    return docs.select(
        i.alias("doc_id"),
        (F.length(t) + 8).cast("long").alias("size"),
        F.crc32(t).alias("text_crc32"),
        _bits(t).alias("k1"),
        _bits(F.coalesce(i.cast("string"), F.lit("null")).cast("binary")).alias("k2"),
    )


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """``shards - 1`` keys (k1, k2) in ascending order: shard s ends before the s-th.

    Each open splitter keeps an interval (a prefix of the key) and the exact bytes
    below it. A round counts the bytes of its 4096 parts and takes the boundary
    nearest the target, or goes into the part that holds the target.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    aims = [total * s / shards for s in range(1, shards)]
    done: dict[int, tuple[int, int]] = {}
    # splitter -> (prefix of k1 and k2, bits of the prefix, bytes below it)
    at = {s: (0, 0, 0) for s in range(shards - 1)}
    close = tolerance * total / shards
    depth = 0
    while at and depth < 2 * HALF:
        first, shift = depth < HALF, (HALF - depth % HALF - STEP)
        key = F.col("k1") if first else F.col("k2")
        part = F.shiftright(key, shift).bitwiseAND((1 << STEP) - 1)
        up = F.shiftright(key, shift + STEP) if shift + STEP < HALF else F.lit(0).cast("long")
        wanted = sorted({(p1, p2) for p1, p2, _ in at.values()})
        head = (F.col("p1") == up) if first else ((F.col("p1") == F.col("k1")) & (F.col("p2") == up))
        prefixes = rows.sparkSession.createDataFrame(wanted, "p1 long, p2 long")
        counts = rows.join(F.broadcast(prefixes), head).groupBy("p1", "p2", part.alias("part")).agg(F.sum("size").alias("size")).collect()
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in sorted(counts, key=lambda r: r["part"]):
            by.setdefault((r["p1"], r["p2"]), []).append((r["part"], r["size"]))
        for s, (p1, p2, below) in list(at.items()):
            aim, start = aims[s], below
            inside = None
            best = (abs(start - aim), 0)
            for k, n in by.get((p1, p2), []):
                if start <= aim < start + n:
                    inside = (k, start)
                best = min(best, (abs(start - aim), k), (abs(start + n - aim), k + 1))
                start += n
            last = depth + STEP >= 2 * HALF
            if best[0] <= close or inside is None or last:
                done[s] = _key(p1, p2, best[1], first, shift)
                del at[s]
            else:
                k = inside[0]
                at[s] = ((p1 << STEP) | k, 0, inside[1]) if first else (p1, (p2 << STEP) | k, inside[1])
        depth += STEP
    return [done[s] for s in range(shards - 1)]


def _key(p1: int, p2: int, part: int, first: bool, shift: int) -> tuple[int, int]:
    """The least key of a part below a prefix."""
    if first:
        return (((p1 << STEP) + part) << shift, 0)
    k2 = ((p2 << STEP) + part) << shift
    return (p1, k2) if k2 < 1 << HALF else (p1 + 1, 0)


def shard_of(splits: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below the row's key."""
    places = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in splits])
    below = F.filter(places, lambda p: (p["a"] < F.col("k1")) | ((p["a"] == F.col("k1")) & (p["b"] <= F.col("k2"))))
    return F.size(below).cast("int") if splits else F.lit(0)


def exchanged(rows: DataFrame, splits: list[tuple[int, int]], shards: int) -> DataFrame:
    """``rows`` (k1, k2, ...) with shard and part, exchanged once by the splitters and sorted by key within parts.

    A shard is one or more parts, as many as fill the session's shuffle partitions: even
    intervals of its keys, which are hashes. Part p goes to partition p.
    """
    each = max(1, -(-partitions(rows.sparkSession) // shards))
    edges = [(0, 0), *splits, (1 << HALF, 0)]
    at = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard") + 1)
    # a shard within one text is cut by the ids' hashes instead
    alone = [lo[0] == hi[0] for lo, hi in zip(edges, edges[1:])]
    low = at([lo[1] if one else lo[0] for one, lo in zip(alone, edges)])
    span = at([max(1, hi[1] - lo[1] if one else hi[0] - lo[0]) for one, lo, hi in zip(alone, edges, edges[1:])])
    key = F.when(at([int(one) for one in alone]) == 1, F.col("k2")).otherwise(F.col("k1"))
    inner = F.least(F.floor((key - low) / span * each), F.lit(each - 1))
    placed = rows.withColumn("shard", shard_of(splits)).withColumn("part", (F.col("shard") * each + inner).cast("int"))
    return placed.repartitionById(shards * each, F.col("part")).sortWithinPartitions("part", "k1", "k2")


def assign(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), slots gapless from 0 within each shard.

    The narrow rows are exchanged once by the splitters; a slot is the row's place in its
    part plus the rows of its shard in earlier parts.
    """
    rows = materialize(sized(docs, id_col, text))
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = exchanged(rows, splitters(rows, shards, tolerance), shards)
    dealt = materialize(dealt.select("doc_id", "size", "text_crc32", "shard", "part", local.alias("row")))
    starts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    starts = starts.withColumn("before", F.expr("coalesce(sum(n) over (partition by shard order by part rows between unbounded preceding and 1 preceding), 0)"))
    starts = materialize(starts.select("shard", "part", "first", "before"))
    return dealt.join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first") + F.col("before")).alias("slot"))


def write_shards(docs: DataFrame, shards: int = SHARDS, *, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> str:
    """Write whole rows below ``path`` in folders __shard=0 ... in one exchange; returns the path."""
    path = path or shared_dir(docs.sparkSession)
    splits = splitters(materialize(sized(docs, id_col, text)), shards)
    t = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _bits(t).alias("k1"), _bits(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).cast("binary")).alias("k2"))
    name = fresh("__shard", docs.columns)
    exchanged(keyed, splits, shards).select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return path


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
