"""Shared small helpers: scratch tables, size-checked semi joins, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpairs.tables import shared_dir

#: Most ids that a semi join may broadcast; larger id sets are shuffled.
BROADCAST_IDS = 4_000_000


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for exchanges whose work is not in proportion to their bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def semi_join(df: DataFrame, ids: DataFrame, key: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the one column of ``ids`` (cheap to count).

    Up to ``bound`` ids are broadcast, more are shuffled; the rows are the same.
    """
    ids = ids.toDF(key)
    return df.join(F.broadcast(ids) if ids.count() <= bound else ids, key, "left_semi")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected ``edges`` (src, dst); component is the least node.

    Each round takes the least label among a node and its neighbours, then follows
    that label once (pointer jumping), so long chains shorten by doubling. The
    labels of each round are a table in the shared folder. Nulls and self-loops
    are no edges; with no edges the result is empty.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    both = materialize(edges.union(edges.select("dst", "src")).distinct())
    labels = materialize(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")))
    while True:
        near = (
            both.join(labels, both.dst == labels.node)
            .groupBy("src")
            .agg(F.min("component").alias("m"))
            .select(F.col("src").alias("node"), "m")
        )
        own = labels.select("node", F.col("component").alias("was"))
        low = own.join(near, "node").select("node", "was", F.least("was", "m").alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        step = materialize(low.join(far, "low").select("node", "was", F.least("low", "next").alias("component")))
        labels = step.select("node", "component")
        if step.where("was <> component").isEmpty():
            return labels


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until it clashes with no column (Spark ignores case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, by exact or case-insensitive name; extra ones fall away."""
    return df.select(*[F.col(f"`{n}`") for n in names])
