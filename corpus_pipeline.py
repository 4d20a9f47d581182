"""A corpus pipeline of four stages over `documents`.

Quality rules drop rejected documents; of each group of near duplicates (five-word
shingles, similarity 0.8 or more) one document stays; documents that hold benchmark
items go; the rest is encoded by byte-level BPE, decoded again, and returned as
digests. Each stage gets all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farpairs.llm import bpe, decontaminate, neardup, quality
from farpairs.llm.common import materialize
from farpairs.tables import table

STAGES = [
    ("quality_rules", quality.stage),
    ("near_dedup", neardup.stage),
    ("decontaminate", decontaminate.stage),
    ("bpe_encode", bpe.stage),
]

#: SimHash windows, signatures and merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
