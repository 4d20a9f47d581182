"""Reading the driver tables, and tables of the shared folder that one job reads more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Session setting with the folder of the scope in force, below the shared one.
SCOPE = "farpairs.scope"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share.

    Where that setting is missing in a local session (tests, a laptop), a temporary folder
    is set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="farpairs-")
        spark.conf.set("spark.checkpoint.dir", base)
    scope = spark.conf.get(SCOPE, "")
    return "/".join(x for x in (base.rstrip("/"), scope, f"farpairs-{uuid.uuid4().hex}") if x)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: a lost executor costs a task, not the job."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Tables written inside go when it ends; results have to be consumed before.

    Scopes nest: the inner one's tables go first.
    """
    outer = spark.conf.get(SCOPE, "")
    name = "/".join(x for x in (outer, f"scope-{uuid.uuid4().hex}") if x)
    spark.conf.set(SCOPE, name)
    try:
        yield name
    finally:
        spark.conf.set(SCOPE, outer)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
